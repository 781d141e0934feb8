"""Importance resampling, the filter audit and SimHash against brute force, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kmerloom.llm import filter_audit, importance, queries, simhash

# Names that the operators use inside come along.
DOCS = "doc_id long, text string, source string, mask string, print string, part string, rank string, n_words string, edge string, _p string, _i string"


def odd_rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghÄé9#") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = some(300)
    near = base.split()
    near[7] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t", "one", "ONE", "one two three four", "one  two\nthree four", some(20_000), "ü" * 300, "aaaa " * 300, "x" * 200_000, "A" * 50 + " b" * 250, some(250) + " $", "日本語 テキスト",
             "\x00nul \x1f unit\x85next　wide", base, *[some(30) for _ in range(40)], *[base[:-5] + " " + some(2) for _ in range(25)]]
    return [(i, t, [None, "s1", "s1", ""][i % 4]) for i, t in enumerate(texts)]


def repeated_rows():
    rows = odd_rows()
    return rows[:12] + rows[:5] * 3 + [(None, r[1], r[2]) for r in rows[:6]] * 2


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], DOCS)


@pytest.fixture(scope="module", params=["odd", "repeated", "empty"])
def rows(request):
    return {"odd": odd_rows, "repeated": repeated_rows, "empty": list}[request.param]()


# -- importance -----------------------------------------------------------------------------------


def brute_importance(rows, target, n, buckets, min_words, percent):
    def words(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(grams(text))
    for text in target:
        t.update(grams(text))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for i, text, _ in rows:
        g = [gain(b) for b in grams(text)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(g) / len(g)) if g else 0
        out.append((i, len(words(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = able[: percent * len(able) // 100]
    return out, ranks


@pytest.mark.parametrize(("n", "min_words", "percent"), [(1, 20, 10), (3, 0, 50), (2, 1, 100)])
def test_importance_equals_brute_force(spark, rows, n, min_words, percent):
    target = ["one two three", None, "", "ü Ä9 changed aaaa aaaa"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.importance(frame(spark, rows), table, n=n, buckets=1000, min_words=min_words, percent=percent).collect()
    want, ranks = brute_importance(rows, target, n, 1000, min_words, percent)
    plain = lambda xs: Counter(tuple(x) for x in xs)
    assert plain((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == plain(want)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(ranks) + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(r[0], r[4]) for r in ranks]


def test_importance_draws_rows_of_the_table(spark):
    docs = frame(spark, odd_rows())
    out = importance.resample(docs, docs.limit(0), min_words=1, percent=50)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_crcs_of_runs_are_those_of_their_text():
    texts = ["a bb ccc " + "d" * 5000 + " eé 日本 0", "", "z" * 70, "one"]
    words, found = importance.features([t.encode() for t in texts], 4)
    assert words.tolist() == [7, 0, 1, 1]
    for k, (of, crcs) in enumerate(found, 1):
        split = [t.split() for t in texts]
        want = [(d, zlib.crc32(" ".join(w[i : i + k]).encode())) for d, w in enumerate(split) for i in range(len(w) - k + 1)]
        assert list(zip(of.tolist(), crcs.tolist())) == want
    rng = np.random.default_rng(0)
    for size in (1, 7, 1000, 123_456):
        a, b = rng.bytes(9), rng.bytes(size)
        x = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([size]))[0] ^ zlib.crc32(b)
        assert x == zlib.crc32(a + b)


# -- the audit --------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 2 * len(body), "D": bool(re.search(r"[#$%&*|]", body)), "E": i is not None and least[body] < i}
        docs.append((source or "", i, {k for k, v in fails.items() if v}))
    out = {}
    for part in {d[0] for d in docs}:
        own, removed = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[2]]
                redundant = sum(f in d[2] for d in gone)
                left, gone = [d for d in left if f not in d[2]], gone + hit
                removed[f] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), redundant, sum(d[2] == {f} for d in own), sum(d[1] in good for d in hit), sum(d[1] in toxic for d in hit), f]
        for (p, *_), row in out.items():
            if p == part:
                row[6] = removed[row[6]]
    return out


@pytest.mark.parametrize("ranges", [4, 40])
def test_audit_equals_brute_force(spark, rows, ranges):
    """With many ranges, runs of copies go on over several tasks."""
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (4, 1, 0), (4, 0, 0), (None, 1, 1), (7, None, 1), (12, 1, None), (18, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.audit(frame(spark, rows), table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


# -- SimHash ------------------------------------------------------------------------------------------


def brute_print(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[root(j)] = root(i)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("limit", [2048, 2])
def test_simhash_equals_brute_force(spark, rows, limit):
    """With a low limit, buckets are cut again and rows meet in pieces."""
    got = simhash.near_duplicates(frame(spark, rows), limit=limit).collect()
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints, 4)
    least = {}
    for (i, *_), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((r[0], f"{p:016x}", least.get(x)) for r, p, x in zip(rows, prints, roots))


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_sliced_forest_connects_as_all_pairs_do(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 200):
        prints = rng.integers(0, 2**64, max(1, n // 5), dtype=np.uint64)[rng.integers(0, max(1, n // 5), n)]
        for _ in range(3):
            prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        group = np.sort(rng.integers(0, 3, n))
        a, b = simhash.forest(prints, group, radius)
        assert all(group[x] == group[y] and int(prints[x] ^ prints[y]).bit_count() <= radius for x, y in zip(a, b))
        tag = [int(p) | 255 << 64 + 8 * int(g) for p, g in zip(prints, group)]  # groups are far apart
        got = brute_components_of(n, zip(a.tolist(), b.tolist()))
        want = brute_components(tag, radius)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def brute_components_of(n, pairs):
    label = list(range(n))
    for x, y in pairs:
        a, b = label[x], label[y]
        label = [a if v == b else v for v in label]
    return label


def test_simhash_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints, 4)
    least = {}
    for (i, _), root in zip(rows, roots):
        least[root] = min(i, least.get(root, i))
    got = {(r["doc_id"], r["component_id"]) for r in queries.op13_simhash_duplicates(spark, sf).collect()}
    assert got == {(i, least[root]) for (i, _), root in zip(rows, roots)}
    assert any(i != c for i, c in got)
