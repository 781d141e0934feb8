"""The training-data operators against brute force, on odd rows and on the driver's documents."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import chunk_dedup, components, hilbert_ann, jaccard_join, kneser_ney, langid, mixing, packing, quality_classifier, quality_rules, suffix_dedup, warc
from kmerloom.llm.common import materialize
from kmerloom.llm.queries import tokenizer_path
from kmerloom.llm.spans import merge_spans

# Columns whose names the operators use inside come along.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_no string, spans string, kept_text string, n_shingles string, rank string, mix_epoch string, label string"


def words_of(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = words_of(rng, 120, vocabulary)
    near = base.split()
    near[60] = "changed"
    passage = words_of(rng, 60, vocabulary)
    texts = [base, base, " ".join(near), None, "", "   \n\t ", "one", "one two three four", "One two THREE four", words_of(rng, 20_000, vocabulary), "ü" * 300, "aaaa " * 200, "a" * 3000, "<|endoftext|> ünïcode  two  spaces \n x ", "12345 67890 !!! ???",
             passage + " " + words_of(rng, 50, vocabulary), words_of(rng, 50, vocabulary) + " " + passage, "日本語 テキスト 漢字", "\x00nul \x1f unit\x85next　wide"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s1", "s2"][i % 4]) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x", "x", "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows and null ids."""
    rows = odd_rows()
    return frame(spark, rows[:9] + rows[:3] + [(None, *rows[0][1:]), (None, *rows[3][1:])])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- 1 and 6: Kneser-Ney ------------------------------------------------------------------------


def test_model_is_a_distribution_and_joins_equal_arrays(spark, docs):
    order = 3
    model = materialize(kneser_ney.estimate(kneser_ney.count_grams(docs, order=order), order=order, materialize=materialize), "m")
    arrays = kneser_ney.Arrays(model.toArrow(), order)
    rng = np.random.default_rng(0)
    for context in (b"th", b"\x01a", b"zz", b"\x01\x01"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.int64)
        assert abs(np.exp(arrays.score("en", keys)).sum() - 1) < 1e-9
    keys = np.unique(rng.integers(97, 123, (500, order)) @ (256 ** np.arange(order)[::-1]))
    rows = spark.createDataFrame([("en", int(k)) for k in keys] + [(None, int(keys[0]))], "lang string, key long")
    scores = {(r.lang, r.key): r.score for r in kneser_ney.score_keys(rows, model, order=order).collect()}
    assert len(scores) == len(keys) + 1
    assert np.allclose([scores["en", int(k)] for k in keys], arrays.score("en", keys))
    assert scores[None, int(keys[0])] == kneser_ney.UNIFORM * 1.0 or scores[None, int(keys[0])] < 0


def test_counts_cover_running_text(spark, docs):
    got = {(r.lang, r.key): r.n for r in kneser_ney.count_grams(docs, order=3, room=1000).collect()}
    expect: Counter = Counter()
    for r in docs.collect():
        if words := r.text.encode().split():
            s = b"\x01\x01" + b" ".join(words) + b"\x02"
            expect.update((r.lang, int.from_bytes(s[i : i + 3], "big")) for i in range(len(s) - 2))
    assert got == expect


def test_rules_statistics():
    assert quality_rules.text_statistics("a b\na b\n\n\n c# $x")[:5] == (6, 8, 2, 1, 0)
    five = "a b c d e"
    assert quality_rules.repeated_words(f"{five} x {five}".encode().split()) == 10
    assert quality_rules.repeated_words(b"a a a a a a".split()) == 6
    rng = random.Random(2)
    for _ in range(50):
        w = [rng.choice("ab").encode() for _ in range(rng.randint(0, 40))]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
        assert quality_rules.repeated_words(w) == len(hit)


def test_rules_forms_agree(spark, odd, docs):
    for df in (odd, docs):
        a = {r.doc_id: r for r in quality_rules.quality_rules(df, order=3).collect()}
        b = {r.doc_id: r for r in quality_rules.quality_rules(df, order=3, max_model_bytes=0).collect()}
        assert a.keys() == b.keys() and len(a) == df.count()
        for i, r in a.items():
            assert (r.n_words, r.base_failed, r.kept) == (b[i].n_words, b[i].base_failed, b[i].kept)
            assert r.perplexity is None and b[i].perplexity is None or abs(math.log(r.perplexity) - math.log(b[i].perplexity)) < 1e-5
    assert not a[0].base_failed


def test_rules_edges(odd, empty, repeated):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(odd, order=3).collect()}
    assert rows[3].n_words == rows[4].n_words == rows[5].n_words == 0 and rows[3].base_failed and not rows[3].kept
    assert quality_rules.quality_rules(empty, order=3).count() == 0
    assert quality_rules.quality_rules(repeated, order=3).count() == repeated.count()


def test_classifier(spark, sf, docs, odd, empty, repeated):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.4
    few = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(odd, few).count() == odd.count()
    assert quality_classifier.classify(empty, few).count() == 0
    assert quality_classifier.classify(repeated, few.limit(0)).count() == repeated.count()


# -- 2: mixing ----------------------------------------------------------------------------------


def test_mixture_meets_its_target(spark, docs):
    import math

    sizes = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()}
    total = sum(sizes.values())
    p = [t / total for t in sizes.values()]
    entropy = lambda a: (lambda w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w))([x**a for x in p])
    target = (entropy(0) + entropy(1)) / 2
    shares = spark.createDataFrame([(x,) for x in p], "p double")
    assert abs(entropy(mixing.solve_exponent(shares, 1.0, target, None)) - target) < 1e-6
    a = mixing.solve_exponent(shares, 1.0, None, 1.2)
    assert max(x ** (a - 1) for x in p) / sum(x**a for x in p) <= 1.2 + 1e-9
    out = mixing.mix_sources(docs, budget_tokens=total, target_entropy=target, max_repeats=None, block_tokens=500)
    z = sum(x ** mixing.solve_exponent(shares, 1.0, target, None) for x in p)
    alpha = mixing.solve_exponent(shares, 1.0, target, None)
    longest = docs.agg(F.max(mixing.word_count(F.col("text")))).first()[0]
    for r in out.groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect():
        budget = (sizes[r.source] / total) ** alpha / z * total
        assert budget - longest <= r.t <= budget + 1
    for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("mix_epoch").alias("e"), F.countDistinct("mix_epoch").alias("d")).collect():
        assert r.n == r.d == r.e + 1


def test_mixture_keeps_every_document(docs):
    out = mixing.mix_sources(docs)
    assert out.select("doc_id").distinct().count() == docs.count() and out.agg(F.max("mix_epoch")).first()[0] <= 1


def test_mixture_keeps_columns_of_any_name(docs):
    names = ["_n", "_src", "_ident", "_epochs", "_rest", "_blocks", "_cut", "_t", "c0"]
    df = docs.select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    out = mixing.mix_sources(df)
    assert out.columns[: len(df.columns)] == df.columns and out.select("doc_id", "mix_epoch").distinct().count() == out.count() == mixing.mix_sources(docs).count()
    assert out.filter(" or ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0


def test_mixture_edges(odd, empty, repeated):
    out = mixing.mix_sources(odd)
    assert out.count() > 0 and out.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "mix_epoch"]
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(repeated, budget_tokens=10**6, max_repeats=None).count() > repeated.count()
    assert mixing.mix_sources(odd, budget_tokens=0).filter("mix_tokens > 0").count() == 0


# -- 3: WARC ------------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    long = "WARC/1.1\r\n\r\n" * 200
    extra = spark.createDataFrame([(10**6 + i, u, h) for i, (u, h) in enumerate([("http://a/b", long), (None, long), ("http://x\r\ny", "short"), ("http://z", "short"), ("", None), ("q", ""), ("http://u", "ü" * 600), ("http://u", "ü" * 600)])] + [(None, "n", "n")], "page_id long, url string, html string")
    again = spark.createDataFrame([(10**6, "http://again", long), (10**6, "http://a/b", long), (None, None, None), (None, "n", long), (5, "other", "another payload"), (10**6 + 7, "last", "ü" * 600), (10**6 + 7, "last", "ü" * 600)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    source = pages.unionByName(extra).unionByName(again)
    warc.write_archives(source, path)
    rows = [(r.page_id, r.html or "") for r in source.collect()]
    largest: dict = {}
    for i, body in rows:
        largest[body] = max(largest.get(body, -1), -1 if i is None else i)
    expect: Counter = Counter()
    for body in largest:
        ids = [i for i, other in rows if other == body]
        long_, sha, n = len(body.encode()) >= 1000, hashlib.sha1(body.encode()).hexdigest(), len(body.encode())
        if long_:
            ids.remove(largest[body])
            expect[largest[body], "response", None, sha, n] += 1
        for i in ids:
            expect[i, "revisit" if long_ else "response", largest[body] if long_ else None, sha, n] += 1
    got = [r.response for r in warc.assemble(warc.read_records(spark, path)).filter("request is not null and metadata is not null").collect()]
    assert Counter((r.page_id, r.type, r.refers_to_page, r.payload_sha1 if r.type == "response" else r.digest, r.declared_bytes) for r in got) == expect
    assert all(r.intact and len(r.payload) == r.declared_bytes if r.type == "response" else r.payload == b"" for r in got)
    warc.write_archives(extra.limit(0), path + "0")
    # An archive folder without records has no part that holds any.
    assert warc.assemble(warc.read_records(spark, path + "0")).count() == 0


# -- 4: near duplicates ---------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed=7, groups=6, size=14):
    """Groups of near copies around the threshold, passages that all documents share, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = words_of(rng, 60, vocabulary)
    rows = []
    for g in range(groups):
        base = words_of(rng, rng.choice([6, 9, 30, 100, 250]), vocabulary).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [words_of(rng, rng.randint(5, 60), vocabulary) + " " + shared for _ in range(40)]
    rows += [words_of(rng, rng.randint(1, 9), vocabulary[:3]) for _ in range(40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("light", [2, 8])
def test_near_duplicates(spark, light):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, light=light, tokens_per_part=2000).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_edges(odd, empty, repeated):
    out = jaccard_join.near_duplicates(odd)
    expect = brute_components([(r[0], r[1]) for r in odd_rows()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == expect
    assert jaccard_join.near_duplicates(empty).count() == 0
    again = jaccard_join.near_duplicates(repeated).collect()
    assert len(again) == repeated.count() and {r.component_id for r in again if r.text == odd_rows()[0][1]} == {None}
    assert jaccard_join.keep_first(repeated).count() == len({brute_components([(r[0], r[1]) for r in odd_rows()[:9]])[i][1] for i in range(9)}) + 1


IDS = {
    "negative": ("long", [-1, -2, 5, -(2**63), 0, -7]),
    "huge": ("long", [2**63 - 1, 2**62, 2**61, 2**62 + 1, -(2**62), 3]),
    "text": ("string", ["b", "a", "ä", "", "10", "9"]),
    "fractions": ("double", [0.5, -0.5, 1e300, 2.0, -1e300, 0.0]),
}


@pytest.mark.parametrize("kind", IDS)
def test_ids_of_any_kind(spark, kind):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = words_of(rng, 60, vocabulary)
    texts = [base, base.replace(base.split()[30], "other", 1), base, words_of(rng, 60, vocabulary), "zz " + base, None]
    type_, ids = IDS[kind]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rows, f"doc_id {type_}, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) < 6
    assert {r.doc_id for r in jaccard_join.keep_first(df).collect()} == {c for _, c in got.values()}
    for operator, brute in ((chunk_dedup.dedup_chunks, brute_chunks), (suffix_dedup.dedup_substrings, brute_substrings)):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in operator(df).collect()}
        assert found == brute(sorted(rows, key=lambda r: r[0].encode() if type_ == "string" else r[0]))


def test_one_id_on_many_rows(spark):
    rows = [(None if i % 2 else 7, "a b c d e f g " * 20 + str(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.near_duplicates(df).collect()
    assert len(out) == 30 and {r.component_id for r in out} == {None}
    assert suffix_dedup.dedup_substrings(df).filter("n_removed = 0").count() == 0  # each repeats within itself
    assert chunk_dedup.dedup_chunks(df).count() == 30


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_shingles_of_many_texts(monkeypatch, chunk):
    """Texts hashed together have the sets that each has alone, wherever the running sum is cut."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = random.Random(2)
    vocabulary = ["a", "aa", "ab", "ba", "B", "\u00e4", "\u00c4", "\u0130", "x" * 40, "\x00", "\x1f", "\u00a0", "\u2003z"]
    texts = [None, "", " \t", "one", "One  two\nthree\x0bfour", "\ud800 a b c d e"]
    texts += ["".join(rng.choice(vocabulary) + rng.choice(" \t\n\r\x0b\x0c") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    tokens = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    want = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in tokens]
    found = jaccard_join.Shingles(5).of(texts)
    assert [len(x) for x in found] == [len(x) for x in want]
    assert all((np.diff(x.astype(object)) > 0).all() for x in found)
    for x, y, t in zip(found, want, texts):
        assert (jaccard_join.Shingles(5)(t) == x).all()
        for i in range(0, len(texts), 20):
            assert len(np.intersect1d(x, found[i])) == len(y & want[i])
    words = sorted({w for t in tokens for w in t})
    _, hashes = jaccard_join.word_hashes(b" ".join(words))
    assert len(set(hashes.tolist())) == len(words) == len(hashes)


def test_allocation_finds_all_partners():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(3, 200))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        change = int(rng.integers(0, max(1, n // 7) + 1))
        y = np.unique(np.concatenate([x[change:], rng.integers(0, 2**63, change).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 4 * common >= 3 * (len(x) + len(y) - common):
            for step in (1, 2):
                (a, da), (b, db) = ([np.concatenate(c) for c in zip(*jaccard_join.entries(s, step))] for s in (x, y))
                assert len(np.intersect1d(a[~da], b)) or len(np.intersect1d(a, b[~db]))
        diff = jaccard_join.bitmap_difference(jaccard_join.parity_bitmap(x), jaccard_join.parity_bitmap(y))
        assert diff <= len(x) + len(y) - 2 * common


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 150)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in least if any(x in e and e[0] != e[1] for e in edges)}


# -- 5: language -----------------------------------------------------------------------------------


def test_language_accuracy(spark, docs):
    out = langid.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_phrases_against_a_plain_parse():
    rng = random.Random(4)
    sample = np.array([rng.randrange(3) for _ in range(200)])
    table = langid.Automaton(sample, 5)
    text = "".join(map(str, sample))
    known = {text[i:j] for i in range(200) for j in range(i + 1, 201)}
    rows = sorted(([rng.randrange(5) for _ in range(rng.randint(1, 60))] for _ in range(40)), key=len, reverse=True)
    lanes = np.zeros((40, 60), np.int32)
    for i, r in enumerate(rows):
        lanes[i, : len(r)] = r
    got = langid.count_phrases(lanes, np.array([len(r) for r in rows]), table)
    for r, n in zip(rows, got):
        s, count, at = "".join(map(str, r)), 0, 0
        while at < len(s):
            end = at + 1
            while end <= len(s) and s[at:end] in known:
                end += 1
            at, count = max(end - 1, at + 1), count + 1
        assert n == count


def test_prediction_against_a_plain_cross_parse(spark):
    """Whole results: samples of this size are taken whole, and texts are shorter than a segment."""
    rng = random.Random(11)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)] for lang, letters in {"aa": "abcdef", "bb": "defghi", "cjk": [chr(0x4E00 + i) for i in range(700)], "wide": "abc𐐀𐐁𐐂"}.items()}
    rows = [(i, words_of(rng, rng.randint(3, 40), vocabulary[lang]), lang) for i, lang in enumerate(sorted(vocabulary) * 40)]
    rows += [(1000 + i, words_of(rng, 12, vocabulary["aa"] + vocabulary["bb"]) + " Zz!9", None) for i in range(40)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.learn_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=1000).collect()}

    def plain(text):
        return "".join(c if c.isalpha() else " " for c in text.lower())

    def symbols(text):
        out = ""
        for c in plain(text):
            if c != " " or out[-1:] != " ":
                out += c
        return out

    samples: dict = {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            samples.setdefault(lang, []).append(text)
    # Any order of a sample's texts has the same substrings within texts, so phrases across them are kept out.
    lengths = {lang: len(symbols("\n".join(t))) for lang, t in samples.items()}
    samples = {lang: "\x00".join(symbols("\n" + t + "\n") for t in texts) for lang, texts in samples.items()}
    agree = 0
    for i, text, _ in rows:
        costs = []
        for lang in sorted(samples):
            s, at, phrases = symbols(text), 0, 0
            while at < len(s):
                end = at + 1
                while end <= len(s) and s[at:end] in samples[lang]:
                    end += 1
                at, phrases = max(end - 1, at + 1), phrases + 1
            costs.append((phrases * math.log2(lengths[lang]) / max(len(s), 1), lang))
        costs.sort()
        agree += got[i][0] == costs[0][1] and abs(got[i][1] - min(max(1 - costs[0][0] / costs[1][0], 0), 1)) < 0.05
    assert agree >= 0.97 * len(rows)


def test_language_edges(spark, odd, empty, repeated):
    rows = {r.doc_id: r for r in langid.learn_and_identify(odd).collect()}
    for i in (3, 4, 5, 14):
        assert rows[i].lang_pred == "und" and rows[i].score == 0
    assert rows[9].lang_pred in ("en", "de")
    assert langid.learn_and_identify(empty).count() == 0
    assert langid.learn_and_identify(repeated).count() == repeated.count()
    nothing = langid.learn_and_identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    kept = langid.keep_identified(odd, langid.learn(odd))
    assert kept.columns == odd.columns and kept.filter("doc_id in (3, 4, 5, 14)").count() == 0


# -- 7 and 8: substrings ------------------------------------------------------------------------------


def cut(raw, spans):
    spans, out, at = merge_spans(spans, len(raw)), b"", 0
    for a, b in spans:
        out, at = out + raw[at:a], b
    rest = out + raw[at:]
    return len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()


def brute_chunks(rows):
    seen, out = set(), {}
    for i, t in rows:
        raw, spans = (t or "").encode(), []
        ends = chunk_dedup.chunk_ends(np.frombuffer(raw, np.uint8), 48, 1024).tolist()
        for a, b in zip([0, *ends], ends):
            spans += [(a, b)] if raw[a:b] in seen else []
            seen.add(raw[a:b])
        edges = Counter(x for span in spans for x in span)
        out[i] = cut(raw, [(a, b) for a, b in spans if b - a >= 65 or b - a == len(raw) or edges[a] + edges[b] > 2])
    return out


def brute_substrings(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        raw, spans = (t or "").encode(), []
        for p in range(len(raw) - n + 1):
            g = raw[p : p + n]
            spans += [(p, p + n)] if g in seen else []
            seen.add(g)
        out[i] = cut(raw, spans)
    return out


@pytest.mark.parametrize("operator,brute", [(chunk_dedup.dedup_chunks, brute_chunks), (suffix_dedup.dedup_substrings, brute_substrings)])
def test_substrings(spark, docs, odd, empty, repeated, operator, brute):
    shown = lambda df: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in operator(df).collect()}
    assert shown(odd) == brute([(r[0], r[1]) for r in odd_rows()])
    sample = docs.filter("doc_id < 120")
    assert shown(sample) == brute([(r.doc_id, r.text) for r in sample.orderBy("doc_id").collect()])
    assert operator(empty).count() == 0
    again = operator(repeated)
    assert again.count() == repeated.count() and again.filter("doc_id = 0 and n_removed = 0").count() <= 1
    assert "label" in again.columns


def test_chunk_ends_resist_insertions():
    rng = random.Random(5)
    raw = bytes(rng.randrange(97, 123) for _ in range(20_000))
    ends = set(chunk_dedup.chunk_ends(np.frombuffer(raw, np.uint8), 32, 1024).tolist())
    moved = set(chunk_dedup.chunk_ends(np.frombuffer(raw[:5000] + b"xyz" + raw[5000:], np.uint8), 32, 1024).tolist())
    assert len(ends) > 100 and {e for e in ends if e < 4900} <= moved and {e + 3 for e in ends if e > 5100} <= moved
    assert chunk_dedup.chunk_ends(np.zeros(5000, np.uint8), 32, 1024).tolist()[-1] == 5000


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    body = "".join(rng.choice("abc") for _ in range(400))
    rows = [(0, body + "x" * 150 + body), (1, body[50:300])]
    monkeypatch.setattr(suffix_dedup, "POSITION_BITS", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(df).collect()}
    assert got == brute_substrings(rows)


# -- 9: packing ------------------------------------------------------------------------------------------


def fewest_bins(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in sorted(set(bins), reverse=True):
            if j >= items[i]:
                rest = list(bins)
                rest.remove(j)
                place(i + 1, [*rest, j - items[i]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best


def test_dominance_loses_nothing():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        left = dict(Counter(items))
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for n, _ in fixed) + fewest_bins(rest, capacity) == fewest_bins(items, capacity), items


def test_solver_uses_every_piece_once():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(rng.randint(1, 20))}
        used: dict = {}
        bins = 0
        for times, items in packing.solve(counts, 60):
            assert times > 0 and sum(items) <= 60
            bins += times
            for s in items:
                used[s] = used.get(s, 0) + times
        assert used == counts
        assert bins <= 11 / 9 * (sum(s * n for s, n in counts.items()) / 60 + 1) + 30 * max(s > 30 for s in counts) * 20


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    encode = packing.Encoder(tokenizer_path(), room=10)
    assert encode.encode is not None
    rng = random.Random(9)
    texts = [r[1] or "" for r in odd_rows()] + ["".join(rng.choice(" \n\t　\x85ab1'é,.") for _ in range(30)) for _ in range(500)] + ["a\n b", "a \n b", " a", "a ", "\n \nx", "don't we'll 's", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, docs, odd, empty, repeated):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    for df, group_rows in ((docs, 3), (odd, 250_000), (repeated, 1)):
        rows = packing.pack(df, tokenizer_path=tokenizer_path(), group_rows=group_rows).collect()
        expect: Counter = Counter()
        for r in df.collect():
            ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
            first = (len(ids) - 1) % 1024 + 1
            for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
                part = ids[start : start + 1024] if piece else ids[:first]
                expect[r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
        sequences: dict = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= sum(r.length for r in rows) / 1024 * 1.05 + 2
    assert packing.pack(empty, tokenizer_path=tokenizer_path()).count() == 0


# -- 10: neighbours ----------------------------------------------------------------------------------------


def test_hilbert_curve_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_neighbours(ids, x, k, modulus):
    out = {}
    for i in np.flatnonzero(ids % modulus == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if np.isfinite(s[j])]
    return out


def test_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    truth = brute_neighbours(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows]), 20, 20)
    got: dict = {}
    for r in hilbert_ann.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == truth.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in t}) / len(t) for q, t in truth.items()]) >= 0.9
    for q, found in got.items():
        assert len(found) == len(truth[q]) and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0], 0) for i in range(60)] + [(100, [2.0, 1.0], 0), (101, None, 0), (102, [0.0, 0.0], 0), (103, [nan, 1.0], 0), (104, [1.0], 0), (None, [1.0, 1.0], 0), (120, [float("inf"), 1.0], 0), (140, [None, 1.0], 0), (100, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    for r in hilbert_ann.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [*range(1, 21)], 20: [i for i in range(21) if i != 20], 40: [*range(20)], 100: [*range(20)]}
    assert hilbert_ann.nearest_neighbours(df.limit(0)).count() == 0
    two = hilbert_ann.nearest_neighbours(df.filter("vec_id in (0, 100)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(two)] == [(0, 1, 100), (100, 1, 0)]


# -- the pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, sf), "stage")
        kept.append(now)
    assert all(d.schema == docs.schema for d in kept[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] <= {r.doc_id for r in docs.select("doc_id").collect()}
    rows = kept[0].orderBy("doc_id").collect()
    expect = {c for _, c in brute_components([(r.doc_id, r.text) for r in rows]).values()}
    assert ids[1] == expect and ids[4] == ids[3] == ids[2] == ids[1]
    before = [(r.doc_id, r.text) for r in kept[1].orderBy("doc_id").collect()]
    hashes = {i: h for i, (_, _, _, h) in brute_substrings(before).items()}
    for r in kept[2].collect():
        assert r.n_chars == len(r.text) and ("�" in r.text or hashes[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest() or not r.text.isascii())


@pytest.mark.parametrize("rows", ["odd", "repeated", "empty"])
def test_pipeline_stages_on_odd_rows(spark, sf, rows, request):
    import corpus_pipeline

    df = request.getfixturevalue(rows)
    own = [(r.doc_id, r.text) for r in df.collect()]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, df, sf)
        if name != "best-fit packing":
            assert out[name].columns == df.columns
    assert {(r.doc_id, r.text) for r in out["language ID"].collect()} <= {(i, t) for i, t in own if t and any(map(str.isalpha, t))}
    kept = out["n-gram Jaccard join"].collect()
    assert {r.text for r in kept if not (r.text or "").split()} == {t for _, t in own if not (t or "").split()} and len({r.text for r in kept}) >= min(1, len(own))
    assert sorted(map(str, (r.doc_id for r in out["suffix-array dedup"].collect()))) == sorted(str(i) for i, _ in own)
    assert {(r.doc_id, r.text) for r in out["mixing sources to target weights"].collect()} == set(own)
    assert {r.doc_id for r in out["best-fit packing"].collect()} == {i for i, _ in own}


@pytest.mark.parametrize("operator", [jaccard_join.near_duplicates, jaccard_join.keep_first, chunk_dedup.dedup_chunks, suffix_dedup.dedup_substrings])
def test_numbering_keeps_columns_of_any_name(spark, operator):
    """Ids that must be numbered, beside columns named as helpers are."""
    rows = [(-1, "a b c d e f", "p0", "i0", "c0", "f0", "b0", "x0"), (5, None, "p1", "i1", "c1", "f1", "b1", "x1"), (5, "g h", "p2", "i2", "c2", "f2", "b2", "x2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _p string, _i string, _c string, _first string, _before string, c0 string")
    out = operator(df)
    assert sorted(tuple(r)[2:8] for r in out.select(*df.columns).collect()) == sorted(r[2:] for r in rows)


def test_classifier_takes_ids_of_any_type(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(40)]
    rows = [(i, words_of(rng, 40, vocabulary), "en") for i in range(60)] + [(60, "zzzz qqqq xxxx wwww " * 9, "en"), (61, None, None)]
    labels = [(i, 1) for i in range(0, 50)]
    shown = lambda ids, cast: {str(r.doc_id): (r.trusted, r.kept) for r in quality_classifier.classify(
        spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(cast)), spark.createDataFrame(labels, "doc_id long, quality int").withColumn("doc_id", F.col("doc_id").cast(cast))).collect()}
    as_text = shown(rows, "string")
    assert as_text == shown(rows, "long") and len(as_text) == 62 and as_text["60"] == (False, False)
