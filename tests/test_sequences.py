"""Scalar functions, extension sets and k-mer tables: properties and hand-checked values."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import exts as E
from kmerloom.functions import seq as S
from kmerloom.operators import kmers as K
from kmerloom.operators import msp as M
from kmerloom.sources import dna

SEQS = "seq_id long, seq string, exts int, label string"
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


def dna_of(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def strands(spark):
    rng = random.Random(3)
    rows = [(dna_of(rng, n), dna_of(rng, n)) for n in [1, 2, 4, 5, 12, 16, 20, 31, 31, 31] for _ in range(20)]
    return spark.createDataFrame(rows, "a string, b string")


def test_sequence_functions(strands):
    rows = strands.select(
        "a", "b", S.rc("a").alias("rc"), S.canonical("a").alias("canon"), S.is_flipped("a").alias("flip"), S.rank("a").alias("rank"), S.hamming("a", "b").alias("ham"),
        S.hamming_packed(S.rank("a"), S.rank("b")).alias("hamp"), S.gc_count("a").alias("gc"), S.at_count("a").alias("at"), S.is_palindrome("a").alias("pal"), S.codes("a").alias("codes"),
        S.from_codes(S.codes("a")).alias("back"), S.kmers("a", 4).alias("kmers"), S.hamming1("a").alias("near"), S.set_base("a", 0, F.lit("T")).alias("set0"), dna.from_packed(dna.to_packed("a"), F.length("a")).alias("packed"),
    ).collect()
    for r in rows:
        a, b = r.a, r.b
        assert r.rc == rc(a) and r.canon == min(a, rc(a)) and r.flip == (a >= rc(a))
        assert r.rank == int(a.translate(str.maketrans("ACGT", "0123")), 4)
        assert r.ham == r.hamp == sum(x != y for x, y in zip(a, b))
        assert r.gc + r["at"] == len(a) and r.gc == a.count("G") + a.count("C")
        assert r.pal == (a == rc(a))
        assert r.codes == ["ACGT".index(x) for x in a] and r.back == a and r.packed == a
        assert r.kmers == [a[i : i + 4] for i in range(len(a) - 3)]
        assert len(set(r.near)) == 3 * len(a) and all(sum(x != y for x, y in zip(a, n)) == 1 for n in r.near)
        assert r.set0 == "T" + a[1:]


def test_base_codes(spark):
    r = spark.range(1).select(*[S.code_to_base(F.lit(i)) for i in range(5)], S.base_to_code(F.lit("n")), S.strict_base_to_code(F.lit("n")), S.base_to_code(F.lit("t")), S.complement_code(F.lit(1))).first()
    assert list(r) == ["A", "C", "G", "T", "X", 0, None, 3, 2]


def test_extension_sets(spark):
    def bits(e, right):
        return {b for i, b in enumerate("ACGT") if e >> (i + 4 * right) & 1}

    rows = spark.range(256).select(F.col("id").cast("int").alias("e")).select(
        "e", E.complement("e").alias("c"), E.reverse("e").alias("r"), E.rc("e").alias("rc"), E.get("e", False).alias("l"), E.get("e", True).alias("g"),
        E.count("e", True).alias("n"), E.unique("e", False).alias("u"), E.text("e").alias("t"), E.has_ext("e", F.lit("G"), True).alias("h"),
    ).collect()
    swap = {"A": "T", "T": "A", "C": "G", "G": "C"}
    for x in rows:
        left, right = bits(x.e, 0), bits(x.e, 1)
        assert bits(x.c, 0) == {swap[b] for b in left} and bits(x.c, 1) == {swap[b] for b in right}
        assert bits(x.r, 0) == right and bits(x.r, 1) == left
        assert bits(x.rc, 0) == {swap[b] for b in right}
        assert x.l == sorted(left) and x.g == sorted(right) and x.n == len(right) and x.h == ("G" in right)
        assert x.u == (min(left) if len(left) == 1 else None) and x.t == "".join(sorted(left)) + "|" + "".join(sorted(right))
    assert [(r.c, r.r, r.rc) for r in rows if r.e == 131] == [(28, 56, 193)]


def test_hand_checked_counts(spark):
    one = spark.createDataFrame([(1, "ACGTA", 0, "x")], SEQS)
    assert [(r.kmer, r.exts) for r in K.kmers_with_exts(one, 3).collect()] == [("ACG", 128), ("CGT", 17), ("GTA", 2)]
    outer = one.withColumn("exts", F.lit(0x81))
    assert [(r.kmer, r.exts) for r in K.kmers_with_exts(outer, 3).collect()] == [("ACG", 129), ("CGT", 17), ("GTA", 130)]
    assert {(r.kmer, r.n, r.exts) for r in K.filter_kmers(one, 3, K.count_filter(1)).collect()} == {("ACG", 2, 136), ("GTA", 1, 2)}
    pal = spark.createDataFrame([(1, "TACGTT", 0, "x")], SEQS)
    assert {(r.kmer, r.n, r.exts) for r in K.filter_kmers(pal, 4, K.count_filter(1)).collect()} == {("AACG", 1, 128), ("ACGT", 1, 17), ("CGTA", 1, 1)}


def test_short_and_empty_sequences(spark):
    short = spark.createDataFrame([(1, "", 0, "x"), (2, "AC", 0, "x"), (3, None, 0, None)], SEQS)
    assert K.filter_kmers(short, 3, K.count_filter(1)).count() == 0
    assert K.kmer_total(short, 3).first().total == 0
    assert M.segments(short, 3, 2).count() == 0


def test_minimizer_segments(spark):
    expect = {
        "GATTACAGGCATTACG": [(0, 8, "TT", 2, 0, 64), (3, 7, "AC", 4, 1, 24), (5, 7, "AG", 6, 2, 129), (7, 9, "TT", 11, 0, 1)],
        "AAAAAAAAAA": [(0, 10, "AA", 4, 0, 0)],
        "ACACGTGTTGCA": [(0, 8, "GT", 4, 1, 128), (3, 9, "TT", 7, 0, 1)],
    }
    df = spark.createDataFrame([(i, s, 0, "x") for i, s in enumerate(expect)], SEQS)
    got = {}
    for r in M.msp_sequence(df, 6, 2, rc=True).orderBy("seq_id", "seg_no").collect():
        got.setdefault(r.seq_id, []).append((r.start, r.len, r.minimizer, r.minimizer_pos, r.bucket, r.exts))
    assert list(got.values()) == list(expect.values())


@pytest.mark.parametrize("k,p", [(16, 5), (31, 8), (50, 12)])
def test_minimizer_invariants(k, p):
    import numpy as np

    rng = random.Random(k)
    for n in [k, k + 1, 3 * k, 300]:
        for s in [dna_of(rng, n), "A" * n]:
            ranks, mirrored = M.pmer_ranks(s, p)
            for scores in (ranks, np.minimum(ranks, mirrored), np.array([s[i : i + p].count("A") + s[i : i + p].count("T") for i in range(n - p + 1)])):
                runs = M.minimizer_runs(scores, k - p + 1)
                ends = [r[0] for r in runs[1:]] + [n - k + 1]
                assert runs[0][0] == 0
                for (start, at), end in zip(runs, ends):
                    assert start < end and end - start <= k - p + 1
                    for i in range(start, end):
                        window = scores[i : i + k - p + 1]
                        assert i <= at <= i + k - p and scores[at] == window.min()


def walked(scores, window):
    """The rule of segments, one p-mer at a time."""
    fresh = lambda start: max(range(start, start + window), key=lambda i: (-scores[i], i))
    runs = [(0, fresh(0))]
    for kmer in range(1, len(scores) - window + 1):
        at = runs[-1][1]
        if scores[kmer + window - 1] < scores[at]:
            runs.append((kmer, kmer + window - 1))
        elif at < kmer:
            runs.append((kmer, fresh(kmer)))
    return runs


@pytest.mark.parametrize("piece", [7, 23, 1000])
def test_segments_of_sequences_in_pieces(spark, monkeypatch, piece):
    """Tasks that walk along parts of a sequence arrive at what one walk does, also where walks never meet."""
    import numpy as np

    k, p = 11, 4
    monkeypatch.setattr(M, "PIECE", max(piece, k - p + 1))
    rng = random.Random(piece)
    seqs = [dna_of(rng, 300), "A" * 200, "ACGT" * 40, dna_of(rng, 60) + "T" * 90, dna_of(rng, k), dna_of(rng, k - 1), "ACAC" * 9 + dna_of(rng, 40)]
    df = spark.createDataFrame([(i, s, 17, f"l{i}") for i, s in enumerate(seqs)], SEQS)
    got = {}
    for r in M.segments(df, k, p, score=M.permutation_score(rc=True), keep=("label",), outer=True).orderBy("seq_id", "seg_no").collect():
        got.setdefault(r.seq_id, []).append((r.seg_no, r.start, r.len, r.minimizer, r.minimizer_pos, r.seq, r.exts, r.label))
    bit = lambda c, side: 1 << "ACGT".index(c) + side
    for i, s in enumerate(seqs):
        if len(s) < k:
            assert i not in got
            continue
        ranks, mirrored = M.pmer_ranks(s, p)
        runs = walked(np.minimum(ranks, mirrored).tolist(), k - p + 1)
        assert M.minimizer_runs(np.minimum(ranks, mirrored), k - p + 1) == runs
        ends = [start + k - 1 for start, _ in runs[1:]] + [len(s)]
        want = [(n, a, b - a, s[at : at + p], at, s[a:b], (bit(s[a - 1], 0) if a else 1) | (bit(s[b], 4) if b < len(s) else 16), f"l{i}") for n, ((a, at), b) in enumerate(zip(runs, ends))]
        assert got[i] == want


@pytest.mark.parametrize("p", [3, 8])
def test_hashed_order_is_one_of_all_pmers(p):
    import numpy as np

    ranks = np.arange(4**p)
    assert sorted(M.hashed_score(p)(ranks, ranks).tolist()) == ranks.tolist()


def test_simple_scan(spark):
    df = spark.createDataFrame([(1, "GATTACAGGCATTACG", 0, "x")], SEQS)
    rows = M.simple_scan(df, 6, 2, list(range(16))).orderBy("start").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 8), (1, 1, 3, 7), (1, 2, 5, 7), (1, 0, 7, 9)]
    with pytest.raises(ValueError):
        M.simple_scan(df, 6, 2, [0, 1])


def test_segments_keep_all_kmers(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, dna_of(rng, 150), 0, "x") for i in range(10)], SEQS)
    pieces = M.msp_sequence(df, 21, 6, rc=True)
    whole = {tuple(r) for r in K.filter_kmers(df, 21, K.count_filter(1)).select("kmer", "exts", "n").collect()}
    assert {tuple(r) for r in K.filter_kmers(pieces, 21, K.count_filter(1)).select("kmer", "exts", "n").collect()} == whole
    spread = pieces.select("bucket", F.explode(F.transform(S.kmers("seq", 21), S.canonical)).alias("kmer")).distinct()
    assert spread.count() == spread.select("kmer").distinct().count()  # a k-mer has one bucket


def test_stream_counts(spark, tmp_path):
    from kmerloom.streaming.counts import stream_kmers

    rows = spark.createDataFrame([(1, "ACGTACGTTTGACA", 0, "x")], SEQS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SEQS).parquet(str(tmp_path / "in"))
    q = stream_kmers(stream, 5).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counts").select("kmer", "exts", "n").collect()}
    assert got == {tuple(r) for r in K.filter_kmers(rows, 5, K.count_filter(1)).select("kmer", "exts", "n").collect()}
