"""Random access, summaries by functions and ordered reductions against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import compact, coordinates, function_summaries, graph, kmers, local_repair, tables
from kmerloom.operators.tables import Temporary, written

SEQS = "seq_id long, seq string, exts int, label string"
SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(SWAP)[::-1]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture
def seqs():
    rng = random.Random(6)
    return [dna(rng, n) for n in (0, 3, 70, 1, 500, 2, 40, 9)] + [None, dna(rng, 25)]


def test_slices_cross_borders(spark, monkeypatch, seqs):
    monkeypatch.setattr(coordinates, "BLOCK", 16)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")
    line, rng = "".join(s or "" for s in seqs), random.Random(1)
    asked = [(i, a, a + rng.randrange(90)) for i, a in enumerate(rng.randrange(-5, len(line) + 9) for _ in range(80))]
    found = coordinates.index(df)
    assert found.total == len(line)
    got = {r.query: r.seq for r in coordinates.slices(found, spark.createDataFrame(asked, "query long, start long, end long")).collect()}
    want = {i: line[max(a, 0) : max(b, 0)] for i, a, b in asked}
    assert got == {i: s for i, s in want.items() if s}
    own = [(i, rng.randrange(len(seqs)), a, a + 7) for i, a in enumerate(range(-3, 60))]
    got = {r.query: r.seq for r in coordinates.sequence_slices(found, spark.createDataFrame(own, "query long, id long, start long, end long")).collect()}
    want = {q: (seqs[i] or "")[max(a, 0) : max(b, 0)] for q, i, a, b in own}
    assert got == {q: s for q, s in want.items() if s}
    with pytest.raises(ValueError):
        coordinates.slices(coordinates.index(df, k=3), spark.range(1))


def test_kmers_by_number(spark, monkeypatch, seqs):
    monkeypatch.setattr(coordinates, "BLOCK", 16)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")
    every = [s[i : i + 5] for s in seqs if s for i in range(len(s) - 4)]
    found = coordinates.index(df, k=5)
    asked = spark.range(-2, len(every) + 3).select(F.col("id").alias("query"), F.col("id").alias("n"))
    assert {r.query: r.kmer for r in coordinates.kmers_at(found, asked).collect()} == dict(enumerate(every))
    assert coordinates.index(df.limit(0), k=5).total == 0


def test_summaries_by_functions(spark, monkeypatch):
    """Labels with their counts; the states of few k-mers are held at a time."""
    monkeypatch.setattr(function_summaries, "STATES", 20)
    rng = random.Random(3)
    rows = [(i, dna(rng, 60) if i % 3 else "ACGTTGCAAC" * 5, 33, rng.choice(["x", "y", None])) for i in range(30)] + [(90, "", 0, "x"), (91, None, 0, "x")]
    summarizer = function_summaries.FunctionSummarizer(
        lambda: [0, 0], lambda s, exts, label: [s[0] + (label == "x"), s[1] + exts.bit_count()], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s, n: (s[0] > 0, f"{s[0]}/{s[1]}/{n}"), "array<long>", "string")
    df = spark.createDataFrame(rows, SEQS)
    got = {r.kmer: (r.exts, r.n, r.data) for r in function_summaries.filter_kmers(df, 7, summarizer).collect()}
    xs, bits, n, exts = Counter(), Counter(), Counter(), Counter()
    for r in kmers.kmers_with_exts(df, 7, canonical=True).collect():
        xs[r.kmer] += r.label == "x"
        bits[r.kmer] += r.exts.bit_count()
        n[r.kmer] += 1
        exts[r.kmer] |= r.exts
    assert got == {m: (exts[m], n[m], f"{xs[m]}/{bits[m]}/{n[m]}") for m in n if xs[m]}


@pytest.mark.parametrize("pieces", [4096, 3])
def test_ordered_reduction(spark, monkeypatch, pieces):
    """Data are joined in path order, and turned where a path walks an element backwards."""
    monkeypatch.setattr(compact, "PIECES", pieces)
    rng = random.Random(7)
    parts = [dna(rng, 30) for _ in range(3)]
    df = spark.createDataFrame([(i, s, 0, "x") for i, s in enumerate(parts)], SEQS)
    table = kmers.filter_kmers(df, 9, kmers.count_filter(1)).withColumn("data", F.struct(F.left("kmer", F.lit(1)).alias("a"), F.right("kmer", F.lit(1)).alias("b")))
    # Of each k-mer the first base as it is read along the path: together the path without its last k - 1 bases.
    first = compact.Ordered(lambda d: F.struct(d["a"].alias("text"), d["b"].alias("other")), lambda x, y: F.struct(F.concat(x["text"], y["text"]).alias("text"), F.concat(x["other"], y["other"]).alias("other")), lambda x: F.struct(F.translate(x["other"], "ACGT", "TGCA").alias("text"), F.translate(x["text"], "ACGT", "TGCA").alias("other")))
    nodes = compact.compress_kmers(table, 9, spec=compact.Compression({"n": F.count(F.lit(1))}, ordered={"firsts": first})).collect()
    assert sorted(min(r.seq, rc(r.seq)) for r in nodes) == sorted(min(s, rc(s)) for s in parts)
    assert all(r.firsts.text == r.seq[:-8] and r.n == len(r.seq) - 8 for r in nodes)


def test_nodes_added_and_looked_up(spark):
    rows = spark.createDataFrame([("ACGTAC", 0, 1), ("GGATTT", 17, 2)], "seq string, exts int, data int")
    g = graph.base_graph(rows, 5)
    assert [(r.node_id, r.seq, r.data) for r in g.nodes.orderBy("node_id").collect()] == [(0, "ACGTAC", 1), (1, "GGATTT", 2)]
    more = graph.add(g, spark.createDataFrame([("CCCCC", 0, 3)], "seq string, exts int, data int"))
    assert [r.seq for r in more.nodes.orderBy("node_id").collect()] == ["ACGTAC", "CCCCC", "GGATTT"]
    assert [r.seq for r in graph.nodes_by_id(more, spark.createDataFrame([(1,), (1,), (9,)], "node_id long")).collect()] == ["CCCCC"]
    with pytest.raises(ValueError):
        graph.base_graph(rows, 7)


def test_starts_of_many_ranges(spark):
    sizes = [(i, (i * 7) % 5) for i in range(300)]
    got = {r.id: r.start for r in tables.starts(spark.createDataFrame(sizes, "id long, size long").repartition(9)).collect()}
    assert got == {i: sum(s for j, s in sizes if j < i) for i, _ in sizes}


def test_temporary_tables_go(spark):
    with Temporary(spark, "t") as write:
        a, b = write(spark.range(3), "a"), write(spark.range(4), "b")
        write.drop(a)
        assert b.count() == 4
        kept = written(b, "kept")
    assert kept.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FAILED_READ_FILE"):
        b.select("id").collect()


@pytest.mark.parametrize(("stranded", "symmetric", "held"), [(False, True, 1 << 16), (True, True, 50), (False, False, 7)])
def test_repair_where_neighbours_are(spark, monkeypatch, stranded, symmetric, held):
    """However few k-mers a task compares at a time, the borders are looked up."""
    monkeypatch.setattr(local_repair, "HELD", held)
    rng = random.Random(held)
    df = spark.createDataFrame([(i, dna(rng, 90) if i % 3 else "A" * 40 + "ACGT" * 9, 0, "x") for i in range(12)] * 2, SEQS)
    table = written(kmers.filter_kmers(df, 11, kmers.count_filter(2), stranded=stranded), "t")
    if not symmetric:
        table = table.filter("kmer > 'AC'").withColumn("exts", F.lit(255))
    want = sorted(map(repr, kmers.remove_censored_exts(table, stranded=stranded).collect()))
    assert sorted(map(repr, local_repair.remove_censored_exts(table, 11, p=4, stranded=stranded, symmetric=symmetric).collect())) == want
    assert local_repair.remove_censored_exts(table.limit(0), 11, p=4).count() == 0
