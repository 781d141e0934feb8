"""Unitigs by fragments are those of compact.compress_kmers(), circles and palindromes too."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import compact, fragments, graph, kmers, segment_counts
from kmerloom.operators.tables import Temporary, at_least

COLUMNS = ["node_id", "seq", "len", "exts", "members", "data"]


def _texts(rng):
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    circle, long_circle = some(40), some(700)
    texts = [some(n) for n in (5, 30, 31, 400, 3000)]
    texts += [circle * 3, long_circle * 2, "ACGT" * 20, "A" * 60, some(4) * 20, "AT" * 30]
    texts += [texts[3][:200] + some(50), some(50) + texts[4][1000:2000], texts[4][500:900].translate(str.maketrans("ACGT", "TGCA"))[::-1]]
    return texts


@pytest.mark.parametrize("k, min_obs", [(24, 1), (40, 2)])
def test_as_compress_kmers(spark, monkeypatch, k, min_obs):
    rng = random.Random(k)
    texts = _texts(rng) * 2 + _texts(rng)
    seqs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], "seq_id long, seq string, exts int, label string")
    want = graph.Graph(compact.compress_kmers(kmers.filter_kmers(seqs, k, kmers.count_filter(min_obs)), k), k).normalised().nodes.select(COLUMNS)
    # Circles cross tasks, and chains take rounds.
    monkeypatch.setattr(segment_counts, "TASK_BASES", 1 << 14)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = graph.Graph(fragments.unitigs(seqs, k, kmers.count_filter(min_obs), base=20), k).normalised().nodes.select(COLUMNS)
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("base, known", [(1000, True), (150, False)])
def test_chains(spark, base, known):
    """Chains and circles of known states."""
    rng = random.Random(3)
    rows, want, at, circles = [], {}, 0, 0
    for length, circle in [(1, 0), (2, 0), (2, 0), (3, 0), (4, 0), (9, 0), (60, 0), (2, 1), (12, 1), (25, 1)]:
        states = [2 * (at + i) + rng.randint(0, 1) for i in range(length)]
        at, circles = at + length, circles + circle
        for a, b in [*zip(states, states[1:]), *([(states[-1], states[0])] if circle else [])]:
            rows += [(a, b), (b ^ 1, a ^ 1)]
        for walk in [] if circle else [states, [x ^ 1 for x in states[::-1]]]:
            want |= {x: (walk[-1], length - 1 - i) for i, x in enumerate(walk[:-1])}
    leave, arrive = {s for s, _ in rows}, {t for _, t in rows}
    table = [(s, t, not known or t in leave, not known or s in arrive) for s, t in rows]
    with Temporary(spark, "test") as write:
        got = {r.s: (r.end, r.hops) for r in fragments.chains(spark.createDataFrame(table, "s long, t long, more boolean, before boolean"), write, base=base).collect()}
    assert len(got) == len(rows) - 2 * circles and {x: got[x] for x in want} == want


def test_tasks_grow_with_the_input(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(segment_counts, "TASK_BASES", 1000)
    rng = random.Random(1)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=200)), 0) for i in range(60)], "seq_id long, seq string, exts int")
    try:
        got = segment_counts.filter_kmers(seqs, 20, kmers.count_filter(1)).count()
        assert got == kmers.filter_kmers(seqs, 20, kmers.count_filter(1)).count()
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 12 and at_least(spark, 1) > 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_rows_leave_a_task(spark):
    """Most neighbours meet where they are counted: fragments are far fewer than k-mers."""
    rng = random.Random(2)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=500)), 0) for i in range(40)], "seq_id long, seq string, exts int")
    found = segment_counts.filter_kmers(seqs, 31, kmers.count_filter(1), finish=lambda part: fragments.fragments(part, 31))
    rows, members = found.agg(F.count(F.lit(1)), F.sum("members")).first()
    assert members == kmers.filter_kmers(seqs, 31, kmers.count_filter(1)).count() and rows < members / 4
