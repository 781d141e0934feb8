"""All shards of the documents' k-mers are repaired and returned; counting by segments is counting."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from kmerloom.operators import kmers, segment_counts


@pytest.mark.parametrize("name", ["exts_censored_sharded", "exts_censored_all_shards"])
def test_every_shard_is_repaired(spark, sf, name):
    queries = entry.queries()
    got = {r.kmer: r.exts for r in queries[name](spark, sf).collect()}
    valid = {r.kmer for r in queries["kmer_count"](spark, sf).select("kmer").collect()}
    assert got.keys() == valid and len({k[:2] for k in got}) > 2

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expect = db.execute(entry.oracle_sql()[name]).fetchall()
    assert dict(expect) == got and len(expect) == len(got)


@pytest.mark.parametrize(("stranded", "limit"), [(False, None), (False, 300), (True, 300)])
def test_counts_by_segments(spark, stranded, limit):
    """A repeat fills one bucket with a third of all bases; with a limit it is counted by k-mers."""
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(10)] * 2 + ["AC" + "A" * 600 + "G"] + ["", "ACG", None]
    df = spark.createDataFrame([(i, s, [0, 17, 36][i % 3], "xyz"[i % 3]) for i, s in enumerate(seqs)], "seq_id long, seq string, exts int, label string")
    rows = lambda t: sorted(map(repr, t.collect()))
    for summarizer in (kmers.count_filter(2), kmers.label_filter(1)):
        want = kmers.filter_kmers(df, 21, summarizer, stranded=stranded, report_all=True)
        got = segment_counts.filter_kmers(df, 21, summarizer, p=5, stranded=stranded, report_all=True, limit=limit)
        assert rows(got[0].select(*want[0].columns)) == rows(want[0]) and rows(got[1]) == rows(want[1])
