"""The driver's contract, and queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CHECKED = ["kmer_count", "kmer_colors", "exts_algebra", "hamming_pairs", "push_packed", "msp_bucket", "unitigs_keys", "dna_only_split"]


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    ours = entry.queries()[name](spark, sf).toPandas()
    theirs = con.sql(entry.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)
