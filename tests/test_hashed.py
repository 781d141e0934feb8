"""Unknown characters as hashed bases: the first digit of an MD5, many at a time."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.sources import dna


def _plain(text, name):
    if text is None:
        return None
    digit = lambda i: int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[0], 16) % 4
    return "".join(c.upper() if c in "ACGTacgt" else "" if name is None else "ACGT"[digit(i)] for i, c in enumerate(text))


@pytest.mark.parametrize("size", [50, 1 << 18])
def test_as_hashed_one_by_one(spark, monkeypatch, size):
    """Texts of any characters and lengths, names of none and of more than one block of MD5, null of both."""
    rng = random.Random(size)
    some = lambda n: "".join(rng.choices("ACGTacgtNn -\n\0é€😀", k=n))
    names = ["", "7", "1234567890" * 5, "é" * 26, "x" * 53, "x" * 54, "x" * 55, "x" * 200, None]
    rows = [(some(n), name) for name in names for n in (0, 1, 9, 11, 130, *([1005] if size > 1000 else []))] + [(None, "7"), (None, None), ("", None)]
    rng.shuffle(rows)
    monkeypatch.setattr(dna, "HASHED_BYTES", size)
    got = dna._hashed.func(pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.string()))
    assert got.to_pylist() == [_plain(*r) for r in rows]
    assert dna._hashed.func(pa.array([None, "N", "A-"], pa.string())[1:], pa.array(["1", "2", "3"], pa.string())[1:]).to_pylist() == [_plain("N", "2"), _plain("A-", "3")]
    if size > 1000:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, name string")
        assert [r.seq for r in df.select("id", dna.hashed("text", F.col("name")).alias("seq")).orderBy("id").collect()] == [_plain(*r) for r in rows]


def test_time_of_a_long_text(spark):
    """A text of four million characters. When each was hashed by an expression of its own it took 31 s."""
    df = spark.range(1).select(F.repeat(F.lit("some words, "), 340_000).alias("text"))
    df.select(F.length(dna.hashed("text", F.lit("warm")))).collect()
    began = time.time()
    assert df.select(F.length(dna.hashed("text", F.lit("1"))).alias("n")).first().n == 4_080_000
    assert time.time() - began < 8
