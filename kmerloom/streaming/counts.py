"""K-mer counting over a stream of sequences: counts and extension sets merge, so they need no window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import COUNT_LIMIT, kmers_with_exts


def stream_kmers(sequences: DataFrame, k: int, *, stranded: bool = False) -> DataFrame:
    """kmer, exts, n, data of a streaming table of sequences, for output modes update and complete."""
    obs = kmers_with_exts(sequences, k, keep=(), canonical=not stranded)
    return obs.groupBy("kmer").agg(F.bit_or("exts").alias("exts"), F.count(F.lit(1)).alias("n"), F.least(F.count(F.lit(1)), F.lit(COUNT_LIMIT)).cast("int").alias("data"))
