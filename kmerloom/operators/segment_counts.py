"""K-mer counting that shuffles segments instead of k-mers.

All occurrences of a k-mer have one minimizer, and neighbours mostly share theirs. So segments, of at
most 2 k - p bases, are shuffled by the minimizer's bucket, and their k-mers are listed and grouped
behind that shuffle. Buckets too large for one task are cut again by longer minimizers, and what is left
(a repeat) is counted by its k-mers, added up before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import msp
from .kmers import Summarizer, kmers_with_exts, summarize
from .tables import Temporary, at_least, written

#: Bases of a bucket that one task takes at least.
LEAST_LIMIT = 1 << 20
#: Bases of segments that one task takes on average: what it holds does not grow with the input.
TASK_BASES = 1 << 21


def minimizer_size(k: int) -> int:
    """Bases of a minimizer by default."""
    return min(12, max(1, k // 2))


def heavy_buckets(segments: DataFrame, limit: int | None, write: Temporary) -> tuple[DataFrame, int]:
    """bucket of the buckets with more than `limit` bases, by default those of over a task's share, so that
    there are fewer than tasks; and how many tasks there are to be."""
    sizes = write(segments.groupBy("bucket").agg(F.sum("len").alias("bases")), "sizes")
    total = sizes.agg(F.sum("bases")).first()[0] or 0
    tasks = at_least(segments.sparkSession, total // TASK_BASES)
    if limit is None:
        limit = max(LEAST_LIMIT, total // tasks)
    return write(sizes.filter(F.col("bases") > limit).select("bucket"), "heavy"), tasks


def filter_kmers(sequences: DataFrame, k: int, summarizer: Summarizer, *, p: int | None = None, stranded: bool = False, report_all: bool = False, limit: int | None = None, finish: Callable[[DataFrame], DataFrame] | None = None, finish_rest: Callable[[DataFrame], DataFrame] | None = None, write: Callable[[DataFrame, str], DataFrame] = written):
    """What kmers.filter_kmers gives, by way of segments.

    Segments of buckets that are too large are cut again by minimizers twice as long; what then still
    is in large buckets are repeats, whose k-mers add up before they are shuffled. The walk runs twice
    over the pieces of the sequences (bucket sizes, then segments), which is cheaper than to write
    the segments. The result is written. limit: bases of a bucket in one task. p: bases of a minimizer,
    by default half of k and at most 12, which makes millions of buckets of hardly shorter segments.
    finish: what is made of the valid k-mers (kmer as bytes), whole buckets in a task, before they are
    written; finish_rest: the same for those of large buckets, which are not in one task; write: how the result is.
    """
    p = p or minimizer_size(k)
    if not 1 <= p <= min(k, 12):
        raise ValueError("a minimizer has 1 to min(k, 12) bases")
    kept = summarizer.needs

    def counted(part: DataFrame) -> DataFrame:
        obs = kmers_with_exts(part, k, keep=("bucket", *kept), canonical=not stranded, packed=True, spread=False)
        return summarize(obs, ("bucket", "kmer"), summarizer).drop("bucket")

    def done(part: DataFrame, finish=finish) -> DataFrame:
        return finish(counted(part).filter(summarizer.valid)) if finish else counted(part)

    finish_rest = finish_rest or finish

    write_result = write
    with Temporary(sequences.sparkSession, "segment-counts") as write:
        rest, table = sequences, None
        for size in dict.fromkeys((p, min(2 * p, k))):
            rows = msp.segments(rest, k, size, score=msp.hashed_score(size, rc=not stranded), keep=kept, outer=True, write=write)
            heavy, tasks = heavy_buckets(rows, limit, write)
            rows = rows.select("bucket", "seq", "exts", *kept)
            # Grouping by (bucket, kmer) needs no further exchange where rows are dealt by bucket.
            part = done(rows.join(F.broadcast(heavy), "bucket", "left_anti").repartition(tasks, "bucket"), finish if size == p else finish_rest)
            table = part if table is None else table.unionByName(part)
            rest = None
            if not heavy.head(1):
                break
            rest = rows.join(F.broadcast(heavy), "bucket", "left_semi").select(F.lit(0).cast("long").alias("seq_id"), "seq", "exts", *kept)
        if rest is not None:
            table = table.unionByName(done(rest.withColumn("bucket", F.lit(0)), finish_rest))
        if finish:
            return write_result(table, "finished")
        text = F.col("kmer").cast("string").alias("kmer")
        others = [c for c in table.columns if c != "kmer"]
        if not report_all:
            return write_result(table.filter(summarizer.valid).select(text, *others), "kmers")
        table = written(table.select(text, *others), "kmers")
        return table.filter(summarizer.valid), table.select("kmer")
