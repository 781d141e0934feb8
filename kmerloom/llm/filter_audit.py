"""Which filters remove what, alone, together and in any order.

Every text gets a mask of the filters that it fails. All else adds up over masks: a part of the table
(a source) has at most 32 of them, and one small table says for each mask, filter and set of earlier
filters what a document with that mask counts for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, materialize

LETTERS = "ABCDE"
#: The filter that compares texts.
COPY = 1 << LETTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that continue a code point in UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """A text fails A with fewer than min_words words, B with fewer than min_distinct_pct distinct words in
    a hundred, C with more than max_upper_pct capitals A-Z in a hundred code points, and D if it
    holds one of symbols. It fails E if a row with a lesser id has the same text."""

    min_words: int = 200
    min_distinct_pct: int = 50
    max_upper_pct: int = 2
    symbols: str = "#$%&*|"


def own_mask(raw: bytes, limits: Limits) -> int:
    """Filters A to D of a text in UTF-8; words are what stands between ASCII blanks."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    points = len(raw.translate(None, CONTINUATION))
    failed = (
        len(words) < limits.min_words,
        100 * len(set(words)) < limits.min_distinct_pct * len(words),
        100 * upper > limits.max_upper_pct * points,
        re.search(b"[" + re.escape(limits.symbols.encode()) + b"]", raw) is not None,
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def failure_masks(docs: DataFrame, limits: Limits = Limits(), *, doc_id: str = "doc_id", text: str = "text", part: str = "source", write) -> DataFrame:
    """doc_id, part, mask (bit i: fails the i-th filter) of every row of docs.

    Rows are range-partitioned by the text's SHA-256, id and place, and each task sorts its range by
    fingerprint, text and id: copies stand in a row, however many tasks they take, and a text is
    compared with the one before it. What a task cannot know is whether the run that it begins with
    began before; that concerns the rows of one id, which are marked, and is settled from one row a
    task (its first and its last run).
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    # The fingerprint stands for the text in the bounds of the ranges, which the driver holds.
    rows = rows.withColumn("print", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("place", F.monotonically_increasing_id())
    ident = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange("print", ident, "place").sortWithinPartitions("print", "text", ident)
    edge = f"struct<head:binary,head_id:{kind},last:binary,last_id:{kind},whole:boolean>"
    schema = f"doc_id {kind}, part string, mask int, tie boolean, task int, edge {edge}"

    @lean
    def run(batches):
        task = TaskContext.get().partitionId()
        head = now = None  # (fingerprint, text, least id) of the first and of the present run
        mask, kinds = 0, None
        for batch in batches:
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
            masks, ties = [], []
            kinds = batch.column("doc_id").type
            for ident_, print_, raw in zip(ids, prints, batch.column("text").cast(pa.binary()).to_pylist()):
                if now is None or now[0] != print_ or now[1] != raw:
                    now = (print_, raw, ident_)
                    mask = own_mask(raw, limits)
                    head = head or now
                # Ids ascend within a run, nulls last: one that is not the first is greater.
                copy = ident_ is not None and now[2] is not None and ident_ != now[2]
                masks.append(mask | COPY if copy else mask)
                ties.append(now is head and ident_ == now[2])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(ties), pa.array([task] * n, pa.int32()), pa.nulls(n, edge_type(kinds))], names=names)
        if now is not None:
            one = {"head": head[0], "head_id": head[2], "last": now[0], "last_id": now[2], "whole": now is head}
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), pa.array([task], pa.int32()), pa.array([one], edge_type(kinds))], names=names)

    def edge_type(ids):
        return pa.struct([("head", pa.binary()), ("head_id", ids), ("last", pa.binary()), ("last_id", ids), ("whole", pa.bool_())])

    names = ["doc_id", "part", "mask", "tie", "task", "edge"]
    found = write(rows.select("doc_id", "part", "text", "print").mapInArrow(run, schema), "audit-masks")
    # One row a task; a run that goes on from task to task keeps its first id.
    late, before = [], None
    for row in found.filter("edge is not null").select("task", "edge").orderBy("task").toLocalIterator():
        e = row["edge"]
        goes_on = before is not None and before[0] == e["head"]
        if goes_on and before[1] is not None and e["head_id"] is not None and before[1] != e["head_id"]:
            late.append((row["task"],))
        if not (goes_on and e["whole"]):
            before = (e["last"], e["last_id"])
    late = F.broadcast(spark.createDataFrame(late, "task int").withColumn("late", F.lit(COPY)))
    out = found.filter("edge is null").join(late, "task", "left")
    return out.select("doc_id", "part", F.when(F.col("tie"), F.col("mask").bitwiseOR(F.coalesce("late", F.lit(0)))).otherwise(F.col("mask")).alias("mask"))


def weights() -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(mask, earlier filters, filter, kept, removed, redundant, unique, share): what a document that fails
    `mask` counts for at a filter after a set of others. share: in how many orders the filter removes it."""
    n = len(LETTERS)
    out = []
    for mask in range(1 << n):
        for f in range(n):
            own = 1 << f
            fails = mask & own > 0
            sets = [s for s in range(1 << n) if not s & own]
            share = sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in sets if fails and not s & mask)
            for s in sets:
                out.append((mask, s, f, int(not mask & (s | own)), int(fails and not s & mask), int(fails and s & mask > 0), int(mask == own), share))
    return out


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, earlier filters, filter) of all orders of the filters."""
    return [("".join(p), i + 1, sum(1 << LETTERS.index(x) for x in p[:i]), LETTERS.index(p[i])) for p in permutations(LETTERS) for i in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step and counts of documents for every part, order of the filters and step:
    kept (after the step), removed (here), redundant (fail the filter, removed earlier), unique_fails
    (fail this filter only), good_lost and toxic_lost (removed here, labelled quality = 1 or toxic =
    1) and shapley (removed by the filter, summed over all orders).

    labels: doc_id, quality, toxic; of several rows for one id any that says 1 counts, and every
    row of docs with that id is labelled. Rows with a null id are in no copy relation and have no
    label; rows with equal ids are documents of their own, and no copies of each other. A null text
    is an empty one, a null part the empty name. An empty table gives no rows. Other columns of docs
    and labels are not looked at.
    """
    spark = docs.sparkSession
    with Scratch(spark, "audit") as write:
        masks = failure_masks(docs, limits, doc_id=doc_id, text=text, part=part, write=write)
        # Rows are added up before they meet the labels, so that an id on many rows is one.
        rows = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
        says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
        marks = labels.filter("quality = 1 or toxic = 1").groupBy(F.col(doc_id).alias("doc_id")).agg(says("quality"), says("toxic"))
        rows = rows.join(marks, "doc_id", "left")
        times = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
        counts = write(rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("quality"), times("toxic")), "audit-counts")
        rules = spark.createDataFrame(weights(), "mask int, earlier int, filter int, kept int, removed int, redundant int, alone int, share int")
        of = lambda c, n, name: F.sum(F.col(c) * F.col(n)).cast("long").alias(name)
        sums = counts.join(F.broadcast(rules), "mask").groupBy("part", "earlier", "filter").agg(
            of("kept", "n", "kept"), of("removed", "n", "removed"), of("redundant", "n", "redundant"), of("alone", "n", "unique_fails"),
            of("removed", "quality", "good_lost"), of("removed", "toxic", "toxic_lost"), of("share", "n", "shapley"),
        )
        sums = materialize(sums, "audit-sums")
    steps = spark.createDataFrame(orders(), "filter_order string, step int, earlier int, filter int")
    return sums.join(F.broadcast(steps), ["earlier", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
