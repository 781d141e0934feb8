"""Removing byte spans from texts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import bound_batches, lean, materialize


def merge_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans, clipped to 0..size; touching spans are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Up to this many row numbers (16 bytes each) are broadcast to pick out rows before a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def with_rows(docs: DataFrame, per_row: DataFrame) -> DataFrame:
    """docs joined with per_row (a written table, one row per row_no) on row_no.

    While few rows are asked for, only their texts are shuffled; else all are.
    """
    if per_row.count() <= MAX_BROADCAST_ROWS:
        docs = docs.join(F.broadcast(per_row.select("row_no")), "row_no", "left_semi")
    return docs.join(per_row.hint("shuffle_merge"), "row_no")


def without_rows(docs: DataFrame, per_row: DataFrame) -> DataFrame:
    """The rows of docs whose row_no per_row lacks."""
    few = per_row.count() <= MAX_BROADCAST_ROWS
    ids = per_row.select("row_no")
    return docs.join(F.broadcast(ids) if few else ids, "row_no", "left_anti")


def remove_spans(docs: DataFrame, spans: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """The rows of docs plus n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    spans: a written table row_no, spans array<struct<a, b>> for the documents that lose something,
    where docs has a unique row_no. kept_text leaves out the bytes of characters that a cut splits.
    """
    bound_batches(docs.sparkSession)
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    whole = without_rows(docs, spans)
    body = F.coalesce(F.col(text), F.lit(""))
    whole = whole.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2(body.cast("binary"), 256), "kept_text": F.col(text)})
    own = docs.columns

    @lean
    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for body, runs in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist()):
                raw = (body or "").encode("utf-8", "surrogatepass")
                runs = merge_spans([(r["a"], r["b"]) for r in runs], len(raw))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                for column, value in zip(out, (len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(c, k) for c, k in zip(out, kinds)], names=own + [x.split()[0] for x in added.split(", ")])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + added
    return whole.unionByName(with_rows(docs, spans).mapInArrow(cut, schema))


#: Ids below this are row numbers as they are: operators may double a row number and add to it.
LARGEST_ROW = 2**61


def numbered(docs: DataFrame, doc_id: str, name: str) -> DataFrame:
    """docs with a row_no from 0 on, unique, that follows (doc_id, place of the row); nulls come first.

    Unique whole numbers from 0 to LARGEST_ROW are row numbers already, and nothing is written.
    Any other ids (negative, huge, text, null or repeated ones) are numbered: rows are
    range-partitioned by (id, place), so that one id on many rows is many parts, each part of the
    written table numbers its own rows, and the parts' sizes add up.
    """
    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        facts = docs.agg(F.count(F.lit(1)).alias("n"), F.count(doc_id).alias("ids"), F.count_distinct(doc_id).alias("distinct"), F.min(doc_id).alias("least"), F.max(doc_id).alias("most")).first()
        if facts["n"] == facts["ids"] == facts["distinct"] and (not facts["n"] or (facts["least"] >= 0 and facts["most"] < LARGEST_ROW)):
            return docs.withColumn("row_no", F.col(doc_id).cast("long"))
    # The columns have names of our own while helpers stand beside them.
    within = [f"c{i}" for i in range(len(docs.columns))]
    order = [F.col(within[docs.columns.index(doc_id)]).asc_nulls_first(), F.col("_i")]
    part = docs.toDF(*within).withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    part = materialize(part.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), name)
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_first"))
    # One row per part of the table.
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("_before") + F.col("_i") - F.col("_first")
    return part.join(F.broadcast(sizes), "_p").select(*[F.col(c).alias(own) for c, own in zip(within, docs.columns)], number.alias("row_no"))
