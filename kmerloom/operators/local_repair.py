"""Extension repair where neighbours are: most of a k-mer's neighbours have its minimizer.

K-mers are dealt by the bucket of their minimizer, so a task meets most neighbours itself; what it
has not seen is looked up across tasks, and that concerns the k-mers at the borders of segments only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import fragments, msp, segment_counts
from .kmers import Summarizer, neighbour_bits
from .tables import Temporary, written

#: K-mers that a task compares at a time.
HELD = 1 << 16
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(b) for b in "ACGT"]] = [ord(b) for b in "TGCA"]


def with_buckets(kmers: DataFrame, k: int, p: int, *, stranded: bool = False) -> DataFrame:
    """kmers with the bucket of their minimizer by msp.hashed_score, computed without a shuffle."""
    score = msp.hashed_score(p, rc=not stranded)

    def run(batches):
        for batch in batches:
            text = "".join(batch.column("kmer").to_pylist())
            ranks, mirrored = msp.pmer_ranks(text, p)
            places = np.arange(batch.num_rows)[:, None] * k + np.arange(k - p + 1)
            scores, buckets = score(ranks, mirrored)[places], np.minimum(ranks, mirrored)[places]
            # Equally scored p-mers share a bucket.
            own = buckets[np.arange(batch.num_rows), scores.argmin(axis=1)] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "bucket"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kmers.schema.fields)
    return kmers.mapInArrow(run, f"{schema}, bucket long")


def seen_bits(texts: np.ndarray, exts: np.ndarray, stranded: bool) -> np.ndarray:
    """Of the extension bits of k-mers (fixed-length bytes) those that lead to one of the same k-mers."""
    k = texts.dtype.itemsize
    letters = texts.view(np.uint8).reshape(len(texts), k)
    known = np.sort(texts)
    out = np.zeros(len(texts), np.int64)
    for right in (0, 1):
        for i, base in enumerate(b"ACGT"):
            bit = 1 << (i + 4 * right)
            at = np.flatnonzero(exts & bit)
            if not len(at):
                continue
            new = np.full((len(at), 1), base, np.uint8)
            step = np.hstack([letters[at, 1:], new] if right else [new, letters[at, :-1]])
            to = np.ascontiguousarray(step).view(f"S{k}").ravel()
            if not stranded:
                other = np.ascontiguousarray(_COMPLEMENT[step[:, ::-1]]).view(f"S{k}").ravel()
                to = np.where(other < to, other, to)
            place = np.searchsorted(known, to).clip(max=len(known) - 1)
            out[at[known[place] == to]] |= bit
    return out


def remove_censored_exts(kmers: DataFrame, k: int, *, p: int = 8, stranded: bool = False, symmetric: bool = True) -> DataFrame:
    """kmers (kmer, exts, any other columns) without extensions that lead out of the table, as
    kmers.remove_censored_exts gives them.

    symmetric: a k-mer with an extension to another one in the table has one from it, too, as tables of
    counted k-mers do; then the k-mers at borders are looked up among each other. Without it they
    are looked up in the whole table. The result is written.
    """
    names = [c for c in kmers.columns if c != "bucket"]
    dealt = with_buckets(kmers.select(names), k, p, stranded=stranded).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            texts = np.frombuffer("".join(rows.column("kmer").to_pylist()).encode(), f"S{k}")
            exts = rows.column("exts").to_numpy().astype(np.int64)
            seen = seen_bits(texts, exts, stranded)
            out = rows.select(names).append_column("_seen", pa.array(seen, pa.int32())).append_column("_open", pa.array(exts & ~seen, pa.int32()))
            yield from out.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield from flush()
        if held:
            yield from flush()

    with Temporary(kmers.sparkSession, "repair") as write:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kmers.select(names).schema.fields)
        local = write(dealt.mapInArrow(run, f"{schema}, _seen int, _open int"), "local")
        border = local.filter("_open <> 0")
        rest = [c for c in names if c not in ("kmer", "exts")]
        open_ = border.select("kmer", F.col("_open").alias("exts"), "_seen", *rest)
        probes = neighbour_bits(open_, stranded=stranded, keep=("_seen", *rest))
        among = (border if symmetric else local).select(F.col("kmer").alias("target"), F.lit(True).alias("_found"))
        # A k-mer's own columns go with its bits, which spares a join of the borders.
        found = F.bit_or(F.when(F.col("_found"), F.col("bit")).otherwise(0))
        mended = probes.join(among, "target", "left").groupBy("kmer").agg(found.alias("_more"), *[F.first(c).alias(c) for c in ("_seen", *rest)])
        mended = mended.select("kmer", *rest, F.col("_seen").bitwiseOR(F.col("_more")).alias("exts"))
        inner = local.filter("_open = 0").select("kmer", *rest, F.col("_seen").alias("exts"))
        return written(inner.unionByName(mended).select(names), "repaired")


def _seen(kmers: DataFrame, k: int) -> DataFrame:
    """k-mers (kmer as bytes, exts, any other columns) as text, with exts that lead to one of the same task only, and
    the others as _open."""
    names = kmers.columns

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            texts = b"".join(rows.column("kmer").to_pylist())
            exts = rows.column("exts").to_numpy().astype(np.int64)
            seen = fragments.seen(fragments._CODE[np.frombuffer(texts, np.uint8)].reshape(-1, k), exts)
            for name, values in (("kmer", rows.column("kmer").cast(pa.string())), ("exts", pa.array(seen, pa.int32()))):
                rows = rows.set_column(names.index(name), name, values)
            yield from rows.append_column("_open", pa.array(exts & ~seen, pa.int32())).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= fragments.HELD:
                yield from flush()
        if held:
            yield from flush()

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'kmer' else f.dataType.simpleString()}" for f in kmers.schema.fields)
    return kmers.mapInArrow(run, f"{schema}, _open int")


def counted(sequences: DataFrame, k: int, summarizer: Summarizer, *, shard: Callable[[Column], Column] | None = None) -> DataFrame:
    """kmer, exts, n, data of the k-mers that summarizer keeps, as kmers.remove_censored_exts() leaves them, or with a
    shard (of a k-mer's column) as kmers.remove_censored_exts_sharded() does.

    Neighbours are met in the tasks that count them. An extension to another task's k-mer is looked up among those
    that have such extensions, if it stays in its shard. The sequences hold all k-mers that their extensions lead
    to (exts of their own are 0), so what a shard has not kept it has dropped, and the dropped k-mers need not be
    written.
    """

    def finish(part: DataFrame) -> DataFrame:
        rows = _seen(part, k)
        asked = F.col("_open")
        if shard is not None:
            asked = F.lit(0)
            for right in (0, 1):
                for i, base in enumerate(S.BASES):
                    to = S.canonical((S.extend_right if right else S.extend_left)("kmer", F.lit(base)))
                    asked = asked.bitwiseOR(F.when(shard(F.col("kmer")) == shard(to), F.col("_open").bitwiseAND(F.lit(1 << (i + 4 * right)))).otherwise(0))
        rows = rows.withColumn("_asked", asked)
        return rows.withColumn("exts", F.col("exts").bitwiseOR(F.col("_open").bitwiseAND(F.bitwise_not("_asked")))).drop("_open")

    spark = sequences.sparkSession
    table = segment_counts.filter_kmers(sequences, k, summarizer, finish=finish, write=written)
    with Temporary(spark, "repair") as write:
        border = write(table.filter("_asked <> 0"), "border")
        rest = [c for c in table.columns if c not in ("kmer", "exts", "_asked")]
        probes = neighbour_bits(border.select("kmer", F.col("_asked").alias("exts"), F.col("exts").alias("_seen"), *rest), stranded=False, keep=("_seen", *rest))
        among = border.select(F.col("kmer").alias("target"), F.lit(True).alias("_found"))
        found = F.bit_or(F.when(F.col("_found"), F.col("bit")).otherwise(0))
        # A k-mer's own columns go with its bits, which spares a join of the borders.
        mended = probes.join(among, "target", "left").groupBy("kmer").agg(found.alias("_more"), *[F.first(c).alias(c) for c in ("_seen", *rest)])
        mended = written(mended.select("kmer", F.col("_seen").bitwiseOR(F.col("_more")).alias("exts"), *rest), "mended")
    return table.filter("_asked = 0").select("kmer", "exts", *rest).unionByName(mended)
