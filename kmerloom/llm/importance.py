"""Resampling by importance: documents that look like a target table are drawn more often.

Features are runs of words, counted in buckets of their CRC-32. No run is ever put together: the CRC
of a word is computed once, and that of a run follows from those of its words, since appending L
bytes to a text multiplies its CRC by a fixed matrix over GF(2) and adds the CRC of what comes.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, materialize, slices

#: Reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Bytes of words: 0-9, a-z and all bytes of characters beyond ASCII (fixed values).
WORD_BYTES = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: Words with more bytes are handed to zlib one by one.
LONG_WORD = 64


# -- CRC algebra ------------------------------------------------------------------------------------


def byte_table() -> np.ndarray:
    """What each value of a byte adds to the register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A matrix over GF(2) (the images of the 32 bits) times each vector of 32 bits."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


def shift_tables(powers: int = 40) -> list[np.ndarray]:
    """For each i the matrix that appends 2**i bytes of zeros, as four tables by bytes of the vector."""
    matrix = np.array([POLYNOMIAL] + [1 << i for i in range(31)], np.uint32)  # one bit
    for _ in range(3):
        matrix = times(matrix, matrix)
    out = []
    for _ in range(powers):
        out.append(np.stack([times(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)]))
        matrix = times(matrix, matrix)
    return out


TABLE, SHIFTS = byte_table(), shift_tables()


def shifted(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs moved by numbers of bytes; shifted(crc(a), len(b)) ^ crc(b) is the CRC of a + b."""
    out = crcs.copy()
    for i in range(int(sizes.max()).bit_length() if len(sizes) else 0):
        at = np.flatnonzero(sizes >> i & 1)
        x, t = out[at], SHIFTS[i]
        out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the words data[start : start + size]: the j-th byte of all words at a time."""
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -LONG_WORD, side="left") :]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    first, size = starts[order], sizes[order]
    for j in range(int(size[0]) if len(order) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # words with more than j bytes
        part = register[:n]
        register[:n] = TABLE[(part ^ data[first[:n] + j]) & 255] ^ (part >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = ~register
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return out


def features(texts: list[bytes], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for runs of 1 to n words (text, CRC-32) of every run, in order.

    A-Z count as a-z. A run's CRC is that of its words joined by single spaces.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    step = np.diff(np.concatenate([[0], WORD_BYTES[data].view(np.int8)]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    of = np.searchsorted(begins, starts, side="right") - 1
    size = ends - starts
    own = word_crcs(data, starts, size)
    # The CRC of a space and the word: what is appended to a run.
    more = shifted(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ own
    runs, out = own, [(of, own)]
    for k in range(2, n + 1):
        runs = shifted(runs[:-1], size[k - 1 :] + 1) ^ more[k - 1 :]
        inside = of[: len(of) - k + 1] == of[k - 1 :]
        out.append((of[: len(of) - k + 1][inside], runs[inside]))
    return np.bincount(of, minlength=len(texts)), out


# -- counts, weights, scores --------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, *, text: str, n: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket. Each task adds up its own, so `buckets` rows a task are shuffled
    at most, and as many reach the driver."""

    @lean
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw = [r for r in batch.column("text").cast(pa.binary()).to_pylist() if r]
            for _, crcs in features(raw, n)[1]:
                total += np.bincount(crcs % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    counts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: str, ident) -> int:
    """A repeatable draw from Gumbel's distribution for an id, in thousandths; floor goes down."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, *, doc_id: str, text: str, n: int, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs."""
    buckets = len(gain)

    @lean
    def run(batches):
        for batch in slices(batches, 1024):
            raw = [r or b"" for r in batch.column("text").cast(pa.binary()).to_pylist()]
            words, found = features(raw, n)
            total, count = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            for of, crcs in found:
                upto = np.concatenate([[0], np.cumsum(gain[crcs % buckets])])
                edges = np.searchsorted(of, np.arange(len(raw) + 1))
                total += np.diff(upto[edges])
                count += np.diff(edges)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            score = weight + np.array([noise(seed, i) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words.astype(np.int64), count, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, write) -> DataFrame:
    """rows with their place, from 1, in an order: ranges number their own rows, and the ranges' sizes add up."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    part = write(part, "importance-ranges")
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    # One row a range.
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(sizes), "_p").withColumn("rank", F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_n", "_first", "_before")


def importance(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs.

    weight is the floored mean of the gains of a text's features (runs of 1 to n words): by how much
    their bucket is fuller in the target than in docs. score adds Gumbel's noise, so that the
    highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the N rows
    with at least min_words words floor(percent * N / 100) are drawn, ties to the smaller id, and
    numbered by rank; the others' rank is null.

    Only rows at or above the score where the draw ends are sorted: scores are whole numbers within
    a range that logarithms bound (some 100,000 at most), so the driver finds it from their counts.

    A null or empty text has no feature and weight 0. Null ids draw their noise from an empty name
    and come last among ties, rows with equal ids and texts tie and take any order. An empty table
    gives no rows; an empty target is one without features. Other columns are not looked at. The
    texts of an Arrow batch (1 MB, or one longer text) are held about ten times over.
    """
    with Scratch(docs.sparkSession, "importance") as write:
        gain = gains(bucket_counts(docs, text=text, n=n, buckets=buckets), bucket_counts(target, text=target_text, n=n, buckets=buckets))
        every = write(scores(docs, gain, doc_id=doc_id, text=text, n=n, seed=seed), "importance-scores")
        enough = F.col("n_words") >= min_words
        counts = sorted(((r["score"], r["n"]) for r in every.filter(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        drawn, seen, last = sum(c for _, c in counts) * percent // 100, 0, math.inf
        for score, c in counts:
            if seen >= drawn:
                break
            seen, last = seen + c, score
        above = enough & (F.col("score") >= last) if math.isfinite(last) else F.lit(False)
        top = ranked(every.filter(above), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], write)
        top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        return materialize(top.unionByName(every.filter(~above).withColumn("rank", F.lit(None).cast("long"))), "importance")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that importance() draws, with all their columns; rows that share an id with a drawn
    one come along."""
    drawn = importance(docs, target, doc_id=doc_id, **options).filter("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, docs[doc_id].eqNullSafe(drawn["doc_id"]), "left_semi")
