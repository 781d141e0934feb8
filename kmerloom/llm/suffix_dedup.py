"""Substring deduplication by distributed prefix doubling.

The rank of a position at length L names the L bytes that start there; the rank at 2L is the name
of the pair (rank at p, rank at p + L). Ranks are kept for those positions only that can still
decide something:

* length 32: of all windows of `threshold` bytes, each is represented by one position, the least
  ranked of the 32-byte strings in it (equal windows have it in the same place). Spark sorts these
  (rank, position) pairs; a position whose rank is unique leaves, and all its windows are unique.
* length up to 2 * threshold: positions with an equal rank whose whole stretch of windows is equal,
  too, are settled at once: all windows but those of the first repeat. One position per stretch
  goes on, if its rank has several stretches.
* length 64: of those, Spark compares the ranks at offsets -32 and 0 that a repeated window would
  share; the sides on which they are unique leave.
* length `threshold`: the windows that are left are ranked by the pair of 64-byte ranks at offset
  threshold - 64, sorted, and all but the first of equal rank repeat.

Names are 64-bit mixes of the pair, so equal strings have equal names. What is removed is decided on
two of them, made of different tables of bytes in the last step and of different lengths in the one
before: of n strings, unequal ones are taken for equal with a probability of n**2 / 2**129.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, materialize, slices
from .spans import merge_spans, numbered, remove_spans, with_rows

GRAM = 32
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, person=b"rank").digest(), "little") for b in range(256)], np.uint64)
_CHECK = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, person=b"check").digest(), "little") for b in range(256)], np.uint64)
_ODD = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8, person=b"odd").digest(), "little") | 1) for i in range(3)]
#: Low bits of a comparison key that hold the position; longer texts are read in overlapping parts.
POSITION_BITS = 20


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = a * _ODD[0]
    x += b * _ODD[1]
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    x ^= x >> np.uint64(29)
    return x


def gram_ranks(raw: np.ndarray, names: np.ndarray = _BYTE) -> np.ndarray:
    """Rank at length 32 of every position that has 32 bytes, by doubling from single bytes."""
    rank, length = names[raw], 1
    while length < GRAM:
        rank = pair_rank(rank[:-length], rank[length:])
        length *= 2
    return rank


def window_ranks(ranks: np.ndarray, at: np.ndarray, threshold: int) -> np.ndarray:
    """Rank at length `threshold` (64..128) of the positions `at`."""
    half = GRAM
    first = pair_rank(ranks[at], ranks[at + half])
    last = pair_rank(ranks[at + threshold - 2 * half], ranks[at + threshold - half])
    return pair_rank(first, last)


def representatives(ranks: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that represent windows, and the first and last window start that each stands for."""
    width = threshold - GRAM + 1
    n = len(ranks) - width + 1
    key = ((ranks >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS)) | np.arange(len(ranks), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    place = (key[:n] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return place[first], first, np.append(first[1:], n) - 1


ROWS = "kind int, rank long, stretch long, row_no long, place int, lo int, hi int, left long, right long"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
REPEAT, OPEN = 1, 0


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def stretches(docs: DataFrame, *, text: str, threshold: int) -> DataFrame:
    """ROWS of every representative position; within a task, equal stretches are sent once, and all
    but the first of them (which surely repeat) become REPEAT rows."""
    part = (1 << POSITION_BITS) - threshold

    @lean
    def run(batches):
        for batch in slices(batches, 2048):
            got: list[list[np.ndarray]] = [[] for _ in range(7)]
            for row, body in zip(batch.column("row_no").to_pylist(), batch.column("text").to_pylist()):
                raw = np.frombuffer((body or "").encode("utf-8", "surrogatepass"), np.uint8)
                for start in range(0, max(len(raw) - threshold + 1, 0), part):
                    ranks = gram_ranks(raw[start : start + part + threshold - 1])
                    place, lo, hi = representatives(ranks, threshold)
                    whole = pair_rank(window_ranks(ranks, lo, threshold), window_ranks(ranks, hi, threshold)) + ((hi - lo) * 256 + (place - lo)).astype(np.uint64)
                    left = np.where(lo <= place - GRAM, pair_rank(ranks[np.maximum(place - GRAM, 0)], ranks[place]), 0)
                    inside = np.minimum(place + GRAM, len(ranks) - 1)
                    right = np.where(hi > place - GRAM, pair_rank(ranks[place], ranks[inside]), 0)
                    for held, value in zip(got, (ranks[place].view(np.int64), whole.view(np.int64), np.full(len(place), row), place + start, lo + start, hi + start, np.stack([left, right]).astype(np.uint64).view(np.int64))):
                        held.append(value)
            if not got[0]:
                continue
            rank, whole, row, place, lo, hi = (np.concatenate(g) for g in got[:6])
            left, right = np.concatenate(got[6], axis=1)
            order = np.lexsort((lo, row, whole, rank))
            again = np.zeros(len(rank), bool)
            again[order[1:]] = (rank[order[1:]] == rank[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            keep = np.flatnonzero(~again)
            yield _rows(np.full(len(keep), OPEN), rank[keep], whole[keep], row[keep], place[keep], lo[keep], hi[keep], left[keep], right[keep])
            at = np.flatnonzero(again)
            if len(at):
                # neighbouring stretches of a document touch: one row for each run of them
                begin = np.flatnonzero((np.diff(row[at], prepend=-1) != 0) | (np.diff(lo[at], prepend=-1) != np.append(-1, hi[at][:-1]) - np.append(-1, lo[at][:-1]) + 1))
                end = np.append(begin[1:], len(at)) - 1
                zero = np.zeros(len(begin), np.int64)
                spread = pair_rank(row[at][begin].astype(np.uint64), lo[at][begin].astype(np.uint64)).view(np.int64)
                yield _rows(zero + REPEAT, spread, zero, row[at][begin], zero, lo[at][begin], hi[at][end], zero, zero)

    return docs.select("row_no", F.col(text).alias("text")).mapInArrow(run, ROWS)


def settle(sorted_rows: DataFrame) -> DataFrame:
    """ROWS again, from rows sorted by (rank, stretch, row_no, lo): a later row of an equal stretch
    repeats; the first one stays open if its rank has another stretch. One row is carried over."""

    @lean
    def run(batches):
        held, shared = None, False  # the last first-of-stretch row, and whether its rank is shared
        last = (None, None)
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            passed = cols[0] == REPEAT
            if passed.any():
                yield _rows(*[c[passed] for c in cols])
            cols = [c[~passed] for c in cols]
            if not len(cols[0]):
                continue
            rank, stretch = cols[1], cols[2]
            first = np.ones(len(rank), bool)
            first[1:] = (rank[1:] != rank[:-1]) | (stretch[1:] != stretch[:-1])
            first[0] = (rank[0], stretch[0]) != last
            last = rank[-1], stretch[-1]
            if not first.all():
                again = [c[~first] for c in cols]
                yield _rows(np.full(len(again[0]), REPEAT), *again[1:])
            cols = [c[first] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            rank = cols[1]
            same = rank[1:] == rank[:-1]
            open_ = np.zeros(len(rank), bool)
            open_[1:] |= same
            open_[:-1] |= same
            open_[0] |= held is not None and shared
            done = open_.copy()
            done[-1] = False
            if done.any():
                yield _rows(*[c[done] for c in cols])
            held, shared = [c[-1:] for c in cols], bool(open_[-1])
        if held is not None and shared:
            yield _rows(*held)

    return sorted_rows.mapInArrow(run, ROWS)


def repeated_spans(docs: DataFrame, *, text: str, threshold: int, write) -> DataFrame:
    """row_no, spans of the bytes of docs (row_no, text) that a repeated window covers."""
    keyed = stretches(docs, text=text, threshold=threshold).repartition("rank").sortWithinPartitions("rank", "stretch", "row_no", "lo")
    settled = write(settle(keyed), "suffix-settled")
    open_ = settled.filter(F.col("kind") == OPEN)

    # Length 64: a side goes on if two different stretches of the rank share its name there.
    sides = open_.select("rank", "stretch", "row_no", F.explode(F.array(
        F.struct(F.col("left").alias("name"), F.lit(0).alias("side"), F.col("lo").alias("a"), F.least("hi", F.col("place") - GRAM).alias("b")),
        F.struct(F.col("right").alias("name"), F.lit(1).alias("side"), F.greatest("lo", F.col("place") - GRAM + 1).alias("a"), F.col("hi").alias("b")),
    )).alias("s")).select("rank", "stretch", "row_no", "s.*").filter("a <= b")
    shared = sides.groupBy("rank", "side", "name").agg(F.min("stretch").alias("x"), F.max("stretch").alias("y")).filter("x <> y").select("rank", "side", "name")
    ranges = sides.join(shared, ["rank", "side", "name"], "left_semi").groupBy("row_no").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    ranges = write(ranges, "suffix-ranges")

    # Length `threshold`: the windows that are left.
    @lean
    def windows(batches):
        part = 1 << 20  # windows named at a time
        for batch in slices(batches):
            got: list[tuple] = []
            for row, body, runs in zip(*[batch.column(c).to_pylist() for c in ("row_no", "text", "ranges")]):
                raw = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8)
                for begin, end in merge_spans([(r["a"], r["b"] + 1) for r in runs], len(raw)):
                    for start in range(begin, end, part):
                        at = np.arange(min(part, end - start))
                        names = [window_ranks(gram_ranks(raw[start : start + len(at) + threshold - 1], table), at, threshold).view(np.int64) for table in (_BYTE, _CHECK)]
                        got.append((*names, np.full(len(at), row), (at + start).astype(np.int32)))
                if sum(len(g[0]) for g in got) > part:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["rank", "check", "row_no", "at"])
                    got = []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["rank", "check", "row_no", "at"])

    ranked = with_rows(docs.select("row_no", F.col(text).alias("text")), ranges).mapInArrow(windows, "rank long, check long, row_no long, at int")
    ranked = ranked.repartition("rank").sortWithinPartitions("rank", "check", "row_no", "at")

    @lean
    def later(batches):
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, check = batch.column("rank").to_numpy(), batch.column("check").to_numpy()
            again = np.empty(len(rank), bool)
            again[1:] = (rank[1:] == rank[:-1]) & (check[1:] == check[:-1])
            again[0] = (rank[0], check[0]) == last
            last = rank[-1], check[-1]
            row, at = (batch.column(c).to_numpy()[again] for c in ("row_no", "at"))
            order = np.lexsort((at, row))
            row, at = row[order], at[order].astype(np.int64)
            begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
            end = np.append(begin[1:], len(row)) - 1 if len(row) else begin
            yield pa.RecordBatch.from_pydict({"row_no": row[begin], "a": at[begin], "b": at[end] + threshold})

    late = ranked.mapInArrow(later, "row_no long, a long, b long")
    whole = settled.filter(F.col("kind") == REPEAT).select("row_no", F.col("lo").cast("long").alias("a"), (F.col("hi") + threshold).cast("long").alias("b"))
    return whole.unionByName(late).groupBy("row_no").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 100) -> DataFrame:
    """The rows of docs plus n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    Removed are all bytes covered by a string of `threshold` bytes (64 to 128) that also starts
    earlier, in a document with a smaller id or earlier in the same one, judged on the input.
    Matches do not cross documents.

    A null text has no bytes; null ids come before all others, rows with equal ids in the order in
    which they are read; texts below `threshold` bytes stay whole; an empty table gives no rows.
    Columns named like the added ones, or row_no, are replaced.
    """
    if not 2 * GRAM <= threshold <= 4 * GRAM:
        raise ValueError(f"threshold must be within {2 * GRAM} and {4 * GRAM}")
    docs = docs.drop("row_no", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")
    docs = numbered(docs, doc_id, "suffix-rows")
    with Scratch(docs.sparkSession, "suffix") as write:
        spans = materialize(repeated_spans(docs, text=text, threshold=threshold, write=write), "suffix-spans")
    return remove_spans(docs, spans, doc_id=doc_id, text=text).drop("row_no")
