"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash is the least within `radius` bytes
on either side. Such ends depend on nearby bytes only, so an insertion moves the ends around it
and no others. Chunks that occur earlier, by digest, are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .spans import numbered, remove_spans

#: A pseudo-random 32-bit number for each byte value.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 32 of GEAR[raw[i - j]] << j, modulo 2**32: h = (h << 1) + GEAR[byte]."""
    h = GEAR[raw]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] += h[:-s] << np.uint32(s)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width], clipped at the end."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        if len(out) > step:
            np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def chunk_ends(raw: np.ndarray, radius: int, longest: int) -> np.ndarray:
    """Ends of the chunks of raw, the last of which is len(raw); none for an empty text."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    h = gear_hash(raw).astype(np.uint64)
    cuts = np.empty(0, np.int64)
    if n > 2 * radius:
        least = _window_min(h, radius)  # of i .. i + radius - 1
        inner = h[radius : n - radius]
        # strictly below what precedes, not above what follows: the first of equals wins
        cut = (inner < least[: n - 2 * radius]) & (inner <= least[radius + 1 : n - radius + 1])
        cuts = np.flatnonzero(cut) + radius + 1
    ends = np.append(cuts, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > longest:
        full = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest])]
        ends = np.unique(np.concatenate([ends, *full]))
    return ends


ROWS = "settled boolean, d1 long, d2 long, row_no long, a int, b int, whole boolean"
#: Chunks that a task compares among themselves before it hands them on (about 100 MB of text).
FOLD = 1 << 20


def _rows(*columns) -> pa.RecordBatch:
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in ROWS.split(", ")])


def chunks(docs: DataFrame, *, text: str, radius: int, longest: int) -> DataFrame:
    """ROWS of every chunk, the digest as two longs; whole: it is a whole text. Of equal chunks that a task
    holds at a time (FOLD) only the first is open; the others surely repeat and are settled."""

    @lean
    def cut(batches):
        held: list[tuple] = []

        def fold():
            row, a, b, whole, d1, d2 = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((a, row, d2, d1))
            settled = np.zeros(len(row), bool)
            settled[order[1:]] = (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]])
            # Settled chunks need no partner; their places spread over the parts.
            spread = np.where(settled, (row * 1_000_003 + a) * 0x5851F42D, d1)
            for at in range(0, len(row), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield _rows(*(c[part] for c in (settled, spread, d2, row, a, b, whole)))

        for batch in batches:
            rows, starts, stops, whole, digests = [], [], [], [], []
            for row, body in zip(batch.column("row_no").to_pylist(), batch.column("text").to_pylist()):
                if not body:
                    continue
                raw = body.encode("utf-8", "surrogatepass")
                ends = chunk_ends(np.frombuffer(raw, np.uint8), radius, longest).tolist()
                for a, b in zip([0, *ends], ends):
                    rows.append(row), starts.append(a), stops.append(b), whole.append(b - a == len(raw))
                    digests.append(hashlib.blake2b(raw[a:b], digest_size=16).digest())
            if rows:
                d1, d2 = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
                held.append((np.array(rows, np.int64), np.array(starts, np.int64), np.array(stops, np.int64), np.array(whole), d1, d2))
            if sum(len(h[0]) for h in held) >= FOLD:
                yield from fold()
        if held:
            yield from fold()

    return docs.select("row_no", F.col(text).alias("text")).mapInArrow(cut, ROWS)


def repeats(sorted_rows: DataFrame) -> DataFrame:
    """row_no, a, b, whole of the chunks that repeat, from ROWS sorted by (d1, d2, row_no, a)."""

    @lean
    def run(batches):
        last = (None, None)
        for batch in batches:
            settled, d1, d2, row, a, b, whole = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            open_ = np.flatnonzero(~settled)
            again = settled.copy()
            if len(open_):
                x, y = d1[open_], d2[open_]
                same = np.zeros(len(open_), bool)
                same[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                same[0] = (x[0], y[0]) == last
                last = x[-1], y[-1]
                again[open_] = same
            yield pa.RecordBatch.from_pydict({"row_no": row[again], "a": a[again], "b": b[again], "whole": whole[again]})

    return sorted_rows.mapInArrow(run, "row_no long, a int, b int, whole boolean")


def runs(again: DataFrame, shortest: int) -> DataFrame:
    """row_no, spans: the repeated chunks of each text that go. A single one of less than `shortest` bytes,
    between two that do not repeat, stays, unless it is the whole text."""
    listed = again.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("a", "b", "whole"))).alias("all"))
    touches = lambda x, i: F.coalesce(F.get("all", i - 1)["b"] == x["a"], F.lit(False)) | F.coalesce(F.get("all", i + 1)["a"] == x["b"], F.lit(False))
    spans = F.filter("all", lambda x, i: (x["b"] - x["a"] >= shortest) | x["whole"] | touches(x, i))
    spans = F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    return listed.select("row_no", spans.alias("spans")).filter(F.size("spans") > 0)


def dedup_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 48, longest: int = 1024, shortest: int = 65) -> DataFrame:
    """The rows of docs plus n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A chunk has more than `radius` bytes, about twice that on average, and at most `longest` (where no
    end is found, one is set at that distance, which does not resist shifts); a text's last one may
    be shorter. Chunks whose digest occurs earlier (smaller id, or earlier in the document) are
    removed, the first occurrence stays. A repeated chunk of less than `shortest` bytes with no
    repeated neighbour stays, unless it is a whole text: a phrase, not a passage. Digests are
    sorted once, with one row per digest and FOLD chunks of a task, so a passage that a third of the
    documents share is pre-aggregated; the sorted rows are read as a stream, so no group is held.

    A null text has no bytes; null ids come before all others, rows with equal ids in the order in
    which they are read; an empty table gives no rows. Columns named like the added ones, row_no
    or spans are replaced. A text's repeated chunks are one row.
    """
    docs = docs.drop("row_no", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")
    docs = numbered(docs, doc_id, "chunk-rows")
    found = chunks(docs, text=text, radius=radius, longest=longest)
    again = repeats(found.repartition("d1").sortWithinPartitions("d1", "d2", "row_no", "a"))
    spans = materialize(runs(again, shortest), "chunk-spans")
    return remove_spans(docs, spans, doc_id=doc_id, text=text).drop("row_no")
