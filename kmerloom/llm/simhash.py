"""Near-duplicates by SimHash fingerprints: bit-sliced comparison within buckets.

Two fingerprints of 64 bits that differ in at most `radius` bits agree in one of radius + 1 blocks of
bits. Distinct fingerprints meet in buckets by block; a bucket with more than LIMIT of them is cut
again by blocks of the bits that are left, and at last into pieces of which each pair meets in a task
of its own. So no task holds more than a bounded part of a bucket, and no pair of close fingerprints
is missed.

Within a bucket the bits are stored vertically: plane b holds bit b of 64 rows in a word. Rows are
compared with those d places behind for d = 1, 2, ...: one XOR of a plane with itself, shifted by d
bits, says of 64 pairs at once whether they differ there. Distances of all pairs add up in bit planes,
by carry-save adders, and a shift is abandoned once every pair exceeds the radius.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, materialize, slices
from .components import components
from .spans import MAX_BROADCAST_ROWS

BITS = 64
#: Fingerprints of a bucket that are compared in one task.
LIMIT = 2048
#: Rounds of cutting buckets by more bits, before the rest is cut into pieces.
CUTS = 2
#: Rows that a task gathers before it compares them.
ROWS = 1 << 16
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 15


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text's words, A-Z in lower case: a bit is set if it is set in over half of the hashes
    (XXH64) of the runs of `width` words, repeats counted. Fewer words are one run, none give 0."""
    words = raw.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    n = max(len(words) - width + 1, 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES):
        runs = map(body.__getitem__, map(slice, starts[at : at + SHINGLES], ends[at : at + SHINGLES]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), "<u8", min(SHINGLES, n - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str, text: str, width: int, seed: int) -> DataFrame:
    """doc_id, print (a signed long) of every row of docs."""

    @lean
    def run(batches):
        for batch in slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(r or b"", width, seed) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, print long")


# -- bit-sliced comparison ------------------------------------------------------------------------


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(BITS, words): word w of plane b holds bit b of the rows 64 w to 64 w + 63; a word of zeros follows."""
    words = -(-len(prints) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((BITS, words + 1), np.uint64)
    out[:, :-1] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    return out


def over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Of distances in bit planes (lowest first), whether they exceed the radius."""
    more, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more


def within(planes: np.ndarray, by: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs (row, row + by) that `valid` (words) asks for, those that differ in at most radius bits."""
    words = len(valid)
    alive = valid.copy()
    skip, bits = divmod(by, 64)
    at = np.arange(words)  # words that still have a pair within the radius
    # The counters hold radius + 1; what runs over is beyond the radius.
    counters = [np.zeros(words, np.uint64) for _ in range((radius + 1).bit_length())]

    def differ(b: int) -> np.ndarray:
        plane = planes[b]
        if not bits:
            return plane[at] ^ plane[at + skip]
        return plane[at] ^ (plane[at + skip] >> np.uint64(bits) | plane[at + (skip + 1)] << np.uint64(64 - bits))

    for b in range(0, BITS, 2):
        x, y = differ(b), differ(b + 1)
        half = x ^ y
        # A full adder takes two planes of differences into the lowest plane of the counters.
        counters[0], carry = half ^ counters[0], (x & y) | (half & counters[0])
        for i in range(1, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        alive &= ~carry
        if b % 8 == 6:
            alive &= ~over(counters, radius)
            left = np.flatnonzero(alive)
            if not len(left):
                return np.zeros(words, np.uint64)
            if len(left) < len(at) // 2:
                at, alive, counters = at[left], alive[left], [c[left] for c in counters]
    out = np.zeros(words, np.uint64)
    out[at] = alive
    return out


def forest(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places a, b) that connect the rows of a group (sorted by it) as all pairs within the radius do.

    A pair that other links join already is not compared again, so a dense group costs little more
    than its rows and gives fewer links than it has rows.
    """
    n = len(prints)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")  # the largest groups first: with each d fewer rows count
    sizes, starts = sizes[order], starts[order]
    ends = np.cumsum(sizes)
    of_row = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(n) + (starts - ends + sizes)[of_row]
    planes, label = planes_of(prints[places]), np.arange(n)
    found: list[tuple[int, int]] = []
    for by in range(1, int(sizes[0])):
        rows = int(ends[np.searchsorted(-sizes, -by, side="left") - 1]) - by  # of groups with more than `by` rows
        asked = (of_row[:rows] == of_row[by : rows + by]) & (label[:rows] != label[by : rows + by])
        if not asked.any():
            continue
        valid = np.zeros(-(-rows // 64) * 8, np.uint8)
        packed = np.packbits(asked, bitorder="little")
        valid[: len(packed)] = packed
        near = within(planes, by, valid.view("<u8"), radius)
        hits = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[:rows])
        if not len(hits):
            continue
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while x in up:
                x = up[x]
            return x

        for i, x, y in zip(hits.tolist(), label[hits].tolist(), label[hits + by].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((i, i + by))
        move = np.arange(n)
        for x in up:
            move[x] = root(x)
        label = move[label]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return places[pairs[:, 0]], places[pairs[:, 1]]


def compare(buckets: DataFrame, radius: int) -> DataFrame:
    """a, b: links of the fingerprints (print) of each bucket (bucket, a long; few rows each)."""

    @lean
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            nonlocal held
            if not held:
                return
            all_ = pa.Table.from_batches(held)
            bucket, prints = (all_.column(c).to_numpy() for c in ("bucket", "print"))
            cut = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            held = all_.slice(cut).combine_chunks().to_batches()
            if cut:
                a, b = forest(prints[:cut].view(np.uint64), bucket[:cut], radius)
                yield pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS:
                yield from flush(False)
        yield from flush(True)

    return buckets.select("bucket", "print").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


# -- buckets ----------------------------------------------------------------------------------------


def blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the bits of `free` into parts of nearly equal numbers."""
    places = [i for i in range(BITS) if free >> i & 1]
    edges = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(prints: DataFrame, *, radius: int, limit: int, write) -> DataFrame:
    """a, b: links that connect the distinct fingerprints (print) as all pairs within the radius do."""
    parts = radius + 1
    everything = (1 << BITS) - 1
    # Each cut holds its rows as (print, cut, used): the number of the blocks taken so far, and the bits.
    now, masks, out = prints.select("print", F.lit(0).cast("long").alias("cut")), [everything], None
    for level in range(CUTS):
        chosen = [(signed(own), left & ~own) for left in masks for own in blocks(left, parts)]
        bits = F.array(*[F.lit(own).cast("long") for own, _ in chosen])
        first = F.col("cut") * parts
        cuts = now.select("print", F.explode(F.sequence(first, first + (parts - 1))).alias("cut"), *(["bucket"] if level else []))
        own = F.col("print").bitwiseAND(F.element_at(bits, (F.col("cut") + 1).cast("int")))
        before = [F.col("bucket")] if level else []
        cuts = cuts.withColumn("bucket", F.xxhash64(*before, "cut", own))
        sizes = cuts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        heavy = write(sizes.filter(F.col("n") > limit).select("bucket", "n"), f"simhash-heavy{level}")
        few = heavy.count()
        side = F.broadcast(heavy) if few <= MAX_BROADCAST_ROWS else heavy
        fits = cuts.join(side.select("bucket"), "bucket", "left_anti") if few else cuts
        met = compare(fits, radius)
        out = met if out is None else out.unionByName(met)
        if not few:
            return out
        now, masks = write(cuts.join(side, "bucket"), f"simhash-cut{level}"), [left for _, left in chosen]
    # Still too many: rows are dealt to pieces, and every two pieces meet.
    pieces = F.ceil(F.col("n") / limit).cast("long")
    mine = F.pmod(F.xxhash64("print", F.lit(1)), pieces)
    dealt = now.withColumn("mine", mine).select("print", "bucket", "mine", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("other"))
    dealt = dealt.select("print", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))
    return out.unionByName(compare(dealt, radius))


# -- documents --------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of docs.

    Fingerprints that differ in at most `radius` bits link, and component_id is the least id that
    links reach. Equal fingerprints are one from the start, so copies cost nothing further; a pair
    that other links join already is not compared, so the result is the classes, not the links.

    A null text counts as an empty one; both, and texts without a word, have the fingerprint 0, which
    links like any other. Ids may be of any type that has an order, null or repeated; null ids are
    never the least one of a component that has another. An empty table gives no rows. Other columns
    of docs are not looked at. A text is held whole, its words and bits in parts.
    """
    spark = docs.sparkSession
    with Scratch(spark, "simhash") as write:
        every = materialize(fingerprints(docs, doc_id=doc_id, text=text, width=width, seed=seed), "simhash-prints")
        distinct = write(every.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        joined = write(components(links(distinct, radius=radius, limit=limit, write=write), write=write), "simhash-components")
        linked = joined.select(F.col("node").alias("print"), "component").join(distinct, "print")
        least = linked.groupBy("component").agg(F.min("least").alias("_least"))
        named = joined.join(least, "component").select(F.col("node").alias("print"), "_least")
        known = distinct.join(named, "print", "left").select("print", F.coalesce("_least", "least").alias("component_id"))
        known = materialize(known, "simhash-known")
    return every.join(known, "print").select("doc_id", fingerprint_text("print").alias("fingerprint"), "component_id")


def fingerprint_text(print_: str) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))
