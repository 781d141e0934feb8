"""Exact near-duplicate join on word shingles by a partition of the token universe.

Two sets of sizes s >= t with Jaccard similarity >= 3/4 differ in at most (s + t) // 7 tokens. All
tokens are hashed into the segments of their size band; sets that differ in at most H tokens
agree within some of any H + 1 non-empty segments. Sets are therefore indexed by the contents of
their segments, with a budget allocated by cost:

1. Every set indexes its non-empty segments exactly (each spends 1 of the budget). Contents that
   more than `light` sets share are expensive and get nothing. A set with enough inexpensive
   segments left still meets all its partners.
2. The others are indexed again, on a partition of half as many segments, by exact contents and
   by their one-deletion neighbourhoods: equal entries exist for segments that differ in one
   token, so each spends 2 of the budget.

Candidates are checked with a parity bitmap, which bounds the difference from below, and then
exactly on the sets. Large buckets of step 2 are first linked to their least member; only pairs
that this leaves in different components are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, materialize, slices
from .components import components
from .spans import MAX_BROADCAST_ROWS, numbered, with_rows, without_rows

_K = [np.uint64(k | 1) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]
#: Low bits of an entry that hold its size band.
BAND = 63


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _K[0]
    x ^= x >> np.uint64(31)
    x *= _K[1]
    x ^= x >> np.uint64(29)
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


#: Bytes of text that are hashed at a time.
CHUNK = 1 << 16
#: A byte's share of a word's hash, A-Z as a-z, and the base of the polynomial with its inverse modulo 2**64.
_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _K[1])
_VALUE[65:91] = _VALUE[97:123]
_BASE, _INVERSE = int(_K[0]), pow(int(_K[0]), -1, 1 << 64)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))


_UP, _DOWN = _powers(_BASE, CHUNK), _powers(_INVERSE, CHUNK)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their hashes: polynomials of their bytes modulo 2**64, from the
    differences of one running sum."""
    data = np.frombuffer(text, np.uint8)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_BLANK[data]
    turns = np.flatnonzero(word[1:] != word[:-1])  # a word's begin, its end, the next one's begin, ...
    upto, down = np.empty(len(turns), np.uint64), np.empty(len(turns), np.uint64)
    so_far, mask = 0, (1 << 64) - 1
    cuts = np.searchsorted(turns, np.arange(0, len(data) + CHUNK + 1, CHUNK))
    for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        at = i * CHUNK
        part = data[at : at + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * _UP[: len(part)], out=sums[1:])
        sums *= np.uint64(pow(_BASE, at, 1 << 64))
        sums += np.uint64(so_far)
        here = turns[lo:hi] - at
        upto[lo:hi] = sums[here]
        down[lo:hi] = _DOWN[here] * np.uint64(pow(_INVERSE, at, 1 << 64))
        so_far = int(sums[-1]) & mask
    return turns[::2], (upto[1::2] - upto[::2]) * down[::2]


class Shingles:
    """Distinct hashes of the `width`-word shingles of texts, ascending."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of([text])[0]

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sets of several texts, hashed in one go."""
        own = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        begins, h = word_hashes(b" ".join(own))
        ends = np.cumsum([len(t) + 1 for t in own])
        to = np.searchsorted(begins, ends).tolist()
        whole = self._chain(h, self.width) if len(h) >= self.width else h[:0]
        out, at = [], 0
        for end in to:
            n = end - at
            if n >= self.width:
                out.append(_distinct(whole[at : end - self.width + 1]))
            else:  # the whole sequence as one, none without words
                out.append(self._chain(h[at:end], n) if n else h[:0])
            at = end
        return out

    @staticmethod
    def _chain(h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = _mix(out ^ h[j : n + j])
        return out


def bands(size: int) -> list[int]:
    """The bands in which a set of this size meets its partners: its own, as the larger one of a
    pair, and the next, if a partner within 4/3 of the size lies there."""
    own = size.bit_length() - 1
    return [own, own + 1] if 4 * size // 3 >= 2 ** (own + 1) else [own]


def largest_difference(band: int) -> int:
    top = 2 ** (band + 1) - 1
    return 2 * top // 7


def need(size: int) -> int:
    """Budget that finds every partner of a set: one more than they can differ in."""
    return (size + 4 * size // 3) // 7 + 1


def segments(band: int, step: int) -> int:
    h = largest_difference(band)
    return max(h + 1, 2**band) if step == 1 else (h + 2) // 2


def _segment(tokens: np.ndarray, m: int) -> np.ndarray:
    return ((tokens >> np.uint64(20)) % np.uint64(m)).astype(np.int64)


def _sums(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each token, its mixed value, and each segment's sum of values and count."""
    seg = _segment(tokens, m)
    value = _mix(tokens)
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, value)
    return seg, value, total, np.bincount(seg, minlength=m)


def entries(tokens: np.ndarray, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct entries of a set, and whether each is a deletion only, for each of its bands.

    Step 1 leaves out empty segments, unless the set has too few others for its budget. Segments
    that differ in one token meet in the exact entry of one and a deletion of the other, so two
    deletions that meet prove nothing.
    """
    out = []
    for band in bands(len(tokens)) if len(tokens) > 2 else []:
        m = segments(band, step)
        seg, value, total, count = _sums(tokens, m)
        full = int(np.count_nonzero(count))
        place = np.arange(m)
        if step == 1 and full >= need(len(tokens)):
            place = np.flatnonzero(count)
        named = lambda code: (_mix(code ^ np.uint64(band * 2 + step)) & ~np.uint64(BAND)) | np.uint64(band)  # noqa: B023, E731
        code = named(total[place] + place.astype(np.uint64) * _K[2])
        if step == 1:
            code = _distinct(code)
            out.append((code, np.zeros(len(code), bool)))
            continue
        code, at = np.unique(np.append(code, named(total[seg] - value + seg.astype(np.uint64) * _K[2])), return_index=True)
        out.append((code, at >= len(place)))
    return out


def parity_bitmap(tokens: np.ndarray, per_token: int = 1) -> bytes:
    """Bit b is the parity of the tokens hashed to b. Two maps differ in no more bits than the
    sets in tokens; a map folds to half its length by xor of its halves. The more bits per token,
    the closer is the bound."""
    bits = max(64, per_token << (max(len(tokens), 1) - 1).bit_length())
    at = (_mix(tokens ^ _K[2]) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def bitmap_difference(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(m, np.uint8) for m in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_facts(docs: DataFrame, *, text: str, width: int) -> DataFrame:
    """row_no, print (digest of the set), n, own_full, next_full, bitmap of every document."""

    @lean
    def run(batches):
        shingles = Shingles(width)
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for row, tokens in zip(batch.column("row_no").to_pylist(), shingles.of(batch.column("text").to_pylist())):
                full = [int(np.count_nonzero(np.bincount(_segment(tokens, segments(b, 1))))) for b in (bands(len(tokens)) if len(tokens) > 2 else [])]
                for column, value in zip(out, (row, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), len(tokens), *[*full, 0, 0][:2], parity_bitmap(tokens))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["row_no", "print", "n", "own_full", "next_full", "bitmap"])

    return docs.select("row_no", F.col(text).alias("text")).mapInArrow(run, "row_no long, print binary, n long, own_full long, next_full long, bitmap binary")


def _by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, columns' bytes) of every part that occurs."""
    order = np.argsort(part, kind="stable")
    present, begin = np.unique(part[order], return_index=True)
    for p, at in zip(present.tolist(), np.split(order, begin[1:])):
        yield p, *[c[at].tobytes() for c in columns]


def index(docs: DataFrame, *, text: str, width: int, step: int, parts: int, light: int, room: int = 200_000) -> DataFrame:
    """large boolean, a long, b long: pairs of rows that share an entry held by at most `light`
    sets (large = false), and (entry, 2 * row + deletion) of those that more hold (large = true).

    Entries travel as packed arrays, one per part and `room` entries of a task. An entry that these
    alone show to be large sends a mark to its part, and its rows elsewhere, so no part holds them all.
    """

    @lean
    def pack(batches):
        shingles = Shingles(width)
        codes, owners, held = [], [], 0

        def flush():
            code, owner = np.concatenate(codes), np.concatenate(owners)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(begin, len(code)))
            sure = np.repeat(size > light, size)
            marks = code[begin[size > light]]
            sent_code, sent_owner = np.concatenate([code[~sure], marks]), np.concatenate([owner[~sure], np.full(len(marks), -1)])
            part = ((sent_code >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
            rows = [(p, False, *packed) for p, *packed in _by_part(part, sent_code, sent_owner)]
            part = (_mix(owner[sure].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            rows += [(p, True, *packed) for p, *packed in _by_part(part, code[sure], owner[sure])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "sure", "codes", "owners"])

        for batch in slices(batches):
            for row, tokens in zip(batch.column("row_no").to_pylist(), shingles.of(batch.column("text").to_pylist())):
                for code, deletion in entries(tokens, step):
                    codes.append(code)
                    owners.append(2 * row + deletion.astype(np.int64))
                    held += len(code)
                if held > room:
                    yield flush()
                    codes, owners, held = [], [], 0
        if codes:
            yield flush()

    def meet(key, table):
        def gather(sure: bool) -> tuple[np.ndarray, np.ndarray]:
            own = table.filter(pa.array([x == sure for x in table.column("sure").to_pylist()], pa.bool_()))
            return tuple(np.concatenate([np.frombuffer(x, t) for x in own.column(c).to_pylist()] or [np.empty(0, t)]) for c, t in (("codes", np.uint64), ("owners", np.int64)))

        code, owner = gather(False)
        order = np.lexsort((owner, code))
        code, owner = code[order], owner[order]
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
        size = np.diff(np.append(begin, len(code)))
        marked = owner[begin] < 0  # marks sort first
        big = marked | (size > light)
        pairs = [np.empty((0, 2), np.int64)]
        for f in range(2, light + 1):
            at = begin[(size == f) & ~big]
            for i in range(f if len(at) else 0):
                for j in range(i + 1, f):
                    two = np.stack([owner[at + i], owner[at + j]], axis=1)
                    pairs.append(two[(two & 1).sum(axis=1) < 2] >> 1)
        pair = np.unique(np.concatenate(pairs), axis=0)
        held = np.repeat(big, size) & (owner >= 0)
        extra_code, extra_owner = gather(True)
        a = np.concatenate([pair[:, 0], code[held].view(np.int64), extra_code.view(np.int64)])
        b = np.concatenate([pair[:, 1], owner[held], extra_owner])
        return pa.table({"large": np.arange(len(a)) >= len(pair), "a": a, "b": b})

    packed = docs.select("row_no", F.col(text).alias("text")).mapInArrow(pack, "part int, sure boolean, codes binary, owners binary")
    return packed.groupBy("part").applyInArrow(meet, "large boolean, a long, b long")


def verify(pairs: DataFrame, facts: DataFrame, docs: DataFrame, *, text: str, width: int, write) -> DataFrame:
    """The pairs (a, b) of rows whose sets have similarity >= 3/4: by sizes, bitmaps, then sets."""
    side = facts.select("row_no", "n", "bitmap")
    both = pairs.join(side.select(F.col("row_no").alias("a"), F.col("n").alias("an"), F.col("bitmap").alias("am")), "a")
    both = both.join(side.select(F.col("row_no").alias("b"), F.col("n").alias("bn"), F.col("bitmap").alias("bm")), "b").filter("4 * least(an, bn) >= 3 * greatest(an, bn)")

    @lean
    def close(batches):
        for batch in slices(batches):
            keep = [bitmap_difference(x, y) <= (s + t) // 7 for x, y, s, t in zip(*[batch.column(c).to_pylist() for c in ("am", "bm", "an", "bn")])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = write(both.mapInArrow(close, "a long, b long"), "join-near")
    asked = write(near.select(F.col("a").alias("row_no")).union(near.select("b")).distinct(), "join-asked")

    @lean
    def sets(batches):
        shingles = Shingles(width)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array([x.tobytes() for x in shingles.of(batch.column("text").to_pylist())], pa.binary())], names=["row_no", "s"])

    own = write(with_rows(docs.select("row_no", F.col(text).alias("text")), asked).mapInArrow(sets, "row_no long, s binary"), "join-sets")
    met = near.join(own.select(F.col("row_no").alias("b"), F.col("s").alias("bs")), "b").join(own.select(F.col("row_no").alias("a"), F.col("s").alias("as")), "a")

    @lean
    def exact(batches):
        for batch in slices(batches, 64):  # two sets a row
            keep = []
            for x, y in zip(batch.column("as").to_pylist(), batch.column("bs").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= 75 * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return write(met.select("a", "b", "as", "bs").mapInArrow(exact, "a long, b long"), "join-links")


def close_bitmaps(docs: DataFrame, *, text: str, width: int, per_token: int = 8) -> DataFrame:
    """row_no, n, bitmap with `per_token` bits for each shingle."""

    @lean
    def run(batches):
        shingles = Shingles(width)
        for batch in slices(batches):
            sets = shingles.of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_bitmap(x, per_token) for x in sets], pa.binary())], names=["row_no", "n", "bitmap"])

    return docs.select("row_no", F.col(text).alias("text")).mapInArrow(run, "row_no long, n long, bitmap binary")


def cross_pairs(large: DataFrame, labels: DataFrame, facts: DataFrame, *, block: int = 1024) -> DataFrame:
    """Pairs within large buckets (entry, row, deletion), not both by deletion, whose rows are in different components and whose
    bitmaps allow a link. Buckets are compared in blocks, so a task holds two blocks of one."""
    named = large.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    open_ = named.groupBy("entry").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("f")).filter("x <> y").select("entry", "f")
    rows = named.join(open_, "entry").join(facts.select(F.col("row_no").alias("row"), "n", "bitmap"), "row")
    rows = rows.withColumn("blocks", F.ceil(F.col("f") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("row", "entry"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("entry", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "row", "deletion", "component", "n", "bitmap")

    def compare(key, table):
        left, right = key[1].as_py(), key[2].as_py()
        own, row, label, n = (table.column(c).to_numpy() for c in ("own", "row", "component", "n"))
        exact = ~table.column("deletion").to_numpy()
        maps = table.column("bitmap").to_pylist()
        length = min(map(len, maps))
        folded = np.zeros((len(maps), length), np.uint8)
        for i, m in enumerate(maps):
            x = np.frombuffer(m, np.uint8)
            while len(x) > length:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            folded[i] = x
        folded = folded.view(np.uint64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        theirs = np.flatnonzero(own == right)
        for i in np.flatnonzero(own == left):
            js = theirs if left != right else theirs[row[theirs] > row[i]]
            js = js[(label[js] != label[i]) & (exact[js] | exact[i]) & (4 * np.minimum(n[js], n[i]) >= 3 * np.maximum(n[js], n[i]))]
            if len(js):
                js = js[np.bitwise_count(folded[js] ^ folded[i]).sum(axis=1) <= (n[js] + n[i]) // 7]
                a.append(np.minimum(row[js], row[i]))
                b.append(np.maximum(row[js], row[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("entry", "i", "j").applyInArrow(compare, "a long, b long")


def classes_of(docs: DataFrame, *, text: str, width: int, light: int, tokens_per_part: int, write) -> DataFrame:
    """row_no, n_shingles, least (the least row_no reachable by links) of docs with a row_no; `write` is for tables that
    the result still reads."""
    facts = write(set_facts(docs, text=text, width=width), "join-facts")
    full = facts.filter("n > 0")
    classes = write(full.groupBy("print", "n").agg(F.min("row_no").alias("rep"), F.count(F.lit(1)).alias("f")).filter("f > 1").select("print", "n", "rep"), "join-classes")
    copies = write(full.select("row_no", "print", "n").join(classes, ["print", "n"]).filter("row_no <> rep").select("row_no", "rep"), "join-copies")
    total = facts.agg(F.sum("n")).first()[0] or 0
    parts = max(8, -(-total // tokens_per_part))

    reps = without_rows(docs, copies)
    step1 = write(index(reps, text=text, width=width, step=1, parts=parts, light=light), "join-step1")
    pairs = step1.filter("not large").select("a", "b")

    # What a set has left of its budget when the large entries get none of it.
    lost = step1.filter("large").groupBy(F.shiftright("b", 1).alias("row_no"), F.col("a").bitwiseAND(F.lit(BAND)).alias("band")).agg(F.count(F.lit(1)).alias("lost"))
    lost = lost.groupBy("row_no").agg(F.max(F.when(F.col("band") >= 0, F.struct("band", "lost"))).alias("hi"), F.min(F.struct("band", "lost")).alias("lo"))
    budget = (F.col("n") + F.floor(4 * F.col("n") / 3)) / 7
    own_band = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("long")
    part = lambda at: F.when(F.col("lo.band") == at, F.col("lo.lost")).when(F.col("hi.band") == at, F.col("hi.lost")).otherwise(0)
    lost = facts.join(lost, "row_no", "left").withColumn("own", own_band)
    crosses = F.floor(4 * F.col("n") / 3) >= F.pow(F.lit(2.0), F.col("own") + 1)
    short = lambda full_, at: F.col(full_) - part(at) < F.floor(budget) + 1
    again = lost.filter((F.col("n") > 2) & (short("own_full", F.col("own")) | (crosses & short("next_full", F.col("own") + 1)))).select("row_no")
    again = write(again.join(copies.select("row_no"), "row_no", "left_anti"), "join-again")

    left = docs.select("row_no", F.col(text).alias("text"))
    poor = left.join(F.broadcast(again) if again.count() <= MAX_BROADCAST_ROWS else again, "row_no", "left_semi")
    step2 = write(index(poor, text="text", width=width, step=2, parts=parts, light=light), "join-step2")
    large = step2.filter("large").select(F.col("a").alias("entry"), F.shiftright("b", 1).alias("row"), (F.col("b") % 2 == 1).alias("deletion"))
    # A bucket needs an exact entry; those with the same rows are one bucket.
    exact = F.min(F.when(~F.col("deletion"), F.col("row")))
    held = large.groupBy("entry").agg(F.count(F.lit(1)).alias("f"), F.sum(F.xxhash64("row", "deletion").cast("decimal(38,0)")).alias("h"), exact.alias("first")).filter("f > 1 and first is not null")
    large = write(large.join(held.groupBy("f", "h").agg(F.min(F.struct("entry", "first")).alias("e")).select("e.entry", "e.first"), "entry"), "join-large")
    stars = large.filter("row <> first").select(F.least("first", "row").alias("a"), F.greatest("first", "row").alias("b"))
    first = write(pairs.unionByName(step2.filter("not large").select("a", "b")).unionByName(stars).distinct(), "join-first")
    links = verify(first, facts, docs, text=text, width=width, write=write)

    labels = write(components(links, write=write), "join-labels")
    bucketed = write(large.select(F.col("row").alias("row_no")).distinct(), "join-bucketed")
    close = write(close_bitmaps(with_rows(left, bucketed), text="text", width=width), "join-close")
    second = write(cross_pairs(large.select("entry", "row", "deletion"), labels, close).distinct().join(first, ["a", "b"], "left_anti"), "join-second")
    if second.head(1):
        links = links.unionByName(verify(second, facts, docs, text=text, width=width, write=write))
        labels = write(components(links, write=write), "join-labels")

    copies = copies.select("row_no", "rep")
    rep = facts.select("row_no", "n").join(copies, "row_no", "left").withColumn("rep", F.coalesce("rep", "row_no"))
    rep = rep.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("row_no", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("_least"))
    return rep.withColumnRenamed("_least", "least")


ADDED = ("row_no", "n_shingles", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, light: int = 8, tokens_per_part: int = 400_000) -> DataFrame:
    """The rows of docs plus n_shingles and component_id.

    Two documents link when their sets of distinct `width`-word shingles (A-Z in lower case, words
    apart by ASCII blanks; a shorter text is one shingle) have 100 * intersection >= 75 * union.
    component_id is the smallest id reachable by links. Equal sets are indexed once. The result is
    the classes that links make, not the links: pairs that other links already join are not all
    compared, so their number is not given.

    Ids may be of any type that has an order. A null text, or one without words, has an empty set
    and is linked with nothing. Null ids come first in that order, so a component with one has a
    null id; rows with equal ids are documents of their own. An empty table gives no rows. Columns named like the added ones, or row_no, are replaced.
    """
    docs = numbered(docs.drop(*ADDED), doc_id, "join-rows")
    with Scratch(docs.sparkSession, "join") as write:
        found = materialize(classes_of(docs, text=text, width=width, light=light, tokens_per_part=tokens_per_part, write=write), "join-result")
    names = docs.select(F.col("row_no").alias("least"), F.col(doc_id).alias("component_id"))
    return docs.join(found.join(names, "least").drop("least"), "row_no").drop("row_no")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, light: int = 8, tokens_per_part: int = 400_000) -> DataFrame:
    """The rows of docs, without all but the first of each component of near_duplicates(). Columns
    named like the ones that it adds, or row_no, are left out."""
    docs = numbered(docs.drop(*ADDED), doc_id, "join-rows")
    with Scratch(docs.sparkSession, "join") as write:
        found = classes_of(docs, text=text, width=width, light=light, tokens_per_part=tokens_per_part, write=write)
        later = materialize(found.filter("row_no <> least").select("row_no"), "join-dropped")
    return without_rows(docs, later).drop("row_no")
