"""Unitigs by way of fragments: what a task can join of its own k-mers is joined where they are counted.

K-mers are counted in their minimizer's bucket, and most neighbours share theirs. So a task compacts the
k-mers that it has counted before anything is written or shuffled; what leaves it are fragments of
unitigs. Only these are numbered, linked across tasks, ordered along their paths and spelled.

A link is one (k+1)-mer: the two sides that see it, each as its only extension, are the sides that
it joins. So links are found by grouping sides, and no table of k-mers is looked up.

Extensions are repaired in the same way. A task settles those that lead to a k-mer of its own; the others
stay open, and nothing is joined at a side that has one. Open ones lead to a k-mer of another task, if
any, for which the way back is open too: so a (k+1)-mer that two fragments have open is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import exts as E
from ..functions import seq as S
from . import msp, segment_counts
from .compact import BASE, PIECES, Ordered, fold
from .compact import chains as contracted
from .kmers import COUNT_LIMIT, Summarizer
from .tables import Temporary, at_least, written

#: K-mers that a task compacts at a time.
HELD = 1 << 20
#: Fragments, or sides of them, that one task groups.
ROWS = 1 << 19
#: How extensions are repaired: of those observed the ones that lead to a k-mer stay, or all that do are set.
CENSORED, FROM_SET = "censored", "from set"
#: K-mers whose minimizers are looked at at a time.
SCORED = 1 << 15
_CODE = np.zeros(256, np.uint8)
_CODE[[ord(b) for b in "ACGT"]] = range(4)
_LETTER = np.frombuffer(b"ACGT", np.uint8)
#: The base of a nibble with one bit, else -1; a byte of extensions seen from the other strand.
_ONLY = np.full(16, -1, np.int8)
_ONLY[[1, 2, 4, 8]] = range(4)
_TURNED = np.array([int(f"{e:08b}"[::-1], 2) for e in range(256)], np.int64)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as words of 32 bases, one column a word, canonical: the lesser of a row and its reverse complement."""

    def words(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), -(-rows.shape[1] // 32)), np.uint64)
        for j in range(rows.shape[1]):
            out[:, j // 32] = out[:, j // 32] << np.uint64(2) | rows[:, j]
        return out

    own, other = words(codes), words(3 - codes[:, ::-1])
    less, open_ = np.zeros(len(own), bool), np.ones(len(own), bool)
    for j in range(own.shape[1]):
        less |= open_ & (other[:, j] < own[:, j])
        open_ &= other[:, j] == own[:, j]
    own[less] = other[less]
    return own


def _follow(ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every state its end, the steps to it, the least state on the way and whether it is on a circle."""
    n = len(ahead)
    at, hops = np.where(ahead >= 0, ahead, np.arange(n)), (ahead >= 0).astype(np.int64)
    least = np.minimum(np.arange(n), at)
    for _ in range(n.bit_length()):
        on = np.flatnonzero(ahead[at] >= 0)
        if not len(on):
            break
        far = at[on]
        hops[on], least[on], at[on] = hops[on] + hops[far], np.minimum(least[on], least[far]), at[far]
    return at, hops, least, ahead[at] >= 0


def _sortable(words: np.ndarray) -> np.ndarray:
    """Rows of words as values with an order."""
    return words[:, 0] if words.shape[1] == 1 else np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel()


def _step(codes: np.ndarray, base: int, right: bool, *, whole: bool = False) -> np.ndarray:
    """K-mers with a base on one side, less that on the other side unless whole."""
    new = np.full((len(codes), 1), base, np.uint8)
    if right:
        return np.hstack([codes if whole else codes[:, 1:], new])
    return np.hstack([new, codes if whole else codes[:, :-1]])


def seen(codes: np.ndarray, exts: np.ndarray) -> np.ndarray:
    """Of the extension bits of k-mers (rows of codes) those that lead to one of the same k-mers."""
    known, out = np.sort(_sortable(_packed(codes))), np.zeros(len(codes), np.int64)
    for right in (False, True):
        for base in range(4):
            bit = 1 << (base + 4 * right)
            at = np.flatnonzero(exts & bit)
            to = _sortable(_packed(_step(codes[at], base, right)))
            place = np.searchsorted(known, to).clip(max=len(known) - 1)
            out[at[known[place] == to]] |= bit
    return out


def leaving(codes: np.ndarray, p: int) -> np.ndarray:
    """The extension bits of k-mers that lead to another bucket of minimizers of p bases (msp.hashed_score)."""
    score = msp.hashed_score(p, rc=True)

    def scores(rows: np.ndarray) -> np.ndarray:
        n = rows.shape[1] - p + 1
        ranks, mirrored = np.zeros((len(rows), n), np.int64), np.zeros((len(rows), n), np.int64)
        for j in range(p):
            ranks = ranks * 4 + rows[:, j : n + j]
            mirrored += (3 - rows[:, j : n + j].astype(np.int64)) << (2 * j)
        return score(ranks, mirrored)

    out = np.zeros(len(codes), np.int64)
    for at in range(0, len(codes), SCORED):
        part = codes[at : at + SCORED]
        all_ = scores(part)
        own = all_.min(axis=1)
        for right in (False, True):
            rest = (all_[:, 1:] if right else all_[:, :-1]).min(axis=1, initial=msp.NONE)
            for base in range(4):
                new = _step(part[:, part.shape[1] - p + 1 :] if right else part[:, : p - 1], base, right, whole=True)
                out[at : at + SCORED] |= np.where(np.minimum(rest, scores(new)[:, 0]) != own, 1 << (base + 4 * right), 0)
    return out


def joined(codes: np.ndarray, exts: np.ndarray, *, unsettled: np.ndarray | None = None, groups: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The fragments of some k-mers (rows of codes), whose links outside of these stay open: text and begin (all
    letters, and where each fragment's start), exts, members, and of the left and the right side
    the packed (k+1)-mer that leads on, if it is the only one (left, right; has_left, has_right).

    order: the k-mers, fragment by fragment; turned: whether each is read backwards; opens: where in these each
    fragment starts. At a side with unsettled bits nothing is joined, nor are k-mers of different groups."""
    n, k = codes.shape
    unsettled = np.zeros(n, np.int64) if unsettled is None else unsettled
    keys, has = np.zeros((2 * n, -(-(k + 1) // 32)), np.uint64), np.zeros(2 * n, bool)
    whole = (codes == 3 - codes[:, ::-1]).all(axis=1) if k % 2 == 0 else np.zeros(n, bool)  # palindromes have no links
    for right in (True, False):
        base = np.where(unsettled & (240 if right else 15), -1, _ONLY[exts >> 4 if right else exts & 15])
        one = np.flatnonzero((base >= 0) & ~whole)
        new = base[one].astype(np.uint8)[:, None]
        states = 2 * one + (not right)
        keys[states], has[states] = _packed(np.hstack([codes[one], new] if right else [new, codes[one]])), True
    sides = np.flatnonzero(has)
    sides = sides[np.lexsort(keys[sides].T)]
    met = (keys[sides[1:]] == keys[sides[:-1]]).all(axis=1) & (sides[1:] >> 1 != sides[:-1] >> 1)
    if groups is not None:
        met &= groups[sides[1:] >> 1] == groups[sides[:-1] >> 1]
    a, b = sides[:-1][met], sides[1:][met]
    ahead = np.full(2 * n, -1, np.int64)
    ahead[a], ahead[b] = b ^ 1, a ^ 1
    end, hops, least, circle = _follow(ahead)
    if circle.any():
        cut = circle & np.where(least % 2 == 0, ahead == least, np.arange(2 * n) == least)
        ahead[cut] = -1
        end, hops, _, _ = _follow(ahead)
    forward, back = end[1::2] ^ 1, end[::2] ^ 1  # where the walks to the right and to the left began
    turned = back < forward
    place = np.where(turned, hops[::2], hops[1::2])
    order = np.lexsort((place, np.minimum(forward, back)))
    turned, first = turned[order], place[order] == 0
    opens = np.flatnonzero(first)
    closes = np.append(opens[1:], n) - 1
    sizes = np.where(first, k, 1)
    to = np.cumsum(sizes)
    text = np.empty(int(to[-1]), np.uint8)
    text[to - 1] = np.where(turned, 3 - codes[order, 0], codes[order, -1])
    heads = codes[order[opens]]
    begin = to[opens] - k
    text[begin[:, None] + np.arange(k)] = np.where(turned[opens, None], 3 - heads[:, ::-1], heads)
    faced = np.where(turned, _TURNED[exts[order]], exts[order])
    state = 2 * order + turned
    left, right = state[opens] ^ 1, state[closes]
    return {
        "text": _LETTER[text], "begin": np.append(begin, to[-1]), "exts": faced[opens] & 15 | faced[closes] & 240, "members": closes - opens + 1,
        "left": keys[left], "has_left": has[left], "right": keys[right], "has_right": has[right], "order": order, "turned": turned, "opens": opens,
    }


def ways(codes: np.ndarray, exts: np.ndarray, unsettled: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of the fragments x of k-mers all extensions at their ends, the fragments in order: which fragment, the bit,
    the packed (k+1)-mer, whether it is unsettled."""
    order, turned, opens = x["order"], x["turned"], x["opens"]
    closes = np.append(opens[1:], len(order)) - 1
    out = []
    for right, place in ((False, opens), (True, closes)):
        row, back = order[place], turned[place]
        rows = np.where(back[:, None], 3 - codes[row][:, ::-1], codes[row])
        bits, open_ = (np.where(back, _TURNED[e[row]], e[row]) for e in (exts | unsettled, unsettled))
        for base in range(4):
            bit = 1 << (base + 4 * right)
            at = np.flatnonzero(bits & bit)
            out.append((at, np.full(len(at), bit), _packed(_step(rows[at], base, right, whole=True)), open_[at] & bit > 0))
    whole = [np.concatenate(c) for c in zip(*out)]
    by = np.argsort(whole[0], kind="stable")
    return tuple(c[by] for c in whole)


def fragments(kmers: DataFrame, k: int, *, repair: str | None = None, p: int | None = None, equal: bool = False, listed: bool = False) -> DataFrame:
    """seq, exts, members, data, left, right of k-mers (kmer as bytes, exts, data): those that meet in a
    task are joined along unbranched links.

    data are added up. With equal only k-mers of equal data are joined, and it is kept; with listed `values` are the
    data in order and `turned` tells whether each k-mer is read backwards.

    With repair, exts are the settled ones, and instead of left and right there are `ways`, all extensions at a
    fragment's ends: bit, key (the (k+1)-mer), open. p: tasks hold whole buckets of minimizers of p bases, so
    that FROM_SET leaves open only what leads to another bucket.
    """
    one_word = k < 32

    def side(x: np.ndarray, has: np.ndarray) -> pa.Array:
        if one_word:
            return pa.array(x[:, 0].view(np.int64), mask=~has)
        return pa.array([row.tobytes() if h else None for row, h in zip(x, has.tolist())], pa.binary())

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(whole: bool):
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            codes = _CODE[np.frombuffer(b"".join(rows.column("kmer").to_pylist()), np.uint8)].reshape(-1, k)
            exts, data = rows.column("exts").to_numpy().astype(np.int64), rows.column("data").combine_chunks()
            unsettled = None
            if repair:
                asked = exts if repair == CENSORED else np.full(len(exts), 255, np.int64)
                exts = seen(codes, asked)
                unsettled = asked & ~exts
                if repair == FROM_SET and whole and p:
                    unsettled &= leaving(codes, p)
            groups = data.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if equal else None
            x = joined(codes, exts, unsettled=unsettled, groups=groups)
            order, begin = x["order"], x["opens"]
            seq = pa.StringArray.from_buffers(len(begin), pa.py_buffer(x["begin"].astype(np.int32)), pa.py_buffer(x["text"]))
            columns = {"seq": seq, "exts": pa.array(x["exts"], pa.int32()), "members": pa.array(x["members"], pa.int64())}
            if listed:
                list_ = lambda values: pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), values)
                columns |= {"values": list_(data.take(pa.array(order))), "turned": list_(pa.array(x["turned"]))}
            elif equal:
                columns["data"] = data.take(pa.array(order[begin]))
            else:
                columns["data"] = pa.array(np.minimum(np.add.reduceat(data.to_numpy().astype(np.int64)[order], begin), COUNT_LIMIT), pa.int32())
            if repair:
                own, bit, key, open_ = ways(codes, exts, unsettled, x)
                entries = pa.StructArray.from_arrays([pa.array(bit, pa.int32()), side(key, np.ones(len(key), bool)), pa.array(open_)], ["bit", "key", "open"])
                columns["ways"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(begin) + 1)), pa.int32()), entries)
            else:
                columns |= {"left": side(x["left"], x["has_left"]), "right": side(x["right"], x["has_right"])}
            yield from pa.table(columns).to_batches(max_chunksize=1 << 13)

        whole = True
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                whole = False
                yield from flush(whole)
        if held:
            yield from flush(whole)

    kind = "long" if one_word else "binary"
    of = kmers.schema["data"].dataType.simpleString()
    data = f"values array<{of}>, turned array<boolean>" if listed else f"data {of if equal else 'int'}"
    outer = f"ways array<struct<bit: int, key: {kind}, open: boolean>>" if repair else f"left {kind}, right {kind}"
    return kmers.select("kmer", "exts", "data").mapInArrow(run, f"seq string, exts int, members long, {data}, {outer}")


def settled(table: DataFrame, k: int, tasks: int) -> DataFrame:
    """Fragments (id, ..., ways) with exts repaired, and left and right instead of ways: an open extension is there
    if another fragment has its (k+1)-mer open, too."""
    open_ = table.select("id", F.explode(F.filter("ways", lambda w: w["open"])).alias("w")).select("id", "w.bit", "w.key")
    # Two k-mers have a (k+1)-mer, so there are four rows of a key at most.
    met = open_.repartition(tasks, "key").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.collect_list(F.struct("id", "bit")).alias("x")).filter("a <> b")
    found = met.select(F.explode("x").alias("x")).select("x.*").repartition(tasks, "id").groupBy("id").agg(F.bit_or("bit").alias("_found"))
    closed = F.forall("ways", lambda w: ~w["open"])
    rows = table.filter(~closed).repartition(tasks, "id").join(found, "id", "left").withColumn("exts", F.col("exts").bitwiseOR(F.coalesce("_found", F.lit(0)))).drop("_found")
    rows = table.filter(closed).unionByName(rows)
    bend = (F.col("members") == 1) & S.is_palindrome("seq")  # palindromes have no links

    def only(mask: int) -> Column:
        there = F.filter("ways", lambda w: w["bit"].bitwiseAND(F.col("exts")).bitwiseAND(F.lit(mask)) != 0)
        return F.when((F.size(there) == 1) & ~bend, F.element_at(there, 1)["key"])

    return rows.withColumn("left", only(15)).withColumn("right", only(240)).drop("ways")


def links(table: DataFrame, tasks: int, *, equal: bool = False) -> DataFrame:
    """s, t, more, before of fragments (id, left, right): two sides with one (k+1)-mer are linked; with equal if their
    data is equal, too. more: whether the fragment arrived at has a way on, perhaps; before: whether the one that is
    left may be arrived at."""
    data = (F.col("data"),) if equal else ()
    sides = F.array(*[F.struct(F.col(own).alias("key"), (F.col("id") * 2 + at).alias("state"), F.col(other).isNotNull().alias("open"), *data) for own, other, at in (("right", "left", 0), ("left", "right", 1))])
    rows = table.select(F.explode(sides).alias("x")).filter("x.key is not null").select("x.key", F.struct("x.state", "x.open", *["x.data" for _ in data]).alias("x"))
    pairs = rows.repartition(tasks, "key").groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 2 and shiftright(a.state, 1) <> shiftright(b.state, 1)")
    if equal:
        pairs = pairs.filter("a.data <=> b.data")
    way = lambda a, b: F.struct(F.col(f"{a}.state").alias("s"), F.col(f"{b}.state").bitwiseXOR(F.lit(1)).alias("t"), F.col(f"{b}.open").alias("more"), F.col(f"{a}.open").alias("before"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("l")).select("l.*")


def chains(rows: DataFrame, write: Temporary, *, base: int = BASE) -> DataFrame:
    """s, end, hops of links (s, t, more, before): where the states of chains end. Circles are cut, on both
    strands, where they arrive at their least state.

    Short chains, the most, are through first: a link that is known to arrive at an end is taken over by the
    one before it and is settled, as long as that settles a quarter of the links. The rest is contracted by
    compact.chains().
    """
    counts = lambda: (F.count(F.lit(1)).alias("n"), F.sum((F.col("done") & ~F.col("before")).cast("long")).alias("settled"))
    seen = Observation()
    now = write(rows.select("s", "t", F.lit(1).cast("long").alias("hops"), (~F.col("more")).alias("done"), "before").observe(seen, *counts()), "links")
    ends, first = [now.filter("done and not before")], True
    n = seen.get["n"] - (seen.get["settled"] or 0)
    now = now.filter("before or not done")
    while n > base:
        over = (now if first else now.filter("done")).select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        met = now.filter("not done").join(over, F.col("t") == F.col("_s"), "left")
        take = F.coalesce("_done", F.lit(False))
        # In the first round all are looked up: a state without a link is an end.
        done = take | F.col("_s").isNull() if first else take
        met = met.select("s", F.when(take, F.col("_t")).otherwise(F.col("t")).alias("t"), (F.col("hops") + F.when(take, F.col("_hops")).otherwise(0)).alias("hops"), done.alias("done"), "before")
        ends.append(now.filter("done"))
        seen, was, first = Observation(), n, False
        now = write(met.observe(seen, *counts()), "links")
        n = seen.get["n"] - (seen.get["settled"] or 0)
        ends.append(now.filter("done and not before"))
        now = now.filter("before or not done")
        if 4 * n > 3 * was:
            break
    found, circles = contracted(now.select("s", "t", "hops"), write, base=base)
    out = found
    for part in ends:
        out = out.unionByName(part.select("s", F.col("t").alias("end"), "hops"))
    circles = write(circles, "circles")
    if circles.head(1):
        even = F.pmod("least", F.lit(2)) == 0
        cut = circles.filter(~((even & (F.col("t") == F.col("least"))) | (~even & (F.col("s") == F.col("least"))))).select("s", "t")
        out = out.unionByName(contracted(write(cut, "cut"), write, base=base)[0])
    return out


def _place(ends: DataFrame, tasks: int) -> DataFrame:
    """id, backward, path, pos of the fragments that have a link."""
    of = lambda side, c: F.max(F.when(F.pmod("s", F.lit(2)) == side, F.col(c)))
    rows = ends.select(F.shiftright("s", 1).alias("id"), "s", "end", "hops").repartition(tasks, "id").groupBy("id").agg(*[of(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("end", "hops")])
    end0, end1 = F.coalesce("end0", F.col("id") * 2), F.coalesce("end1", F.col("id") * 2 + 1)
    from0, from1 = end1.bitwiseXOR(F.lit(1)), end0.bitwiseXOR(F.lit(1))
    back = from1 < from0
    return rows.select("id", back.alias("backward"), F.least(from0, from1).alias("path"), F.coalesce(F.when(back, F.col("hops0")).otherwise(F.col("hops1")), F.lit(0)).alias("pos"))


#: Columns of lists in the order of a fragment's k-mers, and what makes them those of the fragment read backwards.
_LISTS = {"values": F.reverse, "turned": lambda c: F.transform(F.reverse(c), lambda x: ~x)}


def _spell(table: DataFrame, placed: DataFrame, k: int, tasks: int, *, equal: bool = False) -> DataFrame:
    """path, seq, exts, members and data or lists. Rows are dealt by path once, and put together PIECES at a time."""
    rows = table.drop("left", "right").repartition(tasks, "id").join(placed, "id", "left")
    back, pos = F.coalesce("backward", F.lit(False)), F.coalesce("pos", F.lit(0))
    seq = F.when(back, S.rc("seq")).otherwise(F.col("seq"))
    piece = F.when(pos == 0, seq).otherwise(F.substring(seq, F.lit(k), F.length(seq)))
    data = [F.when(back, _LISTS[c](F.col(c))).otherwise(F.col(c)).alias(c) if c in _LISTS else F.col(c) for c in table.columns if c in ("data", *_LISTS)]
    rows = rows.select(F.coalesce("path", F.col("id") * 2).alias("path"), pos.alias("pos"), piece.alias("seq"), F.when(back, E.rc("exts")).otherwise(F.col("exts")).alias("exts"), "members", *data)

    def put(parts: DataFrame, by: tuple[str, ...], at: str) -> DataFrame:
        in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c])
        data = [F.flatten(in_order(c)).alias(c) for c in _LISTS if c in table.columns]
        if "data" in table.columns:
            total = F.first("data") if equal else F.least(F.sum("data"), F.lit(COUNT_LIMIT)).cast("int")
            data.append(total.alias("data"))
        return parts.groupBy(*by).agg(F.array_join(in_order("seq"), "").alias("seq"), F.min_by("l", at).alias("l"), F.max_by("r", at).alias("r"), F.sum("members").alias("members"), *data)

    rows = rows.withColumn("l", F.col("exts")).withColumn("r", F.col("exts")).withColumn("block", F.floor(F.col("pos") / PIECES))
    rows = put(put(rows.repartition(tasks, "path"), ("path", "block"), "pos"), ("path",), "block")
    return rows.withColumn("exts", E.merge("l", "r")).drop("l", "r")


def rotated(nodes: DataFrame, k: int) -> DataFrame:
    """nodes (seq, exts, members, ...), circles cut before their least k-mer, which is read forwards."""
    seq, exts, size = F.col("seq"), F.col("exts"), F.col("members").cast("int")
    circle = (size > 1) & (F.left(seq, F.lit(k - 1)) == F.right(seq, F.lit(k - 1))) & (F.substring(seq, size, F.lit(1)) == E.unique(exts, False)) & (F.substring(seq, k, 1) == E.unique(exts, True))

    def start(text: Column) -> Column:
        """The least k-mer of a text, where it is, and the text."""
        return F.array_min(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.substring(text, i, F.lit(k)).alias("kmer"), i.alias("i"))))

    rows = nodes.withColumn("_own", F.when(circle, start(seq))).withColumn("_other", F.when(circle, start(S.rc(seq))))
    ahead = F.col("_own.kmer") <= F.col("_other.kmer")
    text, at = F.when(ahead, seq).otherwise(S.rc(seq)), F.when(ahead, F.col("_own.i")).otherwise(F.col("_other.i"))
    once = F.concat(F.substring(text, at, size - at + 1), F.substring(text, F.lit(1), at - 1))
    # A circle may be shorter than a k-mer: then it is read more than once round.
    again = F.left(F.repeat(once, F.ceil((size + (k - 1)) / size).cast("int")), size + (k - 1))
    for c in _LISTS:
        if c in nodes.columns:
            turned = F.when(ahead, F.col(c)).otherwise(_LISTS[c](F.col(c)))
            rows = rows.withColumn(c, F.when(F.col("_own").isNull(), F.col(c)).otherwise(F.concat(F.slice(turned, at, size - at + 1), F.slice(turned, F.lit(1), at - 1))))
    rows = rows.withColumn("seq", F.when(F.col("_own").isNull(), seq).otherwise(again))
    sides = E.bit(F.substring(F.col("seq"), size, F.lit(1)), False).bitwiseOR(E.bit(F.substring("seq", k, 1), True))
    return rows.withColumn("exts", F.when(F.col("_own").isNull(), exts).otherwise(sides)).select(nodes.columns)


def _folded(nodes: DataFrame, ordered: dict[str, Ordered]) -> DataFrame:
    """nodes with reductions of their lists in the order of the path."""

    def reduced(o: Ordered) -> Column:
        return fold(F.zip_with("values", "turned", lambda x, back: F.when(back, o.turn(o.of(x))).otherwise(o.of(x))), o.merge)

    return nodes.withColumns({name: reduced(o) for name, o in ordered.items()}).drop(*_LISTS)


def unitigs(sequences: DataFrame, k: int, summarizer: Summarizer, *, repair: str | None = None, data: Column | None = None, equal: bool = False, ordered: dict[str, Ordered] | None = None, base: int = BASE) -> DataFrame:
    """The nodes that compact.compress_kmers() makes of the k-mers that summarizer keeps, without strands, with
    the counts in data added up; ids and directions are other ones. The result is written.

    repair: of the extensions before, CENSORED as kmers.remove_censored_exts() or FROM_SET as kmers.exts_from_set().
    data: what is made of the summary (data). equal: only k-mers with equal data are joined, as by
    compact.equal_data_compression(). ordered: instead of a sum, the data of a path folded in its order.
    """
    spark = sequences.sparkSession

    def finish(p: int | None):
        def run(part: DataFrame) -> DataFrame:
            part = part if data is None else part.withColumn("data", data)
            return fragments(part, k, repair=repair, p=p, equal=equal, listed=bool(ordered))

        return run

    with Temporary(spark, "fragments") as write:
        observed = Observation()
        counts = [F.count(F.lit(1)).alias("n"), *([F.sum(F.size(F.filter("ways", lambda w: w["open"]))).alias("open")] if repair else [])]
        found = segment_counts.filter_kmers(sequences, k, summarizer, finish=finish(segment_counts.minimizer_size(k)), finish_rest=finish(None), write=lambda df, name: write(df.withColumn("id", F.monotonically_increasing_id()).observe(observed, *counts), name))
        n, asked = observed.get["n"], observed.get.get("open") or 0
        if repair:
            old, found = found, write(settled(found, k, at_least(spark, max(n, asked) // ROWS)), "settled")
            write.drop(old)
        tasks = at_least(spark, n // ROWS)
        placed = _place(chains(links(found, tasks, equal=equal), write, base=base), tasks)
        # Fragments that lead nowhere on either side are whole.
        open_ = "left is not null or right is not null"
        whole = found.filter("left is null and right is null").withColumn("path", F.col("id") * 2).drop("id", "left", "right")
        nodes = rotated(whole.unionByName(_spell(found.filter(open_), placed, k, tasks, equal=equal)), k)
        nodes = _folded(nodes, ordered) if ordered else nodes
        return written(nodes.select(F.col("path").alias("node_id"), "seq", F.length("seq").alias("len"), "exts", "members", *(ordered or ["data"])), "unitigs")
