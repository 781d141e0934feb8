"""Path compaction: k-mers or nodes joined along unbranched links.

An element (k-mer or node) is walked forwards, leaving on the right, or backwards, leaving on the
left: state 2 * id or 2 * id + 1. A link takes a state to at most one other, and the mirror image
of a link is a link, so the states form chains and circles. They are contracted, in rounds that each
leave three quarters of the links, until one task can follow what is left; no walk along a whole
path and no visited set exists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import exts as E
from ..functions import seq as S
from .kmers import COUNT_LIMIT, exts_from_set
from .tables import Temporary, starts, written

#: Links that one task follows in memory (32 bytes each).
BASE = 1 << 20
#: Pieces of a path that are put together at a time.
PIECES = 4096


@dataclass(frozen=True)
class Ordered:
    """A reduction in path order: of(data) of the first member, merged with that of the next, and so on.

    merge must be associative, and need not be commutative. turn makes of an element's value that of
    the same element read backwards (by default the same).
    """

    of: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    turn: Callable[[Column], Column] = lambda x: x


@dataclass(frozen=True)
class Compression:
    """How node data merge: aggregates over the members' `data`, and whether neighbours may join.

    The aggregates must not depend on order; where the order matters, `ordered` names reductions that
    are folded along the path. join_test must be symmetric.
    """

    reduce: dict[str, Column] = field(default_factory=lambda: {"data": F.least(F.sum("data"), F.lit(COUNT_LIMIT)).cast("int")})
    join_test: Callable[[Column, Column], Column] = lambda a, b: F.lit(True)
    ordered: dict[str, Ordered] = field(default_factory=dict)


def simple_compression(**reduce: Column) -> Compression:
    return Compression(reduce) if reduce else Compression()


def equal_data_compression() -> Compression:
    """Joins only elements with equal data, and keeps that."""
    return Compression({"data": F.first("data")}, lambda a, b: a.eqNullSafe(b))


def solve(links: DataFrame) -> DataFrame:
    """s, end, hops, least of weighted links (s, t, hops, least), of which there are at most BASE: one task
    takes them all. end is null on circles, of which least is the least of all of theirs."""

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        s, t, hops, least = (rows.column(c).to_numpy() for c in ("s", "t", "hops", "least"))
        order = np.argsort(s)
        s, t, hops, least = s[order], t[order], hops[order], least[order]
        at = np.searchsorted(s, t).clip(max=len(s) - 1)
        ahead = np.where(s[at] == t, at, -1)  # the place of the row that goes on from t
        for _ in range(len(s).bit_length()):
            on = np.flatnonzero(ahead >= 0)
            far = ahead[on]
            hops[on], least[on], t[on] = hops[on] + hops[far], np.minimum(least[on], least[far]), t[far]
            ahead[on] = ahead[far]
        circle = ahead >= 0
        out = pa.table({"s": s, "end": pa.array(t, mask=circle), "hops": hops, "least": least})
        yield from out.to_batches(max_chunksize=1 << 16)

    return links.select("s", "t", "hops", "least").repartition(1).mapInArrow(run, "s long, end long, hops long, least long")


def chains(links: DataFrame, write: Temporary, *, base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """From links (s, t): (s, end, hops) of the states on chains, and (s, t, least) of those on circles. A link
    may come with hops of its own, else it has one.

    Contraction by random mates: each state tosses a coin in each round, and one with heads whose
    successor has tails leaves, its link taken over by its predecessor (which stays, as its own
    successor has heads). So a quarter of the links leaves in a round, and all rounds together write
    four times the links. What is left fits one task, which follows it in memory; those that left
    come back in reverse order, each with what its successor has found.
    """
    left: list[DataFrame] = []
    seen = Observation()
    hops = F.col("hops") if "hops" in links.columns else F.lit(1).cast("long").alias("hops")
    now = links.select("s", "t", hops, F.least("s", "t").alias("least"))
    now = write(now.observe(seen, F.count(F.lit(1)).alias("n")), "chains")
    n = seen.get["n"]
    while n > base:
        coin = lambda state: F.xxhash64(state, F.lit(len(left))).bitwiseAND(F.lit(1)) == 1  # noqa: B023, E731
        # A link that has come round to its own state is a circle, and settled.
        leaves = (coin(F.col("s")) & ~coin(F.col("t"))) | (F.col("s") == F.col("t"))
        gone = write(now.filter(leaves), "chains-left")
        over = gone.select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        kept = now.filter(~leaves).join(over, F.col("t") == F.col("_s"), "left")
        kept = kept.select("s", F.coalesce("_t", "t").alias("t"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.least("least", "_least").alias("least"))
        seen = Observation()
        old, now = now, write(kept.observe(seen, F.count(F.lit(1)).alias("n")), "chains")
        n = seen.get["n"]
        write.drop(old)
        left.append(gone)
    found = write(solve(now), "chains-found")
    write.drop(now)
    for gone in reversed(left):
        far = found.select(F.col("s").alias("_s"), "end", F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        back = gone.join(far, F.col("t") == F.col("_s"), "left")
        # A successor without a row of its own is an end.
        back = back.select("s", F.when(F.col("_s").isNull() & (F.col("s") != F.col("t")), F.col("t")).otherwise(F.col("end")).alias("end"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("_least", "least").alias("least"))
        old, found = found, write(found.unionByName(back), "chains-found")
        write.drop(old), write.drop(gone)
    circles = found.filter("end is null").select("s", "least").join(links.select("s", "t"), "s").select("s", "t", "least")
    return found.filter("end is not null").select("s", "end", "hops"), circles


def paths(elements: DataFrame, links: DataFrame, write: Temporary, *, stranded: bool = False, base: int = BASE) -> DataFrame:
    """id, backward, path, pos for every element (id): its path, its place in it and whether the path
    walks it backwards. A path starts at the lesser of its two ends, with strands always at the one
    that is walked forwards; a circle is cut before its least element, which is walked forwards."""
    mirrored = links.select(F.col("t").bitwiseXOR(F.lit(1)).alias("s"), F.col("s").bitwiseXOR(F.lit(1)).alias("t"))
    both = links.select("s", "t").withColumn("own", F.lit(1)).unionByName(mirrored.withColumn("own", F.lit(0)))
    links = both.groupBy("s", "t").agg(F.max("own").alias("x"), F.min("own").alias("y")).filter("x <> y").select("s", "t")
    links = write(links, "links")
    ends, circles = chains(links, write, base=base)
    circles = write(circles, "circles")
    if circles.head(1):
        even = F.pmod("least", F.lit(2)) == 0
        cut = circles.filter(~((even & (F.col("t") == F.col("least"))) | (~even & (F.col("s") == F.col("least"))))).select("s", "t")
        ends = ends.unionByName(chains(write(cut, "cut"), write, base=base)[0])
    side = lambda b: ends.filter(F.pmod("s", F.lit(2)) == b).select(F.shiftright("s", 1).alias("id"), F.col("end").alias(f"end{b}"), F.col("hops").alias(f"hops{b}"))
    rows = elements.select("id").join(side(0), "id", "left").join(side(1), "id", "left")
    end0, end1 = F.coalesce("end0", F.col("id") * 2), F.coalesce("end1", F.col("id") * 2 + 1)
    from0, from1 = end1.bitwiseXOR(F.lit(1)), end0.bitwiseXOR(F.lit(1))  # where the forward and the backward walk began
    back = F.lit(False) if stranded else from1 < from0
    return rows.select("id", back.alias("backward"), (from0 if stranded else F.least(from0, from1)).alias("path"), F.coalesce(F.when(back, F.col("hops0")).otherwise(F.col("hops1")), F.lit(0)).alias("pos"))


def fold(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """An array folded from its first element on."""
    return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), merge)


def spell(elements: DataFrame, placed: DataFrame, k: int, spec: Compression) -> DataFrame:
    """nodes(node_id, seq, len, exts, data) from elements (id, seq, exts, data) and their places.

    Pieces are put together, and ordered values folded, PIECES at a time before whole paths are, which
    bounds what is sorted.
    """
    rows = elements.join(placed, "id")
    oriented = F.when(F.col("backward"), S.rc("seq")).otherwise(F.col("seq"))
    turned = F.when(F.col("backward"), E.rc("exts")).otherwise(F.col("exts"))
    rows = rows.withColumn("_piece", F.when(F.col("pos") == 0, oriented).otherwise(F.substring(oriented, F.lit(k), F.length(oriented)))).withColumn("_e", turned)
    for name, o in spec.ordered.items():
        own = o.of(F.col("data"))
        rows = rows.withColumn(f"_o_{name}", F.when(F.col("backward"), o.turn(own)).otherwise(own))
    rows = rows.withColumn("_block", F.floor(F.col("pos") / PIECES))
    listed = lambda c, at: F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c])
    join = lambda c, at: F.array_join(listed(c, at), "")
    folds = lambda at: [fold(listed(f"_o_{n}", at), o.merge).alias(f"_o_{n}") for n, o in spec.ordered.items()]
    parts = rows.groupBy("path", "_block").agg(join("_piece", "pos").alias("_piece"), *folds("pos"))
    whole = parts.groupBy("path").agg(join("_piece", "_block").alias("seq"), *folds("_block"))
    sums = rows.groupBy("path").agg(F.min_by("_e", "pos").alias("_l"), F.max_by("_e", "pos").alias("_r"), F.count(F.lit(1)).alias("members"), *[c.alias(n) for n, c in spec.reduce.items()])
    nodes = whole.join(sums, "path").withColumn("exts", E.merge("_l", "_r"))
    return nodes.select(F.col("path").alias("node_id"), "seq", F.length("seq").alias("len"), "exts", "members", *spec.reduce, *[F.col(f"_o_{n}").alias(n) for n in spec.ordered])


def with_ids(kmers: DataFrame, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """k-mers with an id that follows their order (a range partition, numbered part by part)."""
    return write(kmers.repartitionByRange("kmer").sortWithinPartitions("kmer").withColumn("id", F.monotonically_increasing_id()), "kmers")


def in_order(kmers: DataFrame) -> DataFrame:
    """K-mers with their place in lexicographic order, from 0, as column `place`."""
    return kmers.join(starts(kmers.select(F.col("kmer").alias("id"), F.lit(1).alias("size"))).select(F.col("id").alias("kmer"), F.col("start").alias("place")), "kmer")


def kmer_links(kmers: DataFrame, *, stranded: bool, join_test) -> DataFrame:
    """s, t of each k-mer and side with one extension, to a k-mer with one on the side arrived at.

    Without strands a palindrome has no links. A k-mer is not linked with itself.
    """
    sides = F.array(*[F.struct(F.lit(right).alias("right"), E.unique("exts", right).alias("base")) for right in (False, True)])
    out = kmers.select("id", "kmer", "data", F.explode(sides).alias("x")).filter("x.base is not null")
    right = F.col("x.right")
    step = S.extend("kmer", F.col("x.base"), right)
    if stranded:
        out = out.withColumn("next", step).withColumn("flip", F.lit(False))
    else:
        out = out.filter(~S.is_palindrome("kmer")).withColumn("step", step).withColumn("next", S.canonical("step")).withColumn("flip", F.col("step") >= S.rc("step"))
    arrive_right = (~right) != F.col("flip")
    to = kmers.select(F.col("id").alias("vid"), F.col("kmer").alias("next"), F.col("exts").alias("vexts"), F.col("data").alias("vdata"))
    met = out.join(to, "next").filter((F.col("id") != F.col("vid")) & (E.count("vexts", arrive_right) == 1) & join_test(F.col("data"), F.col("vdata")))
    if not stranded:
        met = met.filter(~S.is_palindrome("next"))
    return met.select((F.col("id") * 2 + (~right).cast("int")).alias("s"), (F.col("vid") * 2 + arrive_right.cast("int")).alias("t"))


def compress_kmers(kmers: DataFrame, k: int, *, stranded: bool = False, spec: Compression | None = None) -> DataFrame:
    """nodes of a k-mer table (kmer, exts, data): its unbranched paths, spelled.

    The outer exts of a node are those of its end k-mers, in the node's frame, whether or not
    their targets are in the table.
    """
    spec = spec or Compression()
    with Temporary(kmers.sparkSession, "compact") as write:
        table = with_ids(kmers.select("kmer", "exts", "data"), write)
        placed = paths(table, kmer_links(table, stranded=stranded, join_test=spec.join_test), write, stranded=stranded)
        return written(spell(table.withColumnRenamed("kmer", "seq"), placed, k, spec), "unitigs")


def compress_kmers_no_exts(kmers: DataFrame, k: int, *, spec: Compression | None = None) -> DataFrame:
    """As compress_kmers, with extensions taken from membership in the table."""
    return compress_kmers(exts_from_set(kmers.select("kmer", "data").withColumn("exts", F.lit(0))), k, spec=spec)
