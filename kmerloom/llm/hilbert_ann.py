"""Approximate nearest neighbours by many shifted Hilbert orderings.

Vectors are projected to some dimensions, once per curve with a projection and a shift of its own,
and placed on a Hilbert curve. Spark range-partitions (curve, key) and sorts; what travels along a
curve is a vector's number and a sketch of a byte per component. A task reads its part in windows
of rows: a query is compared, by sketch, with its own window and the ones before and after it. The
best of each curve are merged, and the best of these are ranked by the exact inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, materialize


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points [n, dims] with `bits` bits each (bits * dims <= 62).

    The transform of J. Skilling (2004), for all points at once.
    """
    x = np.ascontiguousarray(cells.astype(np.int64).T)
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        mask = level - 1
        for i in range(dims):
            inverted = (x[i] & level) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(inverted, mask, swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _projections(width: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    frames = [np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0] for _ in range(curves)]
    return np.stack(frames), rng.uniform(0, 0.25, size=(curves, min(dims, width)))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def sketches(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: a float32 scale, and the components in steps of it."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return np.concatenate([scale.astype("<f4").view(np.uint8).reshape(-1, 4), codes.view(np.uint8)], axis=1)


def from_sketches(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def best_of(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the `keep` largest, and their ids (one list, or one for each row)."""
    take = min(keep, scores.shape[1])
    at = np.argpartition(-scores, take - 1, axis=1)[:, :take]
    return np.take_along_axis(scores, at, 1), np.take_along_axis(np.broadcast_to(ids, scores.shape), at, 1)


class Curve:
    """Reads rows (rep, asked, sketch) in the order of a curve, `window` rows at a time; keeps the best
    of each query among its own window and the neighbouring ones."""

    def __init__(self, window: int, keep: int):
        self.window, self.keep, self.held, self.size = window, keep, [], 0
        self.before = self.pending = self.head = None
        self.pairs = 0

    def feed(self, rep: np.ndarray, asked: np.ndarray, raw: np.ndarray):
        self.held.append((rep, asked, raw))
        self.size += len(rep)
        if self.size >= self.window:
            rep, asked, raw = (np.concatenate(x) for x in zip(*self.held))
            whole = len(rep) - len(rep) % self.window
            for at in range(0, whole, self.window):
                yield from self.step(*(x[at : at + self.window] for x in (rep, asked, raw)))
            self.held, self.size = [(rep[whole:], asked[whole:], raw[whole:])], len(rep) - whole

    def step(self, rep, asked, raw):
        x = from_sketches(raw)
        if self.head is None:
            self.head = rep, asked, raw
        if self.pending is not None:
            ids, q, best, found = self.pending
            score, found2 = best_of(q @ x.T, rep, self.keep)
            self.pairs += len(ids) * len(rep)
            score, found = best_of(np.concatenate([best, score], 1), np.concatenate([found, found2], 1), self.keep)
            yield ids, found, score
        own, all_rep, all_x = np.flatnonzero(asked), rep, x
        if self.before is not None:
            all_rep, all_x = np.concatenate([self.before[0], rep]), np.concatenate([from_sketches(self.before[2]), x])
        self.pending = None
        if len(own):
            self.pairs += len(own) * len(all_rep)
            self.pending = rep[own], x[own], *best_of(x[own] @ all_x.T, all_rep, self.keep)
        self.before = rep, asked, raw

    def close(self):
        if self.size:
            yield from self.step(*(np.concatenate(x) for x in zip(*self.held)))
        if self.pending is not None:
            ids, _, best, found = self.pending
            yield ids, found, best


FOUND = "query_rep long, rep long, score float, curve int, part int, tail boolean, reps binary, asks binary, rows binary, pairs long"
_KINDS = [pa.int64(), pa.int64(), pa.float32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _found(ids: np.ndarray, found: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    n = found.size
    columns = [np.repeat(ids, found.shape[1]), found.ravel(), score.ravel().astype(np.float32)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)] + [pa.nulls(n, k) for k in _KINDS[3:]], names=_NAMES)


def nearest_neighbours(
    vectors: DataFrame,
    *,
    k: int = 20,
    query_modulus: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    curves: int = 72,
    dims: int = 12,
    window_share: float = 0.0032,
    window_rows: int | None = None,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id query_modulus divides.

    Every valid row is indexed and a candidate. Equal vectors are indexed once with their k + 1
    smallest ids, which is all that a ranking with ties to the smaller id can need, so a vector
    held by a third of the rows costs as much as any other.

    A query is compared with at most 3 * window rows on each curve. window_rows sets the window: work
    is then linear in the rows, which suits vectors with structure. By default it is the share
    window_share of the rows (8 at least): vectors without structure, as the given ones, have no near
    neighbours to speak of, and recall depends on the share of the rows examined (3 * window_share *
    curves, 0.69 of an exact search). Up to 4 * (k + 1) different vectors, and
    any number with window_rows = number of rows, are one window: an exact search.

    Rows whose vector is null, empty, zero, of another width than most, or has null or non-finite
    components take no part, nor do rows with a null id; repeated rows count once. An empty table
    gives none.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "ann") as write:
        prepared = _distinct(vectors, k=k, query_modulus=query_modulus, vec_id=vec_id, embedding=embedding, write=write)
        if prepared is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        distinct, asked, width = prepared
        rows = distinct.count()
        window = rows if rows <= 4 * (k + 1) else window_rows or max(8, int(np.ceil(window_share * rows)))
        found = write(_candidates(distinct, rows, width, k=k, curves=curves, dims=dims, window=window, seed=seed, write=write), "found")
        return materialize(_ranked(distinct, asked, found, k=k), "ann-result")


def _distinct(vectors: DataFrame, *, k: int, query_modulus: int, vec_id: str, embedding: str, write):
    """distinct (rep, ids, v, asks), asked (vec_id, v) and the width; None without a valid vector."""
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    base = base.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0))
    widths = base.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return None
    base = base.filter(F.size("v") == widths["w"])
    smallest = Window.partitionBy("v").orderBy("vec_id")
    distinct = base.withColumn("_r", F.dense_rank().over(smallest)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    asked = base.filter(F.pmod("vec_id", F.lit(query_modulus)) == 0).distinct()
    distinct = distinct.join(asked.groupBy("v").agg(F.count(F.lit(1)).alias("asks")), "v", "left")
    distinct = write(distinct.select(F.col("ids")[0].alias("rep"), "ids", "v", F.coalesce("asks", F.lit(0)).alias("asks")), "distinct")
    return distinct, asked, widths["w"]


def _candidates(distinct: DataFrame, rows: int, width: int, *, k: int, curves: int, dims: int, window: int, seed: int, write) -> DataFrame:
    """query_rep, rep: the best 3 * (k + 1) by sketch of what each query met on any curve."""
    keep = k + 5
    frames, shifts = _projections(width, curves, dims, seed)
    dims = frames.shape[2]
    bits = min(15, 60 // dims)
    flat = np.ascontiguousarray(frames.transpose(1, 0, 2)).reshape(width, -1)

    @lean
    def moments(batches):
        n, s, ss = 0, np.zeros(curves * dims), np.zeros(curves * dims)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column("v")) @ flat
                n, s, ss = n + len(y), s + y.sum(0), ss + (y * y).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"axis": np.arange(curves * dims), "n": np.full(curves * dims, n), "s": s, "ss": ss})

    # A row for each curve and dimension.
    stats = distinct.select("v").mapInArrow(moments, "axis long, n long, s double, ss double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("axis").collect()
    mean = np.array([r["s"] / r["n"] for r in stats])
    spread = np.sqrt(np.maximum(np.array([r["ss"] / r["n"] for r in stats]) - mean**2, 0)) + 1e-12

    @lean
    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"))
                y = ((x @ flat - mean) / spread / 8 + 0.5).reshape(len(x), curves, dims) + shifts / 4
                cells = np.clip(y * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                codes = pa.array([r.tobytes() for r in sketches(x)], pa.binary())
                for c in range(curves):
                    key = hilbert_keys(cells[:, c], bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key), part.column("rep"), part.column("asked"), codes], ["curve", "key", "rep", "asked", "code"])

    placed = distinct.select("rep", (F.col("asks") > 0).alias("asked"), "v").mapInArrow(place, "curve int, key long, rep long, asked boolean, code binary")
    ordered = placed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")

    def pack(curve, part, tail, rows, pairs):
        values = [None, None, None, curve, part, tail, rows[0].tobytes(), rows[1].astype(np.uint8).tobytes(), rows[2].tobytes(), pairs]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], names=_NAMES)

    @lean
    def scan(batches):
        part, now, walk = TaskContext.get().partitionId(), None, None

        def end():
            for x in walk.close():
                yield _found(*x)
            yield pack(now, part, False, walk.head, walk.pairs)
            yield pack(now, part, True, walk.before, 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            curve, rep, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "rep", "asked"))
            raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
            cuts = [0, *(np.flatnonzero(np.diff(curve)) + 1).tolist(), len(rep)]
            for a, b in zip(cuts, cuts[1:]):
                if curve[a] != now:
                    if walk is not None:
                        yield from end()
                    now, walk = int(curve[a]), Curve(window, keep)
                for x in walk.feed(rep[a:b], asked[a:b], raw[a:b]):
                    yield _found(*x)
        if walk is not None:
            yield from end()

    seen = write(ordered.mapInArrow(scan, FOUND), "seen")
    # Windows that a border between tasks cuts: the last rows of a part meet the first of the next.
    border = seen.filter("curve is not null").withColumn("at", F.dense_rank().over(Window.partitionBy("curve").orderBy("part")))
    last = border.filter("tail").select("curve", (F.col("at") + 1).alias("at"), *[F.col(c).alias(f"l_{c}") for c in ("reps", "asks", "rows")])
    meet = border.filter("not tail").join(last, ["curve", "at"]).select("reps", "asks", "rows", "l_reps", "l_asks", "l_rows")

    @lean
    def across(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sides = [(np.frombuffer(row[p + "reps"], np.int64), np.frombuffer(row[p + "asks"], np.uint8) > 0, np.frombuffer(row[p + "rows"], np.uint8)) for p in ("", "l_")]
                (a, ask_a, x), (b, ask_b, y) = [(r, ask, from_sketches(raw.reshape(len(r), -1))) for r, ask, raw in sides]
                for ids, ask, q, others, z in ((a, ask_a, x, b, y), (b, ask_b, y, a, x)):
                    if ask.any():
                        score, found = best_of(q[ask] @ z.T, others, keep)
                        yield _found(ids[ask], found, score)

    both = seen.filter("query_rep is not null").unionByName(meet.mapInArrow(across, FOUND)).groupBy("query_rep", "rep").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
    return both.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= 3 * (k + 1)).select("query_rep", "rep")


def _ranked(distinct: DataFrame, asked: DataFrame, found: DataFrame, *, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of asked (vec_id, v) from candidates found (query_rep, rep). The
    score is summed in one fixed order over the original components."""
    by_rep = distinct.select("rep", "ids", "v")
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = found.join(by_rep, "rep").join(by_rep.select(F.col("rep").alias("query_rep"), F.col("v").alias("qv")), "query_rep").select("query_rep", exact.alias("score"), F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    scored = scored.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k + 1)
    lists = scored.groupBy("query_rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    lists = distinct.filter("asks > 0").select(F.col("rep").alias("query_rep"), "v", "asks").join(lists, "query_rep").select("v", "asks", "near")
    # Vectors that many queries share are few (fewer than 50,000): they are broadcast, their queries stay.
    many = max(256, (distinct.agg(F.sum("asks")).first()[0] or 0) // 50_000)
    hot, rest = F.broadcast(lists.filter(F.col("asks") > many)), lists.filter(F.col("asks") <= many)
    of = asked.join(hot, "v").unionByName(asked.join(F.broadcast(lists.filter(F.col("asks") > many).select("v")), "v", "left_anti").join(rest, "v"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = of.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
