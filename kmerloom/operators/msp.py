"""Minimum-substring partitioning: sequences in segments whose k-mers share a minimizer.

The segments of a sequence follow a walk from minimizer to minimizer, and a step of it depends on the
p-mer that it starts from alone. So steps are computed for all p-mers at once, a sequence is cut into
pieces that different tasks walk along, and where the walk enters a piece follows from what each
piece makes of every place at which it may be entered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq as S
from .tables import Temporary, written

_CODE = np.zeros(256, np.int64)
_CODE[[ord(b) for b in "ACGT"]] = range(4)
#: A score is given the ranks of p-mers and those of their reverse complements.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: P-mers of a piece of a sequence.
PIECE = 1 << 14
#: Bases that a task holds in arrays at a time.
BASES_AT_ONCE = 1 << 18
#: What no score reaches: the place is no p-mer.
NONE = np.iinfo(np.int64).max


def permutation_score(permutation: list[int] | None = None, *, rc: bool = False) -> Score:
    """The place of a p-mer in a permutation (by default its rank), or the lesser of its own and its
    reverse complement's."""

    def score(ranks: np.ndarray, mirrored: np.ndarray) -> np.ndarray:
        table = None if permutation is None else np.asarray(permutation, np.int64)
        own = ranks if table is None else table[ranks]
        return np.minimum(own, mirrored if table is None else table[mirrored]) if rc else own

    return score


def hashed_score(p: int, *, rc: bool = False) -> Score:
    """A fixed shuffled order of the p-mers. In lexicographic order a few p-mers (AAAA...) win nearly
    everywhere; in this one buckets are about as even as the p-mers are frequent."""
    mask, half = (1 << 2 * p) - 1, p

    def mix(ranks: np.ndarray) -> np.ndarray:
        # Each step maps the ranks onto themselves.
        for odd in (0x9E3779B1, 0x85EBCA6B):
            ranks = ranks * odd & mask
            ranks = ranks ^ ranks >> half
        return ranks

    def score(ranks: np.ndarray, mirrored: np.ndarray) -> np.ndarray:
        return np.minimum(mix(ranks), mix(mirrored)) if rc else mix(ranks)

    return score


def pmer_ranks(seq: str, p: int) -> tuple[np.ndarray, np.ndarray]:
    codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = max(len(codes) - p + 1, 0)
    ranks, mirrored = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(p):
        ranks = ranks * 4 + codes[j : n + j]
        mirrored += (3 - codes[j : n + j]) << (2 * j)
    return ranks, mirrored


def steps(scores: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the minimizer at each p-mer, how far ahead the next one is (0: there is none) and at which
    k-mer its run begins, counted from the p-mer. window: p-mers of a k-mer.

    A p-mer that enters takes over only if it is strictly less; when the minimizer leaves, the fresh
    window takes its right-most minimum.
    """
    n = len(scores)
    ahead = np.concatenate([scores, np.full(window + 1, NONE)])
    less = np.zeros(n, np.int64)
    for d in range(window - 1, 0, -1):
        less[ahead[d : n + d] < scores] = d
    least, place = ahead[1 : n + 1].copy(), np.ones(n, np.int64)
    for d in range(2, window + 1):
        takes = ahead[d : n + d] <= least
        place[takes] = d
        np.minimum(least, ahead[d : n + d], out=least)
    fresh = np.where(ahead[window : n + window] != NONE, place, 0)
    return np.where(less > 0, less, fresh), np.where(less > 0, less - window + 1, 1)


def entry(scores: np.ndarray, window: int) -> int:
    """The first minimizer of a sequence: the right-most minimum of its first k-mer."""
    return window - 1 - int(np.argmin(scores[:window][::-1]))


def minimizer_runs(scores: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first k-mer, place of its minimizer) of each run of one whole sequence."""
    jump, first = steps(scores, window)
    at, out = entry(scores, window), []
    begin = 0
    while True:
        out.append((begin, at))
        if not jump[at]:
            return out
        at, begin = at + int(jump[at]), at + int(first[at])


def _pieces(sequences: DataFrame, k: int, p: int, keep: tuple[str, ...]) -> DataFrame:
    """Parts of sequences with what their walks look at around them: text from the sequence's base `at`
    on, whose own p-mers are lo to hi - 1; n, the sequence's length; key, which sequence it is."""
    n, lo = F.length("seq"), F.col("lo")
    window = k - p + 1
    rows = sequences.filter(n >= k).select("seq_id", *keep, "seq", F.explode(F.sequence(F.lit(0), n - p, F.lit(PIECE))).alias("lo"))
    at = F.greatest(lo - window - 1, F.lit(0))
    text = F.substring("seq", at + 1, F.least(lo + PIECE + 2 * window + k + 2, n) - at)
    key = F.when(n - p + 1 > PIECE, F.xxhash64("seq_id", "seq"))
    return rows.select("seq_id", *keep, key.alias("key"), F.floor(lo / PIECE).cast("int").alias("piece"), text.alias("text"), at.alias("at"), lo, F.least(lo + PIECE, n - p + 1).alias("hi"), n.alias("n"))


def _together(batches):
    """Arrow batches in parts of about BASES_AT_ONCE bases."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(batch.column("n")).clip(max=2 * PIECE))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BASES_AT_ONCE)))
            yield batch.slice(at, to - at)
            at = to


def _scored(batch, p: int, window: int, score: Score):
    """All texts in one string, so far apart that no window sees two of them; where each begins; the ranks
    of p-mers, mirrored too; their scores."""
    texts = batch.column("text").to_pylist()
    gap = "A" * window
    whole = gap.join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + window) - sizes - window
    ranks, mirrored = pmer_ranks(whole, p)
    border = np.zeros(len(ranks) + p + window + 1, np.int64)
    border[begins] += 1
    border[begins + sizes - p + 1] -= 1
    return whole, begins, ranks, mirrored, np.where(np.cumsum(border)[: len(ranks)] > 0, score(ranks, mirrored), NONE)


def _entries(pieces: DataFrame, k: int, p: int, score: Score) -> DataFrame:
    """key, piece, entry (the walk's first p-mer in the piece, null if it has ended), before (runs that
    begin in earlier pieces) of the pieces of long sequences but the first ones.

    For each piece `exits` says where a walk leaves it (counted from the next piece) that enters it at
    its first p-mer, its second, ... Such tables are composed piece by piece, in rounds that double
    the way; walks soon meet, so nearly all tables have one exit only, which needs no round.
    """
    window = k - p + 1

    def run(batches):
        for whole_batch in batches:
            for batch in _together([whole_batch]):
                _, begins, _, _, scores = _scored(batch, p, window, score)
                jump, _ = steps(scores, window)
                exits, counts = [], []
                for begin, at, lo, hi in zip(begins.tolist(), *(batch.column(c).to_pylist() for c in ("at", "lo", "hi"))):
                    shift = begin - at
                    now = np.arange(window) + lo + shift if lo else np.full(window, entry(scores[shift : shift + window], window) + shift)
                    passed, count = now >= hi + shift, np.zeros(window, np.int64)
                    ended = np.zeros(window, bool)
                    while not (passed | ended).all():
                        on = np.flatnonzero(~(passed | ended))
                        by = jump[now[on]]
                        now[on] += by
                        count[on] += by > 0
                        ended[on] = by == 0
                        passed[on] = now[on] >= hi + shift
                    exits.append(np.where(ended, -1, now - hi - shift))
                    counts.append(count)
                lists = [pa.array([x.tolist() for x in c], pa.list_(pa.int32())) for c in (exits, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), *lists], names=["key", "piece", "exits", "counts"])

    with Temporary(pieces.sparkSession, "msp") as write:
        long = pieces.filter("key is not null").dropDuplicates(["key", "piece"]).select("key", "piece", "text", "at", "lo", "hi", "n")
        tables = write(long.mapInArrow(run, "key long, piece int, exits array<int>, counts array<int>"), "exits")
        if not tables.head(1):
            return None
        one = F.array_min("exits") == F.array_max("exits")
        reach = write(tables.select("key", "piece", "exits", F.when(one, 0).otherwise(F.col("piece")).alias("from")), "reach")
        while reach.filter("`from` > 0").head(1):
            before = reach.select("key", (F.col("piece") + 1).alias("from"), F.col("exits").alias("_exits"), F.col("from").alias("_from"))
            joined = reach.filter("`from` > 0").join(before, ["key", "from"])
            through = F.transform("_exits", lambda x: F.when(x < 0, x).otherwise(F.element_at("exits", x + 1)))
            again = joined.select("key", "piece", through.alias("exits"), "_from")
            again = again.select("key", "piece", "exits", F.when(one, 0).otherwise(F.col("_from")).alias("from"))
            old, reach = reach, write(again.unionByName(reach.filter("`from` = 0")), "reach")
            write.drop(old)
        into = reach.select("key", (F.col("piece") + 1).alias("piece"), F.when(F.element_at("exits", 1) >= 0, F.element_at("exits", 1)).alias("entry"))
        own = tables.select("key", "piece", "counts").join(into, ["key", "piece"], "left")
        # A row a piece: what a walk adds there, by where it enters; the first piece begins one run more.
        count = F.when(F.col("piece") == 0, F.element_at("counts", 1) + 1).when(F.col("entry").isNull(), 0).otherwise(F.element_at("counts", F.col("entry") + 1))
        earlier = F.sum("_c").over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
        return written(own.withColumn("_c", count).withColumn("before", earlier).filter("piece > 0").select("key", "piece", "entry", "before"), "msp-entries")


def segments(sequences: DataFrame, k: int, p: int, *, score: Score | None = None, keep: tuple[str, ...] = (), outer: bool = False, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """seq_id, seg_no, bucket, minimizer, minimizer_pos, start, len, exts, seq and the kept columns: the
    segments of every sequence of at least k bases; shorter ones give none.

    exts are the bases next to a segment; at the sequence's own ends none, or with outer those of its
    column exts. bucket is the rank of the canonical minimizer, whatever the score looked at. A
    sequence with more than PIECE p-mers is walked by several tasks.

    The pieces are written once, by `write`, dealt evenly to the tasks however few files or row groups the
    sequences come in.
    """
    score = score or permutation_score()
    window = k - p + 1
    own = (*keep, "exts") if outer and "exts" not in keep else keep
    spark = sequences.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pieces = write(_pieces(sequences, k, p, own).repartition(tasks), "msp-pieces")
    entries = _entries(pieces, k, p, score)
    plain = pieces.withColumn("entry", F.lit(None).cast("int")).withColumn("before", F.lit(0).cast("long"))
    if entries is not None:
        plain = plain.filter("key is null").unionByName(pieces.filter("key is not null").join(entries, ["key", "piece"], "left"))

    def run(batches):
        for batch in _together(batches):
            whole, begins, ranks, mirrored, scores = _scored(batch, p, window, score)
            jump, first = steps(scores, window)
            go = jump.tolist()
            row, came, here = [], [], []  # of each run: its piece, the minimizer before it and its own
            for i, (begin, at, piece, lo, hi, into) in enumerate(zip(begins.tolist(), *(batch.column(c).to_pylist() for c in ("at", "piece", "lo", "hi", "entry")))):
                begin -= at
                if piece == 0:
                    now = entry(scores[begin : begin + window], window) + begin
                    row.append(i), came.append(-1), here.append(now)
                elif into is None:
                    continue
                else:
                    now = lo + into + begin
                stop = hi + begin
                while now < stop and go[now]:
                    row.append(i), came.append(now)
                    now += go[now]
                    here.append(now)
            row, came, here = (np.array(x, np.int64) for x in (row, came, here))
            zero = (begins - np.asarray(batch.column("at")))[row]  # where the sequence's base 0 would stand
            n, opens = np.asarray(batch.column("n"))[row], came < 0
            start = np.where(opens, zero, came + first[came])
            end = np.where(jump[here] > 0, here + first[here] + k - 1, zero + n)
            codes = _CODE[np.frombuffer(whole.encode("ascii", "replace"), np.uint8)]
            left, right = start > zero, end < zero + n
            exts = np.where(left, 1 << codes[start - 1], 0) | np.where(right, 16 << codes[np.minimum(end, len(codes) - 1)], 0)
            if outer:
                mine = np.asarray(batch.column("exts"))[row]
                exts |= np.where(left, 0, mine & 15) | np.where(right, 0, mine & 240)
            number = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row] + np.asarray(batch.column("before").fill_null(0))[row]
            index = pa.array(row)
            cut = lambda a, b: pa.array([whole[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.string())
            ints = lambda x: pa.array(x, pa.int32())
            columns = [batch.column("seq_id").take(index), ints(number), pa.array(np.minimum(ranks[here], mirrored[here])), cut(here, here + p), ints(here - zero), ints(start - zero), ints(end - start), ints(exts), cut(start, end)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(index) for c in keep)], names=names)

    kinds = {"seq_id": None, "seg_no": "int", "bucket": "long", "minimizer": "string", "minimizer_pos": "int", "start": "int", "len": "int", "exts": "int", "seq": "string"} | dict.fromkeys(keep)
    names = [*kinds]
    return plain.drop("key").mapInArrow(run, ", ".join(f"`{c}` {t or sequences.schema[c].dataType.simpleString()}" for c, t in kinds.items()))


def bucket(minimizer: Column) -> Column:
    """Rank of the canonical minimizer, whatever the score looked at."""
    return S.rank(S.canonical(minimizer))


def msp_sequence(sequences: DataFrame, k: int, p: int, *, permutation: list[int] | None = None, rc: bool = False) -> DataFrame:
    """segments() with the column label, scored by a permutation."""
    return segments(sequences, k, p, score=permutation_score(permutation, rc=rc), keep=("label",))


def simple_scan(sequences: DataFrame, k: int, p: int, permutation: list[int], *, rc: bool = True) -> DataFrame:
    """seq_id, bucket, start, len of segments by a permutation of the p-mers, p at most 8."""
    if p > 8 or len(permutation) != 4**p:
        raise ValueError("a permutation of all p-mers, p <= 8, is needed")
    return segments(sequences, k, p, score=permutation_score(permutation, rc=rc)).select("seq_id", "bucket", "start", "len")


def kmer_buckets(sequences: DataFrame, k: int, p: int, *, rc: bool = True) -> DataFrame:
    """seq_id, pos, kmer, bucket of every k-mer under the identity permutation, without a walk:
    equally scored p-mers share a bucket, so the bucket is a minimum over the k-mer's p-mers."""
    pmers = F.transform(S.kmers("seq", p), S.canonical) if rc else S.kmers("seq", p)
    # The p-mers are listed once for a sequence; what is exploded are places only.
    rows = sequences.filter(F.length("seq") >= k).select("seq_id", "seq", pmers.alias("_m"))
    rows = rows.select("seq_id", "seq", "_m", F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("_i"))
    least = F.array_min(F.slice("_m", F.col("_i"), k - p + 1))
    return rows.select("seq_id", (F.col("_i") - 1).alias("pos"), F.substring("seq", F.col("_i"), F.lit(k)).alias("kmer"), (S.rank(least) if rc else bucket(least)).alias("bucket"))
