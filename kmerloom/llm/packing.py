"""Packing documents into fixed-length token sequences.

Every document is tokenised, ended with an end token and cut into pieces only where it exceeds
a sequence. Packing needs the pieces' lengths only, and there are at most `capacity` different
lengths: Spark counts them, the driver solves the instance of at most `capacity` (length, count)
pairs, and the solution, a list of patterns with multiplicities, is dealt back to the pieces by
their rank among those of equal length. The solver first fixes sets that provably dominate all
alternatives (Martello and Toth), then places the rest best-fit decreasing, both in multiples.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, lean, materialize, slices


def solve(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (multiplicity, lengths) that use each length exactly as often as counts says."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def reduce_by_dominance(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns that some best solution holds; their pieces are taken out of left.

    A bin {a, b} dominates every other bin for a if whatever else fits beside a can be put in b's
    place. That is certain where b fills the bin; where b is the largest that fits beside a and no
    two pieces do; and where no three do and b is no less than the best two. A piece beside which
    nothing fits is a bin alone. Each such set is fixed as often as there are copies, and the
    smaller instance is looked at again until nothing changes.
    """
    patterns: list[tuple[int, list[int]]] = []

    def fix(times: int, items: list[int]) -> None:
        patterns.append((times, items))
        for s in items:
            left[s] -= times
            if not left[s]:
                del left[s]

    def companion(a: int, sizes: list[int]) -> int | None:
        """The dominating piece for a; 0 for none at all, None if none is certain."""
        room = capacity - a
        spare = lambda s: left[s] - (s == a)
        sizes = [s for s in sizes[: bisect.bisect_right(sizes, room)] if spare(s)]
        if not sizes or sizes[-1] == room:
            return sizes[-1] if sizes else 0
        small = [s for s in sizes[:3] for _ in range(min(3, spare(s)))][:3]
        if len(small) < 2 or sum(small[:2]) > room:
            return sizes[-1]
        if len(small) > 2 and sum(small) <= room:
            return None
        best, i, j = 0, 0, len(sizes) - 1  # the best two, by one walk from both ends
        while i <= j:
            if sizes[i] + sizes[j] > room or (i == j and spare(sizes[i]) < 2):
                j -= 1
                continue
            best = max(best, sizes[i] + sizes[j])
            i += 1
        return sizes[-1] if sizes[-1] >= best else None

    changed = True
    while changed:
        changed = False
        for a in sorted(left, reverse=True):
            while a in left:
                b = companion(a, sorted(left))
                if b is None:
                    break
                changed = True
                if b == 0:
                    fix(left[a] if 2 * a > capacity else 1, [a])
                elif a + b == capacity or 2 * a > capacity:
                    fix(left[a] // 2 if a == b else min(left[a], left[b]), [a, b])
                else:  # copies of a may fit beside each other: one at a time
                    fix(1, [a, b])
    return patterns


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns of the pieces in left, longest first, each in the fullest bin that has room for it.

    Bins with equal room are handled together: the fullest that fit take as many copies as go in.
    """
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, items: list[int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, items))

    for s in sorted(left, reverse=True):
        todo = left[s]
        while todo:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                times, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, times, items = capacity, todo, []
            each = room // s
            full = min(times, todo // each)
            if full:
                put(room - each * s, full, items + [s] * each)
            todo -= full * each
            if times > full and todo and todo < each:
                put(room - todo * s, 1, items + [s] * todo)
                full, todo = full + 1, 0
            if times > full and items:
                put(room, times - full, items)
    return [(times, items) for room in rooms for times, items in open_[room]]


#: The pre-tokeniser's pattern of byte-level BPE vocabularies of this family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACED = tuple(" " + c for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f")


def _fast_encode(spec: dict):
    """An equal but faster encoder for a byte-level BPE file, or None where ids are not in merge order."""
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    char = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    order = [vocab.get(a + b, -1) for a, b in pairs]
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or order != sorted(order) or any(c not in char for t in vocab for c in t):
        return None
    ranks = {bytes(char[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Words(dict):
    """Ids, as little-endian 32-bit bytes, of a space and a word."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        self.held += 150 + len(word) + len(ids)
        return ids


class Encoder:
    """Token ids of texts, as tokenizers' encode(text, add_special_tokens=False) gives them.

    The pre-tokeniser starts a token at every space before a non-blank, so the ids of a text are
    those of its space-separated words joined, unless blanks stand around a space; such texts
    are encoded whole. Texts that hold one of the file's added tokens, and all texts where no
    faster equal exists, go to the tokenizer itself. The table of words is emptied when it takes
    about `room` bytes.
    """

    def __init__(self, tokenizer_path: str, room: int = 12_000_000):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.room, self.plain = tokenizer_path, room, None
        self.encode = _fast_encode(spec)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words = _Words(self.encode)

    def exactly(self, text: str) -> bytes:
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.encode is None or (self.added and self.added.search(text)):
            return self.exactly(text)
        if text[-1:] == " " or any(b in text for b in _SPACED) or (not text.isascii() and _WIDE_BLANK.search(text)):
            return array("I", self.encode(text)).tobytes()
        if self.words.held > self.room:
            self.words.clear()
            self.words.held = 0
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.words.__getitem__, rest))


def tokenize_pieces(docs: DataFrame, *, doc_id: str, text: str, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is an empty one."""
    end = array("I", [end_id]).tobytes()

    @lean
    def pieces(batches):
        encode = Encoder(tokenizer_path)
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for ident, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(body or "") + end
                total = len(ids) // 4
                at, upto = 0, (total - 1) % capacity + 1
                for piece in range((total + capacity - 1) // capacity):
                    for column, value in zip(out, (ident, piece, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto]))):
                        column.append(value)
                    at, upto = upto, upto + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    group_rows: int = 50_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document's ids and the end id are cut from the right into pieces of `capacity`, so only its
    first piece may be shorter. Sequences are filled without gaps from 0.

    The driver sees a histogram of at most `capacity` lengths. A length held by many pieces (all
    full ones, or a group of equal documents) is ranked in groups of about group_rows, so no task
    sorts them all. Null and empty texts give one piece of the end id alone, null ids stay null,
    repeated rows are packed as often as they come, an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    # A number for each row, fixed by the written copy, tells equal rows apart.
    pieces = tokenize_pieces(docs, doc_id=doc_id, text=text, tokenizer_path=tokenizer_path, capacity=capacity, end_id=end_id)
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}

    ranges, base, used = [], 0, dict.fromkeys(counts, 0)
    for times, items in solve(counts, capacity):
        at = 0
        for s in sorted(set(items), reverse=True):
            n = items.count(s)
            ranges.append((s, used[s], used[s] + times * n, base, n, at))
            used[s] += times * n
            at += n * s
        base += times
    slots = spark.createDataFrame(ranges, "length long, lo long, hi long, base long, n long, at long")
    groups = spark.createDataFrame([(s, -(-n // group_rows)) for s, n in counts.items()], "length long, groups long")

    dealt = pieces.join(F.broadcast(groups), "length").withColumn("grp", F.pmod(F.xxhash64("_row"), F.col("groups")))
    sizes = dealt.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "grp", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "grp").orderBy("_row"))
    ranked = dealt.withColumn("_own", own).join(sizes, ["length", "grp"]).withColumn("rank", F.col("_own") - 1 + F.col("_before"))
    # One row per length and pattern: bounded by the number of lengths, not by the data.
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots["length"])
    turn = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(turn / F.col("n"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("n")) * F.col("length")).cast("long").alias("offset"),
    )
