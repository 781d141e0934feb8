"""Sequences from text, codes and packed bytes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import seq
from ..functions.seq import ColumnOr, _c


def lenient(text: ColumnOr) -> Column:
    """Bases in either case are kept, every other character becomes A."""
    return F.translate(F.regexp_replace(_c(text), "[^ACGTacgt]", "A"), "acgt", "ACGT")


def only_bases(text: ColumnOr) -> Column:
    """The bases of a text, everything else left out."""
    return F.translate(F.regexp_replace(_c(text), "[^ACGTacgt]", ""), "acgt", "ACGT")


def split_bases(text: ColumnOr) -> Column:
    """Array of the maximal runs of bases."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit("[ACGTacgt]+"), 0), lambda r: F.translate(r, "acgt", "ACGT"))


def hashed(text: ColumnOr, name: ColumnOr) -> Column:
    """As lenient(), but other characters become a repeatable pseudo-random base: the first digit of the MD5
    of `name:place`, modulo 4. Without a name they are left out."""
    return _hashed(_c(text), _c(name).cast("string"))


#: Bytes of text whose characters are hashed at a time.
HASHED_BYTES = 1 << 18
#: MD5s computed at a time, few enough for the processor's cache.
AT_ONCE = 1 << 13
#: MD5's shifts and constants (RFC 1321).
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: The base of a byte of text, 0 for none.
_BASE = np.zeros(256, np.uint8)
_BASE[[ord(b) for b in "ACGTacgt"]] = [ord(b) for b in "ACGTACGT"]
_LETTER = np.frombuffer(b"ACGT", np.uint8)


def md5_first_words(blocks: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of messages that are one padded block of 64 bytes each."""
    words = [np.ascontiguousarray(w) for w in blocks.view("<u4").T]
    words = [w if w.any() else None for w in words]
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in _START)
    x, y = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=x), np.bitwise_and(x, b, out=x), np.bitwise_xor(x, d, out=x)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=x), np.bitwise_and(x, d, out=x), np.bitwise_xor(x, c, out=x)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=x), np.bitwise_xor(x, d, out=x)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=x), np.bitwise_or(x, b, out=x), np.bitwise_xor(x, c, out=x)
            at = 7 * i % 16
        x += a
        x += _SINES[i]
        if words[at] is not None:
            x += words[at]
        np.left_shift(x, np.uint32(_SHIFTS[i]), out=y), np.right_shift(x, np.uint32(32 - _SHIFTS[i]), out=x)
        y |= x
        y += b
        a, d, c, b, y = d, c, b, y, a  # the array of the word that leaves is free
    return a + _START[0]


def _first_digits(names: list[bytes], own: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first digit of the MD5 of names[own]:place."""
    size = np.fromiter(map(len, names), np.int64, len(names))[own] + 1
    digits = np.ones(len(place), np.int64)
    for j in range(1, len(str(int(place.max(initial=0))))):
        digits += place >= 10**j
    out = np.zeros(len(place), np.int64)
    one = size + digits <= 55
    for i in np.flatnonzero(~one).tolist():  # of more than one block, since the name is long
        out[i] = hashlib.md5(b"%b:%d" % (names[own[i]], place[i]), usedforsecurity=False).digest()[0] >> 4
    heads = np.zeros((len(names), 64), np.uint8)
    for i, name in enumerate(names):
        if len(name) < 55:
            heads[i, : len(name) + 1] = np.frombuffer(name + b":", np.uint8)
    rows = np.flatnonzero(one)
    for at in range(0, len(rows), AT_ONCE):
        row = rows[at : at + AT_ONCE]
        blocks, n, d, rest = heads[own[row]], size[row], digits[row], place[row]
        line = np.arange(len(row))
        blocks[line, n + d] = 128
        for j in range(int(d.max())):
            on = np.flatnonzero(d > j)
            blocks[on, (n + d)[on] - 1 - j] = 48 + rest[on] % 10
            rest = rest // 10
        bits = 8 * (n + d)
        blocks[:, 56], blocks[:, 57] = bits & 255, bits >> 8
        out[row] = md5_first_words(blocks) >> 4 & 15
    return out


@F.arrow_udf(StringType())
def _hashed(text: pa.Array, name: pa.Array) -> pa.Array:
    filled = text.fill_null("").cast(pa.large_string())
    _, ends, data = filled.buffers()
    ends = np.frombuffer(ends, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    names = [n.encode() if n is not None else None for n in name.to_pylist()]
    known, named = [n or b"" for n in names], np.array([n is not None for n in names], bool)
    begins = np.zeros(len(filled), np.int64)  # characters of the earlier texts
    passed, seen, parts, kept = int(ends[0]), 0, [], np.zeros(len(filled), np.int64)
    while passed < ends[-1]:
        to = min(passed + HASHED_BYTES, int(ends[-1]))
        part = data[passed:to]
        at = np.flatnonzero(part & 192 != 128)  # where characters begin
        own = np.searchsorted(ends, at + passed, "right") - 1
        number = seen + np.arange(len(at))
        opens = np.flatnonzero(at + passed == ends[own])
        begins[own[opens]] = number[opens]
        letters = _BASE[part[at]]
        other = np.flatnonzero((letters == 0) & named[own])
        first, last = (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)
        letters[other] = _LETTER[_first_digits(known[first:last], own[other] - first, number[other] - begins[own[other]]) % 4]
        there = letters > 0
        kept += np.bincount(own[there], minlength=len(filled))
        parts.append(letters[there])
        passed, seen = to, seen + len(at)
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    out = pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer(np.append(0, np.cumsum(kept)).astype(np.int64)), pa.py_buffer(whole)).cast(pa.string())
    return pc.if_else(text.is_null(), pa.scalar(None, pa.string()), out)


def from_packed(packed: ColumnOr, n: ColumnOr) -> Column:
    """The first n bases of an array of byte values that hold four bases each, lowest bits first;
    null if there are fewer."""
    packed, n = _c(packed), _c(n)

    def four(byte: Column) -> Column:
        return F.concat(*[seq.code_to_base(F.shiftright(byte.cast("int"), 2 * j).bitwiseAND(F.lit(3))) for j in range(4)])

    return F.when(n <= 4 * F.size(packed), F.left(F.array_join(F.transform(packed, four), ""), n))


def to_packed(s: ColumnOr) -> Column:
    """Byte values of a sequence, four bases each, lowest bits first."""
    s = _c(s)
    starts = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s), F.lit(4))).otherwise(F.array().cast("array<int>"))

    def byte(i: Column) -> Column:
        codes = [seq.base_to_code(F.substring(s, i + j, F.lit(1))) * 4**j for j in range(4)]
        return codes[0] + codes[1] + codes[2] + codes[3]

    return F.transform(starts, byte)


def sequences(df: DataFrame, seq_id: str, text: str, *, label: str | None = None, clean=only_bases) -> DataFrame:
    """The engine's table of sequences: seq_id, seq, exts, label."""
    label_ = F.col(label) if label else F.lit(None).cast("string")
    return df.select(F.col(seq_id).cast("long").alias("seq_id"), clean(F.col(text)).alias("seq"), F.lit(0).alias("exts"), label_.alias("label"))
