"""Extension sets: the bases seen on either side of a k-mer or node, as an INT of eight bits.

The low four bits are the left side's A, C, G, T, the high four the right side's. A side is a
boolean Column or literal `right`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import seq
from .seq import ColumnOr, _c

EMPTY = 0


def _side(right) -> Column:
    return right if isinstance(right, Column) else F.lit(bool(right))


def flip(right: Column) -> Column:
    return ~_side(right)


def cond_flip(right: Column, flipped: Column) -> Column:
    return _side(right) != flipped


def pick(right: Column, if_left: ColumnOr, if_right: ColumnOr) -> Column:
    return F.when(_side(right), _c(if_right)).otherwise(_c(if_left))


def bit(base: ColumnOr, right) -> Column:
    """The set of one base (A, C, G, T) on a side; the empty set for anything else."""
    code = F.instr(F.lit(seq.BASES), _c(base)) - 1
    if not isinstance(right, Column):
        return _power(code, 4 if right else 0)
    return F.when(right, _power(code, 4)).otherwise(_power(code, 0))


def _power(code: Column, shift: int) -> Column:
    out = F.lit(0)
    for i in range(3, -1, -1):
        out = F.when(code == i, F.lit(1 << (i + shift))).otherwise(out)
    return out


def from_single_dirs(left: ColumnOr, right: ColumnOr) -> Column:
    """Low nibbles of both, as left and right side."""
    return F.shiftleft(_c(right).bitwiseAND(F.lit(15)), 4).bitwiseOR(_c(left).bitwiseAND(F.lit(15)))


def merge(left: ColumnOr, right: ColumnOr) -> Column:
    """Left side of the one, right side of the other."""
    return _c(left).bitwiseAND(F.lit(15)).bitwiseOR(_c(right).bitwiseAND(F.lit(240)))


def add(a: ColumnOr, b: ColumnOr) -> Column:
    return _c(a).bitwiseOR(_c(b))


def set_ext(e: ColumnOr, base: ColumnOr, right) -> Column:
    return _c(e).bitwiseOR(bit(base, right))


def single_dir(e: ColumnOr, right) -> Column:
    """One side as the low nibble."""
    e = _c(e)
    if not isinstance(right, Column):
        return F.shiftright(e, 4).bitwiseAND(F.lit(15)) if right else e.bitwiseAND(F.lit(15))
    return F.when(right, F.shiftright(e, 4)).otherwise(e).bitwiseAND(F.lit(15))


def get(e: ColumnOr, right) -> Column:
    """Array of a side's bases in the order A, C, G, T."""
    side = single_dir(e, right)
    return F.array_compact(F.array(*[F.when(side.bitwiseAND(F.lit(1 << i)) != 0, F.lit(b)) for i, b in enumerate(seq.BASES)]))


def has_ext(e: ColumnOr, base: ColumnOr, right) -> Column:
    return _c(e).bitwiseAND(bit(base, right)) != 0


def count(e: ColumnOr, right) -> Column:
    return F.bit_count(single_dir(e, right))


def unique(e: ColumnOr, right) -> Column:
    """The side's only base; null if it has none or several."""
    side = single_dir(e, right)
    return F.when(side == 1, "A").when(side == 2, "C").when(side == 4, "G").when(side == 8, "T")


def _spread(e: Column, moves: list[tuple[int, int]]) -> Column:
    """Bits moved by the given places: (mask, shift to the left, negative to the right)."""
    out = F.lit(0)
    for mask, by in moves:
        part = e.bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(part, by) if by >= 0 else F.shiftright(part, -by))
    return out


def complement(e: ColumnOr) -> Column:
    """A and T, C and G exchanged within each side."""
    return _spread(_c(e), [(0x11, 3), (0x22, 1), (0x44, -1), (0x88, -3)])


def reverse(e: ColumnOr) -> Column:
    return _spread(_c(e), [(0x0F, 4), (0xF0, -4)])


def rc(e: ColumnOr) -> Column:
    return _spread(_c(e), [(0x01, 7), (0x02, 5), (0x04, 3), (0x08, 1), (0x10, -1), (0x20, -3), (0x40, -5), (0x80, -7)])


def of_bounds(s: ColumnOr, start: ColumnOr, n: ColumnOr) -> Column:
    """The bases of s right before and right after its window of n bases from start."""
    s, start, end = _c(s), _c(start), _c(start) + _c(n)
    left = F.when(start > 0, bit(F.substring(s, start, F.lit(1)), False)).otherwise(0)
    right = F.when(end < F.length(s), bit(F.substring(s, end + 1, F.lit(1)), True)).otherwise(0)
    return left.bitwiseOR(right)


def text(e: ColumnOr) -> Column:
    """Left bases, a bar, right bases."""
    return F.concat(F.array_join(get(e, False), ""), F.lit("|"), F.array_join(get(e, True), ""))


def extensions(kmer: ColumnOr, e: ColumnOr, right) -> Column:
    """Array of the neighbours of a k-mer on a side."""
    right_ = _side(right)
    return F.transform(get(e, right), lambda b: seq.extend(kmer, b, right_))
