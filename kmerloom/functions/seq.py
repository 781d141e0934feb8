"""Sequences and k-mers as STRING columns over A, C, G, T.

Every function takes and gives Columns and stays within Spark's own expressions. Positions count
from 0, intervals are half-open, base codes are A, C, G, T = 0, 1, 2, 3. A k-mer is a string of
length k; its order is that of its packed rank, which fits a BIGINT for k <= 31.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
ColumnOr = Column | str | int


def _c(x: ColumnOr) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _sub(s: Column, start: ColumnOr, n: ColumnOr) -> Column:
    return F.substring(s, _c(start) + 1, _c(n))


# -- bases -----------------------------------------------------------------------------------


def code_to_base(code: ColumnOr) -> Column:
    """A, C, G, T for 0-3 and X for any other code."""
    code = _c(code)
    return F.when(code.between(0, 3), F.substring(F.lit(BASES), code + 1, F.lit(1))).otherwise("X")


def base_to_code(base: ColumnOr) -> Column:
    """0-3 for a base in either case, 0 for anything else."""
    return F.greatest(F.instr(F.lit(BASES), F.upper(_c(base))) - 1, F.lit(0))


def strict_base_to_code(base: ColumnOr) -> Column:
    """0-3 for a base in either case, null for anything else."""
    return F.when(is_valid_base(base), base_to_code(base))


def is_valid_base(base: ColumnOr) -> Column:
    return _c(base).rlike("^[ACGTacgt]$")


def complement_code(code: ColumnOr) -> Column:
    return 3 - _c(code)


# -- whole sequences --------------------------------------------------------------------------


def rc(s: ColumnOr) -> Column:
    """Reverse complement."""
    return F.reverse(F.translate(_c(s), "ACGT", "TGCA"))


def reverse_only(s: ColumnOr) -> Column:
    return F.reverse(_c(s))


def is_empty(s: ColumnOr) -> Column:
    return F.length(_c(s)) == 0


def get_base(s: ColumnOr, pos: ColumnOr) -> Column:
    return _sub(_c(s), pos, 1)


def set_base(s: ColumnOr, pos: ColumnOr, base: ColumnOr) -> Column:
    return F.overlay(_c(s), _c(base), _c(pos) + 1, F.lit(1))


def set_slice(s: ColumnOr, pos: ColumnOr, bases: ColumnOr) -> Column:
    """s with the bases from pos on replaced; the rest of `bases` that would not fit is left out."""
    s, bases = _c(s), _c(bases)
    fits = F.substring(bases, F.lit(1), F.greatest(F.length(s) - _c(pos), F.lit(0)))
    return F.overlay(s, fits, _c(pos) + 1, F.length(fits))


def slice_(s: ColumnOr, start: ColumnOr, end: ColumnOr) -> Column:
    return _sub(_c(s), start, _c(end) - _c(start))


def prefix(s: ColumnOr, k: int) -> Column:
    """The first k bases; null where there are fewer."""
    return F.when(F.length(_c(s)) >= k, F.left(_c(s), F.lit(k)))


def suffix(s: ColumnOr, k: int) -> Column:
    return F.when(F.length(_c(s)) >= k, F.right(_c(s), F.lit(k)))


def bases(s: ColumnOr) -> Column:
    """Array of one-base strings."""
    return F.filter(F.split(_c(s), ""), lambda b: b != "")


def codes(s: ColumnOr) -> Column:
    """Array of base codes."""
    return F.transform(bases(s), base_to_code)


def from_codes(codes_: ColumnOr) -> Column:
    """Sequence of an array of codes; an error if a code is not within 0-3."""
    codes_ = _c(codes_)
    checked = F.assert_true(F.forall(codes_, lambda b: b.between(0, 3)), F.lit("base codes are 0 to 3"))
    return F.when(checked.isNull(), F.array_join(F.transform(codes_, code_to_base), ""))


def blank(n: ColumnOr) -> Column:
    """n times A: a new sequence, or the least k-mer."""
    return F.repeat(F.lit("A"), _c(n))


def push(s: ColumnOr, code: ColumnOr) -> Column:
    """s with the base of one more code (0-3; null for any other)."""
    code = _c(code)
    return F.when(code.between(0, 3), F.concat(_c(s), code_to_base(code)))


def extend_codes(s: ColumnOr, codes_: ColumnOr) -> Column:
    """s with the bases of an array of codes after it."""
    return F.concat(_c(s), from_codes(codes_))


def clear(s: ColumnOr) -> Column:
    """No bases, where there is a sequence."""
    return F.left(_c(s), F.lit(0))


def gc_count(s: ColumnOr) -> Column:
    s = _c(s)
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def at_count(s: ColumnOr) -> Column:
    s = _c(s)
    return F.length(s) - F.length(F.translate(s, "AT", ""))


def hamming(a: ColumnOr, b: ColumnOr) -> Column:
    """Differing bases of sequences of equal length; null where the lengths differ."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(bases(a), bases(b), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda p, q: p + q))


def is_palindrome(s: ColumnOr) -> Column:
    """Equal to its own reverse complement (never so for odd lengths)."""
    return _c(s) == rc(s)


# -- k-mers -----------------------------------------------------------------------------------


def canonical(s: ColumnOr) -> Column:
    return F.least(_c(s), rc(s))


def is_flipped(s: ColumnOr) -> Column:
    """Whether the canonical form is the reverse complement; a palindrome counts as flipped."""
    return _c(s) >= rc(s)


def canonical_flip(s: ColumnOr) -> Column:
    return F.struct(canonical(s).alias("kmer"), is_flipped(s).alias("flip"))


def rank(s: ColumnOr) -> Column:
    """Place of a k-mer (k <= 31) in lexicographic order, from 0."""
    return F.conv(F.translate(_c(s), "ACGT", "0123"), 4, 10).cast("long")


def unrank(x: ColumnOr, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_c(x).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming_packed(a: ColumnOr, b: ColumnOr) -> Column:
    """Hamming distance of two ranks: differing two-bit groups."""
    x = _c(a).bitwiseXOR(_c(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def at_count_packed(a: ColumnOr, k: int) -> Column:
    """A and T have equal bits in their two-bit group."""
    a = _c(a)
    differ = a.bitwiseXOR(F.shiftrightunsigned(a, 1)).bitwiseAND(F.lit(0x5555555555555555 & ((1 << 2 * k) - 1)))
    return k - F.bit_count(differ)


def extend_right(s: ColumnOr, base: ColumnOr) -> Column:
    s = _c(s)
    return F.concat(F.substring(s, F.lit(2), F.length(s)), _c(base))


def extend_left(s: ColumnOr, base: ColumnOr) -> Column:
    s = _c(s)
    return F.concat(_c(base), F.left(s, F.length(s) - 1))


def extend(s: ColumnOr, base: ColumnOr, right: Column) -> Column:
    return F.when(right, extend_right(s, base)).otherwise(extend_left(s, base))


def kmers(s: ColumnOr, k: int) -> Column:
    """Array of the k-mers in order; empty if s is shorter than k."""
    s = _c(s)
    places = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(s, i, F.lit(k)))


def kmer_at(s: ColumnOr, pos: ColumnOr, k: int) -> Column:
    return F.when(_c(pos) + k <= F.length(_c(s)), _sub(_c(s), pos, k))


def terminal_kmers(s: ColumnOr, k: int) -> Column:
    return F.struct(prefix(s, k).alias("first"), suffix(s, k).alias("last"))


def terminal_kmer(s: ColumnOr, k: int, right: Column) -> Column:
    return F.when(right, suffix(s, k)).otherwise(prefix(s, k))


def hamming1(s: ColumnOr) -> Column:
    """Array of the 3k k-mers that differ in one base, by position, then base."""
    s = _c(s)
    alphabet = F.array(*[F.lit(b) for b in BASES])

    def at(i: Column) -> Column:
        here = F.substring(s, i, F.lit(1))
        return F.transform(F.filter(alphabet, lambda b: b != here), lambda b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.length(s))))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), at))


def total_kmers(s: ColumnOr, k: int) -> Column:
    """Number of k-mers of a sequence, for sums."""
    return F.greatest(F.length(_c(s)) - (k - 1), F.lit(0)).cast("long")
