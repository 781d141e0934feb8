"""K-mer tables: enumeration, counting with pluggable summaries, extension repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exts as E
from ..functions import seq as S

#: Counts stop here (a 16-bit counter's limit, a fixed value).
COUNT_LIMIT = 65_535


#: K-mers of a piece of a sequence. Pieces spread long sequences over tasks.
PIECE = 2048


def pieces(sequences: DataFrame, k: int, keep: tuple[str, ...], *, spread: bool = True) -> DataFrame:
    """Overlapping parts of sequences (seq, exts) with at most PIECE k-mers each, with spread dealt evenly to
    the tasks: _p, the part with the base before and after it where the sequence has one; _left, whether
    it has one before; _n, its number of k-mers; exts, the sequence's own at its outer sides."""
    s, own = F.col("seq"), F.col("exts")
    n = F.length(s) - (k - 1)
    cut = sequences.filter(F.length(s) >= k).select(*keep, "exts", "seq", F.explode(F.sequence(F.lit(0), n - 1, F.lit(PIECE))).alias("_at"))
    left, here = F.col("_at") > 0, F.least(F.lit(PIECE), n - F.col("_at"))
    right = F.col("_at") + here < n
    part = F.substring(s, F.greatest(F.col("_at"), F.lit(1)), here + (k - 1) + left.cast("int") + right.cast("int"))
    outer = F.when(left, 0).otherwise(own.bitwiseAND(F.lit(15))).bitwiseOR(F.when(right, 0).otherwise(own.bitwiseAND(F.lit(240))))
    cut = cut.select(*keep, part.alias("_p"), left.alias("_left"), here.alias("_n"), outer.alias("exts"))
    spark = sequences.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cut.repartition(tasks) if spread else cut


def _bit(base: Column, right: bool) -> Column:
    """E.bit of one base as a byte."""
    shift = 4 if right else 0
    out = F.lit(0)
    for i, b in enumerate(S.BASES):
        out = F.when(base == F.lit(b.encode()), F.lit(1 << (i + shift))).otherwise(out)
    return out


def kmers_with_exts(sequences: DataFrame, k: int, *, keep: tuple[str, ...] = ("label",), canonical: bool = False, packed: bool = False, spread: bool = True) -> DataFrame:
    """kmer, exts and the kept columns of every k-mer of sequences (seq, exts).

    Interior k-mers have the bases next to them, the first and the last one take the outer side
    from the sequence's own exts. Sequences shorter than k give nothing. With canonical, k-mers are
    in canonical form and their exts in that frame; packed leaves them as BINARY, one byte a base.

    Only positions are exploded. K-mers are cut from bytes, which takes no walk along the string, and
    their reverse complements from that of the whole piece.
    """
    rows = pieces(sequences, k, keep, spread=spread).withColumn("_r", S.rc("_p").cast("binary")).withColumn("_p", F.col("_p").cast("binary"))
    rows = rows.select("*", F.length("_p").alias("_len"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    begin = F.col("_i") + F.col("_left").cast("int")  # from 1, within _p
    rows = rows.withColumn("_b", begin)
    cut = lambda text, at, size: F.substring(text, at, F.lit(size))
    left = F.when(F.col("_b") > 1, _bit(cut("_p", F.col("_b") - 1, 1), False)).otherwise(F.col("exts").bitwiseAND(F.lit(15)))
    right = F.when(F.col("_b") + k <= F.col("_len"), _bit(cut("_p", F.col("_b") + k, 1), True)).otherwise(F.col("exts").bitwiseAND(F.lit(240)))
    rows = rows.select(*keep, cut("_p", F.col("_b"), k).alias("kmer"), *([cut("_r", F.col("_len") - F.col("_b") - (k - 2), k).alias("_rc")] if canonical else []), left.bitwiseOR(right).alias("exts"))
    if canonical:
        flip = F.col("kmer") >= F.col("_rc")
        rows = rows.select(*keep, F.when(flip, F.col("_rc")).otherwise(F.col("kmer")).alias("kmer"), F.when(flip, E.rc("exts")).otherwise(F.col("exts")).alias("exts"))
    kmer = F.col("kmer") if packed else F.col("kmer").cast("string")
    return rows.select(kmer.alias("kmer"), "exts", *keep)


@dataclass(frozen=True)
class Summarizer:
    """What is kept of a k-mer's observations: aggregates by name, and which k-mers are valid.

    valid is a condition over the aggregates and `n`, the number of observations.
    """

    aggregates: dict[str, Column]
    valid: Column
    #: Columns of the observations that are added up first: `aggregates` then see one row for each of
    #: their values, with the number of its observations as `n`.
    within: tuple[str, ...] = ()
    #: Columns of the sequences that the aggregates read.
    needs: tuple[str, ...] = ("label",)

    def columns(self) -> list[Column]:
        return [c.alias(name) for name, c in self.aggregates.items()]


def count_filter(min_obs: int) -> Summarizer:
    """The saturating count; valid from min_obs on."""
    seen = F.least(F.col("n"), F.lit(COUNT_LIMIT))
    return Summarizer({"data": F.least(F.count(F.lit(1)), F.lit(COUNT_LIMIT)).cast("int")}, seen >= min_obs, needs=())


def label_filter(min_obs: int, label: str = "label") -> Summarizer:
    """The sorted distinct labels; valid from min_obs observations on."""
    return Summarizer({"data": F.array_sort(F.collect_set(label))}, F.col("n") >= min_obs, (label,), (label,))


def filter_kmers(sequences: DataFrame, k: int, summarizer: Summarizer, *, stranded: bool = False, report_all: bool = False):
    """kmer, exts, n, data of the valid k-mers; with report_all also the table of all k-mers.

    One shuffle of observations, after partial aggregation in generated code. A summarizer with
    columns `within` (labels) takes a second one, of the sums by those columns.
    """
    obs = kmers_with_exts(sequences, k, keep=summarizer.needs, canonical=not stranded, packed=True)
    table = summarize(obs, ("kmer",), summarizer)
    text = F.col("kmer").cast("string").alias("kmer")
    rest = [c for c in table.columns if c != "kmer"]
    valid = table.filter(summarizer.valid).select(text, *rest)
    return (valid, table.select(text)) if report_all else valid


def summarize(obs: DataFrame, by: tuple[str, ...], summarizer: Summarizer) -> DataFrame:
    """by, exts, n and the summary of observations (by, exts, ...)."""
    ones = F.count(F.lit(1)).alias("n")
    if summarizer.within:
        obs = obs.groupBy(*by, *summarizer.within).agg(F.bit_or("exts").alias("exts"), ones)
        ones = F.sum("n").alias("n")
    return obs.groupBy(*by).agg(F.bit_or("exts").alias("exts"), ones, *summarizer.columns())


def kmer_total(sequences: DataFrame, k: int) -> DataFrame:
    return sequences.agg(F.coalesce(F.sum(S.total_kmers("seq", k)), F.lit(0)).alias("total"))


def neighbour_bits(kmers: DataFrame, *, stranded: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """kmer, bit, target and the kept columns: each set extension bit and the (canonical) k-mer it points at."""
    steps = F.array(*[
        F.struct(F.lit(1 << (i + 4 * right)).alias("bit"), (S.extend_right if right else S.extend_left)("kmer", F.lit(b)).alias("to"))
        for right in (0, 1) for i, b in enumerate(S.BASES)
    ])
    rows = kmers.select("kmer", "exts", *keep, F.explode(steps).alias("s")).filter(F.col("exts").bitwiseAND(F.col("s.bit")) != 0)
    target = F.col("s.to") if stranded else S.canonical(F.col("s.to"))
    return rows.select("kmer", F.col("s.bit").alias("bit"), target.alias("target"), *keep)


def _with_bits(kmers: DataFrame, kept: DataFrame) -> DataFrame:
    """kmers with exts made of the kept (kmer, bit) rows."""
    new = kept.groupBy("kmer").agg(F.bit_or("bit").alias("_exts"))
    return kmers.join(new, "kmer", "left").withColumn("exts", F.coalesce("_exts", F.lit(0))).select(*kmers.columns)


def remove_censored_exts(kmers: DataFrame, *, stranded: bool = False) -> DataFrame:
    """kmers without extensions that lead out of the table."""
    bits = neighbour_bits(kmers, stranded=stranded)
    return _with_bits(kmers, bits.join(kmers.select(F.col("kmer").alias("target")), "target", "left_semi"))


def remove_censored_exts_sharded(kmers: DataFrame, all_kmers: DataFrame, *, stranded: bool = False, shard=None) -> DataFrame:
    """kmers without extensions to k-mers that this shard saw and dropped; unseen ones may be in
    another shard and stay. The tables are one shard, or all of them where `shard` is a function from
    the k-mer's column to its shard's: then each is repaired by what it saw itself, in one pass."""
    bits = neighbour_bits(kmers, stranded=stranded)
    dropped = all_kmers.select("kmer").join(kmers.select("kmer"), "kmer", "left_anti").select(F.col("kmer").alias("target")).distinct()
    if shard is None:
        return _with_bits(kmers, bits.join(dropped, "target", "left_anti"))
    bits = bits.withColumn("shard", shard(F.col("kmer")))
    return _with_bits(kmers, bits.join(dropped.withColumn("shard", shard(F.col("target"))), ["shard", "target"], "left_anti"))


def exts_from_set(kmers: DataFrame, *, stranded: bool = False) -> DataFrame:
    """kmers with the extensions whose target is in the table, whatever was observed."""
    bits = neighbour_bits(kmers.withColumn("exts", F.lit(255)), stranded=stranded)
    base = kmers.withColumn("exts", F.lit(0)) if "exts" not in kmers.columns else kmers
    return _with_bits(base, bits.join(kmers.select(F.col("kmer").alias("target")), "target", "left_semi"))
