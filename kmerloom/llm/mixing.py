"""Temperature mixing of sources (DataFrame functions only).

A source with token share p gets weight p**a / sum(p**a). The exponent a in [0, 1] is bisected
so that the entropy of the weights meets a target, or so that no source is repeated more than
a limit; with both, the larger exponent wins (it is the milder change). The weights are then
realised: a source's token budget is whole epochs over all its documents, and one partial epoch
that walks a permutation of blocks of documents and stops at the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Words are runs of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Halvings of the exponent's interval per pass over the source table, and passes.
LEVELS, PASSES = 5, 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def solve_exponent(shares: DataFrame, budget_ratio: float | None, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent for a table of positive shares `p`.

    budget_ratio: budget over available tokens; None for the budget that gives the largest source
    one epoch. Each pass evaluates the 2**LEVELS - 1 midpoints
    that LEVELS bisection steps could visit in one aggregation, so that only one row of sums per
    pass reaches the driver, whatever the number of sources.
    """

    def too_flat(a: float, z: float, zl: float, low: float, floor_h: float) -> bool:
        entropy = math.log(z) - a * zl / z
        flat = target_entropy is not None and entropy > max(target_entropy, floor_h)
        repeats = math.exp((a - 1) * (low - high)) if budget_ratio is None else math.exp((a - 1) * low) * budget_ratio / z
        return flat or (max_repeats is not None and repeats > max_repeats)

    at_one = shares.agg(F.sum(F.col("p") * F.log("p")).alias("zl"), F.min(F.log("p")).alias("low"), F.max(F.log("p")).alias("high")).first()
    if at_one["low"] is None:
        return 1.0
    floor_h, high = -at_one["zl"], at_one["high"]
    lo, hi = 0.0, 1.0  # the largest exponent always meets the entropy's lower end
    for _ in range(PASSES):
        n = 2**LEVELS
        grid = [lo + (hi - lo) * i / n for i in range(1, n)]
        sums = shares.agg(
            *[F.sum(F.exp(F.log("p") * g)).alias(f"z{i}") for i, g in enumerate(grid)],
            *[F.sum(F.exp(F.log("p") * g) * F.log("p")).alias(f"l{i}") for i, g in enumerate(grid)],
        ).first()
        a, b = 0, n  # the interval lo..hi in grid steps
        while b - a > 1:
            m = (a + b) // 2
            if too_flat(grid[m - 1], sums[f"z{m - 1}"], sums[f"l{m - 1}"], at_one["low"], floor_h):
                a = m
            else:
                b = m
        step = (hi - lo) / n
        lo, hi = lo + a * step, lo + b * step
    return hi


def mix_sources(
    docs: DataFrame,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    budget_tokens: int | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    block_tokens: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it, plus mix_tokens, mix_epoch,
    mix_block, mix_block_key and mix_doc_key.

    Reading order of the mixture: mix_epoch, mix_block_key, mix_block, mix_doc_key. By default the
    budget is the least that takes every document once: the source with the largest share gets one
    epoch and smaller ones up to max_repeats. With budget_tokens, sources may also get less than an
    epoch. A document is taken in the partial epoch if it still fits
    the budget in that order, so no source exceeds its budget.

    Nulls: a null source is a source of its own, a null text has no tokens, a null id is ordered
    as an empty one. Documents without tokens cost nothing: they come in every whole epoch and
    with their block in the partial one; a source without any tokens gets one epoch. Rows with
    equal ids share a key and are taken or left together. An empty table gives no rows. Columns
    named like the added ones are replaced.
    """
    own = ["mix_tokens", "mix_epoch", "mix_block", "mix_block_key", "mix_doc_key"]
    docs = docs.drop(*own)
    # Columns are numbered while helpers stand beside them, so no name of theirs can clash.
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source, doc_id, text = (f"c{names.index(c)}" for c in (source, doc_id, text))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    tokens = word_count(F.col(text))

    sizes = materialize(docs.select(key.alias("_src"), tokens.alias("_t")).groupBy("_src").agg(F.sum("_t").alias("_avail"), F.count(F.lit(1)).alias("_docs")), "mix-sizes")
    total = sizes.agg(F.sum("_avail")).first()[0] or 0
    share = F.log(F.col("_avail") / F.lit(float(max(total, 1))))
    shares = sizes.filter("_avail > 0").select(F.exp(share).alias("p"))
    alpha = solve_exponent(shares, None if budget_tokens is None else budget_tokens / max(total, 1), target_entropy, max_repeats)
    facts = shares.agg(F.sum(F.exp(F.log("p") * alpha)).alias("z")).first()
    if budget_tokens is None:
        most = sizes.filter("_avail > 0").agg(F.max(share)).first()[0] or 0.0
        tokens_of = F.col("_avail") * F.exp((share - most) * (alpha - 1))
    else:
        tokens_of = F.exp(share * alpha) / (facts["z"] or 1.0) * float(budget_tokens)
    plan = (
        sizes.withColumn("_budget", F.when(F.col("_avail") > 0, F.floor(tokens_of).cast("long")).otherwise(0))
        .withColumn("_epochs", F.when(F.col("_avail") > 0, F.floor(F.col("_budget") / F.col("_avail"))).otherwise(1).cast("int"))
        .withColumn("_rest", F.when(F.col("_avail") > 0, F.col("_budget") - F.col("_epochs") * F.col("_avail")).otherwise(0))
        .withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_avail") / block_tokens)).cast("long"))
    )
    plan = materialize(plan, "mix-plan")

    def with_keys(df: DataFrame) -> DataFrame:
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_ident")))
        df = df.withColumn("mix_block", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("_blocks")))
        return df

    def block_key(epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_src"), epoch.cast("string"), F.col("mix_block").cast("string")))

    def doc_key(epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("_ident")))

    # The partial epoch ends at one place of each source's order: a block and a document key in it.
    narrow = with_keys(docs.select(key.alias("_src"), ident.alias("_ident"), tokens.alias("_t")).join(plan.filter("_rest > 0"), "_src"))
    blocks = narrow.groupBy("_src", "mix_block", "_rest", "_epochs").agg(F.sum("_t").alias("_bt"))
    blocks = blocks.withColumn("_bkey", block_key(F.col("_epochs")))
    by_block = Window.partitionBy("_src").orderBy("_bkey", "mix_block").rowsBetween(Window.unboundedPreceding, 0)
    cut = blocks.withColumn("_upto", F.sum("_bt").over(by_block)).withColumn("_left", F.col("_rest") - (F.col("_upto") - F.col("_bt")))
    cut = materialize(cut.filter("_left >= 0 and _left < _bt").select("_src", F.col("mix_block").alias("_cut"), "_left", F.col("_bkey").alias("_cut_key")), "mix-cut")
    in_block = Window.partitionBy("_src").orderBy("_dkey").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        narrow.join(cut, "_src")
        .filter("mix_block = _cut")
        .withColumn("_dkey", doc_key(F.col("_epochs")))
        .withColumn("_sum", F.sum("_t").over(in_block))
        .filter("_sum <= _left")
        .groupBy("_src")
        .agg(F.max("_dkey").alias("_last"))
    )
    ends = materialize(plan.select("_src", "_epochs", "_rest", "_blocks").join(cut.join(last, "_src", "left"), "_src", "left"), "mix-ends")

    rows = docs.withColumn("_src", key).withColumn("_ident", ident).withColumn("mix_tokens", tokens)
    rows = with_keys(rows.join(ends, "_src"))
    bkey, dkey = block_key(F.col("_epochs")), doc_key(F.col("_epochs"))
    before = (bkey < F.col("_cut_key")) | ((bkey == F.col("_cut_key")) & (F.col("mix_block") < F.col("_cut")))
    at_cut = (F.col("mix_block") == F.col("_cut")) & (dkey <= F.col("_last"))
    partial = F.coalesce((F.col("_rest") > 0) & (before | at_cut), F.lit(False))
    rows = rows.withColumn("_n", F.col("_epochs") + partial.cast("int")).filter("_n > 0")
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("mix_block_key", block_key(F.col("mix_epoch"))).withColumn("mix_doc_key", doc_key(F.col("mix_epoch")))
    return rows.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], *own)
