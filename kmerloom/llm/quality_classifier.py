"""Quality classifier: perplexity under a Kneser-Ney model of trusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from . import kneser_ney as kn
from .common import Scratch, materialize
from .spans import numbered

#: Up to this many trusted ids (16 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def language_quantile(scored: DataFrame, quantile: float, *, step: float = 1e-3) -> DataFrame:
    """lang and its quantile of logppl, exact to `step`, from a histogram of steps."""
    hist = scored.groupBy("lang", F.ceil(F.col("logppl") / step).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy("lang")))
    return hist.filter(F.col("upto") >= F.col("all") * quantile).groupBy(F.col("lang").alias("qlang")).agg((F.min("b") * step).alias("limit"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    trusted: str = "quality = 1",
    order: int = 4,
    quantile: float = 0.98,
) -> DataFrame:
    """doc_id, lang, trusted, perplexity, limit, kept for every document.

    The model counts every n-gram of `order` bytes of the running text of the documents that `labels`
    trusts, per language; every document is scored by sharded joins of n-gram counts, a trusted one
    with its own n-grams taken off them. A document is kept if its log perplexity is at most the
    given quantile of its language's trusted documents, which from 50 of them on is not the worst
    one. A language without trusted text has no model; its documents are kept (there is nothing to
    hold against them), and so are documents without a word, which have no perplexity.

    Ids may be of any type. Null languages are one of their own; null ids are never trusted; repeated rows are scored
    each; repeated or contradictory labels trust a document if one of them does. An empty table
    gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    own = base.schema["doc_id"].dataType
    ids, names = labels.filter(trusted).select(F.col(doc_id).cast(own).alias("doc_id")).filter("doc_id is not null").distinct(), None
    if isinstance(own, IntegralType):
        base, ids = base.withColumn("doc_id", F.col("doc_id").cast("long")), ids.withColumn("doc_id", F.col("doc_id").cast("long"))
    else:  # ids of other types are numbered
        base = numbered(base, "doc_id", "classifier-rows")
        names = base.select(F.col("row_no").alias("doc_id"), F.col("doc_id").alias("_name"))
        ids = names.join(ids.withColumnRenamed("doc_id", "_name"), "_name", "left_semi").select("doc_id")
        base = base.select(F.col("row_no").alias("doc_id"), "lang", "text")
    with Scratch(docs.sparkSession, "classifier") as write:
        ids = write(ids, "trusted")
        side = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
        model = kn.Model(kn.count_grams(base.join(side, "doc_id", "left_semi"), order=order), order=order, write=write)
        marked = base.join(side.withColumn("counted", F.lit(True)), "doc_id", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
        scored = kn.block_scores(marked, model, write=write)
        scored = scored.withColumn("logppl", F.when(F.col("symbols") > 0, -F.col("total") / F.col("symbols")))
        scored = scored.join(side.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        limits = language_quantile(scored.filter("trusted and logppl is not null"), quantile)
        out = scored.join(F.broadcast(limits), scored["lang"].eqNullSafe(limits["qlang"]), "left")
        kept = F.coalesce(F.col("logppl") <= F.col("limit"), F.lit(True))
        if names is not None:
            out = out.join(names, "doc_id").withColumn("doc_id", F.col("_name"))
        return materialize(out.select("doc_id", "lang", "trusted", F.exp("logppl").alias("perplexity"), F.exp("limit").alias("limit"), kept.alias("kept")), "classifier-result")
