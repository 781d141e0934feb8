"""Quality rules: word statistics of a document, and an n-gram perplexity band of its language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kneser_ney as kn
from .common import Scratch, lean, materialize, slices
from .spans import MAX_BROADCAST_ROWS

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict = {}
    code = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
    pairs = code[:-1] * len(numbers) + code[1:]
    if window == 5 and len(numbers) < 2**31:
        pairs = np.unique(pairs, return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * (pairs.max() + 1) + pairs[2:], return_inverse=True)[1]
        runs = fours[:-1] * len(numbers) + code[4:]
    else:
        runs = np.unique(np.lib.stride_tricks.sliding_window_view(code, window), axis=0, return_inverse=True)[1].ravel()
    _, at, count = np.unique(runs, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = text.encode("utf-8", "replace").split()  # on the six ASCII blanks, as bytes do
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set = set()
    dup_lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
            elif line.strip(_BLANKS):
                seen.add(line)
    return len(words), chars, symbols, dup_lines, repeated_words(words), words


OUT = "row long, doc_id {id}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def band_by_language(scored: DataFrame, value: str, *, reach: float, reach_low: float, step: float = 1e-3) -> DataFrame:
    """mlang, low, high of `value`: the median plus `reach` times its distance from the upper quartile,
    and less `reach_low` times its distance from the lower one (distances of 0.01 at least). Quartiles
    move little with a share of outliers. They are exact to `step`: they are taken from a histogram
    of steps, whose size depends on the range and not on the number of documents.
    """
    hist = scored.groupBy("lang", F.round(F.col(value) / step).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy("lang")))
    quartile = [(F.min(F.when(F.col("upto") * 4 >= F.col("all") * i, F.col("b"))) * step).alias(f"q{i}") for i in (1, 2, 3)]
    q = hist.groupBy(F.col("lang").alias("mlang")).agg(*quartile)
    low = F.col("q2") - reach_low * F.greatest(F.col("q2") - F.col("q1"), F.lit(0.01))
    high = F.col("q2") + reach * F.greatest(F.col("q3") - F.col("q2"), F.lit(0.01))
    return q.select("mlang", low.alias("low"), high.alias("high"))


def quality_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = 5,
    reach: float = 5.0,
    reach_low: float = 8.0,
    outside: float = 2.0,
    outside_low: float = 3.0,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_model_bytes: int = 128_000_000,
) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    perplexity, low, high, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them repeated. The
    first model counts every n-gram of `order` bytes of the running text of every document. Documents
    whose perplexity under it lies outside a tight band of their language (outside, outside_low: see
    band_by_language) are taken off the counts, and the second model scores all documents, each of
    which is judged by the others. A document is kept if it passes the base rules and its perplexity
    lies within its language's wide band (reach, reach_low). Bands come from the quartiles of the log
    perplexities of the language's documents of at least min_words words.

    A model of at most max_model_bytes is handed to the tasks as plain sorted arrays; a larger one
    is joined with the documents' n-grams shard by shard, with the same results.

    A null text has no words, a null language is one of its own, null ids stay null, repeated rows
    are judged each, an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    @lean
    def judge(batches):
        for batch in slices(batches):
            out = []
            for row, ident, own, body in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "lang", "text")]):
                out.append((row, ident, own, *text_statistics(body)[:5]))
            kinds = [pa.int64(), batch.schema.field("doc_id").type, pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in OUT.split(", ")])

    with Scratch(spark, "rules") as write:
        # A number for each row of this reading tells repeated ids apart; the written copy fixes it.
        rows = write(base.withColumn("row", F.monotonically_increasing_id()), "rows")

        def scores(marked: DataFrame, model: kn.Model) -> DataFrame:
            """row, logppl (null without words) of marked rows (row, lang, text, counted)."""
            if model.bytes() > max_model_bytes:
                totals = kn.block_scores(marked.select(F.col("row").alias("doc_id"), "lang", "text", "counted"), model, write=write)
                totals = totals.select(F.col("doc_id").alias("row"), "total", "symbols")
            else:
                shared = spark.sparkContext.broadcast(model.arrays())

                @lean
                def score(batches):
                    tables = kn.array_tables(shared.value)
                    for batch in slices(batches):
                        by_lang: dict = {}
                        for row, own, body, counted in zip(*[batch.column(c).to_pylist() for c in ("row", "lang", "text", "counted")]):
                            for column, value in zip(by_lang.setdefault(own, ([], [], [])), (row, kn.running(body), counted)):
                                column.append(value)
                        for own, (numbers, texts, counted) in by_lang.items():
                            total, symbols = kn.score_texts(tables, own, texts, counted)
                            yield pa.RecordBatch.from_pydict({"row": pa.array(numbers, pa.int64()), "total": total, "symbols": symbols})

                totals = marked.select("row", "lang", "text", "counted").mapInArrow(score, "row long, total double, symbols long")
            return write(totals.select("row", F.when(F.col("symbols") > 0, -F.col("total") / F.col("symbols")).alias("logppl")), "scores")

        stats = write(rows.select("row", "doc_id", "lang", "text").mapInArrow(judge, OUT.format(id=kind)), "statistics")
        counts = write(kn.count_grams(rows, order=order), "counts")
        first = stats.select("row", "lang", "n_words").join(scores(rows.withColumn("counted", F.lit(True)), kn.Model(counts, order=order, write=write)), "row").filter("logppl is not null")
        edges = band_by_language(first.filter(F.col("n_words") >= min_words), "logppl", reach=outside, reach_low=outside_low)
        out = first.join(F.broadcast(edges), first["lang"].eqNullSafe(edges["mlang"])).filter("logppl < low or logppl > high").select("row")
        out = write(out, "outside")
        out = F.broadcast(out) if out.count() <= MAX_BROADCAST_ROWS else out
        less = kn.count_grams(rows.join(out, "row", "left_semi"), order=order).withColumn("n", -F.col("n"))
        counts = counts.unionByName(less).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        marked = rows.join(out.withColumn("counted", F.lit(False)), "row", "left").withColumn("counted", F.coalesce("counted", F.lit(True)))
        scored = stats.join(scores(marked, kn.Model(counts, order=order, write=write)), "row")
        band = band_by_language(scored.filter(F.col("n_words") >= min_words).filter("logppl is not null"), "logppl", reach=reach, reach_low=reach_low)
        scored = scored.join(F.broadcast(band), scored["lang"].eqNullSafe(band["mlang"]), "left")
        failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
        inside = F.coalesce(F.col("logppl").between(F.col("low"), F.col("high")), F.lit(False))
        return materialize(
            scored.withColumn("base_failed", failed).select(
                "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                F.exp("logppl").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), (~F.col("base_failed") & inside).alias("kept"),
            ), "rules-result",
        )
