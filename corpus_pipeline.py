"""A training corpus in five stages, from the table `documents` to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; its result
is written as Parquet to the shared folder and read again as the next one's docs.

Null ids, languages and sources stay as they are. A null or empty text has no letter, so the first
stage leaves it out; given to a later stage it stays, as an empty text. Repeated rows are copies of
each other, of which the second stage keeps one. A table without rows gives none. Columns beside
those of documents come along up to the last stage, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import common, jaccard_join, langid, mixing, packing, suffix_dedup
from kmerloom.llm.queries import tokenizer_path


#: The columns of documents.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_columns(stage):
    """A stage that returns the columns it is given: those beside OWN have other names within, so that
    none clashes with what an operator adds."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        within = [c if c in OWN else f"beside_{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*within), sf_dir).toDF(*names)

    return run


@keeping_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cross-parsing cannot tell (no letter, or two languages fit alike) go."""
    return langid.keep_identified(docs, langid.learn(docs))


@keeping_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (the least id, nulls first) of each group of near-duplicates stays; texts
    without a word are in no group."""
    return jaccard_join.keep_first(docs)


@keeping_columns
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes are cut out of the texts; the documents stay, and n_chars follows.
    Of a character that a cut splits nothing is left."""
    own = docs.columns
    out = suffix_dedup.dedup_substrings(docs).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(own)


@keeping_columns
def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: all once at least, those of small sources
    again."""
    return mixing.mix_sources(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", sequences),
]

#: Cross-parsing, prefix doubling and tokenisation are beyond SQL; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result goes when the next one is written."""
    docs, before = common.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.fresh_path(spark, "stage-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.drop_path(spark, before)
        before = path
    return docs
