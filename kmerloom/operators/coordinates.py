"""Random access to a set of sequences or the k-mers of a graph, by one running number.

All k-mers of all sequences (bases are k = 1), in the order of their ids, have a number: the sizes of
the sequences before add up. An index holds the sequences in pieces by blocks of numbers, so a
lookup is an equi-join on the block, whatever the sequences' lengths, and moves pieces of a block at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .tables import starts, written

#: Numbers of a block.
BLOCK = 1 << 12


@dataclass(frozen=True)
class Index:
    """pieces(block, at, text): text begins at number `at` and has the block's k-mers of one sequence;
    starts(id, size, start); total, how many numbers there are."""

    pieces: DataFrame
    starts: DataFrame
    k: int
    total: int


def index(sequences: DataFrame, *, k: int = 1, ident: str = "seq_id") -> Index:
    """The index of sequences (ident unique, seq); null sequences and those without a k-mer have no number."""
    rows = sequences.filter(F.length("seq") >= k).select(F.col(ident).alias("id"), "seq", (F.length("seq") - (k - 1)).cast("long").alias("size"))
    first = starts(rows.select("id", "size"))
    placed = rows.join(first.select("id", "start"), "id")
    last = F.col("start") + F.col("size") - 1
    cut = placed.select("seq", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))).alias("block"))
    at = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    text = F.substring("seq", (at - F.col("start") + 1).cast("int"), (end - at).cast("int") + (k - 1))
    pieces = cut.select("block", at.alias("at"), text.alias("text"))
    pieces = written(pieces.repartitionByRange("block").sortWithinPartitions("block", "at"), "coordinates")
    return Index(pieces, first, k, first.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])


def slices(index: Index, queries: DataFrame) -> DataFrame:
    """query, seq of queries (query, start, end; half-open, over the bases of all sequences in order, k = 1).
    What lies outside has no bases; a query without any gives no row."""
    if index.k != 1:
        raise ValueError("slices are of bases: k = 1")
    asked = queries.filter("start < end").select("query", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block"))
    met = asked.join(index.pieces, "block").filter((F.col("at") < F.col("end")) & (F.col("at") + F.length("text") > F.col("start")))
    begin = F.greatest(F.col("start"), F.col("at"))
    part = F.substring("text", (begin - F.col("at") + 1).cast("int"), (F.col("end") - begin).cast("int"))
    # A group is as large as the slice that it becomes.
    parts = F.transform(F.array_sort(F.collect_list(F.struct(begin.alias("at"), part.alias("part")))), lambda x: x["part"])
    return met.groupBy("query").agg(F.array_join(parts, "").alias("seq"))


def sequence_slices(index: Index, queries: DataFrame) -> DataFrame:
    """query, seq of queries (query, id, start, end), within each sequence; what lies outside has no bases."""
    own = queries.withColumnRenamed("start", "_from").join(index.starts, "id")
    inside = lambda c: F.col("start") + F.greatest(F.lit(0), F.least(F.col(c), F.col("size")))
    return slices(index, own.select("query", inside("_from").alias("start"), inside("end").alias("end")))


def kmers_at(index: Index, queries: DataFrame) -> DataFrame:
    """query, kmer of queries (query, n): the n-th k-mer of all. A number outside gives no row."""
    asked = queries.select("query", "n", F.floor(F.col("n") / BLOCK).alias("block"))
    inside = (F.col("n") >= F.col("at")) & (F.col("n") + index.k <= F.col("at") + F.length("text"))
    return asked.join(index.pieces, "block").filter(inside).select("query", F.substring("text", (F.col("n") - F.col("at") + 1).cast("int"), F.lit(index.k)).alias("kmer"))


def graph_index(graph: Graph) -> Index:
    """The k-mers of all nodes, by node id and place."""
    return index(graph.nodes, k=graph.k, ident="node_id")


def spread_over(total: int, parts: int, number: Column) -> Column:
    """The number-th of `parts` places spread evenly over 0 to total - 1."""
    return F.floor(number * total / parts).cast("long")
