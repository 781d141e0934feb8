"""Sequence graphs: nodes(node_id, seq, len, exts, members, data), and edges derived by joins."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exts as E
from ..functions import seq as S
from .compact import Compression, paths, spell
from .tables import Temporary, bucketed, written


@dataclass(frozen=True)
class Graph:
    """Nodes of a graph of k-mers; overlaps of neighbours are k - 1 bases."""

    nodes: DataFrame
    k: int
    stranded: bool = False
    #: ends() of the nodes in buckets, from indexed(); good as long as ids and sequences stay.
    index: DataFrame | None = None
    #: edges() of the graph, where they are written already; good as long as ids, sequences and exts stay.
    known: DataFrame | None = None
    #: Whether a k-mer is in one node only, and each extension to a node has one back, as those of counted k-mers do.
    mutual: bool = False

    def indexed(self) -> Graph:
        """The graph with its node ends written once, in sorted buckets by (kmer, side): every lookup then
        shuffles what is looked up and not the ends."""
        return replace(self, index=bucketed(ends(self.nodes, self.k), ("kmer", "side"), "ends"))

    def renumbered(self) -> Graph:
        """Node ids 0, 1, ... in the order of the sequences, so that they do not depend on the run.

        Parts of the sorted table number their own rows; the parts' sizes add up before them.
        """
        part = written(self.nodes.drop("node_id").repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
        sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        nodes = part.join(F.broadcast(sizes), "_p").withColumn("node_id", F.col("_before") + F.col("_i") - F.col("_first"))
        return replace(self, index=None, known=None, nodes=nodes.select("node_id", *[c for c in self.nodes.columns if c != "node_id"]))

    def normalised(self) -> Graph:
        """Every node in the lesser of its two directions, then renumbered."""
        if self.stranded:
            return self.renumbered()
        other = S.rc("seq")
        turn = other < F.col("seq")
        same = other == F.col("seq")
        exts = F.when(turn, E.rc("exts")).when(same, F.least(F.col("exts"), E.rc("exts"))).otherwise(F.col("exts"))
        return replace(self, index=None, known=None, nodes=self.nodes.withColumn("exts", exts).withColumn("seq", F.least("seq", other))).renumbered()


def ends(nodes: DataFrame, k: int) -> DataFrame:
    """node_id, side, kmer: the first k-mer of a node (side L) and its last (side R)."""
    both = F.array(F.struct(F.lit("L").alias("side"), F.left("seq", F.lit(k)).alias("kmer")), F.struct(F.lit("R").alias("side"), F.right("seq", F.lit(k)).alias("kmer")))
    return nodes.select("node_id", F.explode(both).alias("e")).select("node_id", "e.side", "e.kmer")


def find_links(probes: DataFrame, graph: Graph) -> DataFrame:
    """probes (kmer, dir) with dst, dst_side, rc of the node that a walk in direction dir enters there.

    A walk to the right enters a node at its first k-mer; else, without strands, at the last one
    read backwards. The forward match is preferred, then the least id. Unmatched probes are dropped.
    """
    end = graph.index if graph.index is not None else ends(graph.nodes, graph.k)
    entry = F.when(F.col("dir") == "R", "L").otherwise("R")
    tries = probes.withColumn("_try", F.lit(0)).withColumn("_k", F.col("kmer")).withColumn("_side", entry)
    if not graph.stranded:
        tries = tries.unionByName(probes.withColumn("_try", F.lit(1)).withColumn("_k", S.rc("kmer")).withColumn("_side", F.col("dir")))
    end = end.select(F.col("node_id").alias("dst"), F.col("side").alias("_side"), F.col("kmer").alias("_k"))
    met = tries.join(end, ["_k", "_side"])
    best = F.min(F.struct(F.col("_try"), F.col("dst"), F.col("_side").alias("dst_side")))
    found = met.groupBy(*probes.columns).agg(best.alias("b"))
    return found.select(*probes.columns, "b.dst", "b.dst_side", (F.col("b._try") == 1).alias("rc"))


def probes_of(nodes: DataFrame, k: int) -> DataFrame:
    """src, dir, base, kmer: the k-mer that each extension of a node leads to."""
    steps = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(b).alias("base"), F.lit(1 << (i + (4 if d == "R" else 0))).alias("bit")) for d in "LR" for i, b in enumerate(S.BASES)])
    rows = nodes.select(F.col("node_id").alias("src"), F.left("seq", F.lit(k)).alias("first"), F.right("seq", F.lit(k)).alias("last"), "exts", F.explode(steps).alias("s"))
    rows = rows.filter(F.col("exts").bitwiseAND(F.col("s.bit")) != 0)
    kmer = F.when(F.col("s.dir") == "R", S.extend_right("last", F.col("s.base"))).otherwise(S.extend_left("first", F.col("s.base")))
    return rows.select("src", "s.dir", "s.base", kmer.alias("kmer"))


def edges(graph: Graph) -> DataFrame:
    """src, src_dir, base, dst, dst_side, rc for each extension that leads to a node."""
    if graph.known is not None:
        return graph.known
    if graph.mutual and not graph.stranded:
        return mutual_edges(graph)
    found = find_links(probes_of(graph.nodes, graph.k), graph)
    return found.select("src", F.col("dir").alias("src_dir"), "base", "dst", "dst_side", "rc")


def mutual_edges(graph: Graph) -> DataFrame:
    """edges() of a mutual graph: the two extensions with one (k+1)-mer are an edge and its way back. So extensions
    are grouped, and no node ends are looked up."""
    nodes = graph.nodes.withColumn("bend", _single_palindrome("seq", graph.k))
    steps = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(b).alias("base"), F.lit(1 << (i + (4 if d == "R" else 0))).alias("bit")) for d in "LR" for i, b in enumerate(S.BASES)])
    own = F.filter(steps, lambda s: F.col("exts").bitwiseAND(s["bit"]) != 0)
    rows = nodes.select(F.col("node_id").alias("src"), "bend", F.left("seq", F.lit(graph.k)).alias("first"), F.right("seq", F.lit(graph.k)).alias("last"), F.explode(own).alias("s"))
    key = F.when(F.col("s.dir") == "R", F.concat("last", "s.base")).otherwise(F.concat("s.base", "first"))
    rows = rows.select(S.canonical(key).alias("key"), F.struct("src", F.col("s.dir").alias("dir"), F.col("s.base").alias("base"), "bend").alias("x"))
    # Two k-mers have a (k+1)-mer; only palindromes see it from both of their sides, so there are four rows at most.
    met = rows.groupBy("key").agg(F.collect_list("x").alias("all")).select("key", "all", F.explode("all").alias("x"))
    other = F.filter("all", lambda y: (y["src"] != F.col("x.src")) | ((y["dir"] != F.col("x.dir")) & ~y["bend"]))
    met = met.select("x", other.alias("other"), S.is_palindrome("key").alias("turns")).filter((F.size("other") > 0) | F.col("turns"))
    flipped = F.when(F.col("x.dir") == "R", "L").otherwise("R")
    there = F.element_at(F.when(F.size("other") > 0, F.col("other")).otherwise(F.array("x")), 1)
    met = met.select("x.src", F.col("x.dir").alias("src_dir"), "x.base", there["src"].alias("dst"), F.when(there["bend"], flipped).otherwise(there["dir"]).alias("dst_side"))
    return met.withColumn("rc", F.col("src_dir") == F.col("dst_side"))


def edge_bit(base: Column, src_dir: Column) -> Column:
    return E.bit(base, src_dir == "R")


def fix_exts(graph: Graph, valid: DataFrame | None = None) -> Graph:
    """The graph without extensions that lead to no node, or to none of valid (node_id). Its edges are looked up
    once, written, and known from then on."""
    own = graph.known if graph.known is not None else written(edges(graph), "edges")
    if valid is not None:
        own = own.join(valid.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(own.columns)
    new = own.groupBy(F.col("src").alias("node_id")).agg(F.bit_or(edge_bit(F.col("base"), F.col("src_dir"))).alias("_e"))
    nodes = graph.nodes.join(new, "node_id", "left").withColumn("exts", F.coalesce("_e", F.lit(0))).select(*graph.nodes.columns)
    return replace(graph, nodes=written(nodes, "fixed"), known=own, mutual=graph.mutual and valid is None)


def without(graph: Graph, censor: DataFrame) -> Graph:
    """The graph without the nodes of censor (node_id), and without extensions that lead to these. A k-mer is at the
    ends of one node only, as in graphs of unitigs: then no edge leads elsewhere for it, and none is looked up."""
    gone = lambda c: censor.select(F.col("node_id").alias(c))
    nodes = graph.nodes.join(gone("node_id"), "node_id", "left_anti")
    own = edges(graph)
    kept = own.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select(own.columns)
    return fix_exts(replace(graph, index=None, nodes=nodes, known=written(kept, "edges")))


def _single_palindrome(seq: str, k: int) -> Column:
    return (F.length(seq) == k) & S.is_palindrome(seq)


def compress_graph(graph: Graph, spec: Compression | None = None, censor: DataFrame | None = None) -> Graph:
    """The graph, without the nodes of censor (node_id), with unbranched neighbours merged."""
    spec = spec or Compression()
    if censor is not None:
        graph = replace(graph, index=None, known=None, nodes=written(graph.nodes.join(censor.select("node_id"), "node_id", "left_anti"), "kept"))
    # Known edges are those of exts that are mended.
    kept = graph if graph.known is not None else fix_exts(graph)
    table = kept.nodes.withColumnRenamed("node_id", "id")
    links = edges(kept).join(table.select(F.col("id").alias("src"), F.col("exts").alias("sexts"), F.col("seq").alias("sseq"), F.col("data").alias("sdata")), "src")
    links = links.join(table.select(F.col("id").alias("dst"), F.col("exts").alias("dexts"), F.col("seq").alias("dseq"), F.col("data").alias("ddata")), "dst")
    right, arrive_right = F.col("src_dir") == "R", F.col("dst_side") == "R"
    links = links.filter((F.col("src") != F.col("dst")) & (E.count("sexts", right) == 1) & (E.count("dexts", arrive_right) == 1) & spec.join_test(F.col("sdata"), F.col("ddata")))
    if not graph.stranded:
        entry = F.when(arrive_right, F.right("dseq", F.lit(graph.k))).otherwise(F.left("dseq", F.lit(graph.k)))
        links = links.filter(~_single_palindrome("sseq", graph.k) & ~S.is_palindrome(entry))
    links = links.select((F.col("src") * 2 + (~right).cast("int")).alias("s"), (F.col("dst") * 2 + arrive_right.cast("int")).alias("t"))
    with Temporary(table.sparkSession, "merge") as write:
        merged = written(spell(table, paths(table, links, write, stranded=graph.stranded), graph.k, spec), "merged")
    return fix_exts(replace(graph, index=None, known=None, nodes=merged))


def uncompressed_pairs(graph: Graph, spec: Compression | None = None) -> DataFrame:
    """src, dst of neighbours that compression should have merged; empty for a compressed graph.

    Exempt are single palindromic k-mers and links of a node with itself.
    """
    spec = spec or Compression()
    own = graph.known if graph.known is not None else written(edges(graph), "edges")
    degree = own.groupBy("src", "src_dir").agg(F.count(F.lit(1)).alias("deg")).filter("deg = 1").select("src", "src_dir")
    one = own.join(degree, ["src", "src_dir"])
    back = degree.select(F.col("src").alias("dst"), F.col("src_dir").alias("dst_side"))
    side = graph.nodes.select("node_id", "seq", "data")
    rows = one.join(back, ["dst", "dst_side"]).filter("src <> dst").join(side.select(F.col("node_id").alias("src"), F.col("seq").alias("sseq"), F.col("data").alias("sdata")), "src")
    rows = rows.join(side.select(F.col("node_id").alias("dst"), F.col("seq").alias("dseq"), F.col("data").alias("ddata")), "dst")
    return rows.filter(~_single_palindrome("sseq", graph.k) & ~_single_palindrome("dseq", graph.k) & spec.join_test(F.col("sdata"), F.col("ddata"))).select("src", "dst")


def is_compressed(graph: Graph, spec: Compression | None = None) -> bool:
    return not uncompressed_pairs(graph, spec).head(1)


def combine(graphs: list[Graph]) -> Graph:
    """All nodes of graphs of one kind, with new ids; their extensions stay."""
    if len({(g.k, g.stranded) for g in graphs}) != 1:
        raise ValueError("graphs to combine must agree in k and strandedness")
    nodes = reduce(DataFrame.unionByName, [g.nodes for g in graphs])
    return replace(graphs[0], index=None, known=None, mutual=False, nodes=nodes).renumbered()


def base_graph(sequences: DataFrame, k: int, *, stranded: bool = False) -> Graph:
    """A graph of sequences (seq, exts, data) as nodes, numbered in the order of seq; no link is made."""
    if sequences.filter(F.length("seq") < k).head(1):
        raise ValueError("a node has k bases or more")
    nodes = sequences.select(F.lit(0).cast("long").alias("node_id"), "seq", F.length("seq").alias("len"), "exts", F.lit(1).cast("long").alias("members"), "data")
    return Graph(nodes, k, stranded).renumbered()


def add(graph: Graph, sequences: DataFrame) -> Graph:
    """The graph with further nodes (seq, exts, data) of any origin; ids are given anew."""
    more = base_graph(sequences, graph.k, stranded=graph.stranded)
    return combine([graph, replace(more, nodes=more.nodes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in graph.nodes.schema.fields]))])


def nodes_by_id(graph: Graph, ids: DataFrame) -> DataFrame:
    """The nodes whose node_id is among ids (node_id)."""
    return graph.nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def node_kmers(graph: Graph) -> DataFrame:
    """node_id, pos, kmer of all k-mers of all nodes."""
    return graph.nodes.select("node_id", F.posexplode(S.kmers("seq", graph.k)).alias("pos", "kmer"))


def degrees(graph: Graph) -> DataFrame:
    return graph.nodes.select("node_id", E.count("exts", False).alias("left"), E.count("exts", True).alias("right"))


def tips(graph: Graph, predicate: Column | None = None) -> DataFrame:
    """node_id of the nodes that end on one side and have at most one way on the other."""
    left, right = E.count("exts", False), E.count("exts", True)
    end = ((left == 0) & (right <= 1)) | ((right == 0) & (left <= 1))
    return graph.nodes.filter(end & (predicate if predicate is not None else F.lit(True))).select("node_id")


def clean(graph: Graph, predicate: Column | None = None, spec: Compression | None = None) -> Graph:
    """The graph without its tips, compressed again."""
    return compress_graph(graph, spec, written(tips(graph, predicate), "tips"))
