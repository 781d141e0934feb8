"""Graphs as text: GFA, DOT and JSON lines, and their writers.

Every format is a table (node_id, line_no, line), so it is written in parts by Spark; a part holds
whole nodes, and the parts in order are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph, edges


#: The first line of a GFA file.
GFA_HEADER = "H\tVN:Z:1.0\tPR:Z:kmerloom"


def gfa_lines(graph: Graph, *, tag: Column | None = None) -> DataFrame:
    """node_id, line_no, line: the header (node -1), and per node its S line and L lines.

    A link is written once: with its left side if the target's id is not smaller, with its right
    side if it is larger (so a right side that links with itself is not written).
    """
    spark = graph.nodes.sparkSession
    head = spark.createDataFrame([(-1, 0, GFA_HEADER)], "node_id long, line_no int, line string")
    node = F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), F.col("seq"), *([tag] if tag is not None else []))
    segments = graph.nodes.select("node_id", F.lit(0).alias("line_no"), node.alias("line"))
    left = F.col("src_dir") == "L"
    kept = edges(graph).filter((left & (F.col("dst") >= F.col("src"))) | (~left & (F.col("dst") > F.col("src"))))
    number = F.when(left, 1).otherwise(5) + F.instr(F.lit("ACGT"), F.col("base")) - 1
    link = F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), F.when(left, "-").otherwise("+"), F.col("dst").cast("string"), F.when(F.col("dst_side") == "L", "+").otherwise("-"), F.lit(f"{graph.k - 1}M"))
    links = kept.select(F.col("src").alias("node_id"), number.cast("int").alias("line_no"), link.alias("line"))
    return head.unionByName(segments).unionByName(links)


def dot_lines(graph: Graph, *, label: Column | None = None) -> DataFrame:
    """node_id, line_no, line: per node its own line and one per edge, blue where the edge arrives at
    a left side and red otherwise; left edges point to the node, right edges away from it."""
    spark = graph.nodes.sparkSession
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    label = label if label is not None else F.lit("")
    node = F.concat(name(F.col("node_id")), F.lit(' [label="id:'), F.col("node_id").cast("string"), F.lit(" len:"), F.length("seq").cast("string"), F.lit("  "), label, F.lit('",style=filled]'))
    own = graph.nodes.select("node_id", F.lit(0).alias("line_no"), node.alias("line"))
    left = F.col("src_dir") == "L"
    a, b = F.when(left, name(F.col("dst"))).otherwise(name(F.col("src"))), F.when(left, name(F.col("src"))).otherwise(name(F.col("dst")))
    colour = F.when(F.col("dst_side") == "L", "blue").otherwise("red")
    number = F.when(left, 1).otherwise(5) + F.instr(F.lit("ACGT"), F.col("base")) - 1
    links = edges(graph).select(F.col("src").alias("node_id"), number.cast("int").alias("line_no"), F.concat(a, F.lit(" -> "), b, F.lit(" [color="), colour, F.lit("]")).alias("line"))
    frame = spark.createDataFrame([(-1, 0, "digraph {"), (2**62, 0, "}")], "node_id long, line_no int, line string")
    return frame.unionByName(own).unionByName(links)


def json_nodes(graph: Graph, *, data: Column | None = None) -> DataFrame:
    """node_id, line: a JSON object with id, length L, data D and the whole sequence Se."""
    data = data if data is not None else F.col("data")
    return graph.nodes.select("node_id", F.to_json(F.struct(F.col("node_id").cast("string").alias("id"), F.length("seq").alias("L"), data.alias("D"), F.col("seq").alias("Se"))).alias("line"))


def json_links(graph: Graph) -> DataFrame:
    """node_id, line: a JSON object for each right edge, D being the side arrived at."""
    right = edges(graph).filter("src_dir = 'R'")
    return right.select(F.col("src").alias("node_id"), F.to_json(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.col("dst_side").alias("D"))).alias("line"))


def json_document(graph: Graph, *, data: Column | None = None, rest: dict[str, str] | None = None) -> DataFrame:
    """node_id, line_no, line: one valid JSON document {"nodes": [...], "links": [...], ...rest}.

    rest: further members as JSON text. Commas stand before all lines but the first of a list.
    """
    spark = graph.nodes.sparkSession
    nodes, links = json_nodes(graph, data=data), json_links(graph)
    first_node, first_link = nodes.agg(F.min("node_id").alias("m")), links.agg(F.min(F.struct("node_id", "line")).alias("m"))
    comma = lambda is_first, line: F.concat(F.when(is_first, "").otherwise(","), line)
    a = nodes.crossJoin(F.broadcast(first_node)).select(F.lit(1).alias("part"), "node_id", comma(F.col("node_id") == F.col("m"), F.col("line")).alias("line"))
    b = links.crossJoin(F.broadcast(first_link)).select(F.lit(3).alias("part"), "node_id", comma((F.col("node_id") == F.col("m.node_id")) & (F.col("line") == F.col("m.line")), F.col("line")).alias("line"))
    tail = "]" + "".join(f',"{k}":{v}' for k, v in (rest or {}).items()) + "}"
    frame = spark.createDataFrame([(0, 0, '{"nodes":['), (2, 0, '],"links":['), (4, 0, tail)], "part int, node_id long, line string")
    return frame.unionByName(a).unionByName(b)


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("node_id", "line_no")) -> None:
    """Write a table's `line` column as text, sorted, in as many parts as Spark's range sort makes."""
    lines.orderBy(*order).select("line").write.text(path)


def write_gfa(graph: Graph, path: str, *, tag: Column | None = None) -> None:
    write_lines(gfa_lines(graph, tag=tag), path)


def write_dot(graph: Graph, path: str, *, label: Column | None = None) -> None:
    write_lines(dot_lines(graph, label=label), path)


def write_json(graph: Graph, path: str, *, data: Column | None = None, rest: dict[str, str] | None = None) -> None:
    write_lines(json_document(graph, data=data, rest=rest), path, ("part", "node_id", "line"))


def write_graph(graph: Graph, path: str) -> None:
    """Nodes as Parquet, with k and strandedness as columns, so that read_graph() needs no more."""
    graph.nodes.withColumn("k", F.lit(graph.k)).withColumn("stranded", F.lit(graph.stranded)).write.parquet(path)


def read_graph(spark, path: str, k: int | None = None, stranded: bool = False) -> Graph:
    """What write_graph() wrote. An empty graph has no row that names its k: it takes those given."""
    nodes = spark.read.parquet(path)
    stored = nodes.select("k", "stranded").first()
    if stored is not None:
        k, stranded = stored["k"], stored["stranded"]
    elif k is None:
        raise ValueError("an empty graph needs k")
    return Graph(nodes.drop("k", "stranded"), k, stranded)
