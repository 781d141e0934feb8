"""Queries over the driver tables, one or more for each operator, and the same in DuckDB's SQL.

The tables hold no DNA, so two projections supply it: DOC, the bases among a document's characters,
and KEY, 32 bases made of the MD5 of a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exts as E
from ..functions import seq as S
from ..operators import compact, coordinates, fragments, function_summaries, graph, kmers, local_repair, msp, paths, segment_counts
from ..operators.tables import shared_folder, written
from ..sources import dna, export, formats

K, MIN_OBS = 31, 2
#: Nodes of max_path with more observations are solid.
SOLID = 100
HEX, AS_DNA = "0123456789abcdef", "ACGTACGTACGTACGT"  # fixed values of the KEY projection


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_sequences(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    return dna.sequences(table(spark, sf_dir, "documents"), "doc_id", "text", label=label)


def keys(spark: SparkSession, sf_dir: str, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """id, seq, other: two sequences of 32 bases per row."""
    as_dna = lambda text: F.translate(F.md5(text), HEX, AS_DNA)
    ident = F.col(key).cast("string")
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), as_dna(ident).alias("seq"), as_dna(F.concat(ident, F.lit("b"))).alias("other"))


# -- M0, M3: counting -------------------------------------------------------------------------


def kmer_count(spark, sf_dir):
    return kmers.filter_kmers(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS)).select("kmer", "exts", "n", F.col("data").alias("seen"))


def kmer_count_stranded(spark, sf_dir):
    return kmers.filter_kmers(doc_sequences(spark, sf_dir), 12, kmers.count_filter(MIN_OBS), stranded=True).select("kmer", "exts", "n")


def kmer_colors(spark, sf_dir):
    out = kmers.filter_kmers(doc_sequences(spark, sf_dir), 20, kmers.label_filter(MIN_OBS))
    return out.select("kmer", "exts", "n", F.array_join("data", ",").alias("colors"))


def _label_counts() -> function_summaries.FunctionSummarizer:
    """How often each label was seen with a k-mer, of k-mers seen with two labels or more."""

    def add(state, exts, label):
        state[label or ""] = state.get(label or "", 0) + 1
        return state

    def merge(a, b):
        a, b = dict(a), dict(b)
        return {x: a.get(x, 0) + b.get(x, 0) for x in a.keys() | b.keys()}

    text = lambda state: ",".join(f"{x}:{n}" for x, n in sorted(state.items()))
    return function_summaries.FunctionSummarizer(dict, add, merge, lambda state, n: (len(dict(state)) > 1, text(dict(state))), "map<string,long>", "string")


def kmer_function_summary(spark, sf_dir):
    out = function_summaries.filter_kmers(doc_sequences(spark, sf_dir), 12, _label_counts())
    return out.select("kmer", "exts", "n", F.col("data").alias("counts"))


def kmer_all_report(spark, sf_dir):
    valid, everything = kmers.filter_kmers(doc_sequences(spark, sf_dir), 20, kmers.count_filter(MIN_OBS), report_all=True)
    return everything.join(valid.select("kmer", F.lit(True).alias("valid")), "kmer", "left").select("kmer", F.coalesce("valid", F.lit(False)).alias("valid"))


def kmer_saturated(spark, sf_dir):
    """Short k-mers, whose counts may pass the 16-bit limit."""
    return kmers.filter_kmers(doc_sequences(spark, sf_dir), 4, kmers.count_filter(1)).select("kmer", "n", F.col("data").alias("seen"))


def kmer_sorted(spark, sf_dir):
    """Each k-mer's place in order."""
    table_ = written(kmers.filter_kmers(doc_sequences(spark, sf_dir), 20, kmers.count_filter(MIN_OBS)), "kmers")
    return compact.in_order(table_).select("kmer", "n", "place")


def kmer_total(spark, sf_dir):
    return kmers.kmer_total(doc_sequences(spark, sf_dir), K)


# -- M1: scalar functions ------------------------------------------------------------------------


def seq_rc(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.rc("seq").alias("rc"))


def seq_canonical(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.canonical("seq").alias("canon"), S.is_flipped("seq").alias("flip"))


def kmer_rank(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.rank(S.prefix("seq", K)).alias("rank"))


def kmer_unrank(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.unrank(S.rank(S.prefix("seq", 20)), 20).alias("kmer"))


def gc_at_count(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.gc_count("seq").cast("long").alias("gc"), S.at_count_packed(S.rank(S.prefix("seq", K)), K).cast("long").alias("at"))


def hamming_pairs(spark, sf_dir):
    packed = S.hamming_packed(S.rank(S.prefix("seq", K)), S.rank(S.prefix("other", K)))
    return keys(spark, sf_dir).select("id", S.hamming("seq", "other").cast("long").alias("dist"), packed.cast("long").alias("dist_packed"))


def is_palindrome(spark, sf_dir):
    mirrored = F.concat(F.left("seq", F.lit(8)), S.rc(F.left("seq", F.lit(8))))
    return keys(spark, sf_dir).select("id", S.is_palindrome("seq").alias("whole"), S.is_palindrome(S.prefix("seq", 4)).alias("four"), S.is_palindrome(mirrored).alias("made"))


def set_base(spark, sf_dir):
    pos = F.pmod("id", F.lit(32)).cast("int")
    return keys(spark, sf_dir).select("id", S.set_base("seq", pos, F.lit("A")).alias("one"), S.set_slice("seq", 8, F.left("other", F.lit(5))).alias("slice"))


def slice_prefix_suffix(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.slice_("seq", 3, 17).alias("cut"), S.prefix("seq", 6).alias("head"), S.suffix("seq", 6).alias("tail"), S.rc(S.slice_(S.rc("seq"), 3, 17)).alias("rc_cut"))


def reverse_only(spark, sf_dir):
    return keys(spark, sf_dir).select("id", S.reverse_only("seq").alias("rev"))


def extend_lr(spark, sf_dir):
    k = S.prefix("seq", K)
    right = F.pmod("id", F.lit(2)) == 0
    return keys(spark, sf_dir).select("id", S.extend_left(k, F.lit("G")).alias("l"), S.extend_right(k, F.lit("T")).alias("r"), S.extend(k, F.lit("C"), right).alias("by_dir"))


def hamming1_neighbors(spark, sf_dir):
    return keys(spark, sf_dir, "customer", "c_custkey").select("id", F.explode(S.hamming1(S.prefix("seq", 12))).alias("kmer"))


def exts_algebra(spark, sf_dir):
    e = F.pmod("id", F.lit(256)).cast("int")
    f = F.pmod(F.col("id") * 7 + 3, F.lit(256)).cast("int")
    rows = keys(spark, sf_dir).select("id", e.alias("e"), f.alias("f"))
    return rows.select(
        "id", E.complement("e").alias("comp"), E.reverse("e").alias("rev"), E.rc("e").alias("rc"), E.merge("e", "f").alias("merged"), E.add("e", "f").alias("added"),
        E.from_single_dirs("e", "f").alias("joined"), E.set_ext("e", F.lit("G"), True).alias("with_g"), E.has_ext("e", F.lit("C"), False).alias("left_c"),
        E.count("e", False).cast("int").alias("nl"), E.count("e", True).cast("int").alias("nr"), E.unique("e", True).alias("only_right"), E.single_dir("e", True).alias("right_low"), E.text("e").alias("text"),
    )


def seq_places(spark, sf_dir):
    """Length, one base, a k-mer at a place and the outer k-mers."""
    pos = F.pmod("id", F.lit(32)).cast("int")
    return keys(spark, sf_dir).select(
        "id", F.length("seq").alias("n"), S.is_empty(S.clear("seq")).alias("cleared"), S.get_base("seq", pos).alias("base"), S.kmer_at("seq", pos, 9).alias("at"),
        S.terminal_kmers("seq", 5)["first"].alias("first"), S.terminal_kmers("seq", 5)["last"].alias("last"), S.terminal_kmer("seq", 7, F.pmod("id", F.lit(2)) == 0).alias("by_side"),
    )


def seq_builders(spark, sf_dir):
    """New sequences: of one base, of codes, and longer ones; codes of characters that may be no base."""
    n, char = F.pmod("id", F.lit(40)).cast("int"), F.left(F.md5(F.col("id").cast("string")), F.lit(1))
    tail = F.slice(S.codes("other"), 1, 6)
    return keys(spark, sf_dir).select(
        "id", S.blank(n).alias("blank"), S.push("seq", S.base_to_code(F.left("other", F.lit(1)))).alias("first_of_other"), S.push("seq", F.pmod("id", F.lit(5)).cast("int")).alias("pushed"),
        S.extend_codes("seq", tail).alias("longer"), S.strict_base_to_code(char).alias("strict"), S.base_to_code(char).alias("lenient"), S.complement_code(S.base_to_code(char)).alias("complement"),
    )


def exts_sides(spark, sf_dir):
    """Directions, the bases of a side and the k-mers that they lead to."""
    right, flipped = F.pmod("id", F.lit(2)) == 1, F.pmod("id", F.lit(3)) == 0
    e = F.pmod(F.col("id") * 11, F.lit(256)).cast("int")
    k = S.prefix("seq", 8)
    return keys(spark, sf_dir).select(
        "id", E.flip(right).alias("flip"), E.cond_flip(right, flipped).alias("cond_flip"), E.pick(right, "seq", "other").alias("pick"), F.array_join(E.get(e, False), "").alias("left"), F.array_join(E.get(e, True), "").alias("right"),
        F.array_join(E.extensions(k, e, False), ",").alias("to_left"), F.array_join(E.extensions(k, e, True), ",").alias("to_right"), E.text(F.lit(E.EMPTY)).alias("none"),
    )


# -- M2: sources --------------------------------------------------------------------------------


def dna_lenient(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), dna.lenient("text").alias("seq"))


def dna_only_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(dna.split_bases("text")).alias("pos", "run"))


def codes_roundtrip(spark, sf_dir):
    return keys(spark, sf_dir).select("id", F.array_join(S.codes("seq"), "").alias("codes"), S.from_codes(S.codes("seq")).alias("back"))


def push_packed(spark, sf_dir):
    packed = dna.to_packed("seq")
    return keys(spark, sf_dir).select("id", F.array_join(packed, ",").alias("bytes"), dna.from_packed(packed, F.lit(30)).alias("first30"))


#: Lookups of the queries of random access.
LOOKUPS = 1000


def _lookups(spark, total: int) -> DataFrame:
    return spark.range(LOOKUPS).select(F.col("id").alias("query"), coordinates.spread_over(total, LOOKUPS, F.col("id")).alias("n"))


def set_slices(spark, sf_dir):
    """Slices of all documents' bases in a row, across their borders too: 200 to 999 bases."""
    index = coordinates.index(doc_sequences(spark, sf_dir))
    asked = _lookups(spark, index.total).select("query", F.col("n").alias("start"), (F.col("n") + 200 + F.pmod(F.col("query") * 7, F.lit(800))).alias("end"))
    return coordinates.slices(index, asked)


def set_get_slice(spark, sf_dir):
    """Of each document the bases 10 to 60."""
    seqs = doc_sequences(spark, sf_dir)
    asked = seqs.select(F.col("seq_id").alias("query"), F.col("seq_id").alias("id"), F.lit(10).cast("long").alias("start"), F.lit(60).cast("long").alias("end"))
    return coordinates.sequence_slices(coordinates.index(seqs), asked)


def hash_n(spark, sf_dir):
    """Unknown characters become pseudo-random bases."""
    return table(spark, sf_dir, "documents").select("doc_id", dna.hashed("text", F.col("doc_id").cast("string")).alias("seq"))


# -- M4: extension repair -------------------------------------------------------------------------


def exts_censored(spark, sf_dir):
    table_ = written(kmers.filter_kmers(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS)), "kmers")
    return kmers.remove_censored_exts(table_).select("kmer", "exts")


def exts_censored_local(spark, sf_dir):
    """exts_censored, with neighbours met in their minimizer's bucket."""
    table_ = kmers.filter_kmers(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS))
    return local_repair.remove_censored_exts(table_, K).select("kmer", "exts")


def _sharded(spark, sf_dir, shard):
    """Every shard repaired by what it saw itself, all in one pass."""
    return local_repair.counted(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS), shard=shard).select("kmer", "exts")


def exts_censored_sharded(spark, sf_dir):
    """Sixteen shards, by the first two bases."""
    return _sharded(spark, sf_dir, lambda kmer: F.left(kmer, F.lit(2)))


def exts_censored_all_shards(spark, sf_dir):
    """Eight shards: the second base counts as A or G."""
    return _sharded(spark, sf_dir, lambda kmer: F.concat(F.left(kmer, F.lit(1)), F.translate(F.substring(kmer, 2, 1), "CT", "AG")))


def exts_from_set(spark, sf_dir):
    table_ = written(kmers.filter_kmers(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS)), "kmers")
    return kmers.exts_from_set(table_).select("kmer", "exts")


# -- M5: minimum-substring partitioning ---------------------------------------------------------------


def msp_bucket(spark, sf_dir):
    return msp.kmer_buckets(keys(spark, sf_dir).select(F.col("id").alias("seq_id"), "seq"), 20, 6).select("seq_id", F.col("pos").cast("long").alias("pos"), "bucket")


def msp_segments(spark, sf_dir):
    return msp.msp_sequence(doc_sequences(spark, sf_dir), K, 8, rc=True).select("seq_id", "seg_no", "bucket", "minimizer", "minimizer_pos", "start", "len", "exts", "seq")


def msp_kmer_cover(spark, sf_dir):
    """K-mers counted from the segments: the same as from the whole sequences."""
    pieces = msp.msp_sequence(doc_sequences(spark, sf_dir), K, 8, rc=True)
    return kmers.filter_kmers(pieces.select("seq", "exts", "label"), K, kmers.count_filter(MIN_OBS)).select("kmer", "exts", "n")


def kmer_count_by_segments(spark, sf_dir):
    """kmer_count, with a shuffle of segments by bucket."""
    return segment_counts.filter_kmers(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS)).select("kmer", "exts", "n", F.col("data").alias("seen"))


def kmer_colors_by_segments(spark, sf_dir):
    out = segment_counts.filter_kmers(doc_sequences(spark, sf_dir), 20, kmers.label_filter(MIN_OBS))
    return out.select("kmer", "exts", "n", F.array_join("data", ",").alias("colors"))


def msp_simple_scan(spark, sf_dir):
    """Segments by a permutation of the p-mers: the ranks read from the last base on."""
    order = [sum((r >> 2 * i & 3) << 2 * (4 - i) for i in range(5)) for r in range(4**5)]
    seqs = keys(spark, sf_dir).select(F.col("id").alias("seq_id"), "seq")
    return msp.simple_scan(seqs, 16, 5, order).select("seq_id", "bucket", "start", "len")


# -- M6: compaction -----------------------------------------------------------------------------------


def doc_graph(spark, sf_dir, k: int = K, min_obs: int = MIN_OBS) -> graph.Graph:
    """The normalised, repaired unitig graph of DOC, with its edges known."""
    nodes = fragments.unitigs(doc_sequences(spark, sf_dir), k, kmers.count_filter(min_obs))
    return graph.fix_exts(graph.Graph(nodes, k, mutual=True).normalised())


def _shown(g: graph.Graph) -> DataFrame:
    return g.nodes.select("seq", F.col("len").cast("long").alias("len"), "exts", F.col("members").cast("long").alias("members"), F.col("data").cast("long").alias("data"))


def unitigs(spark, sf_dir):
    return _shown(graph.Graph(fragments.unitigs(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS)), K).normalised())


def unitigs_stranded(spark, sf_dir):
    """Both strands apart: no k-mer is turned, nor is a node."""
    table_ = kmers.filter_kmers(doc_sequences(spark, sf_dir), 12, kmers.count_filter(MIN_OBS), stranded=True)
    return _shown(graph.Graph(compact.compress_kmers(table_, 12, stranded=True), 12, stranded=True).normalised())


def unitigs_keys(spark, sf_dir):
    """Unbranched sequences: every unitig is one of the inputs."""
    seqs = keys(spark, sf_dir).select(F.col("id").alias("seq_id"), "seq", F.lit(0).alias("exts"), F.lit("").alias("label"))
    return _shown(graph.Graph(fragments.unitigs(seqs, 24, kmers.count_filter(1)), 24).normalised())


def unitigs_colored(spark, sf_dir):
    nodes = fragments.unitigs(doc_sequences(spark, sf_dir), K, kmers.label_filter(MIN_OBS), data=F.array_join("data", ","), equal=True)
    return graph.Graph(nodes, K).normalised().nodes.select("seq", "exts", F.col("members").cast("long").alias("members"), F.col("data").alias("colors"))


def _runs(count: Column) -> Column:
    """first, last: the counts at the ends of a path; runs: how many runs of equal counts it has."""
    return F.struct(count.alias("first"), count.alias("last"), F.lit(1).alias("runs"))


def _join_runs(a: Column, b: Column) -> Column:
    return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["runs"] + b["runs"] - (a["last"] == b["first"]).cast("int")).alias("runs"))


def unitigs_ordered(spark, sf_dir):
    """Node data folded in path order: the counts at both ends, and the runs of equal counts between them."""
    turn = lambda x: F.struct(x["last"].alias("first"), x["first"].alias("last"), x["runs"].alias("runs"))
    nodes = fragments.unitigs(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS), ordered={"ends": compact.Ordered(_runs, _join_runs, turn)})
    return nodes.select(F.least("seq", S.rc("seq")).alias("seq"), F.least("ends.first", "ends.last").alias("low_end"), F.greatest("ends.first", "ends.last").alias("high_end"), "ends.runs")


def unitigs_no_exts(spark, sf_dir):
    """Extensions are those that lead to a k-mer, whatever was observed."""
    nodes = fragments.unitigs(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS), repair=fragments.FROM_SET)
    return _shown(graph.Graph(nodes, K).normalised())


def unitigs_sharded(spark, sf_dir):
    """Shards by minimizer bucket, each compacted on its own, combined, repaired and compacted again.

    A shard is the buckets that a task counts; what it makes are the fragments that are combined.
    """
    nodes = fragments.unitigs(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS), repair=fragments.CENSORED)
    return _by_least_kmer(_shown(graph.Graph(nodes, K))).select("least_kmer", "len", "data")


def unitigs_repaired(spark, sf_dir):
    """Counting, repair of extensions, compaction: what the sharded build arrives at, too."""
    nodes = fragments.unitigs(doc_sequences(spark, sf_dir), K, kmers.count_filter(MIN_OBS), repair=fragments.CENSORED)
    return _shown(graph.Graph(nodes, K).normalised()).select("seq", "len", "exts", "data")


# -- M7: graph operators ---------------------------------------------------------------------------------


def graph_edges(spark, sf_dir):
    return graph.edges(doc_graph(spark, sf_dir))


def graph_find_link(spark, sf_dir):
    """Each node's own end k-mers, looked up as if walked into, and the k-mers that its extensions lead to."""
    g = doc_graph(spark, sf_dir)
    own = graph.ends(g.nodes, g.k).select(F.col("node_id").alias("src"), F.when(F.col("side") == "L", "R").otherwise("L").alias("dir"), "kmer")
    return graph.find_links(own.unionByName(graph.probes_of(g.nodes, g.k).select("src", "dir", "kmer")), g)


def graph_fix_exts(spark, sf_dir):
    g = doc_graph(spark, sf_dir)
    half = g.nodes.filter("node_id % 2 = 0").select("node_id")
    return graph.fix_exts(g, half).nodes.select("node_id", "exts")


def graph_is_compressed(spark, sf_dir):
    """Pairs of nodes that compression should have merged, when tips have gone and after compression (none)."""
    g = doc_graph(spark, sf_dir)
    tips_ = written(graph.tips(g, F.col("len") < 2 * K), "tips")
    cut = graph.without(g, tips_)
    count = lambda x, name: graph.uncompressed_pairs(x).agg(F.count(F.lit(1)).alias(name))
    # One row each.
    return count(cut, "before").join(F.broadcast(count(graph.compress_graph(cut), "pairs")))


def graph_combine(spark, sf_dir):
    g = doc_graph(spark, sf_dir)
    part = lambda c: graph.Graph(g.nodes.filter(c), g.k)
    return graph.combine([part("node_id % 2 = 0"), part("node_id % 2 = 1")]).nodes.select("node_id", "seq", "exts")


def node_kmers(spark, sf_dir):
    return graph.node_kmers(doc_graph(spark, sf_dir)).select("node_id", F.col("pos").cast("long").alias("pos"), "kmer")


def graph_nth_kmers(spark, sf_dir):
    """K-mers of the graph by their number, without listing the others."""
    index = coordinates.graph_index(doc_graph(spark, sf_dir))
    return coordinates.kmers_at(index, _lookups(spark, index.total))


def node_degree(spark, sf_dir):
    return graph.degrees(doc_graph(spark, sf_dir)).select("node_id", F.col("left").cast("int").alias("nl"), F.col("right").cast("int").alias("nr"))


# -- M8, M9, M10 --------------------------------------------------------------------------------------------


def tips(spark, sf_dir):
    return graph.tips(doc_graph(spark, sf_dir), F.col("len") < 2 * K)


def _by_least_kmer(nodes: DataFrame) -> DataFrame:
    """Where a circle is cut depends on what it was made of, so nodes are named by their least k-mer."""
    return nodes.withColumn("least_kmer", F.array_min(F.transform(S.kmers("seq", K), S.canonical)))


def tip_cleaned_unitigs(spark, sf_dir):
    cleaned = graph.clean(doc_graph(spark, sf_dir), F.col("len") < 2 * K)
    return _by_least_kmer(_shown(cleaned)).select("least_kmer", "len", "members", "data")


def _through() -> Column:
    """A node's length if it can be passed through; little for an end."""
    return F.when((E.count("exts", False) > 0) & (E.count("exts", True) > 0), F.col("len").cast("double")).otherwise(0.5)


def max_path(spark, sf_dir):
    return paths.max_path(doc_graph(spark, sf_dir, 20), _through(), F.col("data") > SOLID)


def beam_path(spark, sf_dir):
    return paths.beam_path(doc_graph(spark, sf_dir), 4, F.col("data"))


def path_sequence(spark, sf_dir):
    g = doc_graph(spark, sf_dir, 20)
    return paths.path_sequence(g, written(paths.max_path(g, _through(), F.col("data") > SOLID), "path"))


def gfa_lines(spark, sf_dir):
    return export.gfa_lines(doc_graph(spark, sf_dir), tag=F.concat(F.lit("KC:i:"), F.col("data").cast("string")))


def gfa_source(spark, sf_dir):
    """The lines written as the data source `gfa`, and read again."""
    formats.register(spark)
    path = f"{shared_folder(spark)}/gfa-{uuid.uuid4().hex}"
    tag = F.concat(F.lit("KC:i:"), F.col("data").cast("string"))
    export.gfa_lines(doc_graph(spark, sf_dir), tag=tag).write.format("gfa").mode("append").save(path)
    return spark.read.format("gfa").load(path)


def dot_lines(spark, sf_dir):
    return export.dot_lines(doc_graph(spark, sf_dir), label=F.col("data").cast("string")).select("node_id", "line")


def json_nodes(spark, sf_dir):
    return export.json_nodes(doc_graph(spark, sf_dir))


def json_links(spark, sf_dir):
    return export.json_links(doc_graph(spark, sf_dir))


def graph_stored(spark, sf_dir):
    """Written as Parquet and read again, with the graph's k."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    export.write_graph(doc_graph(spark, sf_dir), path)
    g = export.read_graph(spark, path)
    return g.nodes.select("node_id", "seq", "exts", F.lit(g.k).alias("k"), F.lit(g.stranded).alias("stranded"))


def graph_added(spark, sf_dir):
    """The graph with a node for each customer's key added; those with an id of nines are looked up."""
    more = keys(spark, sf_dir, "customer", "c_custkey").select("seq", F.lit(0).alias("exts"), F.lit(0).alias("data"))
    g = graph.add(doc_graph(spark, sf_dir), more)
    ids = g.nodes.select("node_id").filter("node_id % 10 = 9")
    return graph.nodes_by_id(g, ids).select("node_id", "seq", "exts", F.col("members").cast("long").alias("members"))


def json_document_rest(spark, sf_dir):
    """With further members of the document."""
    return export.json_document(doc_graph(spark, sf_dir), rest={"k": str(K), "of": '{"table":"documents"}'}).filter("part <> 1 and part <> 3")


def json_document(spark, sf_dir):
    return export.json_document(doc_graph(spark, sf_dir))


#: Helpers of this module that are no queries.
_HELPERS = {"table", "doc_sequences", "keys", "doc_graph"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__}
    return {n: f for n, f in own.items() if not n.startswith("_") and n not in _HELPERS | {"queries"}}
