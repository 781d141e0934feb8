"""Compaction, graphs, cleaning, paths and exports against small sequential models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import seq as S
from kmerloom.operators import compact as C
from kmerloom.operators import graph as G
from kmerloom.operators import kmers as K
from kmerloom.operators import paths as P
from kmerloom.operators.tables import Temporary, shared_folder, written
from kmerloom.sources import export

SEQS = "seq_id long, seq string, exts int, label string"
SWAP = {"A": "T", "T": "A", "C": "G", "G": "C"}


def rc(s):
    return "".join(SWAP[b] for b in reversed(s))


def canon(s):
    return min(s, rc(s))


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def contigs(seed):
    rng = random.Random(seed)
    core, arm = dna(rng, 100), dna(rng, 33)
    return [dna(rng, 40) + core + dna(rng, 30), dna(rng, 30) + core + dna(rng, 40), dna(rng, 30) + arm + rc(arm) + dna(rng, 50)]


def graph_of(spark, seqs, k, min_obs=1):
    df = spark.createDataFrame([(i, s, 0, "x") for i, s in enumerate(seqs)], SEQS)
    table = written(K.filter_kmers(df, k, K.count_filter(min_obs)), "t")
    return table, G.Graph(written(C.compress_kmers(table, k), "t"), k)


def model_unitigs(seqs, k):
    """Unitigs by walking, as sets of canonical k-mers."""
    ext = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            m, left, right = s[i : i + k], {s[i - 1]} if i else set(), {s[i + k]} if i + k < len(s) else set()
            if m >= rc(m):
                m, left, right = rc(m), {SWAP[b] for b in right}, {SWAP[b] for b in left}
            e = ext.setdefault(m, (set(), set()))
            e[0].update(left), e[1].update(right)

    def step(m, forward):
        out = ext[m][forward]
        if len(out) != 1 or m == rc(m):
            return None
        b = next(iter(out))
        nxt = m[1:] + b if forward else b + m[:-1]
        flip = nxt >= rc(nxt)
        v = canon(nxt)
        arrive = (not forward) != flip
        if v not in ext or v == rc(v) or v == m or len(ext[v][arrive]) != 1:
            return None
        return v, not arrive

    seen, out = set(), set()
    for m in ext:
        if m in seen:
            continue
        group = {m}
        for way in (True, False):
            at = step(m, way)
            while at and at[0] not in group:
                group.add(at[0])
                at = step(*at)
        seen |= group
        out.add(frozenset(group))
    return out


CASES = {
    "simple": (contigs(1), 31),
    "even": (contigs(2), 12),
    "tiny": ([dna(random.Random(5), 400)], 4),
    "low complexity": (["A" * 5 + "TAAAA" * 8] * 2, 31),
    "circle": ([(s := dna(random.Random(8), 60)) + s[:30] + s[30:35]], 15),
    "one": (["ACGTTGCATG"], 10),
}


@pytest.mark.parametrize("name", CASES)
def test_unitigs(spark, name):
    seqs, k = CASES[name]
    table, g = graph_of(spark, seqs, k)
    nodes = g.nodes.collect()
    got = {frozenset(canon(n.seq[i : i + k]) for i in range(len(n.seq) - k + 1)) for n in nodes}
    assert got == model_unitigs(seqs, k)
    assert sum(n.members for n in nodes) == table.count()  # each k-mer once
    assert all(n.members == len(n.seq) - k + 1 for n in nodes)
    fixed = G.fix_exts(g)
    assert G.is_compressed(G.compress_graph(g))
    known = {canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1)}
    for n in fixed.nodes.collect():
        for i, b in enumerate("ACGT"):
            assert not n.exts >> i & 1 or canon(b + n.seq[: k - 1]) in known
            assert not n.exts >> (i + 4) & 1 or canon(n.seq[len(n.seq) - k + 1 :] + b) in known


def test_one_node_per_kmer_compresses_to_unitigs(spark):
    seqs, k = CASES["simple"]
    table, g = graph_of(spark, seqs, k)
    single = G.Graph(C.with_ids(table).select(F.col("id").alias("node_id"), F.col("kmer").alias("seq"), F.length("kmer").alias("len"), "exts", F.lit(1).alias("members"), "data"), k)
    a = {r.seq for r in G.compress_graph(single).normalised().nodes.collect()}
    assert a == {r.seq for r in g.normalised().nodes.collect()}


def test_colours_split_paths(spark):
    rng = random.Random(4)
    s = dna(rng, 80)
    df = spark.createDataFrame([(1, s, 0, "a"), (2, s[:50], 0, "b")], SEQS)
    table = K.filter_kmers(df, 21, K.label_filter(1))
    nodes = C.compress_kmers(table, 21, spec=C.equal_data_compression()).collect()
    assert sorted(map(tuple, (n.data for n in nodes))) == [("a",), ("a", "b")]
    assert len(C.compress_kmers(table.withColumn("data", F.lit(1)), 21).collect()) == 1


def test_extension_repair(spark):
    df = spark.createDataFrame([(1, "ACGTTGCA", 0, "x"), (2, "CGTTG", 0, "x")], SEQS)
    valid, everything = K.filter_kmers(df, 5, K.count_filter(2), report_all=True)
    valid = written(valid, "v")
    assert {(r.kmer, r.exts) for r in K.remove_censored_exts(valid).collect()} == {("CAACG", 0)}
    assert {(r.kmer, r.exts) for r in K.remove_censored_exts_sharded(valid, everything).collect()} == {("CAACG", 0)}
    kept = K.remove_censored_exts_sharded(valid, valid.select("kmer")).collect()
    assert kept[0].exts == valid.collect()[0].exts  # other shards may have them


def test_tips(spark):
    rng = random.Random(6)
    seqs = []
    for _ in range(2):
        s = dna(rng, 200)
        seqs += [s] * 5 + [s[:100] + dna(rng, 5)] * 2
    _, g = graph_of(spark, seqs, 21, 2)
    g = G.fix_exts(g)
    short = F.col("len") < 42
    assert G.tips(g, short).count() == 2
    cleaned = G.clean(g, short)
    assert sorted(r.len for r in cleaned.nodes.collect()) == [200, 200]


def test_combine(spark):
    _, g = graph_of(spark, *CASES["simple"])
    both = G.combine([g, g]).nodes
    assert both.count() == 2 * g.nodes.count() == both.select("node_id").distinct().count()
    with pytest.raises(ValueError):
        G.combine([g, G.Graph(g.nodes, g.k, True)])


def test_paths(spark):
    rng = random.Random(12)
    a, b, c, d = (dna(rng, 40) for _ in range(4))
    seqs = [a + b + c] * 5 + [a + d + c] * 2
    _, g = graph_of(spark, seqs, 15, 2)
    g = G.fix_exts(g).normalised()
    g = G.Graph(written(g.nodes, "g"), g.k)
    # `solid` nodes on both ways stop the walk, so none is called solid here
    path = written(P.max_path(g, F.col("data") / F.col("members"), F.lit(False)), "p")
    assert [r.pos for r in path.orderBy("pos").collect()] == list(range(path.count()))
    assert P.path_sequence(g, path).first().seq in (a + b + c, rc(a + b + c))
    beam = written(P.beam_path(g, 8, F.col("data")), "p")
    assert P.path_sequence(g, beam).first().seq in (a + b + c, rc(a + b + c))
    stopped = P.max_path(g, F.col("data") / F.col("members"), F.lit(True))
    assert stopped.count() <= path.count()


def test_paths_of_no_graph(spark):
    _, g = graph_of(spark, ["ACG"], 5)
    assert P.max_path(g, F.col("data"), F.lit(True)).count() == 0
    assert P.beam_path(g, 2, F.col("data")).count() == 0


def test_exports(spark, tmp_path):
    _, g = graph_of(spark, *CASES["simple"])
    g = G.fix_exts(g).normalised()
    g = G.Graph(written(g.nodes, "g"), g.k)
    export.write_gfa(g, str(tmp_path / "gfa"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "gfa")).collect()]
    assert sum(x.startswith("S\t") for x in lines) == g.nodes.count() and sum(x.startswith("H") for x in lines) == 1
    doc = json.loads("".join(r.line for r in export.json_document(g, rest={"k": "31"}).orderBy("part", "node_id", "line").collect()))
    assert len(doc["nodes"]) == g.nodes.count() and doc["k"] == 31
    right = G.edges(g).filter("src_dir = 'R'").count()
    assert len(doc["links"]) == right
    dot = [r.line for r in export.dot_lines(g).orderBy("node_id", "line_no").collect()]
    assert dot[0] == "digraph {" and dot[-1] == "}" and len(dot) == 2 + g.nodes.count() + G.edges(g).count()
    export.write_graph(g, str(tmp_path / "nodes"))
    assert export.read_graph(spark, str(tmp_path / "nodes"), g.k).nodes.count() == g.nodes.count()


def test_stranded_counts_keep_direction(spark):
    df = spark.createDataFrame([(1, "AAACCC", 0, "x"), (2, "GGGTTT", 0, "x")], SEQS)
    assert K.filter_kmers(df, 6, K.count_filter(1), stranded=True).count() == 2
    assert K.filter_kmers(df, 6, K.count_filter(1)).count() == 1
    table = K.filter_kmers(df, 4, K.count_filter(1), stranded=True)
    assert sorted(r.seq for r in C.compress_kmers(table, 4, stranded=True).collect()) == ["AAACCC", "GGGTTT"]


def test_kmer_positions(spark):
    _, g = graph_of(spark, *CASES["simple"])
    rows = G.node_kmers(g)
    assert rows.count() == g.nodes.select(F.sum(S.total_kmers("seq", g.k))).first()[0]


def files_below(spark, path):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(folder).getFileCount() if fs.exists(folder) else 0


@pytest.mark.parametrize("base", [1 << 20, 10, 0])
def test_chains_by_contraction(spark, base):
    """Chains and circles of any length, followed in one task or contracted down to nothing."""
    rng = random.Random(base)
    ids = list(range(400))
    rng.shuffle(ids)
    nexts, end, hops, least = {}, {}, {}, {}
    for size, circle in [(1, False), (2, False), (60, False), (130, False), (1, True), (2, True), (3, True), (90, True)]:
        part = [ids.pop() for _ in range(size)]
        for i, s in enumerate(part):
            if i + 1 < size:
                nexts[s], end[s], hops[s] = part[i + 1], part[-1], size - 1 - i
            elif circle:
                nexts[s] = part[0]
        if circle:
            least.update({s: min(part) for s in part})
            for s in part:
                end.pop(s, None)
    links = spark.createDataFrame(list(nexts.items()), "s long, t long")
    with Temporary(spark, "test") as write:
        ends, circles = C.chains(links, write, base=base)
        assert {r.s: (r.end, r.hops) for r in ends.collect()} == {s: (e, hops[s]) for s, e in end.items()}
        assert {(r.s, r.t, r.least) for r in circles.collect()} == {(s, nexts[s], m) for s, m in least.items()}
        assert len([t for t in write.tables if files_below(spark, t[1])]) == 1  # what the results read
    assert not files_below(spark, write.path)


def test_contracted_unitigs_leave_nothing_behind(spark, monkeypatch):
    seqs = contigs(5)
    _, whole = graph_of(spark, seqs, 21)
    want = sorted(map(repr, whole.normalised().nodes.collect()))
    df = spark.createDataFrame([(i, s, 0, "x") for i, s in enumerate(seqs)], SEQS)
    table = written(K.filter_kmers(df, 21, K.count_filter(1)), "t")
    monkeypatch.setattr(C.chains, "__kwdefaults__", {"base": 5})
    monkeypatch.setattr(C.paths, "__kwdefaults__", {"stranded": False, "base": 5})
    before = files_below(spark, shared_folder(spark))
    nodes = C.compress_kmers(table, 21)
    assert sorted(map(repr, G.Graph(nodes, 21).normalised().nodes.collect())) == want
    out = len(nodes.inputFiles())
    assert out <= files_below(spark, shared_folder(spark)) - before <= 4 * out + 40  # the result and what normalised() writes


def test_forest_knows_its_paths():
    rng = random.Random(2)
    forest, paths = P.Forest(), []
    for i in range(600):
        parent = rng.randrange(-1, i) if rng.random() < 0.2 else i - 1
        node = rng.randrange(80)
        assert forest.add(parent, node, "LR"[i % 2]) == i
        paths.append([*(paths[parent] if parent >= 0 else []), (node, "LR"[i % 2])])
    for i in range(0, 600, 7):
        assert [(n, d) for _, n, d in forest.path(i)] == paths[i]
        for node in range(0, 80, 3):
            assert forest.holds(i, node) == any(n == node for n, _ in paths[i])


@pytest.mark.parametrize("beam", [1, 3, 50])
def test_beam_follows_the_model(spark, beam):
    """Against a search that keeps whole paths."""
    rng = random.Random(beam)
    parts = [dna(rng, 30) for _ in range(6)]
    seqs = ["".join(rng.choice(parts) for _ in range(8)) for _ in range(6)]
    _, g = graph_of(spark, seqs, 15)
    g = G.fix_exts(g).normalised()
    g = G.Graph(written(g.nodes, "g"), g.k)
    data = {r.node_id: r for r in g.nodes.collect()}
    out = {}
    for e in G.edges(g).collect():
        out.setdefault((e.src, e.src_dir), []).append((e.base, e.dst, e.dst_side))
    flip = {"L": "R", "R": "L"}
    states = []
    for i, n in sorted(data.items()):
        left, right = n.exts & 15, n.exts & 240
        if not left or not right:
            states.append(([(i, "R" if left and not right else "L")], float(n.data), "end" if not left and not right else "active"))
    states = states or [([(0, "L")], float(data[0].data), "active")]
    while any(s[2] == "active" for s in states):
        pool = []
        for path, total, status in states:
            if status != "active":
                pool.append((path, total, status))
                continue
            last, side = path[-1]
            for _, dst, dst_side in sorted(out.get((last, flip[side]), [])):
                now = "cycle" if any(n == dst for n, _ in path) else "active" if out.get((dst, flip[dst_side])) else "end"
                pool.append(([*path, (dst, dst_side)], total + data[dst].data, now))
        states = sorted(pool, key=lambda s: -s[1])[:beam]
    got = P.beam_path(g, beam, F.col("data")).orderBy("pos").collect()
    assert [(r.node_id, r.dir) for r in got] == states[0][0] and len(got) > 2


def test_path_in_blocks(spark, monkeypatch):
    """A path over several levels of blocks is spelled as one walk spells it."""
    monkeypatch.setattr(P, "BLOCK", 3)
    rng = random.Random(8)
    k, seqs = 5, [dna(rng, 12) for _ in range(40)]
    nodes = spark.createDataFrame(list(enumerate(seqs)), "node_id long, seq string")
    path = [(pos, rng.randrange(40), rng.choice("LR")) for pos in range(70)]
    rows = spark.createDataFrame(path, "pos long, node_id long, dir string")
    own = lambda n, d: rc(seqs[n]) if d == "R" else seqs[n]
    want = own(*path[0][1:]) + "".join(own(n, d)[k - 1 :] for _, n, d in path[1:])
    g = G.Graph(nodes, k)
    assert P.path_sequence(g, rows).first().seq == want
    blocks = P.path_blocks(g, rows).orderBy("block").collect()
    assert "".join(b.seq for b in blocks) == want and all(want[b.start :].startswith(b.seq) for b in blocks) and len(blocks) == 24
    assert [r.seq for r in P.path_sequence(g, rows.limit(0)).collect()] == [""]


def test_indexed_ends_are_not_shuffled(spark):
    """Lookups in an index read its buckets where they are; the results are the same."""
    rng = random.Random(1)
    _, g = graph_of(spark, contigs(3) + [dna(rng, 80)], 11)
    g = G.Graph(written(g.nodes, "g"), g.k)
    rows = lambda df: sorted(map(repr, df.collect()))
    want, fixed = rows(G.edges(g)), rows(G.fix_exts(g).nodes)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        found = g.indexed()
        assert rows(G.edges(found)) == want and rows(G.fix_exts(found).nodes) == fixed
        df = G.edges(found)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan[: plan.index("== Initial Plan ==")]
        lines = plan[plan.index("SortMergeJoin") :].splitlines()
        bucket = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-|*("))
        above, level = [], depth(lines[bucket])
        for line in reversed(lines[:bucket]):  # the scan's own ancestors, up to the join
            if depth(line) < level:
                above, level = [*above, line], depth(line)
            if "SortMergeJoin" in line:
                break
        assert above and not any("Exchange" in line for line in above)
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
