"""Edges that are looked up once, and those of graphs whose extensions are mutual."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import fragments, kmers
from kmerloom.operators import graph as G
from kmerloom.operators import paths as P


def _graph(spark, k, min_obs, fixed=False):
    rng = random.Random(k)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    a, b = some(300), some(200)
    arm = some(k)
    turned = arm.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    texts = [a, b, a[:100] + some(60), some(60) + a[150:], a[200:260] + b[:90], "A" * (2 * k), "AT" * 2 * k, "ACGT" * k, some(40) + arm + turned + some(40), some(30) + arm[1:] + turned[:-1] + some(30), some(7) * 9, "AC" * k]
    seqs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts * min_obs + texts[:3])], "seq_id long, seq string, exts int")
    nodes = fragments.unitigs(seqs, k, kmers.count_filter(min_obs))
    return G.Graph(nodes, k, mutual=True).normalised()


@pytest.mark.parametrize("k, min_obs", [(6, 1), (7, 2), (20, 1), (5, 1)])
def test_mutual_edges(spark, k, min_obs):
    """Palindromes, hairpins, loops and branches, before and after repair."""
    rows = lambda df: sorted(map(repr, df.select("src", "src_dir", "base", "dst", "dst_side", "rc").collect()))
    g = _graph(spark, k, min_obs)
    plain = replace(g, mutual=False)
    want = rows(G.edges(plain))
    assert rows(G.edges(g)) == want and len(want) > 8
    mended, plain = G.fix_exts(g), G.fix_exts(plain)
    assert rows(mended.known) == want == rows(G.edges(replace(mended, known=None)))
    nodes = lambda x: sorted(map(repr, x.nodes.select("node_id", "seq", "exts").collect()))
    assert nodes(mended) == nodes(plain)
    some = mended.nodes.filter("node_id % 3 = 0").select("node_id")
    left = G.without(mended, some)
    again = G.fix_exts(G.Graph(plain.nodes.join(some, "node_id", "left_anti"), k))
    assert nodes(left) == nodes(again) and rows(left.known) == rows(G.edges(replace(again, known=None)))


def test_edges_are_looked_up_once(spark, sf, monkeypatch):
    """max_path and graph_is_compressed read the edges that repaired the graph; only merged nodes are linked anew."""
    import __spark_entry__ as entry

    asked = []
    own = G.mutual_edges
    monkeypatch.setattr(G, "mutual_edges", lambda g: asked.append(1) or own(g))
    monkeypatch.setattr(G, "find_links", None)
    entry.queries()["max_path"](spark, sf)
    assert len(asked) == 1
    entry.queries()["graph_is_compressed"](spark, sf)
    assert len(asked) == 3


def test_walks(spark):
    """Chains, circles and walks of both directions that meet, against steps one by one."""
    from kmerloom.operators.tables import Temporary

    rng = random.Random(5)
    step = {s: rng.randrange(60) for s in rng.sample(range(60), 55)} | {s: s + 2 for s in range(100, 140)}
    table = spark.createDataFrame([*step.items()], "state long, to long")

    def walk(s):
        out, had = [s], {s >> 1}
        while step.get(out[-1]) is not None and step[out[-1]] >> 1 not in had:
            out.append(step[out[-1]])
            had.add(out[-1] >> 1)
        return out

    for starts in ([0, 1], [100, 101], [58, 59], [500, 100]):
        with Temporary(spark, "test") as write:
            got = [[r.state for r in w.orderBy("pos").collect()] for w in P._walks(table, starts, write)]
        assert got == [walk(s) for s in starts]
