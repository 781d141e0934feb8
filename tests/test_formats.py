"""Graph formats as data sources: one header, files that appear together or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import graph
from kmerloom.sources import export, formats


@pytest.fixture
def lines(spark):
    formats.register(spark)
    rows = spark.createDataFrame([("ACGTAC", 16, 1), ("GGATTT", 17, 2), ("CGTACG", 1, 3)], "seq string, exts int, data int")
    return graph.base_graph(rows, 5)


def test_gfa_round_trip(spark, tmp_path, lines):
    path = f"file://{tmp_path}/gfa"
    table = export.gfa_lines(lines).repartition(3)
    table.write.format("gfa").mode("append").save(path)
    want = sorted(r.line for r in table.collect())
    assert sorted(r.line for r in spark.read.format("gfa").load(path).collect()) == want
    files = sorted(os.listdir(tmp_path / "gfa"))
    text = "".join((tmp_path / "gfa" / f).read_text() for f in files if not f.startswith("."))
    assert text.startswith(export.GFA_HEADER + "\n") and text.count("H\t") == 1 and len(text.splitlines()) == len(want)
    table.write.format("gfa").mode("append").save(path)
    again = [r.line for r in spark.read.format("gfa").load(path).collect()]
    assert len(again) == 2 * len(want) - 1 and again.count(export.GFA_HEADER) == 1
    table.write.format("gfa").mode("overwrite").save(path)
    assert sorted(r.line for r in spark.read.format("gfa").load(path).collect()) == want


def test_dot_has_its_frame_around(spark, tmp_path, lines):
    export.dot_lines(lines).write.format("dot").mode("append").save(str(tmp_path / "dot"))
    got = [r.line for r in spark.read.format("dot").load(str(tmp_path / "dot")).coalesce(1).collect()]
    assert got[0] == "digraph {" and got[-1] == "}" and len(got) == 2 + lines.nodes.count() + graph.edges(lines).count()


def test_failed_job_leaves_nothing(spark, tmp_path, lines):
    path = str(tmp_path / "gfa")
    bad = export.gfa_lines(lines).withColumn("line", F.when(F.col("node_id") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("gfa").mode("append").save(path)
    assert not os.path.exists(path) or not os.listdir(path)
    with pytest.raises(Exception, match="line"):
        spark.range(2).write.format("gfa").mode("append").save(path)


def test_folder_without_files(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("gfa").load(str(tmp_path / "none")).count() == 0
