"""Unitigs by fragments with repaired extensions, equal data and ordered folds are those of compact.compress_kmers()."""

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import seq as S
from kmerloom.operators import compact, fragments, graph, kmers, local_repair

NODES = ["node_id", "seq", "len", "exts", "members", "data"]


def _texts(rng):
    """Chains, circles, repeats, palindromes, and branches of them."""
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    texts = [some(n) for n in (5, 30, 31, 400, 1500)]
    texts += [some(40) * 3, some(400) * 2, "ACGT" * 20, "A" * 60, some(4) * 20, "AT" * 30]
    texts += [texts[3][:200] + some(50), some(50) + texts[4][1000:1200], texts[4][500:900].translate(str.maketrans("ACGT", "TGCA"))[::-1]]
    return texts


def _sequences(spark, k):
    rng = random.Random(k)
    # Circles whose members are seen in different shares, so that colours and counts change along them.
    texts = _texts(rng) * 2 + _texts(rng) + ["".join(rng.choices("ACGT", k=90)) * 3, "ACGTTGCA" * 30, "AACCGGTT" * 30]
    rows = [(i, t, 0, "xyz"[i % 3]) for i, t in enumerate(texts)] + [(100 + i, t[len(t) // 3 :], 0, None) for i, t in enumerate(texts[3:8])]
    return spark.createDataFrame(rows, "seq_id long, seq string, exts int, label string")


@pytest.fixture
def small(spark, monkeypatch):
    """Tasks see only some of their k-mers at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 50)
    yield monkeypatch
    spark.conf.set(key, before)


def _plain(table, k, **spec):
    return graph.Graph(compact.compress_kmers(table, k, **spec), k).normalised().nodes


def _rows(nodes, columns=NODES):
    return sorted(map(repr, nodes.select(columns).collect()))


@pytest.mark.parametrize("k, min_obs, held, repair", [(24, 1, 1 << 20, "from set"), (31, 2, 1 << 20, "censored"), (40, 2, 100, "censored"), (12, 2, 300, "from set")])
def test_repaired(spark, small, k, min_obs, held, repair):
    seqs = _sequences(spark, k)
    table = kmers.filter_kmers(seqs, k, kmers.count_filter(min_obs))
    mended = kmers.remove_censored_exts(table) if repair == fragments.CENSORED else kmers.exts_from_set(table)
    small.setattr(fragments, "HELD", held)
    got = fragments.unitigs(seqs, k, kmers.count_filter(min_obs), repair=repair)
    assert _rows(graph.Graph(got, k).normalised().nodes) == _rows(_plain(mended, k))


@pytest.mark.parametrize("k", [31])
def test_equal_data(spark, small, k):
    small.setattr(fragments, "HELD", 50)
    seqs = _sequences(spark, k)
    joined = F.array_join("data", ",")
    want = _plain(kmers.filter_kmers(seqs, k, kmers.label_filter(2)).withColumn("data", joined), k, spec=compact.equal_data_compression())
    got = fragments.unitigs(seqs, k, kmers.label_filter(2), data=joined, equal=True)
    assert _rows(graph.Graph(got, k).normalised().nodes) == _rows(want) and want.select("data").distinct().count() > 2


@pytest.mark.parametrize("k", [24])
def test_ordered_data(spark, small, k):
    """All counts of a path in its order, which no sum tells, circles from their least k-mer on."""
    small.setattr(fragments, "HELD", 50)
    seqs = _sequences(spark, k)
    of = lambda x: F.array(x)
    counts = {"counts": compact.Ordered(of, lambda a, b: F.concat(a, b))}

    def forwards(nodes):
        """Nodes read in the lesser direction; a palindrome by the lesser list."""
        turned = S.rc("seq") < F.col("seq")
        own = F.when(turned, F.reverse("counts")).when(S.rc("seq") == F.col("seq"), F.least("counts", F.reverse("counts"))).otherwise(F.col("counts"))
        return sorted(map(repr, nodes.select(F.least("seq", S.rc("seq")).alias("seq"), own.alias("counts")).collect()))

    want = compact.compress_kmers(kmers.filter_kmers(seqs, k, kmers.count_filter(2)), k, spec=compact.Compression({"n": F.count(F.lit(1))}, ordered=counts))
    got = fragments.unitigs(seqs, k, kmers.count_filter(2), ordered=counts)
    assert forwards(got) == forwards(want)


@pytest.mark.parametrize("name", ["unitigs_repaired", "unitigs_sharded", "unitigs_no_exts", "unitigs_colored", "unitigs_ordered"])
def test_kmers_are_not_looked_up(spark, sf, monkeypatch, name):
    """K-mers are joined in the tasks that count them: no table of them is written, nor looked up."""
    import __spark_entry__ as entry

    def no(*args, **kwargs):
        raise AssertionError("k-mers one by one")

    for module, function in ((compact, "with_ids"), (kmers, "filter_kmers"), (kmers, "neighbour_bits")):
        monkeypatch.setattr(module, function, no)
    assert entry.queries()[name](spark, sf).count() > 20


@pytest.mark.parametrize("k, shard", [(24, lambda kmer: F.left(kmer, F.lit(1))), (31, None)])
def test_counted_and_repaired(spark, small, k, shard):
    """Repair by shards, too, without a table of all k-mers."""
    small.setattr(fragments, "HELD", 50)
    seqs, counts = _sequences(spark, k), kmers.count_filter(2)
    valid, everything = kmers.filter_kmers(seqs, k, counts, report_all=True)
    want = kmers.remove_censored_exts_sharded(valid, everything, shard=shard) if shard else kmers.remove_censored_exts(valid)
    small.setattr(kmers, "filter_kmers", None)
    got = local_repair.counted(seqs, k, counts, shard=shard)
    rows = lambda df: sorted(map(repr, df.select("kmer", "exts", "n", "data").collect()))
    assert rows(got) == rows(want)
