"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir.

    Only a session on this machine alone may go without that setting: it gets a temporary folder, which
    on a cluster would be a different one on each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kmerloom.tables.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kmerloom-tables-")
        spark.conf.set("kmerloom.tables.dir", base)
    return f"{base.rstrip('/')}/kmerloom-tables/{spark.sparkContext.applicationId}"


#: Arrow batches of the session are bounded to so many bytes.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by its bytes, as Spark does by its rows; a lower bound that is set already stays.
    It holds for the session, since operators return DataFrames that are read later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def at_least(spark: SparkSession, tasks: int) -> int:
    """Deal shuffles of the session to at least so many tasks, so that what a task sorts or groups does not grow
    with the input (adaptive execution puts small ones together); how many they are now. It holds for the
    session, since operators return DataFrames that are read later."""
    key = "spark.sql.shuffle.partitions"
    now = int(spark.conf.get(key))
    if tasks > now:
        spark.conf.set(key, int(tasks))
    return max(now, int(tasks))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, on any Hadoop file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back, which ends its lineage. It stays until cleanup()."""
    return _write(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


#: Names of bucketed tables begin with this.
BUCKETED = "kmerloom_buckets_"


def bucketed(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """df as a table in as many sorted buckets by `keys` as the session has shuffle partitions: joins on the
    keys then need no exchange of it. Its files are in the shared folder; it stays until
    drop_bucketed() or cleanup()."""
    spark = df.sparkSession
    table = f"{BUCKETED}{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt as the buckets are, so that each task writes few files.
    dealt = df.repartition(n, *keys)
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, f"{shared_folder(spark)}/{table}")


def drop_bucketed(table: DataFrame) -> None:
    """Remove a table from bucketed()."""
    spark = table.sparkSession
    for t in spark.catalog.listTables(pattern=f"{BUCKETED}*"):
        if any(f"/{t.name}/" in file for file in table.inputFiles()):
            _forget(spark, t.name)


def cleanup(spark: SparkSession) -> None:
    """Remove all tables of this application; call it after the last result is written elsewhere."""
    for t in spark.catalog.listTables(pattern=f"{BUCKETED}*"):
        _forget(spark, t.name)
    remove(spark, shared_folder(spark))


class Temporary:
    """written() for the tables that an operator needs until its own result is written: drop() removes one,
    the end of the `with` block all of them. What outlives the block is written by written() within."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self.tables)}-{name}"
        table = _write(df, path)
        self.tables.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        for own, path in self.tables:
            if own is table:
                remove(self.spark, path)

    def __enter__(self) -> Temporary:
        return self

    def __exit__(self, *failed) -> None:
        remove(self.spark, self.path)


def starts(rows: DataFrame) -> DataFrame:
    """id, size, start of rows (id, size): start, the sum of the sizes before it in the order of ids. Ranges of
    ids add up their own, and the sums of the ranges, one row each, go before them."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        task, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            upto = so_far + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array(upto - sizes), pa.array([task] * batch.num_rows, pa.int32())], names=["id", "size", "within", "task"])
            so_far = int(upto[-1]) if len(upto) else so_far

    with Temporary(rows.sparkSession, "starts") as write:
        own = write(rows.select("id", F.col("size").cast("long").alias("size")).repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, f"id {kind}, size long, within long, task int"), "ranges")
        sums = own.groupBy("task").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return written(own.join(F.broadcast(sums), "task").select("id", "size", (F.col("before") + F.col("within")).alias("start")), "starts")
