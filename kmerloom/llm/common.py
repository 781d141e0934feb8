"""Shared folder, materialised intermediate tables and table loading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a session on this machine alone (a local master, as in tests) may go without: it gets a
    temporary folder once, which it remembers. On a cluster such a folder would be a different one
    on each machine, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kmerloom.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("kmerloom.shared.dir", base)
    return base.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, so that cleanup() leaves others' tables alone."""
    return f"{shared_dir(spark)}/kmerloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there.

    A lost executor loses none of it, later readers compute nothing twice, and Catalyst knows
    its true size when it chooses between a broadcast and a shuffled join.
    """
    return _write(df, fresh_path(df.sparkSession, name))


#: Arrow batches of the session are bounded to so many bytes.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch takes in an executor and its Python workers, whatever the length of the
    texts: by default Spark bounds the rows only. It holds for the session, as operators return
    DataFrames that are read later; a lower bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


class Scratch:
    """Written tables that one call of an operator needs until its own result is written.

    Used as materialize() is; leaving the `with` block removes them all. What outlives the call is
    written by materialize() inside the block.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.path, self.tables = spark, fresh_path(spark, name), 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        return _write(df, f"{self.path}/{self.tables}-{name}")

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *failed) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder under the shared folder (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; call it after its last result is written."""
    drop_path(spark, session_dir(spark))


def lean(run):
    """A function for mapInArrow after which its Python worker, which later tasks use again, gives the
    memory that it has freed back to the system, where the C library can."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def slices(batches, rows: int = 256):
    """Arrow batches cut into parts of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
