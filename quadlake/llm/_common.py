"""Shared helpers of the corpus operators: word rule, scratch tables, table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside ASCII white space. ``bytes.split()`` splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or the script of the rest."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session (tests) may name none: a temporary one is set then."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadlake-"))
    return jsc.getCheckpointDir().get()


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path object) of a path, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def integral(df: DataFrame, key: str) -> str:
    """`key`, if it is an integer column; ids of other types are refused before any job runs."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}; an integer column is needed")
    return key


#: Shuffle files go as soon as the query that made them has been written: no plan reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``drop`` removes a table that no later plan reads; the rest goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._quiet_drop)

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}"

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = self.path()
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        fs, at = hadoop_fs(self.spark, path)
        fs.delete(at, True)

    def _quiet_drop(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch of texts. Spark's own limit is 64 MB, which the JVM's buffers and the worker hold twice and more for every task.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on batches of this session have about BATCH_BYTES, unless it sets a limit of its own.

    It is not set back: a lazy result is planned after the function that made it has returned. Results do not depend on it.
    """
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


#: Rows of an Arrow batch that become Python objects at a time: a worker's memory stays at a few texts.
ROWS = 256


def small(batches: Iterable, rows: int = ROWS) -> Iterator:
    """Arrow batches of at most `rows` rows; slices, not copies."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def arrow_rows(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; strings come as UTF-8 bytes, so that no text is decoded twice."""
    import pyarrow as pa

    for batch in small(batches):
        cols = []
        for name in columns:
            col = batch.column(batch.schema.get_field_index(name))
            if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                col = col.cast(pa.large_binary())
            cols.append(col.to_pylist())
        yield from zip(*cols, strict=True)
