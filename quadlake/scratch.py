"""Intermediate tables in the shared folder: short lineage that survives lost executors.

Tables go when the driver exits, or earlier by ``drop``; a lazily evaluated result may read them until then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this driver, with a session that can delete them.
_FOLDERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session (tests) may name none: a temporary folder is set then."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadlake-"))
    return context.getCheckpointDir().get()


def _folder(spark: SparkSession) -> str:
    base = shared_folder(spark)
    for folder, session in _FOLDERS.items():
        if session is spark and folder.startswith(base):
            return folder
    folder = f"{base}/tables-{uuid.uuid4().hex}"
    _FOLDERS[folder] = spark
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read again."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._paths = [path]
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one."""
    paths = [p for t in tables for p in t._paths]
    out = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)
    out._paths = paths
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete a written table that no result reads."""
    for path in df._paths:
        _delete(df.sparkSession, path)


def drop_all() -> None:
    """Delete all tables of this driver; results that read them end with it."""
    for folder, spark in list(_FOLDERS.items()):
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
    _FOLDERS.clear()


atexit.register(drop_all)
