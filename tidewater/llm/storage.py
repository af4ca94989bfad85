"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may do without: it gets a folder that ends with the process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="tidewater-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[df.sparkSession.sparkContext.applicationId].remove(path)


def sweep(spark: SparkSession) -> int:
    """Delete every table that this application has written here, once no result that reads one is needed. How many they were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def carried(df: DataFrame, own: tuple[str, ...] | list[str]) -> list[str]:
    """Columns of df that keep their names beside results named `own`; names are compared as Spark does, without case."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]
