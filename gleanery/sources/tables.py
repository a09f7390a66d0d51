"""Tables that a job writes once and reads several times."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, **options: int) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (``options`` are the writer's); nothing above it is computed again.

    The table goes with the session's end, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**options).parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out], _counts[out] = path, seen.get["n"]
    return out


def written_in_buckets(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """``df``, which lies in ``buckets`` partitions by ``key``, as a table in the shared folder with a bucket for each: what groups by ``key`` and more, or joins by ``key``, needs no shuffle."""
    spark = df.sparkSession
    name = f"gleanery_{uuid.uuid4().hex}"
    path = passing(spark, f"{shared_folder(spark)}/{name}")
    df.write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_counts: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def rows_of(df: DataFrame) -> int:
    """The number of rows; known without a job where ``df`` is what ``written`` gave."""
    return _counts[df] if df in _counts else df.count()


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def passing(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver ends."""
    files, folder = _at(spark, path)
    files.deleteOnExit(folder)
    return path


def there(*tables: DataFrame) -> bool:
    """Whether what was written for these tables still exists."""
    return all(files.exists(folder) for files, folder in (_at(t.sparkSession, _paths[t]) for t in tables))


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables; nothing may read them any more."""
    for t in tables:
        files, folder = _at(t.sparkSession, _paths.pop(t))
        files.delete(folder, True)
