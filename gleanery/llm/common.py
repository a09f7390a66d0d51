"""Small pieces that several operators share: shared folders, column names, Arrow helpers.

Names: operators that add columns to a table of any columns never touch another
column.  A result column takes the place of one that has its name (in any case).
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that setting is
    absent and driver and executors are one process (``local[...]``, as in tests)
    a temporary one is made; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


ARROW_BYTES = 4 << 20
_ARROW_DEFAULT = {"67108864b", "64MB", "64m"}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES where the session has Spark's default of 64 MB.

    Texts are long: batches of the default size, copied between the JVM and
    Python, take several hundred MB of each executor outside its heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB") in _ARROW_DEFAULT:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back; ``keep``: also beyond the innermost ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gleanery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    owner = len(_scopes) - (2 if keep else 1)
    if owner >= 0:
        _scopes[owner].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_scopes: list[list[str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables; nothing may read them any more."""
    for t in tables:
        _delete(t.sparkSession, _paths.pop(t))


@contextmanager
def scratch(spark: SparkSession):
    """Delete, at the end, all that ``stored`` has written inside (results must be written elsewhere by then).

    Scopes nest; a table belongs to the innermost one, or with ``keep`` to the next.
    """
    depth = len(_scopes)
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        del _scopes[depth:]
        for path in held:
            _delete(spark, path)


def adder(df: DataFrame, fields: list[T.StructField]):
    """(schema, build): ``df`` with ``fields`` added, and what makes such a batch of one of ``df`` and the new arrays."""
    bounded_batches(df.sparkSession)
    own = {f.name.lower() for f in fields}
    keep = [i for i, f in enumerate(df.schema) if f.name.lower() not in own]
    schema = T.StructType([*(df.schema[i] for i in keep), *fields])

    def build(batch: pa.RecordBatch, arrays: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], names=schema.names)

    return schema, build


def hidden(df: DataFrame, *apart: str) -> DataFrame:
    """``df`` with all columns but ``apart`` in one struct ``doc``, so that no other name can clash."""
    bounded_batches(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in apart]
    spare = "_" * (1 + max(map(len, df.columns)))  # a struct needs a field
    return df.select(F.struct(*rest, F.lit(0).alias(spare)).alias("doc"), *(F.col(f"`{c}`") for c in apart))


def shown(columns: list[str], *apart: str, without: tuple = ()) -> list[Column]:
    """The columns that ``hidden`` packed and ``apart``, in their order, without those whose name is in ``without``."""
    gone = {c.lower() for c in without}
    return [F.col(f"`{c}`") if c in apart else F.col("doc").getField(c).alias(c) for c in columns if c.lower() not in gone]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def text_slices(column: pa.Array, limit: int):
    """(start, texts as bytes) for runs of about ``limit`` bytes of a text column.

    Only one run at a time becomes Python objects, which keeps workers small.
    """
    raw = column.cast(pa.binary())
    for a, b in slices((pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False) + 1).tolist(), limit):
        yield a, [v or b"" for v in raw.slice(a, b - a).to_pylist()]


def slices(lengths: list[int], limit: int):
    """Cut 0..n-1 into runs whose lengths add up to about ``limit``."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def merged_parts(df: DataFrame, zero, add, pack) -> DataFrame:
    """Combine the rows (part: int, data: binary) of each part into one.

    Two rounds, the first over a part's rows dealt out by a hash; tasks read
    their rows sorted by part, as a stream, and hold one accumulator at a time.
    ``add(acc, data)`` folds a row in, ``pack(acc)`` writes an accumulator.
    """

    def run(batches):
        def row(part, held):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(held)], pa.binary())], names=["part", "data"])

        now = held = None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if held is not None:
                        yield row(now, held)
                    now, held = part, zero()
                add(held, data)
        if held is not None:
            yield row(now, held)

    schema = "part int, data binary"
    dealt = df.repartition("part", F.pmod(F.xxhash64("data"), F.lit(16))).sortWithinPartitions("part")
    return dealt.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) that spreads all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_key() -> list:
    """Two columns that tell rows of ``documents`` apart up to exact repeats."""
    return [
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_a"),
        F.hash(F.col("text"), F.col("doc_id")).alias("row_b"),
    ]
