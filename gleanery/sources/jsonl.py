"""JSON lines: reading, writing, ordinals, key checks, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, bucket: Column, order: list, name: str = "ord") -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of (bucket, *order).

    Rows are numbered inside their bucket and the buckets' counts are summed up,
    so only the small table of counts passes through one task.  ``bucket`` must
    rise with the order.
    """
    own = df.withColumn("_bucket", bucket)
    counts = own.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return own.withColumn("_at", F.row_number().over(inside)).join(offsets, "_bucket").withColumn(name, F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before")


def first_by_weight(df: DataFrame, bucket: Column, order: list, weight: Column, n: int) -> DataFrame:
    """Rows in the order of (bucket, *order) before which less than ``n`` of ``weight`` lies, with that sum as ``_before``.

    Only the table of the buckets' sums passes through one task, and only the
    buckets that begin below ``n`` are sorted.
    """
    own = df.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("long"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("_bucket").agg(F.sum("_weight").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).where(F.col("_start") < n)
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.join(starts.select("_bucket", "_start"), "_bucket").withColumn("_before", F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return placed.where(F.col("_before") < n).drop("_bucket", "_weight", "_start")


def read_lines(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """Non-blank lines of a file or of all files of ``pattern`` below a folder: value, file, ord (from 1).

    Order is that of the paths, folder by folder, then of the lines.  A file's
    splits are told apart by where they begin, and lines inside a split by the order
    in which its task reads them.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    raw = reader.text(path).where(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0)
    placed = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    # By its parts: "a/b" comes before "a-b/c", unlike in the order of the whole strings.
    bucket = F.struct(F.split("file", "/").alias("parts"), "_start")
    return dense_index(placed, bucket, ["_row"]).drop("_start", "_row")


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None, recursive: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """Typed rows with ``file``, ``ord`` and ``keys`` (the keys each object has).

    Malformed lines and lines that are no object fail.  ``limit`` keeps the first
    rows in order.
    """
    lines = read_lines(spark, path, recursive, pattern)
    if limit is not None:
        lines = lines.where(F.col("ord") <= limit)
    keys = F.json_object_keys("value")
    checked = F.when(keys.isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("value")))).otherwise(keys)
    parsed = lines.select("file", "ord", checked.alias("keys"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_row"))
    return parsed.select("file", "ord", "keys", "_row.*")


def write_jsonl(df: DataFrame, path: str, shard_rows: int | None = None, mode: str = "errorifexists") -> int:
    """Write JSON lines with null keys kept; the number of rows."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false")
    if shard_rows:
        writer = writer.option("maxRecordsPerFile", shard_rows)
    writer.json(path)
    return seen.get["n"]


def write_pages(df: DataFrame, path: str, shard_rows: int, limit: int | None = None) -> int:
    """Pages (id, text, lines) in shards; missing columns read as empty.  ``limit`` needs ``ord``."""
    if limit is not None:
        df = df.where(F.col("ord") <= limit)
    columns = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in ("id", "text", "lines")]
    return write_jsonl(df.select(*columns), path, shard_rows)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row table as a single JSON document."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def require_columns(df: DataFrame, names: list[str], where: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{where} lacks {', '.join(missing)}")
    return df


def require_keys(df: DataFrame, names: list[str], where: str) -> DataFrame:
    """Fail on rows of ``read_jsonl`` whose object lacks one of the keys (a null value is there)."""
    lacking = F.array_except(F.array(*map(F.lit, names)), F.col("keys"))
    complete = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit(f"{where} lacks "), F.array_join(lacking, ", ")))).otherwise(F.lit(True))
    return df.where(complete)  # a filter, as an unused column would be pruned with its check


def pending(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``source`` that ``done`` doesn't have yet."""
    return source.join(done.select(key), key, "left_anti")


def unexpected(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are done but not in the source."""
    return done.select(key).distinct().join(source.select(key), key, "left_anti")


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that stand more than once, with their number."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resume(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """``pending`` after checks: no repeated keys on either side, none done that is not expected."""
    for name, found in (("source", duplicates(source, key)), ("finished rows", duplicates(done, key)), ("unexpected finished rows", unexpected(source, done, key))):
        bad = found.limit(5).collect()
        if bad:
            raise ValueError(f"{name}: {[r[0] for r in bad]}")
    return pending(source, done, key)
