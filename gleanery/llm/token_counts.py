"""Token counts through a digest cache.

A count is stored under two digests: of the content as the tokenizer sees it,
and of the tokenizer's version (its vocabulary file).  ``count_tokens`` joins
the documents' digests to the stored counts, encodes each distinct missing
content once, appends the new counts to the cache and joins again.

The vocabularies in use normalise nothing, so the normalised content is the
text itself with null taken as empty.  A cache is a Parquet folder; appending
is atomic per job, and a content that two concurrent runs both add gives equal
rows, which the read drops as repeats.

Defined results: null and empty texts have 0 tokens; equal texts have equal
counts; repeated rows stay repeated; other columns stay; a null id is an id.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, shared_dir, shown, stored
from .vocabulary import load

CACHE_SCHEMA = "version string, content binary, n_bytes long, n_tokens long"


@lru_cache(maxsize=4)
def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: a changed vocabulary never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def _counter(path: str):
    """text -> number of tokens, special strings read as the library reads them by default.

    The tiktoken encoder gets the merge ranks of the same vocabulary file and
    splits alike for every code point (tests compare them with the tokenizers
    library); it serves because it keeps no offsets and so is several times
    faster.  A text that makes it give up goes to the library itself.
    """
    import tiktoken

    v = load(path)
    fast = tiktoken.Encoding("counts", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens=v.special)
    special = set(v.special)

    def count(text: str) -> int:
        try:
            return len(fast.encode(text, allowed_special=special, disallowed_special=()))
        except BaseException as e:  # the Rust side panics on patterns it can't finish
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            return len(t.encode(text, add_special_tokens=False))

    return count


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty if there is no cache yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    df = spark.read.schema(CACHE_SCHEMA).parquet(cache) if found else spark.createDataFrame([], CACHE_SCHEMA)
    return df.where(F.col("version") == version)


def _encode(misses: DataFrame, path: str) -> DataFrame:
    def run(batches):
        count = _counter(path)
        for batch in batches:
            n = [count(x or "") for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("content"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["content", "n_bytes", "n_tokens"])

    return misses.mapInArrow(run, "content binary, n_bytes long, n_tokens long")


def count_tokens(df: DataFrame, path: str, cache: str, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` to ``df``; ``text`` is dropped.

    Runs the encoding of the misses at once (the append must be complete before
    the final join reads the cache).  Only digests meet in the first join; texts
    move once, to the task that encodes their content, and copies of a content
    are reduced to one row per map task before that.
    """
    spark, version = df.sparkSession, tokenizer_version(path)
    columns = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = hidden(df, text).withColumn("content", F.unhex(F.sha2(body, 256)))
    known = read_cache(spark, cache, version).select("content").distinct()
    placed = keyed.select("content", body.alias("body"), F.octet_length(body).cast("long").alias("n_bytes"))
    first = placed.dropDuplicates(["content"])
    misses = first.join(known, "content", "left_anti")
    added = _encode(misses, path).withColumn("version", F.lit(version)).select("version", "content", "n_bytes", "n_tokens")
    added.write.mode("append").parquet(cache)
    # Written out, so that the last join has no aggregate above its shuffle and a hot content can be split.
    counts = stored(read_cache(spark, cache, version).groupBy("content").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens")))
    return keyed.select("doc", "content").join(counts, "content", "left").select(*shown(columns, without=("n_bytes", "n_tokens")), "n_bytes", "n_tokens")


def new_cache(spark: SparkSession) -> str:
    """A cache folder of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"


def token_counts(docs: DataFrame, path: str, limit: int = 512, cache: str | None = None) -> DataFrame:
    """``documents`` -> doc_id, n_bytes, n_tokens, over_limit."""
    cache = cache or new_cache(docs.sparkSession)
    counted = count_tokens(docs.select("doc_id", "text"), path, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
