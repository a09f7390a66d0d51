"""Label posteriors of queries and of their candidates, through a scorer that the user supplies."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import claim_prompt, prompt_contract
from ..functions.vectors import posterior_from_logits
from ..sources.jsonl import resume
from ..sources.tables import passing, shared_folder

SCHEMA_VERSION = "posteriors.v2"


def score_prompts(prompts: DataFrame, make_scorer: Callable[[], Callable[[list[str]], np.ndarray]], labels: list[str], batch_size: int = 64, prompt: str = "prompt") -> DataFrame:
    """Add ``probs``: what the scorer gives for each prompt.

    ``make_scorer`` runs once in each task and returns a function from a list of
    prompts to an array (prompts x labels) of probabilities, which must be finite,
    not negative and sum to 1 within 1e-5.
    """
    k = len(labels)

    def run(batches):
        scorer = make_scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
            rows = []
            for i in range(0, len(texts), batch_size):
                probs = np.asarray(scorer(texts[i : i + batch_size]), float)
                if probs.shape != (len(texts[i : i + batch_size]), k) or not np.isfinite(probs).all() or (probs < 0).any() or (abs(probs.sum(axis=1) - 1) > 1e-5).any():
                    raise ValueError("the scorer's output is no distribution over the labels")
                rows += probs.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "probs"])

    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))]))


def score_by_logits(prompts: DataFrame, make_logits: Callable[[], Callable[[list[str], list[str]], np.ndarray]], labels: list[str], verbalizers: dict[str, list[str]], batch_size: int = 64, prompt: str = "prompt") -> DataFrame:
    """Add ``logits`` and ``probs`` from a model that tells how it would go on.

    ``make_logits`` runs once in each task and returns a function from prompts and
    verbalizer tokens to an array (prompts x tokens) of next-token logits.  A label
    gets the log-sum-exp over its own verbalizers, once each, and the softmax over
    labels is the posterior; both are column arithmetic.  Logits must be finite.
    """
    if not labels or batch_size < 1:
        raise ValueError("labels must not be empty and batch_size must be positive")
    missing = [label for label in labels if not verbalizers.get(label)]
    if missing:
        raise ValueError(f"no verbalizer for {', '.join(missing)}")
    own = [list(dict.fromkeys(verbalizers[label])) for label in labels]
    asked = [t for tokens in own for t in tokens]
    ends = np.cumsum([0, *map(len, own)]).tolist()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_logits()
        for batch in batches:
            texts, rows = batch.to_pylist(), []
            if any(not t for t in texts):
                raise ValueError("every prompt must be a text that is not empty")
            for i in range(0, len(texts), batch_size):
                logits = np.asarray(model(texts[i : i + batch_size], asked), float)
                if logits.shape != (len(texts[i : i + batch_size]), len(asked)) or not np.isfinite(logits).all():
                    raise ValueError("the model's output is no finite logit for each prompt and verbalizer")
                rows += logits.tolist()
            yield pa.array(rows, pa.list_(pa.float64()))

    scored = prompts.withColumn("logits", F.arrow_udf(run, "array<double>")(F.col(prompt)))
    return scored.withColumn("probs", posterior_from_logits(F.col("logits"), [list(range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]))


def posterior_prompts(retrieval: DataFrame, labels: list[str], verbalizers: dict[str, list[str]], max_candidates: int | None = None) -> DataFrame:
    """id, place, prompt: place 0 asks about the claim alone, place i shows candidate i's text."""
    candidates = F.col("candidates")
    if max_candidates is not None:
        if max_candidates < 0:
            raise ValueError("max_candidates must not be negative")
        candidates = F.slice(candidates, 1, max_candidates) if max_candidates else F.slice(candidates, 1, 0)
    texts = F.concat(F.array(F.lit(None).cast("string")), F.transform(candidates, lambda c: c["text"]))
    rows = retrieval.select("id", "query", F.posexplode(texts).alias("place", "evidence"))
    return rows.select("id", "place", claim_prompt(F.col("query"), labels, verbalizers, F.col("evidence")).alias("prompt"))


def score_posteriors(retrieval: DataFrame, make_scorer, labels: list[str], verbalizers: dict[str, list[str]], max_candidates: int | None = None, batch_size: int = 64) -> DataFrame:
    """Posterior rows: eta0 of the claim alone, eta of each candidate, in candidate order."""
    scored = score_prompts(posterior_prompts(retrieval, labels, verbalizers, max_candidates), make_scorer, labels, batch_size)
    etas = scored.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "probs"))), lambda x: x["probs"]).alias("etas"))
    shape = lambda c, i: F.struct(c["doc_id"].alias("doc_id"), c["rank"].alias("rank"), c["score"].alias("retrieval_score"), c["title"].alias("title"), c["text"].alias("text"), F.col("etas")[i + 1].alias("eta"))
    return retrieval.join(etas, "id").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "id", "query", "label", "split", F.array(*map(F.lit, labels)).alias("labels"), F.col("etas")[0].alias("eta0"), F.transform(F.slice("candidates", 1, F.size("etas") - 1), shape).alias("candidates")
    )


def append_posteriors(retrieval: DataFrame, path: str, make_scorer, labels: list[str], verbalizers: dict[str, list[str]], max_candidates: int | None = None, batch_size: int = 64, buckets: int = 16) -> DataFrame:
    """Score the rows that the Parquet table ``path`` lacks, append them and return the table.

    Rows are appended in ``buckets`` by a hash of their id, one commit each: a run
    that breaks off keeps all buckets it has finished, and the next scores only what
    is left.  Each row keeps the fingerprint of its prompts.  Rows of other
    prompts, repeated ids, finished rows that are not expected and a wrong final
    count are errors.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    spark = retrieval.sparkSession
    contract = prompt_contract(labels, verbalizers)

    def score(rows: DataFrame) -> DataFrame:
        return score_posteriors(rows, make_scorer, labels, verbalizers, max_candidates, batch_size).withColumn("prompt_contract", contract)

    shape = score(retrieval.limit(0))
    shape.write.mode("append").parquet(path)  # so that there is a table, however empty
    done = spark.read.schema(shape.schema).parquet(path)
    if done.where(~F.col("prompt_contract").eqNullSafe(contract)).limit(1).count():
        raise ValueError("the finished rows were scored with other prompts")
    # Written once by bucket, so that no bucket's job computes the others' rows again.
    todo = passing(spark, f"{shared_folder(spark)}/pending-{uuid.uuid4().hex}")
    left = resume(retrieval, done.select("id")).withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    left.repartition("_bucket", F.pmod(F.hash("id"), F.lit(8))).write.partitionBy("_bucket").parquet(todo)
    pending = spark.read.schema(left.schema).parquet(todo)
    for bucket in sorted(r[0] for r in pending.select("_bucket").distinct().collect()):
        score(pending.where(F.col("_bucket") == bucket).drop("_bucket")).write.mode("append").parquet(path)
    out = spark.read.schema(shape.schema).parquet(path)
    have, want = out.count(), retrieval.count()
    if have != want:
        raise ValueError(f"{have} rows are finished, {want} were expected")
    return out


def candidate_count(posteriors: DataFrame) -> DataFrame:
    """One row: rows and candidate prompts scored."""
    return posteriors.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("candidates")), F.lit(0)).alias("candidates"))
