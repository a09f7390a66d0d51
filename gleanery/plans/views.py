"""The standard tables seen as claims, pages, corpus, queries and posteriors."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25
from ..operators import corpus as sentences
from ..sources.tables import there

LABELS = ["SUPPORTS", "REFUTES"]
LABEL_MAP = {"SUPPORTS": "SUPPORTS", "REFUTES": "REFUTES"}
DROP = ["NOT ENOUGH INFO"]
TOP_N, TOP_M = 20, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text")


_indexes: dict[tuple[str, str], bm25.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The inverted index of the corpus, written once in a session (and again if somebody has cleared the shared folder)."""
    key = spark.sparkContext.applicationId, sf_dir
    found = _indexes.get(key)
    if found is None or not there(found.lists, found.frequency, found.size):
        _indexes[key] = bm25.build_index(corpus(spark, sf_dir))
    return _indexes[key]


def top(spark: SparkSession, sf_dir: str, top_n: int = TOP_N) -> DataFrame:
    """id, rank, doc_ord, score of all items."""
    return bm25.retrieve(queries(spark, sf_dir), corpus(spark, sf_dir), top_n, index(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("id"), F.lit("").alias("text"), F.col("text").alias("lines"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("item_id") % 3 == 0, "REFUTES").otherwise("SUPPORTS")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), gold.alias("label"), F.lit("test").alias("split"))


def rare_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest known word of each item (ties by the word) as a query of its own."""
    own = queries(spark, sf_dir)
    rare = bm25.query_terms(own).join(index(spark, sf_dir).frequency, "term").groupBy("id").agg(F.min(F.struct("df", "term"))["term"].alias("word"))
    return own.join(rare, "id").select("id", F.col("word").alias("query"), "label", "split")


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "DISPUTED").when(F.col("toxic") == 1, "NOT ENOUGH INFO").when(F.col("quality") == 1, "SUPPORTS").otherwise("REFUTES")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.col("text").alias("claim"), label.alias("label"))


def dev_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select(F.col("id").alias("ord"), "id", F.col("query").alias("claim"), "label")


def flat_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.col("l_orderkey").cast("string").alias("id"),
        F.when(F.col("l_suppkey") % 3 == 0, "NOT ENOUGH INFO").otherwise("SUPPORTS").alias("label"),
        F.concat(F.lit("claim "), F.col("l_partkey")).alias("claim"),
        F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit("page_"), F.col("l_partkey") % 50)).alias("evidence_wiki_url"),
        (F.col("l_linenumber") - 2).cast("string").alias("evidence_sentence_id"),
        (F.col("l_suppkey") % 7).cast("string").alias("evidence_annotation_id"),
        F.when(F.col("l_partkey") % 11 == 0, "x").otherwise(F.col("l_linenumber").cast("string")).alias("evidence_id"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents; doc_ord keeps their order, page_id names the document."""
    return sentences.keyed_sentences(pages(spark, sf_dir).withColumn("id", F.format_string("page_%d", "ord"))).select(F.col("key").alias("doc_ord"), F.col("id").alias("title"), "text", F.col("id").alias("page_id"), "sentence_id")


def gold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of each claim's page, and a row without evidence."""
    at = F.explode(F.array(*map(F.lit, (0, 1, 2, None)))).alias("sentence_id")
    return page_claims(spark, sf_dir).select("id", F.format_string("page_%d", "id").alias("page_id"), at)


def page_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 characters of each labelled document as a claim about its page."""
    claims = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 80).alias("query"))  # before the join, which else shuffles whole texts
    rows = table(spark, sf_dir, "labels").select("doc_id").distinct().join(claims, "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "query", F.lit("SUPPORTS").alias("label"), F.lit("dev").alias("split"))


def digest_logits():
    """A language model for demonstrations: next-token logits from digests of prompt and token."""

    def logits(prompts: list[str], tokens: list[str]) -> np.ndarray:
        return np.array([[int(hashlib.md5((p + t).encode()).hexdigest()[:6], 16) % 1000 / 250 - 2 for t in tokens] for p in prompts])

    return logits


def digest_reader():
    """A text scorer for demonstrations: scores from a digest of the input."""
    own = digest_scorer()
    return lambda texts: own(texts)[:, 0]


def retrieval(spark: SparkSession, sf_dir: str, top_n: int = TOP_N) -> DataFrame:
    own, docs = queries(spark, sf_dir), corpus(spark, sf_dir)
    return bm25.nest_candidates(top(spark, sf_dir, top_n), own, docs)


def posteriors(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """A deterministic stand-in for scored posteriors: the retrieval score moves the
    prior toward the label of a labelled document; others leave it where it is."""
    labels = table(spark, sf_dir, "labels")
    share = labels.agg(((F.count_if(F.col("quality") == 1) + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
    marks = labels.select(F.col("doc_id").alias("doc_ord"), "quality")
    own, docs = queries(spark, sf_dir), corpus(spark, sf_dir)
    scored = top(spark, sf_dir).join(marks, "doc_ord", "left").crossJoin(F.broadcast(share))
    w = F.col("score") / (F.col("score") + 10)
    moved = lambda prior, hot: F.when(F.col("quality").isNull(), prior).otherwise((1 - w) * prior + w * hot)
    first, second = F.col("p"), 1 - F.col("p")
    eta = F.array(moved(first, (F.col("quality") == 1).cast("double")), moved(second, (F.col("quality") != 1).cast("double")))
    rows = bm25.with_documents(scored, docs) if texts else bm25.with_documents(scored, docs.select("doc_ord", "doc_id")).withColumns({"title": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    item = F.struct("rank", "doc_id", F.col("score").alias("retrieval_score"), "title", "text", eta.alias("eta"))
    nested = rows.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(F.array(first, second)).alias("eta0"))
    shape = F.transform("items", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["rank"].alias("rank"), c["retrieval_score"].alias("retrieval_score"), c["title"].alias("title"), c["text"].alias("text"), c["eta"].alias("eta")))
    # Items count as read from the last to the first, so that the input order is not that of the ids.
    return own.join(nested, "id").select("id", (-F.col("id")).alias("ord"), "query", "label", "split", F.array(*map(F.lit, LABELS)).alias("labels"), "eta0", shape.alias("candidates"))


def digest_scorer():
    """A scorer for demonstrations: probabilities from a digest of the prompt."""

    def score(prompts: list[str]) -> np.ndarray:
        first = np.array([(int(hashlib.md5(p.encode()).hexdigest()[:6], 16) % 1000 + 1) / 1002 for p in prompts])
        return np.stack([first, 1 - first], axis=1)

    return score
