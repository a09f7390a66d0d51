"""Predictions from selections, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import claim_prompt, evidence_block
from ..functions.vectors import first_best
from ..sources.tables import written

SCHEMA_VERSION = "metrics.v2"


def recovered_docs(selection: DataFrame, no_evidence: bool = False, max_docs: int | None = None) -> DataFrame:
    """Add ``docs`` (title, text): the selected documents, or those that ids and candidates name.

    A missing document and one without text are errors.
    """
    if max_docs is not None and max_docs < 0:
        raise ValueError("max_docs must not be negative")
    slim = lambda d: F.struct(d["title"].alias("title"), d["text"].alias("text"))
    none = F.array().cast("array<struct<title:string,text:string>>")
    if no_evidence:
        return selection.withColumn("docs", none)
    parts = []
    if "selected_docs" in selection.columns:
        parts.append(F.transform("selected_docs", slim))
    if "candidates" in selection.columns:
        parts.append(F.transform("selected_doc_ids", lambda i: slim(F.try_element_at(F.filter("candidates", lambda c: c["doc_id"].cast("string") == i.cast("string")), F.lit(-1)))))
    if not parts:
        raise ValueError("neither selected_docs nor candidates are there")
    docs = F.coalesce(*parts)
    bad = docs.isNull() | F.exists(docs, lambda d: F.coalesce(d["text"], F.lit("")) == "")
    docs = F.when(bad, F.raise_error(F.concat(F.lit("selected document without text in row "), F.col("id").cast("string")))).otherwise(docs)
    return selection.withColumn("docs", docs if max_docs is None else F.slice(docs, 1, max_docs))


def evaluation_prompts(selection: DataFrame, labels: list[str], verbalizers: dict[str, list[str]], no_evidence: bool = False, max_docs: int | None = None) -> DataFrame:
    """Add evidence (null if none), evidence_chars, num_docs, prompt."""
    rows = recovered_docs(selection, no_evidence, max_docs)
    rows = rows.withColumn("num_docs", F.size("docs")).withColumn("evidence", F.when(F.size("docs") > 0, evidence_block(F.col("docs"))))
    return rows.withColumn("evidence_chars", F.coalesce(F.char_length("evidence"), F.lit(0))).withColumn("prompt", claim_prompt(F.col("query"), labels, verbalizers, F.col("evidence")))


def predictions(scored: DataFrame, labels: list[str], method: str | None = None, no_evidence: bool = False) -> DataFrame:
    """Prediction rows from scored prompts (see ``posterior.score_prompts``)."""
    named = F.array(*map(F.lit, labels))
    pred = first_best(named, F.col("probs"))
    gold = F.coalesce(*(F.col(c) for c in ("label", "gold") if c in scored.columns))
    how = F.lit("no_evidence") if no_evidence else F.coalesce(F.lit(method), F.col("method"))
    ids = F.array().cast("array<string>") if no_evidence else F.slice("selected_doc_ids", 1, F.col("num_docs"))
    return scored.select("id", "query", gold.alias("gold"), pred.alias("pred"), F.coalesce(pred == gold, F.lit(False)).alias("correct"), named.alias("labels"), "probs", ids.alias("selected_doc_ids"), "num_docs", "evidence_chars", how.alias("method"))


def run_method(selection: DataFrame, default: str = "selection", no_evidence: bool = False) -> DataFrame:
    """One row: the single method of the rows (else ``default``) and whether any row is diagnostic."""
    if no_evidence:
        return selection.agg(F.lit("no_evidence").alias("method"), F.lit(False).alias("diagnostic_only"))
    flag = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False)) if c in selection.columns else F.lit(False)
    # Two extremes tell whether there is one method, whatever their number.
    low, high = F.min("method"), F.max("method")
    return selection.agg(F.when(low == high, low).otherwise(default).alias("method"), F.coalesce(F.bool_or(flag("diagnostic_only", True) | flag("deployable", False)), F.lit(False)).alias("diagnostic_only"))


def _filled(preds: DataFrame) -> DataFrame:
    """Predictions read back may lack the evidence figures: 0."""
    for c in ("num_docs", "evidence_chars"):
        preds = preds.withColumn(c, F.coalesce(c, F.lit(0)) if c in preds.columns else F.lit(0))
    return preds if "probs" in preds.columns else preds.withColumn("probs", F.lit(None).cast("array<double>"))


def summary(preds: DataFrame) -> DataFrame:
    """One row of totals; rows without a prediction count in the denominator."""
    rows = _filled(preds)
    odd = F.exists("probs", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.count_if(F.col("pred") == F.col("gold")).alias("num_correct"),
        F.coalesce(F.count_if(F.col("pred") == F.col("gold")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg("num_docs"), F.lit(0.0)).alias("avg_num_docs"),
        F.coalesce(F.median("num_docs"), F.lit(0.0)).alias("median_num_docs"),
        F.coalesce(F.min("num_docs"), F.lit(0)).alias("min_num_docs"),
        F.coalesce(F.max("num_docs"), F.lit(0)).alias("max_num_docs"),
        F.coalesce(F.avg("evidence_chars"), F.lit(0.0)).alias("avg_evidence_chars"),
        F.count_if(F.coalesce(odd, F.lit(False))).alias("num_non_finite"),
        F.count_if(F.col("pred").isNull()).alias("num_missing"),
    )


def label_table(preds: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``label``: the configured ones, else all gold and predicted values of predicted rows."""
    if labels is not None:
        return preds.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    rows = preds.where("pred is not null")
    return rows.select(F.col("gold").alias("label")).union(rows.select("pred")).where("label is not null").distinct()


def per_class(preds: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """label, num_examples, num_correct, accuracy; labels without rows are 0."""
    counts = preds.where("gold is not null and pred is not null").groupBy(F.col("gold").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("c"))
    rows = label_table(preds, labels).join(counts, "label", "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0))
    return rows.select("label", n.alias("num_examples"), c.alias("num_correct"), F.when(n > 0, c / n).otherwise(0.0).alias("accuracy"))


def confusion(preds: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """gold, pred, n over the grid of labels; predictions outside it are in no cell."""
    names = label_table(preds, labels)
    grid = names.select(F.col("label").alias("gold")).crossJoin(names.select(F.col("label").alias("pred")))
    counts = preds.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("k"))
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("k", F.lit(0)).alias("n"))


def prediction_distribution(preds: DataFrame, labels: list[str] | None = None) -> DataFrame:
    counts = preds.groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("k"))
    return label_table(preds, labels).join(counts, "label", "left").select("label", F.coalesce("k", F.lit(0)).alias("n"))


def num_docs_histogram(preds: DataFrame) -> DataFrame:
    return _filled(preds).groupBy("num_docs").agg(F.count(F.lit(1)).alias("n"))


def metrics_document(preds: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """All metrics as one nested row; the predictions are written once and read for each part."""
    preds = written(preds)
    entries = lambda df, key, value: df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))))
    one = per_class(preds, labels).select("label", F.struct("num_examples", "num_correct", "accuracy").alias("v"))
    cells = confusion(preds, labels).groupBy("gold").agg(F.map_from_entries(F.collect_list(F.struct("pred", "n"))).alias("v"))
    histogram = num_docs_histogram(preds).select(F.col("num_docs").cast("string").alias("k"), "n")
    out = summary(preds).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    for name, df in (("per_class", entries(one, "label", "v")), ("confusion_matrix", entries(cells, "gold", "v")), ("prediction_distribution", entries(prediction_distribution(preds, labels), "label", "n")), ("num_docs_histogram", entries(histogram, "k", "n"))):
        out = out.crossJoin(df.toDF(name))
    return out


def method_table(runs: DataFrame) -> DataFrame:
    """``runs`` (method, seed, accuracy) -> method, runs, mean_accuracy, std_accuracy."""
    return runs.groupBy("method").agg(F.count(F.lit(1)).alias("runs"), F.avg("accuracy").alias("mean_accuracy"), F.stddev("accuracy").alias("std_accuracy"))
