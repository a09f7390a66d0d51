"""Claims: label mapping, dense ids, grouping of flat evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tolerant_int
from ..sources.jsonl import dense_index

BUCKET = 100_000


def convert_label(raw: Column, label_map: dict[str, str], drop: list[str]) -> Column:
    """Dropped and unknown labels are null; dropping wins."""
    out = F.lit(None).cast("string")
    for k, v in label_map.items():
        out = F.when(raw == k, F.lit(v)).otherwise(out)
    return F.when(raw.isin(drop), F.lit(None)).otherwise(out) if drop else out


def classify(raw: DataFrame, split: str, label_map: dict[str, str], drop: list[str], limit: int | None = None) -> DataFrame:
    """Add mapped label and status (kept, dropped, skipped) to raw claims.

    ``raw`` has ord, id, claim, label and may have ``keys``; without it every key
    counts as present.  ``limit`` counts raw rows.
    """
    if limit is not None:
        raw = raw.where(F.col("ord") <= limit)
    has = lambda k: F.array_contains("keys", k) if "keys" in raw.columns else F.lit(k in raw.columns)
    if "label" not in raw.columns:
        raw = raw.withColumn("label", F.lit(None).cast("string"))
    mapped = convert_label(F.col("label"), label_map, drop)
    lacking = ~has("claim") if split == "test" else ~has("claim") | ~has("label")
    dropped = F.col("label").isin(drop) if drop else F.lit(False)
    status = F.when(lacking, "skipped").when(F.col("label").isNull(), "kept").when(dropped, "dropped").when(mapped.isNull(), "skipped").otherwise("kept")
    return raw.withColumn("mapped", mapped).withColumn("status", status)


def prepare_claims(raw: DataFrame, dataset: str, split: str, label_map: dict[str, str], drop: list[str], limit: int | None = None) -> DataFrame:
    """Kept claims with ids ``dataset_split_00000001``, ... in the order of ``ord``."""
    kept = classify(raw, split, label_map, drop, limit).where("status = 'kept'")
    numbered = dense_index(kept, F.floor(F.col("ord") / BUCKET), ["ord"], "number")
    return numbered.select(
        F.format_string(f"{dataset}_{split}_%08d", "number").alias("id"),
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        F.col("claim").alias("query"),
        F.col("mapped").alias("label"),
        F.struct(F.lit("fever").alias("source"), F.col("id").alias("original_id"), F.col("label").alias("original_label")).alias("meta"),
    )


def prepare_splits(raws: dict[str, DataFrame], dataset: str, label_map: dict[str, str], drop: list[str]) -> DataFrame:
    """Kept claims of several splits in one table; each split has numbers of its own."""
    out = None
    for split, raw in raws.items():
        own = prepare_claims(raw, dataset, split, label_map, drop)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no splits")
    return out


def claim_stats(raw: DataFrame, split: str, label_map: dict[str, str], drop: list[str], limit: int | None = None) -> DataFrame:
    """One row: read, kept, dropped, skipped."""
    rows = classify(raw, split, label_map, drop, limit)
    return rows.agg(F.count(F.lit(1)).alias("read"), *(F.count_if(F.col("status") == s).alias(s) for s in ("kept", "dropped", "skipped")))


def claims_from_flat_evidence(flat: DataFrame, limit: int | None = None, no_evidence_label: str = "NOT ENOUGH INFO") -> DataFrame:
    """Group evidence rows by claim: first label and claim, distinct evidence in first-seen order.

    ``flat`` has ord and the columns id, label, claim, evidence_wiki_url,
    evidence_sentence_id, evidence_annotation_id, evidence_id.  With ``limit``,
    reading stops at the first row after that many claims have been seen.
    """
    none = F.lit(-1)
    number = lambda c: tolerant_int(F.col(c).cast("string"), none)
    rows = flat.select("ord", number("id").alias("id"), "label", "claim", F.col("evidence_wiki_url").alias("url"), number("evidence_sentence_id").alias("sent"), number("evidence_annotation_id").alias("ann"), number("evidence_id").alias("ev"))
    if limit is not None:
        if limit <= 0:
            rows = rows.limit(0)
        else:
            # At most ``limit`` first places are needed; the last one ends the reading.
            firsts = rows.groupBy("id").agg(F.min("ord").alias("first")).orderBy("first").limit(limit)
            last = firsts.agg(F.max("first").alias("last"))
            rows = rows.join(F.broadcast(last), F.col("ord") <= F.col("last")).drop("last")
    empty = (F.coalesce(F.col("label"), F.lit("")) == no_evidence_label) | (F.coalesce(F.col("url"), F.lit("")) == "") | (F.col("sent") < 0)
    rows = rows.withColumn("url", F.when(~empty, F.col("url"))).withColumn("sent", F.when(~empty, F.col("sent")))
    # One row for each distinct evidence first: a hot claim shrinks before its rows meet.
    distinct = rows.groupBy("id", "ann", "ev", "url", "sent").agg(F.min("ord").alias("seen"), F.min(F.struct("ord", "label", "claim")).alias("first"))
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("seen", F.struct(F.col("ann").alias("ann_id"), F.col("ev").alias("ev_id"), F.col("url").alias("wiki_url"), F.col("sent").alias("sent_id")).alias("item")))), lambda x: x["item"])
    grouped = distinct.groupBy("id").agg(F.min("first").alias("first"), evidence.alias("items"))
    return grouped.select("id", F.col("first.label").alias("label"), F.col("first.claim").alias("claim"), F.array("items").alias("evidence"), F.col("first.ord").alias("ord"))
