"""Listwise and multitask ranking losses of scored groups, by group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("id", "step")


def _check(scored: DataFrame) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return scored.withColumn("score", F.when(finite("score") & finite("gain"), F.col("score")).otherwise(F.raise_error(F.lit("scores and gains must be finite"))))


def _lse(top: Column, total: Column) -> Column:
    return top + F.log(total)


def listwise_loss(scored: DataFrame, temperature: float = 0.1) -> DataFrame:
    """id, step, loss: cross entropy of the scores' softmax against the gains' (at ``temperature``).

    ``scored`` has id, step, score, gain.  The peaks come first, so nothing overflows.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    rows = _check(scored)
    peaks = rows.groupBy(*KEYS).agg(F.max("score").alias("top"), F.max("gain").alias("best"))
    weight = F.exp((F.col("gain") - F.col("best")) / temperature)
    sums = rows.join(peaks, list(KEYS)).groupBy(*KEYS, "top").agg(F.sum(weight).alias("w"), F.sum(weight * F.col("score")).alias("ws"), F.sum(F.exp(F.col("score") - F.col("top"))).alias("z"))
    return sums.select(*KEYS, (_lse(F.col("top"), F.col("z")) - F.col("ws") / F.col("w")).alias("loss"))


def multitask_loss(scored: DataFrame, b_plus: float, b_minus: float, gamma: float = 1.0, beta: float = 0.5, neutral: str = "negative") -> DataFrame:
    """Per group: ce_loss, rank_loss, total, counts and whether the ranking part was valid.

    The double sum over negative and positive candidates factorises:
    lse(gamma (s_n - s_p)) = lse(gamma s_n) + lse(-gamma s_p); there is no pair join.
    """
    if not b_plus > b_minus > 0 or gamma <= 0 or not 0 <= beta <= 1 or neutral not in ("ignore", "negative"):
        raise ValueError("b_plus > b_minus > 0, gamma > 0, beta in [0, 1] and neutral ignore or negative are needed")
    kind = F.when(F.col("gain") > b_plus, "p").when(F.col("gain") < b_minus, "n").otherwise("o")
    rows = _check(scored).withColumn("kind", kind)
    of = lambda k, value: F.when(F.col("kind") == k, value)
    s = F.col("score")
    softplus = F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s)))
    ce = F.when(F.col("kind") == "p", softplus - s).when((F.col("kind") == "n") | F.lit(neutral == "negative"), softplus)
    peaks = rows.groupBy(*KEYS).agg(F.max(of("n", gamma * s)).alias("tn"), F.max(of("p", -gamma * s)).alias("tp"))
    sums = rows.join(peaks, list(KEYS)).groupBy(*KEYS, "tn", "tp").agg(
        F.coalesce(F.avg(ce), F.lit(0.0)).alias("ce_loss"),
        F.sum(of("n", F.exp(gamma * s - F.col("tn")))).alias("zn"),
        F.sum(of("p", F.exp(-gamma * s - F.col("tp")))).alias("zp"),
        *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("p", "num_positive"), ("n", "num_negative"), ("o", "num_neutral"))),
    )
    pairs = _lse(F.col("tn"), F.col("zn")) + _lse(F.col("tp"), F.col("zp"))
    rank = F.coalesce(F.greatest(pairs, F.lit(0.0)) + F.log1p(F.exp(-F.abs(pairs))), F.lit(0.0))
    rows = sums.withColumn("rank_loss", rank).withColumn("valid", (F.col("num_positive") > 0) & (F.col("num_negative") > 0))
    return rows.select(*KEYS, "ce_loss", "rank_loss", (beta * F.col("ce_loss") + (1 - beta) * F.col("rank_loss")).alias("total"), "num_positive", "num_negative", "num_neutral", "valid")


def loss_report(groups: DataFrame) -> DataFrame:
    """One row over all groups of ``multitask_loss``."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("total", "ce_loss", "rank_loss")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("num_positive", "num_negative", "num_neutral")),
        F.count_if("valid").alias("valid_groups"),
        F.count_if(~F.col("valid")).alias("skipped_groups"),
    )
