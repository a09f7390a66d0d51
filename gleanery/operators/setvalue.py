"""Set value of evidence and its greedy trajectory.

With local effects X and direction d, Theta(S) = d'd - lambda d' A^-1 d where
A = lambda I + sum of x x' over S; adding x gains
lambda (d' A^-1 x)^2 / (1 + x' A^-1 x).  A is labels x labels, so all rows of a
batch advance together, a step at a time: one stacked product gives the gains of
all their candidates and one rank-1 update moves all their A^-1.  For lambda below
DIRECT_BELOW the identity loses digits, and Theta is solved for directly.

Only directions and effects go to Python, and choices and gains come back; ids and
texts stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lists
from ..functions.vectors import dot, minus, norm, one_hot, smooth_clip, smooth_mixture

SCHEMA_VERSION = "teacher.v2"
DIRECT_BELOW = 1e-6
SMOOTHINGS = ("paper_mixture", "legacy_clip_all")


def local_metric(name: str) -> str:
    """The one metric there is, under its aliases."""
    if name in ("identity", "euclidean", "euclidean_posterior_shift"):
        return "euclidean_posterior_shift"
    raise ValueError(f"local metric {name!r} is not available")


def with_effects(posteriors: DataFrame, eps: float = 0.001, smoothing: str = "paper_mixture") -> DataFrame:
    """Add ``direction`` and, to each candidate, x, alignment and norm_x."""
    if smoothing not in SMOOTHINGS:
        raise ValueError(f"unknown smoothing {smoothing!r}")
    target = one_hot(F.col("label"), F.col("labels"))
    if smoothing == "paper_mixture":
        base, target, own = smooth_mixture(F.col("eta0"), eps), smooth_mixture(target, eps), lambda e: e
    else:
        base, own = smooth_clip(F.col("eta0"), eps), lambda e: smooth_clip(e, eps)
    rows = posteriors.withColumn("_base", base).withColumn("direction", minus(target, F.col("_base")))
    fields = [f.name for f in posteriors.schema["candidates"].dataType.elementType.fields]
    shifted = F.transform("candidates", lambda c: F.struct(*(c[n].alias(n) for n in fields), minus(own(c["eta"]), F.col("_base")).alias("x")))
    full = F.transform("candidates", lambda c: F.struct(*(c[n].alias(n) for n in [*fields, "x"]), dot(c["x"], F.col("direction")).alias("alignment"), norm(c["x"]).alias("norm_x")))
    return rows.withColumn("candidates", shifted).withColumn("candidates", full).drop("_base")


def first_step_gain(x: Column, direction: Column, ridge: float) -> Column:
    """Gain of a document alone."""
    return dot(x, direction) * dot(x, direction) / (dot(x, x) + ridge)


def set_value(x: np.ndarray, d: np.ndarray, chosen: list[int], ridge: float) -> float:
    """Theta of the rows ``chosen`` of x, by a direct solve."""
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    if not chosen:
        return 0.0
    own = x[chosen]
    c = own @ d
    return float(c @ np.linalg.solve(own @ own.T + ridge * np.eye(len(chosen)), c))


def marginal_gain(x: np.ndarray, d: np.ndarray, chosen: list[int], one: int, ridge: float) -> float:
    """What row ``one`` of x adds to the rows ``chosen``; a chosen row is an error."""
    if one in chosen:
        raise ValueError(f"document {one} is selected already")
    return set_value(x, d, [*chosen, one], ridge) - set_value(x, d, chosen, ridge)


REASONS = ("top_m_reached", "no_candidates", "gain_below_threshold")


class Walk:
    """Greedy trajectories of many rows in lock step.

    ``x`` is rows x candidates x labels, ``d`` rows x labels, ``sizes`` the numbers of
    candidates.  picked: rows x steps; before: the value before each step; raw:
    rows x steps x candidates, NaN for those that are taken or not there; taken: steps
    of each row; reason: index into REASONS; stop_at, stop_gain: best candidate and
    gain of the step that ended a row below the threshold.
    """

    def __init__(self, x: np.ndarray, d: np.ndarray, sizes: np.ndarray, top_m: int, ridge: float, stop_below: float = 0.0, tolerance: float = 1e-10):
        if top_m < 0 or ridge <= 0 or tolerance < 0:
            raise ValueError("top_m and tolerance must not be negative, ridge must be positive")
        rows, n, k = x.shape
        steps = min(top_m, n)
        self.picked = np.zeros((rows, steps), np.int64)
        self.before, self.best_raw = np.zeros((rows, steps)), np.zeros((rows, steps))
        self.raw = np.full((rows, steps, n), np.nan)
        self.value = np.zeros(rows)
        self.taken = np.zeros(rows, np.int64)
        self.stop_at, self.stop_gain = np.full(rows, -1), np.zeros(rows)
        free = np.arange(n) < sizes[:, None]
        inverse = np.broadcast_to(np.eye(k) / ridge, (rows, k, k)).copy()
        for step in range(steps):
            own = np.flatnonzero((self.stop_at < 0) & (sizes > step))
            if not len(own):
                break
            raw = self._direct(x[own], d[own], self.picked[own, :step], ridge) - self.value[own, None] if ridge < DIRECT_BELOW else self._gains(x[own], d[own], inverse[own], ridge)
            if (raw < -tolerance)[free[own]].any():
                raise ValueError("a gain is negative beyond the tolerance")
            raw = np.where(free[own], raw, np.nan)
            gain = np.where(free[own], np.where(np.abs(raw) <= tolerance, 0.0, raw), -np.inf)
            best = gain.argmax(axis=1)
            at = np.arange(len(own))
            stops = gain[at, best] < stop_below
            self.stop_at[own[stops]], self.stop_gain[own[stops]] = best[stops], gain[at, best][stops]
            raw, best, own = raw[~stops], best[~stops], own[~stops]
            at = np.arange(len(own))
            self.picked[own, step], self.raw[own, step] = best, raw
            self.before[own, step], self.best_raw[own, step] = self.value[own], raw[at, best]
            self.value[own] += raw[at, best]
            self.taken[own] += 1
            free[own, best] = False
            chosen = x[own, best]
            pull = np.einsum("rkl,rl->rk", inverse[own], chosen)
            inverse[own] -= pull[:, :, None] * pull[:, None, :] / (1 + (pull * chosen).sum(axis=1))[:, None, None]
        self.reason = np.where(self.stop_at >= 0, 2, np.where((sizes > 0) & (self.taken >= top_m), 0, 1))

    @staticmethod
    def _gains(x: np.ndarray, d: np.ndarray, inverse: np.ndarray, ridge: float) -> np.ndarray:
        pull = x @ inverse
        return ridge * np.einsum("rnk,rk->rn", pull, d) ** 2 / (1 + (pull * x).sum(axis=2))

    @staticmethod
    def _direct(x: np.ndarray, d: np.ndarray, chosen: np.ndarray, ridge: float) -> np.ndarray:
        """Theta of the chosen rows of x and each further one."""
        rows, n, k = x.shape
        have = np.take_along_axis(x, chosen[:, :, None], axis=1)
        sets = np.concatenate([np.broadcast_to(have[:, None], (rows, n, have.shape[1], k)), x[:, :, None]], axis=2)
        c = np.einsum("rnsk,rk->rns", sets, d)
        gram = sets @ sets.swapaxes(2, 3) + ridge * np.eye(sets.shape[2])
        return (c * np.linalg.solve(gram, c[..., None])[..., 0]).sum(axis=2)


def greedy(x: np.ndarray, d: np.ndarray, top_m: int, ridge: float, stop_below: float = 0.0, tolerance: float = 1e-10) -> tuple[list[dict], str, dict | None]:
    """Steps, stop reason and the decision that ended the run, for one row."""
    x = np.asarray(x, float).reshape(len(x), len(d))
    w = Walk(x[None], np.asarray(d, float)[None], np.array([len(x)]), top_m, ridge, stop_below, tolerance)
    clean = lambda v: 0.0 if abs(v) <= tolerance else float(v)
    steps = []
    for i in range(int(w.taken[0])):
        raw, before = float(w.best_raw[0, i]), float(w.before[0, i])
        gains = [(j, clean(v), float(v)) for j, v in enumerate(w.raw[0, i]) if not np.isnan(v)]
        steps.append({"step": i, "current": w.picked[0, :i].tolist(), "before": before, "best": int(w.picked[0, i]), "gain": clean(raw), "raw": raw, "after": before + raw, "gains": gains})
    stop = {"step": len(steps), "selected": False, "best_index": int(w.stop_at[0]), "best_gain": float(w.stop_gain[0]), "threshold": float(stop_below)} if w.stop_at[0] >= 0 else None
    return steps, REASONS[w.reason[0]], stop


_WALK = "picked array<int>, before array<double>, best_raw array<double>, raw array<array<double>>, value double, reason string, stop_at int, stop_gain double"
_GAIN = "doc_id string, index int, rank int, retrieval_score double, gain double, raw_gain double, theta_after_add double"


def _walks(top_m: int, ridge: float, stop_below: float, tolerance: float, all_gains: bool):
    """(direction, effects of all candidates) -> struct of _WALK."""

    def made(d: pa.Array, x: pa.Array) -> pa.Array:
        sizes = lists.lengths(x)
        direction = lists.padded(d)
        effects = lists.padded_vectors(x, direction.shape[1])
        wide = np.zeros((len(direction), effects.shape[2]))  # a label that a row lacks has no effect
        wide[:, : direction.shape[1]] = direction
        w = Walk(effects, wide, sizes, top_m, ridge, stop_below, tolerance)
        row, step = lists.places(w.taken)
        every = w.raw[row, step] if all_gains else np.zeros((len(row), 0))
        gains = lists.as_lists(lists.ragged(every, sizes[row] if all_gains else np.zeros(len(row), np.int64), pa.float64()), w.taken)
        stopped = w.stop_at >= 0
        fields = {
            "picked": lists.ragged(w.picked, w.taken, pa.int32()),
            "before": lists.ragged(w.before, w.taken, pa.float64()),
            "best_raw": lists.ragged(w.best_raw, w.taken, pa.float64()),
            "raw": gains,
            "value": pa.array(w.value),
            "reason": pa.array([REASONS[i] for i in w.reason], pa.string()),
            "stop_at": pa.array(w.stop_at, pa.int32(), mask=~stopped),
            "stop_gain": pa.array(w.stop_gain, pa.float64(), mask=~stopped),
        }
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    def run(d: pa.Array, x: pa.Array) -> pa.Array:
        return pa.concat_arrays([made(d.slice(i, lists.ROWS), x.slice(i, lists.ROWS)) for i in range(0, max(len(d), 1), lists.ROWS)])

    return F.arrow_udf(run, T.StructType.fromDDL(_WALK))


def greedy_teacher(posteriors: DataFrame, top_m: int = 4, ridge: float = 0.01, eps: float = 0.001, stop_below: float = 0.0, tolerance: float = 1e-10, smoothing: str = "paper_mixture", store_all_gains: bool = True, metric: str = "identity") -> DataFrame:
    """Teacher rows: the greedy trajectory of each posterior row; no shuffle."""
    local_metric(metric)
    if top_m < 0 or ridge <= 0 or tolerance < 0:
        raise ValueError("top_m and tolerance must not be negative, ridge must be positive")
    rows = with_effects(posteriors, eps, smoothing)
    walked = rows.withColumn("_w", _walks(top_m, ridge, stop_below, tolerance, store_all_gains)("direction", F.transform("candidates", lambda c: c["x"])))
    doc = lambda j: F.col("candidates")[j]["doc_id"].cast("string")
    clean = lambda v: F.when(F.abs(v) <= tolerance, F.lit(0.0)).otherwise(v)

    def gains(i):
        value = lambda c, j: F.struct(c["doc_id"].cast("string").alias("doc_id"), j.alias("index"), c["rank"].cast("int").alias("rank"), c["retrieval_score"].cast("double").alias("retrieval_score"), clean(F.col("_w.raw")[i][j]).alias("gain"), F.col("_w.raw")[i][j].alias("raw_gain"), (F.col("_w.before")[i] + F.col("_w.raw")[i][j]).alias("theta_after_add"))
        return F.filter(F.transform("candidates", value), lambda g: ~F.isnan(g["raw_gain"])) if store_all_gains else F.array().cast(f"array<struct<{_GAIN}>>")

    def step(best, i):
        current = F.slice("_w.picked", F.lit(1), i)
        raw = F.col("_w.best_raw")[i]
        return F.struct(
            i.alias("step"),
            F.transform(current, doc).alias("current_doc_ids"),
            current.alias("current_indices"),
            F.col("_w.before")[i].alias("theta_before"),
            doc(best).alias("best_doc_id"),
            best.alias("best_index"),
            clean(raw).alias("best_gain"),
            raw.alias("raw_best_gain"),
            (F.col("_w.before")[i] + raw).alias("theta_after"),
            F.struct(F.lit(True).alias("selected"), F.lit(None).cast("string").alias("reason")).alias("stop_decision"),
            gains(i).alias("candidate_gains"),
        )

    stop = F.struct(F.size("_w.picked").alias("step"), F.lit(False).alias("selected"), F.col("_w.stop_at").alias("best_index"), F.col("_w.stop_gain").alias("best_gain"), F.lit(float(stop_below)).alias("threshold"))
    return walked.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        *(c for c in rows.columns if c != "schema_version"),
        F.col("_w.value").alias("theta_final"),
        F.transform("_w.picked", doc).alias("teacher_selected_doc_ids"),
        F.col("_w.picked").alias("teacher_selected_indices"),
        F.col("_w.reason").alias("stop_reason"),
        F.when(F.col("_w.stop_at").isNotNull(), stop).alias("terminal_stop_decision"),
        F.transform("_w.picked", step).alias("steps"),
        F.lit(0.0).alias("theta_empty"),
        F.lit(float(ridge)).alias("ridge_lambda"),
        F.lit(float(eps)).alias("eps_smooth"),
        F.lit(int(top_m)).alias("top_m"),
        F.lit(float(stop_below)).alias("stop_threshold"),
        F.lit(smoothing).alias("smoothing"),
    )


def teacher_steps(teacher: DataFrame) -> DataFrame:
    """Long form: one row for each (id, step)."""
    return teacher.select("id", F.explode("steps").alias("s")).select("id", "s.step", "s.best_doc_id", "s.best_index", "s.best_gain", "s.theta_before", "s.theta_after")


def label_gain(posteriors: DataFrame) -> DataFrame:
    """id, doc_id, gain: how much a document alone raises its gold label's probability."""
    at = F.array_position("labels", F.col("label")).cast("int")
    rows = posteriors.select("id", F.element_at("eta0", at).alias("base"), at.alias("at"), F.explode("candidates").alias("c"))
    return rows.select("id", F.col("c.doc_id").alias("doc_id"), (F.element_at("c.eta", F.col("at")) - F.col("base")).alias("gain"))
