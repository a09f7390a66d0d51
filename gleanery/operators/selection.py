"""Selecting evidence: the naive top, a scoring model's greedy choice, the teacher's oracle.

A model's choice advances all rows of a batch together: in each step one call of the
scorer gets all candidates that are left in all rows.  Only what the scorer needs
goes to Python, and only places and scores come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lists
from ..functions.prompts import MAX_SELECTED, selector_head, selector_history
from ..functions.text import titled

DOC = "doc_id string, title string, text string, rank int, retrieval_score double, selector_score double, selection_step int"
TOP = "doc_id string, score double"
STEP = f"step int, selected_doc_id string, predicted_score double, remaining_count int, stop boolean, stop_reason string, top_candidates array<struct<{TOP}>>"
ORACLE_NOTE = "oracle uses gold labels and is diagnostic only"


def _score_of(candidate: Column, fields: list[str]) -> Column:
    found = [candidate[n].cast("double") for n in ("retrieval_score", "score") if n in fields]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def normal_doc(candidate: Column, fields: list[str], score: Column, step: Column) -> Column:
    """A selected document in the common shape."""
    return F.struct(
        candidate["doc_id"].cast("string").alias("doc_id"),
        candidate["title"].alias("title"),
        candidate["text"].alias("text"),
        candidate["rank"].cast("int").alias("rank"),
        _score_of(candidate, fields).alias("retrieval_score"),
        score.cast("double").alias("selector_score"),
        step.cast("int").alias("selection_step"),
    )


def selection_row(df: DataFrame, method: str, docs: Column, steps: Column, reason: Column, diagnostic: bool = False) -> DataFrame:
    """The uniform selection table of every method."""
    label = F.coalesce(*(F.col(c) for c in ("label", "gold") if c in df.columns))
    rows = df.withColumn("_docs", docs).withColumn("_steps", steps)
    return rows.select(
        "id",
        "query",
        label.alias("label"),
        label.alias("gold"),
        "split",
        F.lit(method).alias("method"),
        F.transform("_docs", lambda d: d["doc_id"]).alias("selected_doc_ids"),
        F.col("_docs").alias("selected_docs"),
        F.size("_docs").alias("num_docs"),
        F.col("_steps").alias("selection_steps"),
        reason.alias("stop_reason"),
        F.lit(diagnostic).alias("diagnostic_only"),
        F.lit(not diagnostic).alias("deployable"),
    )


def _plain_steps(docs: Column, pool: Column) -> Column:
    null = F.lit(None)
    return F.transform(docs, lambda d, i: F.struct(i.alias("step"), d["doc_id"].alias("selected_doc_id"), null.cast("double").alias("predicted_score"), F.greatest(pool - i, F.lit(0)).cast("int").alias("remaining_count"), F.lit(False).alias("stop"), null.cast("string").alias("stop_reason"), null.cast(f"array<struct<{TOP}>>").alias("top_candidates")))


def _fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema["candidates"].dataType.elementType.fields]


def select_naive(retrieval: DataFrame, top_m: int, method: str = "naive_topm") -> DataFrame:
    """The first ``top_m`` candidates."""
    if top_m < 0:
        raise ValueError("top_m must not be negative")
    fields = _fields(retrieval)
    docs = F.transform(F.slice("candidates", 1, top_m), lambda c, i: normal_doc(c, fields, F.lit(None), i))
    rows = retrieval.withColumn("_own", docs)
    reason = F.when(F.size("_own") >= top_m, "top_m_reached").otherwise("no_candidates")
    return selection_row(rows, method, F.col("_own"), _plain_steps(F.col("_own"), F.size("candidates")), reason)


def select_oracle(teacher: DataFrame, source: DataFrame | None = None, top_m: int | None = None, method: str = "oracle") -> DataFrame:
    """The teacher's own choice, for diagnosis only.

    Documents come from the ``source`` row of the same id where there is one, else
    from the teacher's candidates; one that is missing is an error.
    """
    if top_m is not None and top_m < 0:
        raise ValueError("top_m must not be negative")
    shape = lambda c, fields: F.struct(c["doc_id"].cast("string").alias("doc_id"), c["title"].alias("title"), c["text"].alias("text"), c["rank"].cast("int").alias("rank"), _score_of(c, fields).alias("retrieval_score"))
    own_fields = _fields(teacher)
    rows = teacher.withColumn("_pool", F.transform("candidates", lambda c: shape(c, own_fields)))
    if source is not None:
        fields = _fields(source)
        rows = rows.join(source.select("id", F.transform("candidates", lambda c: shape(c, fields)).alias("_source")), "id", "left").withColumn("_pool", F.coalesce("_source", "_pool")).drop("_source")
    ids = F.transform("teacher_selected_doc_ids", lambda x: x.cast("string"))
    rows = rows.withColumn("_ids", ids if top_m is None else F.slice(ids, 1, top_m))
    chosen = F.transform("_ids", lambda d: F.try_element_at(F.filter("_pool", lambda c: c["doc_id"] == d), F.lit(-1)))
    missing = F.filter("_ids", lambda d: ~F.exists("_pool", lambda c: c["doc_id"] == d))
    rows = rows.withColumn("_found", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("selected document not found: "), F.array_join(missing, ", ")))).otherwise(chosen))
    docs = F.transform("_found", lambda c, i: normal_doc(c, ["retrieval_score"], F.lit(None), i))
    rows = rows.withColumn("_own", docs)
    pool = F.size(F.array_distinct(F.transform("_pool", lambda c: c["doc_id"])))
    reason = F.coalesce("stop_reason", F.lit("teacher_trajectory_complete")) if "stop_reason" in teacher.columns else F.lit("teacher_trajectory_complete")
    return selection_row(rows, method, F.col("_own"), _plain_steps(F.col("_own"), pool), reason, True).withColumn("oracle_note", F.lit(ORACLE_NOTE))


def selection_violations(selection: DataFrame) -> DataFrame:
    """Rows whose count or ids don't agree with their documents."""
    return selection.where((F.col("num_docs") != F.size("selected_docs")) | ~F.col("selected_doc_ids").eqNullSafe(F.transform("selected_docs", lambda d: d["doc_id"].cast("string")))).select("id", "method", "num_docs")


def feature_matrix(eta0: np.ndarray, eta: np.ndarray, inverse_rank: np.ndarray, score: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Features of all candidates of many rows in one step, as ``training.candidate_features`` defines them.

    ``eta0`` is rows x labels, ``eta`` rows x candidates x labels, ``inverse_rank`` and
    ``score`` rows x candidates, ``chosen`` rows x documents chosen before the step.
    """
    rows, n, k = eta.shape
    step = chosen.shape[1]
    shift = eta - eta0[:, None]
    entropy = lambda p: -(np.clip(p, 1e-12, 1) * np.log(np.clip(p, 1e-12, 1))).sum(axis=-1)

    def cosine(a, b):
        size = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
        return np.where(size <= 1e-12, 0.0, (a * b).sum(axis=-1) / np.maximum(size, 1e-300))

    mean, closest, to_mean = np.zeros((rows, k)), np.zeros((rows, n)), np.zeros((rows, n))
    if step:
        own = np.take_along_axis(shift, chosen[:, :, None], axis=1)
        mean = own.mean(axis=1)
        closest = cosine(shift[:, :, None], own[:, None]).max(axis=2)
        to_mean = cosine(shift, mean[:, None])
    wide = lambda v: np.broadcast_to(v[:, None], (rows, n, k))
    same = lambda v: np.broadcast_to(np.asarray(v, float), (rows, n))
    h0, h = entropy(eta0)[:, None], entropy(eta)
    middle = np.stack([same(h0), h, h0 - h, np.linalg.norm(shift, axis=2), inverse_rank, score, same(step), same(step)], axis=2)
    return np.concatenate([wide(eta0), eta, shift, np.abs(shift), middle, wide(mean), closest[..., None], to_mean[..., None]], axis=2)


def linear_scorer(weights: list[float], shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of a fitted linear model (see ``training.fit_selector``)."""
    w = np.array(weights, float)
    return lambda features: features @ w + shift


def network_scorer(layers: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of a fitted network (see ``training.fit_network``): its layers' matrices and shifts, ReLU between them."""

    def score(features: np.ndarray) -> np.ndarray:
        for w, b in layers[:-1]:
            features = np.maximum(features @ w + b, 0.0)
        return (features @ layers[-1][0] + layers[-1][1])[:, 0]

    return score


SHOWN = 5
_CHOICE = "picked array<int>, scores array<double>, left array<int>, best array<double>, tops array<array<int>>, top_scores array<array<double>>"


def _greedy_choice(codes: np.ndarray, rank: np.ndarray, sizes: np.ndarray, scored: Callable, top_m: int, min_docs: int, threshold: float | None) -> pa.Array:
    """Choices (struct of _CHOICE) of many rows in lock step.

    ``codes`` (rows x candidates) tells documents apart: a chosen one leaves with all
    its repeats.  ``scored(rows, free, chosen)`` scores the free candidates of those
    rows, in order, given the places chosen before.
    """
    rows, n = codes.shape
    steps = min(top_m, n)
    picked, scores, best = np.zeros((rows, steps), np.int64), np.zeros((rows, steps)), np.zeros((rows, steps))
    left, shown = np.zeros((rows, steps), np.int64), np.zeros((rows, steps), np.int64)
    tops, top_scores = np.zeros((rows, steps, SHOWN), np.int64), np.zeros((rows, steps, SHOWN))
    taken, told = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    free = np.arange(n) < sizes[:, None]
    going = np.ones(rows, bool)
    for step in range(steps):
        own = np.flatnonzero(going & (sizes > step) & free.any(axis=1))
        if not len(own):
            break
        value = np.full((len(own), n), -np.inf)
        value[free[own]] = np.asarray(scored(own, free[own], picked[own, :step]), float)
        # Best score, then lowest rank, then first place.
        order = np.lexsort((np.broadcast_to(np.arange(n), value.shape), np.where(free[own], rank[own], np.inf), -value), axis=1)
        first, at = order[:, 0], np.arange(len(own))
        left[own, step] = free[own].sum(axis=1)
        best[own, step] = value[at, first]
        listed = np.argsort(-value, axis=1, kind="stable")[:, :SHOWN]
        tops[own, step, : listed.shape[1]], top_scores[own, step, : listed.shape[1]] = listed, np.take_along_axis(value, listed, axis=1)
        shown[own, step] = np.minimum(left[own, step], SHOWN)
        told[own] += 1
        stops = np.zeros(len(own), bool) if threshold is None else (taken[own] >= min_docs) & (value[at, first] < threshold)
        going[own[stops]] = False
        own, first = own[~stops], first[~stops]
        picked[own, step], scores[own, step] = first, best[own, step]
        taken[own] += 1
        free[own] &= codes[own] != codes[own, first][:, None]
    row, step = lists.places(told)
    inner = lambda v, kind: lists.as_lists(lists.ragged(v[row, step], shown[row, step], kind), told)
    fields = {"picked": lists.ragged(picked, taken, pa.int32()), "scores": lists.ragged(scores, taken, pa.float64()), "left": lists.ragged(left, told, pa.int32()), "best": lists.ragged(best, told, pa.float64()), "tops": inner(tops, pa.int32()), "top_scores": inner(top_scores, pa.float64())}
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def _padded_codes(ids: pa.Array) -> np.ndarray:
    sizes = lists.lengths(ids)
    out = np.full((len(sizes), int(sizes.max(initial=0))), -1)
    out[lists.places(sizes)] = ids.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return out


def _chosen(rows: DataFrame, method: str, choose: Callable, inputs: list[Column], top_m: int) -> DataFrame:
    """The selection table of ``choose``, an iterator of Arrow batches of ``inputs`` to structs of _CHOICE."""
    fields = _fields(rows)
    done = rows.withColumn("_c", F.arrow_udf(choose, T.StructType.fromDDL(_CHOICE))(*inputs))
    doc = lambda j: F.col("candidates")[j]
    docs = F.transform("_c.picked", lambda j, i: normal_doc(doc(j), fields, F.col("_c.scores")[i], i))

    def step(n, i):
        stop = i >= F.size("_c.picked")
        tops = F.transform(F.col("_c.tops")[i], lambda j, k: F.struct(doc(j)["doc_id"].cast("string").alias("doc_id"), F.col("_c.top_scores")[i][k].alias("score")))
        return F.struct(i.alias("step"), F.when(~stop, doc(F.try_element_at("_c.picked", i + 1))["doc_id"].cast("string")).alias("selected_doc_id"), F.col("_c.best")[i].alias("predicted_score"), n.alias("remaining_count"), stop.alias("stop"), F.when(stop, "score_below_threshold").alias("stop_reason"), tops.alias("top_candidates"))

    stopped = F.size("_c.left") > F.size("_c.picked")
    reason = F.when(stopped, "score_below_threshold").when(F.size("_c.picked") >= top_m, "top_m_reached").otherwise("no_candidates")
    return selection_row(done, method, docs, F.transform("_c.left", step), reason)


def _limited(posteriors: DataFrame, max_candidates: int | None) -> DataFrame:
    if max_candidates is None:
        return posteriors
    if max_candidates < 0:
        raise ValueError("max_candidates must not be negative")
    return posteriors.withColumn("candidates", F.slice("candidates", 1, max_candidates))


def _in_slices(arrays: tuple, make: Callable) -> pa.Array:
    return pa.concat_arrays([make(*(a.slice(i, lists.ROWS) for a in arrays)) for i in range(0, max(len(arrays[0]), 1), lists.ROWS)])


def select_with_model(posteriors: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], top_m: int = 4, min_docs: int = 1, threshold: float | None = None, max_candidates: int | None = None, method: str = "feature_selector") -> DataFrame:
    """Greedy choice by a scoring model over candidate features (rows x features -> scores).

    Best score wins, then lowest rank (none counts as 0), then first place.
    A step stops the row once ``min_docs`` are chosen and the best score lies
    below ``threshold``.
    """
    top_m, min_docs = max(top_m, 0), max(min_docs, 0)
    rows = _limited(posteriors, max_candidates)
    fields = _fields(rows)
    pick = lambda f: F.transform("candidates", f)
    inputs = [F.col("eta0"), pick(lambda c: c["doc_id"].cast("string")), pick(lambda c: c["rank"].cast("double")), pick(lambda c: _score_of(c, fields)), pick(lambda c: c["eta"])]

    def choose(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = make_scorer()

        def made(eta0, ids, rank, score, eta):
            sizes = lists.lengths(ids)
            base, rank, score = lists.padded(eta0), lists.padded(rank), lists.padded(score)
            etas = lists.padded_vectors(eta, base.shape[1])
            inverse = np.where(rank > 0, 1 / np.maximum(rank, 1), 0.0)
            scored = lambda own, free, chosen: scorer(feature_matrix(base[own], etas[own], inverse[own], score[own], chosen)[free])
            return _greedy_choice(_padded_codes(ids), rank, sizes, scored, top_m, min_docs, threshold)

        for batch in batches:
            yield _in_slices(batch, made)

    return _chosen(rows, method, choose, inputs, top_m)


def select_with_text_model(posteriors: DataFrame, make_scorer: Callable[[], Callable[[list[str]], np.ndarray]], top_m: int = 4, min_docs: int = 1, threshold: float | None = None, max_candidates: int | None = None, batch_size: int = 64, method: str = "text_selector") -> DataFrame:
    """Greedy choice by a scoring model that reads the state-aware input (texts -> scores).

    In each step the inputs of all candidates left in all rows of a batch are
    rendered and scored ``batch_size`` at a time.  Ties and stops as in ``select_with_model``.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    top_m, min_docs = max(top_m, 0), max(min_docs, 0)
    rows = _limited(posteriors, max_candidates)
    # Of a selected document no more than the whole history's length is ever shown.
    item = lambda c: F.substring(titled(c["title"], c["text"]), 1, MAX_SELECTED)
    pick = lambda f: F.transform("candidates", f)
    inputs = [pick(lambda c: selector_head(F.col("query"), c)), pick(item), pick(lambda c: c["doc_id"].cast("string")), pick(lambda c: c["rank"].cast("double"))]

    def choose(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = make_scorer()

        def made(heads, items, ids, rank):
            sizes = lists.lengths(ids)
            head, shown = heads.to_pylist(), items.to_pylist()

            def scored(own, free, chosen):
                texts = []
                for r, left, before in zip(own.tolist(), free, chosen.tolist(), strict=True):
                    history = selector_history([shown[r][j] for j in before])
                    texts += [head[r][j] + history for j in np.flatnonzero(left).tolist()]
                out = [np.asarray(scorer(texts[i : i + batch_size]), float).reshape(-1) for i in range(0, len(texts), batch_size)]
                values = np.concatenate(out)
                if len(values) != len(texts):
                    raise ValueError("the scorer gives another number of scores than it got texts")
                return values

            return _greedy_choice(_padded_codes(ids), lists.padded(rank), sizes, scored, top_m, min_docs, threshold)

        for batch in batches:
            yield _in_slices(batch, made)

    return _chosen(rows, method, choose, inputs, top_m)


def rank_overlap(selection: DataFrame) -> DataFrame:
    """method, rank, n: how often each retrieval rank was selected."""
    return selection.select("method", F.explode("selected_docs").alias("d")).groupBy("method", F.col("d.rank").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def selection_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, shared, only_left, only_right of two selections."""
    a, b = left.select("id", F.col("selected_doc_ids").alias("a")), right.select("id", F.col("selected_doc_ids").alias("b"))
    return a.join(b, "id").select("id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("only_left"), F.size(F.array_except("b", "a")).alias("only_right"))
