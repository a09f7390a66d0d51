"""Training rows, listwise groups and a fitted selector, from teacher trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import strip
from ..functions.vectors import cosine, entropy, minus, norm
from ..sources.jsonl import first_by_weight
from ..sources.tables import discard, written

BUCKET = 10_000


def feature_names(labels: list[str]) -> list[str]:
    """Names of the 5K+10 features in order."""
    per = [f"{kind}_{label}" for kind in ("eta0", "eta", "shift", "abs_shift") for label in labels]
    middle = ["entropy_eta0", "entropy_eta", "entropy_drop", "shift_norm", "inverse_rank", "retrieval_score", "step", "num_selected"]
    return [*per, *middle, *(f"mean_selected_shift_{label}" for label in labels), "max_cosine_to_selected", "cosine_to_mean_selected_shift"]


def candidate_features(eta0: Column, candidate: Column, selected: Column, n_selected: Column, step: Column) -> Column:
    """Feature array of a candidate in a state.

    ``selected`` holds the etas of the selected documents that are known,
    ``n_selected`` counts all selected ids.  Shifts use the unsmoothed eta0.
    """
    eta = candidate["eta"]
    shift = minus(eta, eta0)
    shifts = F.transform(selected, lambda e: minus(e, eta0))
    zero = F.transform(eta0, lambda v: F.lit(0.0))
    mean = F.when(F.size(shifts) > 0, F.transform(F.aggregate(shifts, zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y)), lambda v: v / F.size(shifts))).otherwise(zero)
    cosines = F.transform(shifts, lambda s: cosine(shift, s))
    rank = F.coalesce(candidate["rank"].cast("double"), F.lit(0.0))
    middle = F.array(
        entropy(eta0),
        entropy(eta),
        entropy(eta0) - entropy(eta),
        norm(shift),
        F.when(rank > 0, 1.0 / rank).otherwise(0.0),
        F.coalesce(candidate["retrieval_score"].cast("double"), F.lit(0.0)),
        step.cast("double"),
        n_selected.cast("double"),
    )
    last = F.array(F.when(F.size(shifts) > 0, F.array_max(cosines)).otherwise(0.0), F.when(F.size(shifts) > 0, cosine(shift, mean)).otherwise(0.0))
    return F.concat(eta0, eta, shift, F.transform(shift, F.abs), middle, mean, last)


def _first(df: DataFrame, weight: Column, n: int) -> DataFrame:
    """The rows, by ``ord`` and id, before which less than ``n`` of ``weight`` lies."""
    if "ord" not in df.columns:
        raise ValueError("a limit needs the input order, a column ord")
    return first_by_weight(df, F.floor(F.col("ord") / BUCKET), ["ord", "id"], weight, n)


def states(teacher: DataFrame, posteriors: DataFrame, max_states: int | None = None) -> DataFrame:
    """One row a step: id, eta0, candidates, step, current, best, gains (in array order).

    A teacher id without a posterior row is an error.  ``max_states`` keeps the first
    states in input order, which ``ord`` (a number, ties by id) tells.
    """
    if max_states is not None:
        teacher = _first(teacher, F.size("steps"), max_states).withColumn("steps", F.slice("steps", F.lit(1), F.least(F.size("steps"), max_states - F.col("_before")).cast("int")))
    steps = teacher.select("id", F.explode("steps").alias("s")).select("id", F.col("s.step").alias("step"), F.transform("s.current_doc_ids", lambda x: x.cast("string")).alias("current"), F.col("s.best_doc_id").cast("string").alias("best"), F.col("s.candidate_gains").alias("gains"))
    rows = steps.join(posteriors.select("id", "query", "eta0", "candidates", F.lit(True).alias("found")), "id", "left")
    # As a filter, since an unused column would be pruned together with its check.
    there = F.when(F.col("found").isNull(), F.raise_error(F.concat(F.lit("no posterior row for "), F.col("id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(there).drop("found")


def feature_rows(teacher: DataFrame, posteriors: DataFrame, max_states: int | None = None, max_candidates: int | None = None) -> DataFrame:
    """id, group_id, step, doc_id, features, gain, is_best: one row for each candidate left in each state."""
    rows = states(teacher, posteriors, max_states)
    left = F.filter("candidates", lambda c: ~F.array_contains(F.col("current"), c["doc_id"].cast("string")))
    if max_candidates is not None:
        left = F.slice(left, 1, max_candidates)
    known = F.transform(F.filter("candidates", lambda c: F.array_contains(F.col("current"), c["doc_id"].cast("string"))), lambda c: c["eta"])
    rows = rows.withColumn("left", left).withColumn("selected", known).withColumn("n_selected", F.size("current"))
    flat = rows.select("id", "step", "eta0", "selected", "n_selected", "best", "gains", F.explode("left").alias("c"))
    gain = F.filter("gains", lambda g: g["doc_id"].cast("string") == F.col("c.doc_id").cast("string"))
    return flat.select(
        "id",
        F.concat_ws("::", "id", "step").alias("group_id"),
        "step",
        F.col("c.doc_id").cast("string").alias("doc_id"),
        candidate_features(F.col("eta0"), F.col("c"), F.col("selected"), F.col("n_selected"), F.col("step")).alias("features"),
        F.when(F.size(gain) > 0, F.element_at(gain, F.greatest(F.size(gain), F.lit(1)))["gain"]).otherwise(0.0).alias("gain"),
        (F.col("c.doc_id").cast("string") == F.col("best")).cast("int").alias("is_best"),
    )


def train_balance(rows: DataFrame) -> DataFrame:
    """One row: positives, negatives and whether both are there."""
    return rows.agg(F.count_if(F.col("is_best") == 1).alias("positives"), F.count_if(F.col("is_best") == 0).alias("negatives"), (F.coalesce(F.bool_or(F.col("is_best") == 1), F.lit(False)) & F.coalesce(F.bool_or(F.col("is_best") == 0), F.lit(False))).alias("usable"))


def merged_documents(posteriors: DataFrame, retrieval: DataFrame | None = None) -> DataFrame:
    """id, doc_id, title, text, rank, score, retrieval_score: posterior candidates filled up from retrieval.

    Null and empty fields take retrieval's value; documents that only retrieval
    has are added, for ids that have a posterior row.  The last of repeated
    doc_ids counts.
    """

    def flat(df):
        have = [f.name for f in df.schema["candidates"].dataType.elementType.fields]
        pick = lambda n, kind: (F.col(f"c.{n}") if n in have else F.lit(None)).cast(kind).alias(n)
        rows = df.select("id", F.posexplode("candidates").alias("pos", "c")).where("c.doc_id is not null")
        fields = F.struct(pick("title", "string"), pick("text", "string"), pick("rank", "int"), pick("score", "double"), pick("retrieval_score", "double"))
        return rows.groupBy("id", F.col("c.doc_id").cast("string").alias("doc_id")).agg(F.max_by(fields, "pos").alias("d"))

    own = flat(posteriors)
    if retrieval is None:
        return own.select("id", "doc_id", "d.*")
    other = flat(retrieval.join(posteriors.select("id").distinct(), "id", "left_semi")).withColumnRenamed("d", "r")
    both = own.join(other, ["id", "doc_id"], "full_outer")
    filled = [F.coalesce(F.nullif(f"d.{n}", F.lit("")), F.col(f"r.{n}"), F.col(f"d.{n}")).alias(n) for n in ("title", "text")]
    return both.select("id", "doc_id", *filled, *(F.coalesce(f"d.{n}", f"r.{n}").alias(n) for n in ("rank", "score", "retrieval_score")))


def _group_rows(teacher, posteriors, retrieval, max_candidates):
    gains = F.col("gains") if max_candidates is None else F.slice("gains", 1, max_candidates)
    if max_candidates is not None and max_candidates < 1:
        raise ValueError("max_candidates must be positive")
    docs = merged_documents(posteriors, retrieval)
    whole = F.struct("doc_id", "title", "text", "rank", F.coalesce("retrieval_score", "score").alias("retrieval_score"))
    by_id = docs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", whole.alias("d")))).alias("docs"))
    rows = states(teacher, posteriors).select("id", "step", "query", "current", gains.alias("gains")).join(by_id, "id")
    items = F.transform("gains", lambda g: F.struct(F.element_at("docs", g["doc_id"].cast("string")).alias("d"), F.coalesce(g["gain"], F.lit(0.0)).alias("gain")))
    usable = lambda c: c["d"].isNotNull() & (F.coalesce(strip(F.coalesce(F.nullif(c["d"]["text"], F.lit("")), c["d"]["title"])), F.lit("")) != "")
    rows = rows.withColumn("asked", F.size("gains")).withColumn("candidates", F.filter(items, usable))
    return rows.withColumn("selected_docs", F.filter(F.transform("current", lambda d: F.element_at("docs", d)), lambda d: d.isNotNull()))


def listwise_groups(teacher: DataFrame, posteriors: DataFrame, retrieval: DataFrame | None = None, max_groups: int | None = None, max_candidates: int | None = None) -> DataFrame:
    """Groups of at least two usable candidates: id, step, query, current_doc_ids, candidates, selected_docs.

    ``max_groups`` keeps the first of these in input order, which the teacher's ``ord``
    (a number, ties by id) tells; groups that are too small don't count.
    """
    rows = _group_rows(teacher, posteriors, retrieval, max_candidates).where(F.size("candidates") >= 2)
    if max_groups is not None:
        kept = written(rows)
        own = teacher.select("id", "ord").join(kept.groupBy("id").agg(F.count(F.lit(1)).alias("groups")), "id")
        among = F.row_number().over(Window.partitionBy("id").orderBy("step")) + F.col("_before")
        rows = kept.join(_first(own, F.col("groups"), max_groups).select("id", "_before"), "id").withColumn("_at", among).where(F.col("_at") <= max_groups)
    shape = F.transform("candidates", lambda c: F.struct(c["d"]["doc_id"].alias("doc_id"), c["d"]["title"].alias("title"), c["d"]["text"].alias("text"), c["d"]["rank"].alias("rank"), c["d"]["retrieval_score"].alias("retrieval_score"), c["gain"].alias("gain")))
    return rows.select("id", "step", "query", F.col("current").alias("current_doc_ids"), shape.alias("candidates"), "selected_docs")


def group_stats(teacher: DataFrame, posteriors: DataFrame, retrieval: DataFrame | None = None, max_candidates: int | None = None) -> DataFrame:
    """One row: groups built, candidates skipped for missing text, groups skipped as too small."""
    rows = _group_rows(teacher, posteriors, retrieval, max_candidates)
    return rows.agg(
        F.count_if(F.size("candidates") >= 2).alias("groups"),
        F.coalesce(F.sum(F.col("asked") - F.size("candidates")), F.lit(0)).alias("skipped_missing"),
        F.count_if(F.size("candidates") < 2).alias("skipped_small"),
    )


def epoch_order(groups: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Groups in an order that seed, epoch, id and step decide."""
    return groups.orderBy(F.xxhash64(F.lit(seed + epoch), "id", "step"), "id", "step")


class Fitted:
    """A linear model: its weights and shift, and (shift, *weights, loss) before each Newton step and at the end."""

    def __init__(self, weights: list[float], shift: float, steps: list[list[float]]):
        self.weights, self.shift, self.steps = weights, shift, steps

    def score(self, features: Column) -> Column:
        """The margin of a feature array, in plain columns."""
        return F.aggregate(F.zip_with(features, F.array(*map(F.lit, self.weights)), lambda x, w: x * w), F.lit(self.shift), lambda s, v: s + v)


def _sums(data: DataFrame, per_batch, size: int) -> np.ndarray:
    """The sum over all rows of the vectors that ``per_batch`` (features, targets) gives: one row a task, added up by place."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(lists.padded(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    out = np.zeros(size)
    for r in data.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def newton(data: DataFrame, features: Column, target: Column, steps: int, regularisation: float, tolerance: float = 0.0) -> Fitted:
    """Logistic regression of ``target`` (0 or 1) on a feature array by Newton steps.

    Each step is one job: tasks sum the loss, (target - p) x and p (1 - p) x x' over
    their rows, the sums are added up, and only they come to the driver, where a
    system of the features' size is solved.  A step that makes the loss worse is
    halved.  The penalty ``regularisation`` / 2 times the squared weights leaves the
    shift alone.
    """
    rows = data.select(features.alias("x"), target.cast("double").alias("y"))
    size = len(rows.select("x").first()[0]) + 1
    now, best, least, history = np.zeros(size), np.zeros(size), np.inf, []
    halved = 0

    def sums_at(at):
        def per_batch(x, y):
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            m = x @ at
            p = 1 / (1 + np.exp(-m))
            loss = np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m  # log(1 + exp(m)) - y m
            return np.concatenate([[loss.sum()], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        return per_batch

    while len(history) <= steps:
        sums = _sums(rows, sums_at(now), 1 + size + size * size)
        penalty = regularisation * np.concatenate([[0.0], now[1:]])
        total = float(sums[0] + penalty @ now / 2)
        if total > least and halved < 30:
            now, halved = (now + best) / 2, halved + 1
            continue
        history.append([*now.tolist(), total])
        gained, best, least, halved = least - total, now, total, 0
        if len(history) > steps or gained <= tolerance:
            break
        h = sums[1 + size :].reshape(size, size) + np.diag([0.0, *[regularisation] * (size - 1)])
        now = best + np.linalg.lstsq(h, sums[1 : 1 + size] - penalty, rcond=None)[0]
    return Fitted(best[1:].tolist(), float(best[0]), history)


def _usable(rows: DataFrame) -> DataFrame:
    """features and is_best, written; both classes must be present."""
    data = written(rows.select("features", "is_best"))
    if not train_balance(data).first()["usable"]:
        raise ValueError("training needs both best and other candidates")
    return data


def fit_selector(rows: DataFrame, max_iter: int = 25, regularisation: float = 1e-3, tolerance: float = 1e-9) -> Fitted:
    """Logistic regression on ``features`` for ``is_best``; its margin is the score.

    Both classes must be present.
    """
    data = _usable(rows)
    model = newton(data, F.col("features"), F.col("is_best"), max_iter, regularisation, tolerance)
    discard(data)
    return model


def fit_network(rows: DataFrame, hidden: tuple[int, ...] = (16, 16), epochs: int = 40, rate: float = 0.02, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """A network with ReLU between its layers on ``features`` for ``is_best``: (matrix, shift) of each layer.

    Each epoch is one job: tasks sum the gradient of the logistic loss over their
    rows, the sums are added up by place, and the driver, which holds the weights
    only, takes one Adam step.  Features are standardised; the first layer takes
    that in.  There is no dropout.
    """
    data = _usable(rows)
    size = len(data.select("features").first()[0])
    found = data.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(size)), *(F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in range(size))).first()
    mean = np.array([found[f"m{i}"] for i in range(size)])
    spread = np.array([found[f"s{i}"] if found[f"s{i}"] > 1e-9 else 1.0 for i in range(size)])
    widths = [size, *hidden, 1]
    shapes = [s for a, b in zip(widths, widths[1:], strict=False) for s in ((a, b), (b,))]
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.normal(0, np.sqrt(2 / s[0]), s).ravel() if len(s) == 2 else np.zeros(s) for s in shapes])
    moment, square = np.zeros_like(flat), np.zeros_like(flat)
    for epoch in range(1, epochs + 1):
        g = _sums(data, _gradient(flat, shapes, mean, spread), len(flat)) / found["n"]
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        flat = flat - rate * (moment / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    discard(data)
    layers = _layers(flat, shapes)
    (w, b), *later = layers
    return [(w / spread[:, None], b - (mean / spread) @ w), *later]


def _layers(flat: np.ndarray, shapes: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    cut = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    parts = [c.reshape(s) for c, s in zip(cut, shapes, strict=True)]
    return list(zip(parts[::2], parts[1::2], strict=True))


def _gradient(flat: np.ndarray, shapes: list[tuple], mean: np.ndarray, spread: np.ndarray):
    """(features, targets) -> the gradient of the summed loss."""

    def per_batch(x, y):
        layers = _layers(flat, shapes)
        held = [(x - mean) / spread]
        for w, b in layers[:-1]:
            held.append(np.maximum(held[-1] @ w + b, 0.0))
        margin = (held[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
        back = (1 / (1 + np.exp(-margin)) - y)[:, None]
        parts = []
        for at in range(len(layers) - 1, -1, -1):
            parts += [back.sum(axis=0), (held[at].T @ back).ravel()]
            back = (back @ layers[at][0].T) * (held[at] > 0)
        return np.concatenate(parts[::-1])

    return per_batch


def log_loss(scores: Column, target: Column) -> Column:
    """Mean logistic loss of margins against 0/1."""
    return F.avg(F.greatest(scores, F.lit(0.0)) + F.log1p(F.exp(-F.abs(scores))) - target * scores)


def score_rows(rows: DataFrame, make_scorer, name: str = "score") -> DataFrame:
    """``rows`` with the scorer's score of each row's ``features``, a batch at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = make_scorer()
        for batch in batches:
            yield pa.array(np.asarray(scorer(lists.padded(batch)), float) if len(batch) else [], pa.float64())

    return rows.withColumn(name, F.arrow_udf(run, "double")("features"))
