"""Label distributions and small vectors as arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def entropy(p: Column) -> Column:
    """Natural-log entropy, probabilities clipped to [1e-12, 1]."""
    clipped = F.transform(p, lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-12)))
    return -total(F.transform(clipped, lambda v: v * F.log(v)))


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of the norms is at most 1e-12."""
    size = norm(a) * norm(b)
    return F.when(size <= 1e-12, F.lit(0.0)).otherwise(dot(a, b) / size)


def smooth_mixture(p: Column, eps: float) -> Column:
    """(1 - eps) p + eps / K."""
    if not 0 <= eps < 1:
        raise ValueError("eps must be in [0, 1)")
    return p if eps == 0 else F.transform(p, lambda v: (1 - eps) * v + F.lit(eps) / F.size(p))


def smooth_clip(p: Column, eps: float) -> Column:
    """Clipped below at eps, then normalised."""
    clipped = F.transform(p, lambda v: F.greatest(v, F.lit(float(eps))))
    return F.transform(clipped, lambda v: v / total(clipped))


def one_hot(label: Column, labels: Column) -> Column:
    """An unknown label is an error."""
    made = F.transform(labels, lambda x: F.when(x == label, 1.0).otherwise(0.0))
    return F.when(F.array_contains(labels, label), made).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))


def is_distribution(p: Column, atol: float = 1e-8, tolerance: float = 1e-5) -> Column:
    """Finite, not empty, not below -atol, sums to 1 within ``tolerance``."""
    fine = F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= -atol))
    return F.coalesce((F.size(p) > 0) & fine & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(total(F.transform(a, lambda v: F.exp(v - top))))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    raised = F.transform(a, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / total(raised))


def posterior_from_logits(logits: Column, positions: list[list[int]]) -> Column:
    """Softmax over labels of the log-sum-exp of each label's token logits (positions from 0)."""
    if not positions or not all(positions):
        raise ValueError("every label needs a token position")
    scores = [log_sum_exp(F.array(*[F.element_at(logits, i + 1).cast("double") for i in own])) for own in positions]
    return softmax(F.array(*scores))


def first_best(labels: Column, probs: Column) -> Column:
    """The first label of the highest probability; lengths must agree."""
    best = F.element_at(labels, F.array_position(probs, F.array_max(probs)).cast("int"))
    return F.when(F.size(labels) == F.size(probs), best).otherwise(F.raise_error(F.lit("labels and probabilities differ in length")))
