"""Quality score from compression with two dictionaries.

A zstandard dictionary is trained on good and one on bad labelled text.  Every
whole text is compressed in blocks of about ``BLOCK`` bytes with both; the mean
over blocks of (size with the good one - size with the bad one) / block bytes is
the normalised difference, low for good text.  A logistic curve fitted on
labelled rows that the dictionaries have not seen turns it into a score.

Fitting uses a bounded sample: at most ``PER_CLASS`` ids of each label, those
with the lowest hash, and one text of at most ``FIT_BYTES`` bytes for each (the
smallest, if an id is repeated).  A dictionary learns from two thirds of its
kind's texts, at most ``TRAIN_BYTES`` bytes of them (the library's trainer takes
time beyond proportion); the rest fit the curve.  Scoring covers every row and
whole texts.

Where there is too little text for the library's trainer, a kind's texts themselves
are its dictionary (its last ``DICTIONARY_BYTES``), and a kind of a single text fits
the curve on that text too.

Defined results: null and empty texts score what a difference of 0 gives; without
a usable text of either kind every score is the share of good labels (0.5 without
any); null labels are skipped; a null id is never held out.  ``score_column``
keeps all columns, ``quality_scores`` carries none.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adder, text_slices

PER_CLASS = 2000
FIT_BYTES = 20_000
DICTIONARY_BYTES = 262_144
TRAIN_BYTES = 8_000_000
BLOCK = 500
LEVEL = 3
BATCH_BYTES = 1_000_000
ACCEPT = 0.3


def id_remainder(column, divisor: int):
    """crc32(id as text) mod ``divisor``; null for a null id."""
    return F.crc32(F.encode(F.col(column).cast("string"), "utf-8")) % divisor


def blocks(text: bytes) -> list[bytes]:
    """Blocks of BLOCK bytes; a short rest joins the block before it."""
    n = max(1, (len(text) + BLOCK // 2) // BLOCK)
    return [text[i * BLOCK : (i + 1) * BLOCK if i < n - 1 else len(text)] for i in range(n)]


class Model:
    """Two dictionaries and a logistic curve; plain data, so that it can be broadcast."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", slope: float = 0.0, shift: float = 0.0):
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def difference(self, text: bytes) -> float:
        if not text or not self.good:
            return 0.0
        if self._pair is None:
            import zstandard

            self._pair = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = self._pair
        parts = blocks(text)
        return sum((len(good(p)) - len(bad(p))) / len(p) for p in parts) / len(parts)

    def score(self, text: bytes) -> float:
        x = max(-500.0, min(500.0, self.slope * self.difference(text) + self.shift))
        return 1.0 / (1.0 + math.exp(-x))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps, with a small ridge."""
    scale = max(float(x.std()), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def fit_model(rows: list[tuple[bytes, int]], weight: float | None = None) -> Model:
    """``rows`` (text, 0 or 1) in a random but fixed order; ``weight``: the true share of 1."""
    share = weight if weight is not None else (sum(y for _, y in rows) / len(rows) if rows else 0.5)
    prior = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
    kinds = [[t for t, y in rows if y == k and t] for k in (0, 1)]
    if not all(kinds):
        return Model(shift=prior)
    import zstandard

    raw, cut = [], [max(1, len(own) * 2 // 3) for own in kinds]
    for own, n in zip(kinds, cut, strict=True):
        parts, total = [], 0
        for t in own[:n]:
            for p in (t[i : i + 2000] for i in range(0, len(t), 2000)):
                if total < TRAIN_BYTES:
                    parts.append(p)
                    total += len(p)
        try:
            raw.append(zstandard.train_dictionary(min(DICTIONARY_BYTES, max(2048, total // 4)), parts).as_bytes())
        except zstandard.ZstdError:  # too little text to train on
            raw.append(b"".join(parts)[-DICTIONARY_BYTES:])
    model = Model(raw[1], raw[0])
    x, y = [], []
    for k, own in enumerate(kinds):
        for t in own[cut[k] :] or own:
            x.append(model.difference(t))
            y.append(k)
    y = np.array(y, float)
    model.slope, model.shift = _logistic(np.array(x), y)
    model.shift += prior - math.log(y.mean() / (1 - y.mean()))  # the sample is balanced, the table isn't
    return model


def _order(doc_id) -> int:
    """A fixed shuffle: Python hashes numbers alike in every run, texts not."""
    return hash((doc_id, 11)) if isinstance(doc_id, int) else zlib.crc32(f"fit:{doc_id}".encode())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows whose crc32(doc_id) mod 5 is not 0."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(id_remainder("doc_id", 5) != 0).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = usable.distinct()
    picked = [ids.where(F.col("quality") == k).orderBy(*order).limit(PER_CLASS) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * PER_CLASS rows
    found = docs.where(F.octet_length("text") <= FIT_BYTES).select("doc_id", "text").join(sample, "doc_id")
    rows = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()  # not more than ``sample`` has
    rows.sort(key=lambda r: (_order(r["doc_id"]), str(r["doc_id"]), r["text"]))
    n = sum(counts.values())
    return fit_model([(r["text"].encode(), r["quality"]) for r in rows], counts.get(1, 0) / n if n else None)


def score_column(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1) to ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, build = adder(docs, [T.StructField(score, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            made = [m.score(t) for _, own in text_slices(batch.column(batch.schema.get_field_index(text)), BATCH_BYTES) for t in own]
            yield build(batch, [pa.array(made, pa.float64())])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` and ``labels`` -> doc_id, held_out, score, predicted."""
    scored = score_column(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
