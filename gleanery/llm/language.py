"""Language identification in two steps: family, then language.

One linear support vector machine per family (against the rest) picks the
family; inside it, one-versus-one machines between its languages vote, ties going
to the larger sum of margins.  Features are hashed byte 1- to 3-grams of the
lower-cased text, each text's counts divided by their number.

Machines are fitted by dual coordinate descent on a bounded sample: at most
``PER_LANGUAGE`` ids of each language, chosen by hash, with one text of at most
``FIT_BYTES`` bytes each (the smallest, if an id is repeated); at most
``MAX_SAMPLE`` in all.  Only the ``MAX_LANGUAGES`` languages with most rows are
learned, and none whose texts are all longer than ``FIT_BYTES``; texts in others
get one of the learned languages.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without labelled rows every text is ``und``; with one language every other text
is that language; a language outside ``FAMILIES`` is a family of its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adder, slices
from .quality import id_remainder

PER_LANGUAGE = 400
MAX_SAMPLE = 4000
MAX_LANGUAGES = MAX_SAMPLE // 8
FIT_BYTES = 20_000
BUCKETS = 1 << 14
BATCH_BYTES = 1_000_000
PIECE = 1 << 18  # bytes whose grams are counted together
GROUP = 128  # texts whose counts are multiplied together

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa sa si ur",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def grams(flat: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams that end at each byte."""
    one = flat.astype(np.uint32)
    two, three = one.copy(), one.copy()
    two[1:] |= one[:-1] << np.uint32(8)
    three[1:] |= one[:-1] << np.uint32(8)
    three[2:] |= one[:-2] << np.uint32(16)
    spread = lambda x, seed: ((x + np.uint32(seed)) * np.uint32(2654435761)) >> np.uint32(18)  # noqa: E731  14 bits
    return [spread(one, 1 << 28), spread(two, 1 << 29), spread(three, 1 << 30)]


def _bytes(text: str) -> bytes:
    """Lower-cased, a piece at a time; pieces begin at white space, so no letter's neighbour is missed."""
    parts, at = [b"  "], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        parts.append(text[at:end].lower().encode())
        at = end
    return b"".join([*parts, b" "])


def features(texts: list[str]) -> np.ndarray:
    """Texts x BUCKETS: the share of each feature; a text's bytes are counted ``PIECE`` at a time."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        flat = np.frombuffer(_bytes(t), np.uint8)
        counts = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(flat) - 2, PIECE):
            for g in grams(flat[at : at + PIECE + 2]):  # those that end in the first two bytes were counted before
                counts += np.bincount(g[2:], minlength=BUCKETS)
        out[i] = counts / (3 * (len(flat) - 2))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Weights and shift of an L1-loss machine, by dual coordinate descent; y is -1 or 1."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    alpha, norm = np.zeros(len(y)), (x * x).sum(axis=1) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            g = y[i] * (float(x[i] @ w) + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                b += step
                alpha[i] = new
    return w, b


class Model:
    """Weight columns: families first (none if there is one), then the pairs of languages."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(_FAMILY.get(lang, f"own:{lang}"), []).append(lang)
        self.names = sorted(self.families)
        self.pairs = [(f, a, b) for f in self.names for i, a in enumerate(self.families[f]) for b in self.families[f][i + 1 :]]
        columns = []
        if langs:
            x = features(texts)
            self.scale = np.float32(1.0) / np.maximum(x.std(axis=0), 1e-4)
            x *= self.scale / np.float32(math.sqrt(BUCKETS) / 4)
            lang = np.array(langs)
            kin = np.array([_FAMILY.get(v, f"own:{v}") for v in langs])
            if len(self.names) > 1:
                columns += [linear_svm(x, np.where(kin == f, 1, -1)) for f in self.names]
            for _, a, b in self.pairs:
                own = (lang == a) | (lang == b)
                columns.append(linear_svm(x[own], np.where(lang[own] == a, 1, -1)))
            factor = self.scale / np.float32(math.sqrt(BUCKETS) / 4)
            self.weights = np.stack([w * factor for w, _ in columns], axis=1) if columns else np.zeros((BUCKETS, 0), np.float32)
            self.shifts = np.array([b for _, b in columns])

    def margins(self, texts: list[str]) -> np.ndarray:
        """Texts x machines; neither grows with the texts' length, and ``GROUP`` texts are counted at a time."""
        if not self.weights.shape[1]:
            return np.zeros((len(texts), 0))
        parts = [features(texts[i : i + GROUP]) @ self.weights for i in range(0, len(texts), GROUP)]
        return np.concatenate([np.zeros((0, self.weights.shape[1])), *parts]) + self.shifts

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) for texts that have a letter."""
        m = self.margins(texts)
        first = len(self.names) if len(self.names) > 1 else 0
        out = []
        for row in m:
            logistic = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * v))))
            f, score = self.names[0], 1.0
            if first:
                f = self.names[int(np.argmax(row[:first]))]
                score = logistic(float(row[:first].max()))
            votes = {v: [0, 0.0] for v in self.families[f]}
            for (own, a, b), v in zip(self.pairs, row[first:], strict=True):
                if own == f:
                    votes[a if v > 0 else b][0] += 1
                    votes[a][1] += float(v)
                    votes[b][1] -= float(v)
            best = max(sorted(votes), key=lambda v: votes[v])
            if len(votes) > 1:
                score *= logistic(votes[best][1] / (len(votes) - 1))
            out.append((best, score))
        return out


def sample(docs: DataFrame) -> DataFrame:
    """unit, doc_id, text, lang of the rows to fit on."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= FIT_BYTES)).where(id_remainder("doc_id", 4) != 2)
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    counts = {r["lang"]: r["ids"] for r in counted.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    per = min(PER_LANGUAGE, MAX_SAMPLE // max(1, len(counts)))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, 1.5 * per / max(1, n))) for k, n in counts.items()], "lang string, rate double")
    rows = usable.select("doc_id", "text", "lang", unit.alias("unit")).join(F.broadcast(rates), "lang").where((F.col("unit") < F.col("rate")) & F.col("text").rlike(r"\p{L}"))
    own = rows.groupBy("lang", "unit", "doc_id").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "doc_id"))
    return own.withColumn("nth", nth).where(F.col("nth") <= per).select("unit", "doc_id", "text", "lang")


def train(docs: DataFrame) -> Model:
    """Fit on text and language of rows whose crc32(doc_id) mod 4 is not 2."""
    found = sample(docs)
    rows = [r for r in found.collect() if has_letter(r["text"])]  # at most MAX_SAMPLE
    rows.sort(key=lambda r: (r["unit"], r["doc_id"], r["text"]))
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


def language_columns(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, build = adder(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
            real = [i for i, t in enumerate(texts) if has_letter(t)] if m.names else []
            for a, b in slices([len(texts[i]) for i in real], BATCH_BYTES):
                own = real[a:b]
                for i, p in zip(own, m.predict([texts[i] for i in own]), strict=True):
                    found[i] = p
            yield build(batch, [pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())])

    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """``documents`` -> doc_id, held_out, lang_pred, score."""
    found = language_columns(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
