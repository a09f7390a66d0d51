"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``size`` consecutive item words (a shorter item is one
window).  The search looks at the last ``block`` words of the current window of
the text: a shift table says how far the window may jump without passing an
occurrence; at shift 0 the block names a bucket of patterns with that suffix, of
which those with the window's hash are compared as text.  Windows of one length
share tables; each length of shorter items has its own.

The pattern tables are broadcast only up to ``max_block_bytes`` of item text.
Beyond that the distinct items are dealt into hash blocks of about that size (the
item set is a stated query set).  One sorted pass over the items builds the blocks,
and one pass over the documents searches all of them: a task takes ``PASS_BYTES`` of
text at a time through one block after another and holds one block's tables.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
lower-casing A-Z, so on UTF-8 bytes: a-z, 0-9 and every byte from 0x80 on.

Defined results: null and empty texts have no words and no hits; items without
words have no window; repeated item rows with one id count as one item, equal
texts under several ids as several; empty tables give zero hits; rows repeat as
they did; other columns stay (see ``common`` for names).
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adder, mix64, text_slices
from .shingles import word_hashes

WINDOW = 10
BLOCK_WORDS = 2
MAX_BLOCK_BYTES = 16_000_000  # of item text; its index takes about five times as much
LANE = 256
BATCH_BYTES = 1_000_000
PASS_BYTES = 24_000_000  # of text that goes through all blocks before the next is read
_ODD = 0x9E3779B97F4A7C15

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Matcher:
    """Wu-Manber tables for windows of one length, as flat arrays.

    ``keys`` are the sorted hashes of the blocks, ``shift`` says how far a block
    lets the search jump.  ``bucket`` holds for each window its last block's place
    in ``keys`` and 32 bits of a hash of all its words, sorted; ``start`` is the
    window's first word in the items.
    """

    def __init__(self, length: int, hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.most = length - self.block + 1
        at = np.repeat(firsts, counts) + _ranges(counts)  # words of the items of this length
        place = _ranges(counts)
        at, place = at[place >= self.block - 1], place[place >= self.block - 1]
        key, far = self.blocks(hashes, at), np.maximum(0, length - 1 - place).astype(np.uint8)
        order = np.lexsort((far, key))
        key, far = key[order], far[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.keys, self.shift = key[new], far[new]
        ends = at[place >= length - 1]
        own = self._entry(np.searchsorted(self.keys, self.blocks(hashes, ends)), hashes, ends)
        order = np.argsort(own, kind="stable")
        self.bucket, self.start = own[order], (ends[order] - length + 1).astype(np.uint32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.shift, self.bucket, self.start))

    def blocks(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the blocks whose last words are given."""
        return mix64(hashes[ends - 1] * np.uint64(_ODD) + hashes[ends]) if self.block == 2 else hashes[ends]

    def _entry(self, key: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ends), np.uint64)
        for k in range(self.length):
            total = total * np.uint64(_ODD) + hashes[ends - k]
        return key.astype(np.uint64) << np.uint64(32) | mix64(total) >> np.uint64(32)

    def find(self, hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray):
        """(last word, first and behind last place in ``bucket``) wherever a bucket has windows to compare.

        Long texts are cut into lanes of LANE ends of windows; all lanes advance
        together, each by its own shift.
        """
        many = np.maximum(0, counts - self.length + 1)
        lanes = -(-many // LANE)
        at = np.repeat(firsts + self.length - 1, lanes) + _ranges(lanes) * LANE
        stop = np.minimum(at + LANE, np.repeat(firsts + counts, lanes))
        found: list[np.ndarray] = []
        places: list[np.ndarray] = []
        while len(at) and len(self.keys):
            key = self.blocks(hashes, at)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            far = np.where(self.keys[place] == key, self.shift[place], self.most)
            hit = far == 0
            if hit.any():
                found.append(at[hit])
                places.append(place[hit])
            at = at + np.maximum(far, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return []
        ends = np.concatenate(found)
        own = self._entry(np.concatenate(places), hashes, ends)
        low, high = np.searchsorted(self.bucket, own), np.searchsorted(self.bucket, own, side="right")
        some = low < high
        return zip(ends[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count n, one behind another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Index:
    """All windows of a set of items: their words, one text behind another, and a matcher for each length."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.items = [name for name, _ in items]
        words = [words_of(text) for _, text in items]
        counts = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(counts) - counts
        flat = [w for own in words for w in own]
        self.body = b" ".join(flat)
        self.offset = np.concatenate([[0], np.cumsum([len(w) + 1 for w in flat])]).astype(np.uint32 if len(self.body) < 1 << 32 else np.uint64)
        hashes, _ = word_hashes([self.body], _TABLE)
        length = np.minimum(size, counts)
        self.matchers = [Matcher(n, hashes, self.first[length == n], counts[length == n]) for n in sorted(set(length.tolist()) - {0})]

    @property
    def nbytes(self) -> int:
        return len(self.body) + self.offset.nbytes + self.first.nbytes + sum(m.nbytes for m in self.matchers)

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(number of words, covered word spans, merged and in order, items found) of every text."""
        hashes, counts = word_hashes(texts, _TABLE)
        firsts = np.cumsum(counts) - counts
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        words: dict[int, list[bytes]] = {}
        for m in self.matchers:
            for end, low, high in m.find(hashes, firsts, counts):
                i = int(np.searchsorted(firsts, end, side="right")) - 1
                if i not in words:
                    words[i] = words_of(texts[i])
                stop = end - int(firsts[i]) + 1
                window = b" ".join(words[i][stop - m.length : stop])
                for s in m.start[low:high].tolist():
                    if self.body[self.offset[s] : self.offset[s + m.length] - 1] == window:
                        found[i].append((stop - m.length, stop))
                        items[i].add(self.items[int(np.searchsorted(self.first, s, side="right")) - 1])
        return [(int(n), _joined(own), sorted(names)) for n, own, names in zip(counts, found, items, strict=True)]


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
SPANS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def _search(docs: DataFrame, indexes: list) -> DataFrame:
    """Add SPANS to ``docs``; ``indexes`` are broadcast Indexes."""
    schema, build = adder(docs, list(SPANS))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def column(batch):
        return batch.column(batch.schema.get_field_index("text"))

    def found(ix, batch):
        return [r for _, own in text_slices(column(batch), BATCH_BYTES) for r in ix.search(own)]

    def searched(batches):
        if len(indexes) == 1:
            yield from (found(indexes[0].value, batch) for batch in batches)
            return
        rows = [None] * len(batches)
        for index in indexes:
            for i, batch in enumerate(batches):
                own = found(index.value, batch)
                rows[i] = own if rows[i] is None else [(n, _joined(x + y), sorted({*a, *b})) for (n, x, a), (_, y, b) in zip(rows[i], own, strict=True)]
            vars(index).pop("_value", None)  # the next block's tables take its place
        yield from rows

    def run(batches):
        held, size = [], 0

        def done():
            for batch, rows in zip(held, searched(held), strict=True):
                spans = [[{"start": a, "stop": b} for a, b in r[1]] for r in rows]
                yield build(batch, [pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, kind), pa.array([r[2] for r in rows], pa.list_(pa.string()))])

        for batch in batches:
            held.append(batch)
            size += column(batch).nbytes
            if len(indexes) == 1 or size >= PASS_BYTES:
                yield from done()
                held, size = [], 0
        yield from done()

    return docs.mapInArrow(run, schema)


def search_items(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` (text, ...) with SPANS added.

    ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("body")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // max_block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(blocks))).orderBy("block")
    made = []
    for _, own in groupby(dealt.toLocalIterator(), lambda r: r["block"]):
        made.append(spark.sparkContext.broadcast(Index([(r["item"], r["body"].encode()) for r in own], size)))
    return _search(docs, made or [spark.sparkContext.broadcast(Index([], size))])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``documents`` and ``benchmark`` -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search_items(docs.select("doc_id", "text"), items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT r, i, grams.n, item FROM grams JOIN windows USING (n, gram)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
