"""The best documents of many queries: each task scores all queries over the term lists that it reads, block by block.

Documents come in rounds of growing size, by the hash of their number.  What a query's top_n-th
document reached in the rounds before is its threshold: terms that stay below it
together meet no document by themselves, and a block hands on no more than the documents
that reach it, so that few rows a query are shuffled, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import lengths
from ..sources.tables import discard, rows_of, written

FIRST_DOCS = 8192  # of the first round
GROWTH = 4  # times as many documents are read after each round
QUERY_TERMS = 1_000_000  # of the queries that are sent to the tasks at once: some 30 bytes each
BLOCK = 5_000_000  # postings that a task scores at once: some 60 bytes each
FEW = 4  # times as many steps does it take to find a single row as to pass over one
SLACK = 1e-6  # below a threshold, for sums in another order
DIGITS = 9
PARTS = 1 << 20  # into which the hash deals documents


def _gathered(asked: DataFrame) -> tuple[pa.Array, list[list[int]], pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids; the places of the ids that share each query (equal terms and gains); terms; the queries: where each starts, its terms' places in ``terms``, their gains."""
    rows = asked.select("id", "term", "gain").toArrow()
    ids, terms = (rows[c].combine_chunks().dictionary_encode() for c in ("id", "term"))
    own, codes = ids.indices.to_numpy(), terms.indices.to_numpy()
    order = np.lexsort((codes, own))
    codes, gains = codes[order], rows["gain"].to_numpy()[order]
    starts = np.searchsorted(own[order], np.arange(len(ids.dictionary) + 1)).tolist()
    shared: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        shared.setdefault(codes[a:b].tobytes() + gains[a:b].tobytes(), []).append(i)
    kept = [np.arange(starts[m[0]], starts[m[0] + 1]) for m in shared.values()]
    at = np.concatenate([np.zeros(0, int), *kept])
    return ids.dictionary, list(shared.values()), terms.dictionary, (np.cumsum([0, *map(len, kept)]), codes[at], gains[at])


def _least(best: DataFrame | None, ids: pa.Array, top_n: int) -> np.ndarray:
    """What the top_n-th document of each id has; 0 where there is none."""
    least = np.zeros(len(ids))
    if best is not None:
        rows = best.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("sum").alias("least")).where(F.col("n") >= top_n).toArrow()
        least[pc.index_in(rows["id"].combine_chunks(), ids).to_numpy()] = rows["least"].to_numpy()
    return least


class Block:
    """Documents' postings by term, a term's in the order of the documents."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_terms: int):
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        self.ords, codes, weights = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
        docs = np.concatenate([p[1] + k for p, k in zip(parts, before, strict=False)])
        order = np.argsort(codes, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.first = np.searchsorted(codes[order], np.arange(n_terms + 1))
        self.top = np.zeros(n_terms)
        there = np.flatnonzero(np.diff(self.first))
        if len(there):
            self.top[there] = np.maximum.reduceat(self.weights, self.first[there])
        self._sums, self._found = np.zeros(len(self.ords)), np.zeros(len(self.ords))

    def met(self, terms: list[tuple[int, int, float]], bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents with any of ``terms`` (from, to, gain) whose sum is above 0 and at least ``bar``, and their sums."""
        sums, docs, weights = self._sums, self.docs, self.weights
        terms = [t for t in terms if t[0] < t[1]]
        for a, b, gain in terms:
            sums[docs[a:b]] += gain * weights[a:b]
        if bar > 0 and sum(b - a for a, b, _ in terms) * FEW < len(sums):  # then it takes less to look at the postings' documents alone
            parts = [docs[:0]], [sums[:0]]
            for a, b, _ in terms:
                own = docs[a:b]
                found = sums[own]
                sums[own] = 0  # and is seen once
                at = (found >= bar).nonzero()[0]
                if len(at):
                    parts[0].append(own[at])
                    parts[1].append(found[at])
            return np.concatenate(parts[0]), np.concatenate(parts[1])
        own = (sums >= bar if bar > 0 else sums).nonzero()[0]
        found = sums[own]
        sums[:] = 0
        return own, found

    def added(self, own: np.ndarray, a: int, b: int, gain: float) -> np.ndarray:
        """What a term adds to the documents ``own``."""
        docs, weights = self.docs[a:b], self.weights[a:b]
        if len(own) * FEW < b - a:
            at = docs.searchsorted(own)
            return (docs.take(at, mode="clip") == own) * weights.take(at, mode="clip") * gain
        self._found[docs] = weights
        out = gain * self._found[own]
        self._found[docs] = 0
        return out

    def best(self, queries: tuple[np.ndarray, np.ndarray, np.ndarray], least: np.ndarray, top_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place of a query, doc_ords and sums of its best top_n documents here, those that can't reach its threshold left out."""
        starts, codes, gains = queries
        sizes = np.diff(starts)
        most = gains * self.top[codes]
        query = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((most, query))
        codes, gains, most, bar = codes[order], gains[order], most[order], least - SLACK
        total = np.concatenate([[0.0], np.cumsum(most)])
        upto = total[1:] - total[starts[:-1]][query]
        idle = np.bincount(query, weights=(upto < bar[query] - SLACK) | (most == 0), minlength=len(sizes)).astype(int)
        reach = total[starts[1:]] - total[starts[:-1]]
        first, last, gains, most = self.first[codes].tolist(), self.first[codes + 1].tolist(), gains.tolist(), most.tolist()
        for q in np.flatnonzero((reach > 0) & (reach >= bar)).tolist():
            begin, end, floor = int(starts[q]), int(starts[q + 1]), float(bar[q])
            split = begin + int(idle[q])
            rest = sum(most[begin:split])
            own, sums = self.met([(first[t], last[t], gains[t]) for t in range(split, end)], floor - rest)
            for t in range(split - 1, begin - 1, -1):
                if not len(own) or not most[t]:
                    break  # terms come by what they add at most, none at the front
                sums = sums + self.added(own, first[t], last[t], gains[t])
                rest -= most[t]
                kept = sums + rest >= floor
                own, sums = own[kept], sums[kept]
            if len(own) > top_n:
                score = np.round(sums, DIGITS)
                kept = np.flatnonzero(score >= np.partition(score, len(own) - top_n)[len(own) - top_n])
                if len(kept) > top_n:
                    kept = kept[np.lexsort((self.ords[own[kept]], -score[kept]))[:top_n]]
                own, sums = own[kept], sums[kept]
            if len(own):
                yield q, self.ords[own], sums


def _read(batch: pa.RecordBatch, terms: pa.Array, impact) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ords; of the postings that are in ``terms`` the document's place, the term's and the weight."""
    sizes = lengths(batch.column("terms"))
    codes = pc.fill_null(pc.index_in(batch.column("terms").flatten(), terms), -1).to_numpy()
    at = np.flatnonzero(codes >= 0)
    docs = np.repeat(np.arange(len(sizes)), sizes)[at]
    weights = impact(batch.column("tfs").flatten().to_numpy()[at], batch.column("length").to_numpy()[docs])
    return batch.column("doc_ord").to_numpy().copy(), docs, codes[at], weights


def _blocks(batches: Iterator[pa.RecordBatch], terms: pa.Array, impact) -> Iterator[Block]:
    held, n = [], 0
    for batch in batches:
        held.append(_read(batch, terms, impact))
        n += len(held[-1][1])
        if n >= BLOCK:
            yield Block(held, len(terms))
            held, n = [], 0
    if n:
        yield Block(held, len(terms))


def _round(lists: DataFrame, low: float, high: float) -> DataFrame:
    part = F.pmod(F.xxhash64("doc_ord"), F.lit(PARTS)) / PARTS
    return lists.where((part >= low) & (part < high)).select("doc_ord", "length", F.col("postings.term").alias("terms"), F.col("postings.tf").alias("tfs"))


def _best(asked: DataFrame, lists: DataFrame, n: int, words: float, top_n: int, impact) -> DataFrame:
    """``best`` of as many queries as go to the tasks at once."""
    context = asked.sparkSession.sparkContext
    ids, members, terms, queries = _gathered(asked)
    first = [m[0] for m in members]
    schema = T.StructType([asked.schema["id"], T.StructField("doc_ord", T.LongType()), T.StructField("sum", T.DoubleType())])
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("sum", DIGITS).desc(), "doc_ord"))
    low, high, best = 0.0, 1.0, None
    while high * n > FIRST_DOCS:
        high /= GROWTH
    while low < 1:
        sent = context.broadcast((ids, members, terms, queries, _least(best, ids, top_n)[first]))

        def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, members, terms, queries, least = sent.value
            for block in _blocks(batches, terms, impact):
                rows = [(np.repeat(members[q], len(o)), np.tile(o, len(members[q])), np.tile(s, len(members[q]))) for q, o, s in block.best(queries, least, top_n)]
                if rows:
                    at, ords, sums = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(ords, pa.int64()), pa.array(sums)], names=["id", "doc_ord", "sum"])

        docs = _round(lists, low, high)
        # Large blocks take less time a query; the first round is one block.
        docs = docs.coalesce(max(context.defaultParallelism, int((high - low) * words / BLOCK))) if low else docs.repartition(1)
        found = docs.mapInArrow(scored, schema)
        both = found if best is None else best.unionByName(found)
        now = written(both.withColumn("place", place).where(F.col("place") <= top_n).drop("place"))
        sent.destroy()
        if best is not None:
            discard(best)
        low, high, best = high, high * GROWTH, now
    return best


def best(asked: DataFrame, lists: DataFrame, n: int, words: float, top_n: int, impact) -> DataFrame:
    """id, doc_ord, sum (written): each query's best ``top_n`` documents with a sum above 0, ties in the order of doc_ord.

    ``asked``: id, term, gain (none below 0); ``lists``: doc_ord, length, postings (term, tf) of
    ``n`` documents and about so many ``words``; ``impact`` gives from arrays of tf and length what they weigh.  Queries
    go to the tasks by ``QUERY_TERMS`` terms, all documents are read for each.
    """
    parts = -(-max(rows_of(asked), 1) // QUERY_TERMS)
    own = lambda i: asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
    out = _best(own(0), lists, n, words, top_n, impact)
    for i in range(1, parts):
        out = out.unionByName(_best(own(i), lists, n, words, top_n, impact))
    return out
