"""Exact removal of byte strings of a fixed length that occur more than once.

Every string of ``LENGTH`` bytes (a window) names a base: the smallest of its
``GRAM``-byte grams by hash, moved back to a multiple of ``SPAN`` before the
window's start is left out of account.  Equal windows have the same place
relative to their base and share its core, the bytes that all windows of the base
have in common, so equal windows meet under one core.  Neighbouring windows of
one base form a piece: core, some bytes to the left and some to the right.

1. A pass over all texts counts cores in a bit table of fixed size; a core that
   is alone in its cell can't repeat.  The table only saves work.
2. Pieces of the other cores meet by core.  A piece that occurs twice has all its
   windows repeated.  A core with one piece once has none.
3. Different pieces of one core go through a suffix array (``suffixes``): windows
   whose suffixes agree with a neighbour's for a whole window repeat.  The core is
   one symbol there, different for each core.  Cores are dealt over as many
   partitions as their symbols ask for.  A core with more than ``MOST``
   different pieces is split by halving the range of its windows again and again,
   in joins and counts, until each part is uniform or alone.
4. Repeated windows become spans of their texts; a text that occurs twice is one
   span.  A join brings the spans to the texts.

Passages of more than ``words`` words can be found as well, however few bytes they
have: the same steps run once more over word hashes, one symbol of ``CODE`` bytes a
word, with a window of words + 1 symbols.

Defined results: null is empty; texts shorter than a window have nothing removed;
matches never cross texts; repeated rows are texts that repeat; ``repeat_digests``
carries no extra columns, ``with_spans`` and ``remove_repeats`` carry all.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, hidden, merged_parts, mix64, scratch, shown, stored, text_bytes, text_slices
from .shingles import CASED, _tables, word_hashes
from .suffixes import suffix_array

LENGTH = 400
GRAM = 100
SPAN = 64
SKETCH_BITS = 28
SKETCH_PARTS = 512
MOST = 1500
SYMBOLS = 20_000
TASK_SYMBOLS = 300_000
CHUNK = 400_000
CODE = 8
SEEN = 200_000  # texts a task remembers; a forgotten one is merely looked at again
_WORD = re.compile(rb"[^ \t-\r]+")


class Cutter:
    """Cuts texts into pieces; ``length`` is the window's in symbols of ``unit`` bytes (1 or 8)."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, span: int = SPAN, unit: int = 1):
        self.length, self.gram, self.span, self.unit = length, gram, span, unit
        self.core = length - span + 1
        if self.core < gram or gram < 1:
            raise ValueError("the gram must fit in the core")

    def chunks(self, texts: list[bytes]):
        """(bytes, [(text number, offset of the part in the text, start, size), ...]) of bounded size, in symbols."""
        parts, size = [], 0
        most, unit = CHUNK // self.unit, self.unit
        whole = lambda: (b"".join(p[3] for p in parts), [p[:3] + (len(p[3]) // unit,) for p in parts])
        for i, t in enumerate(texts):
            at, n = 0, len(t) // unit
            while n - at >= self.length:
                own = t[at * unit : (at + most + self.length - 1) * unit]
                if size + len(own) // unit > most and parts:
                    yield whole()
                    parts, size = [], 0
                parts.append((i, at, size, own))
                size += len(own) // unit
                at += most
        if parts:
            yield whole()

    def runs(self, data: bytes, parts: list[tuple]) -> dict[str, np.ndarray]:
        """Pieces of a chunk: base, first and last window (places in the chunk), core and piece hashes, part."""
        flat = np.frombuffer(data, np.uint8 if self.unit == 1 else np.uint64)
        up, down = _tables(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
        width = len(flat) - self.gram + 1
        low = mix64((sums[self.gram :] - sums[:width]) * down[:width])
        low &= np.uint64(~0xFFFFF & (1 << 64) - 1)
        low |= np.arange(width, dtype=np.uint64)
        view = self.length - self.gram + 1
        done = 1
        while done * 2 <= view:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < view:
            low = np.minimum(low[: len(low) - (view - done)], low[view - done :])
        anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
        starts = np.array([p[2] for p in parts])
        counts = np.array([p[3] - self.length + 1 for p in parts])
        part = np.repeat(np.arange(len(parts)), counts)
        at = np.arange(len(part)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        anchor = anchor[at]
        step = (anchor - at) // self.span
        code = anchor * 512 + step
        edge = np.ones(len(at) + 1, bool)
        edge[1:-1] = (code[1:] != code[:-1]) | (part[1:] != part[:-1])
        cut = np.flatnonzero(edge)
        first, last = at[cut[:-1]], at[cut[1:] - 1]
        base = anchor[cut[:-1]] - step[cut[:-1]] * self.span
        hashed = lambda a, b: (sums[b] - sums[a]) * down[a]
        core = mix64(hashed(base, base + self.core) + step[cut[:-1]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        piece = mix64(hashed(first, last + self.length) + (base - last).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ mix64(core + (base - first).astype(np.uint64))
        return {"base": base, "first": first, "last": last, "core": core, "piece": piece, "part": part[cut[:-1]]}


def _new_texts(batches, text: str):
    """(names of the texts, texts) in runs of bounded size, without those this task has had."""
    seen: set[tuple] = set()
    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for a, texts in text_slices(batch.column(batch.schema.get_field_index(text)), 4 * CHUNK):
            keep = []
            for i in range(len(texts)):
                name = names[a + i]
                if name not in seen:
                    keep.append(i)
                    if len(seen) < SEEN:
                        seen.add(name)
            yield [names[a + i] for i in keep], [texts[i] for i in keep]


def named_texts(docs: DataFrame) -> DataFrame:
    """text_a, text_b (hashes that name a text) and text (null: empty)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(body).alias("text_a"), F.hash(body).alias("text_b"), body.alias("text"))


def coded_texts(texts: DataFrame, words: int) -> DataFrame:
    """Named texts of more than ``words`` words, each word as its hash of CODE bytes (case counts, blanks don't)."""

    def run(batches):
        for batch in batches:
            for a, own in text_slices(batch.column(2), CHUNK):
                codes, counts = word_hashes(own, CASED)
                ends = np.cumsum(counts)
                keep = np.flatnonzero(counts > words)
                made = [codes[ends[i] - counts[i] : ends[i]].tobytes() for i in keep.tolist()]
                at = pa.array(keep + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(made, pa.binary())], names=["text_a", "text_b", "text"])

    return texts.mapInArrow(run, "text_a long, text_b int, text binary")


def repeated_cells(texts: DataFrame, cutter: Cutter, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bit for each cell that holds more than one core occurrence; 2**bits bits whatever the input."""
    cells = (1 << bits) // SKETCH_PARTS
    shift = np.uint64(64 - bits)

    def count(batches):
        found = [np.zeros(0, np.uint32)]
        for _, own in _new_texts(batches, "text"):
            for data, parts in cutter.chunks(own):
                found.append((cutter.runs(data, parts)["core"] >> shift).astype(np.uint32))
        found = np.sort(np.concatenate(found))
        if len(found) > 2:  # two of a cell are as good as many
            found = found[np.concatenate(([True, True], found[2:] != found[:-2]))]
        ends = np.searchsorted(found, np.arange(1, SKETCH_PARTS + 1, dtype=np.uint64) * np.uint64(cells))
        rows = [(i, own) for i, own in enumerate(np.split(found, ends[:-1])) if len(own)]
        made = [b"\x00" + (own - np.uint32(i * cells)).tobytes() for i, own in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(made, pa.binary())], names=["part", "data"])

    def add(total, data):
        if data[:1] == b"\x00":
            own = np.frombuffer(data[1:], np.uint32)
            np.add.at(total, own, 1)
        else:
            total += np.frombuffer(zlib.decompress(data[1:]), np.uint8)
        np.minimum(total, 2, out=total)

    counted = texts.mapInArrow(count, "part int, data binary")
    merged = merged_parts(counted, lambda: np.zeros(cells, np.uint8), add, lambda total: b"\x01" + zlib.compress(total.tobytes(), 1))

    def pack(batches):
        for batch in batches:
            made = [np.packbits(np.frombuffer(zlib.decompress(x[1:]), np.uint8) > 1).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["part", "data"])

    out = np.zeros((SKETCH_PARTS, cells // 8), np.uint8)
    for r in merged.mapInArrow(pack, "part int, data binary").collect():  # SKETCH_PARTS rows of fixed size
        out[r["part"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


PIECES = "text_a long, text_b int, core long, piece long, bases array<long>, low int, high int, edges binary"


def pieces_of(texts: DataFrame, table, cutter: Cutter, bits: int = SKETCH_BITS) -> DataFrame:
    """Pieces whose core may repeat.

    A window that starts k bytes before a base is number k of its piece, low to
    high; ``edges`` are the high symbols before the core and the span - 1 - low
    behind it.  Equal pieces of one chunk of a text are one row with all their
    bases, so periodic texts send few rows.
    """
    shift = np.uint64(64 - bits)

    def run(batches):
        bitmap = table.value
        for names, own in _new_texts(batches, "text"):
            for data, parts in cutter.chunks(own):
                r = cutter.runs(data, parts)
                cell = (r["core"] >> shift).astype(np.int64)
                keep = np.flatnonzero(bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & np.uint8(1))
                if not len(keep):
                    continue
                keep = keep[np.lexsort((r["base"][keep], r["piece"][keep], r["core"][keep], r["part"][keep]))]
                base, first, last, part, core, piece = (r[k][keep] for k in ("base", "first", "last", "part", "core", "piece"))
                fresh = np.ones(len(keep), bool)
                fresh[1:] = (part[1:] != part[:-1]) | (core[1:] != core[:-1]) | (piece[1:] != piece[:-1])
                head = np.flatnonzero(fresh)
                origin = np.array([p[1] - p[2] for p in parts])[part]
                bases = pa.ListArray.from_arrays(pa.array(np.append(head, len(keep)).astype(np.int32)), pa.array(base + origin))
                base, first, last, part, core, piece = (x[head] for x in (base, first, last, part, core, piece))
                name = [names[parts[p][0]] for p in part.tolist()]
                behind, stop = base + cutter.core, last + cutter.length
                u = cutter.unit
                edges = [data[a:b] + data[c:d] for a, b, c, d in zip(*((x * u).tolist() for x in (first, base, behind, stop)), strict=True)]
                columns = [
                    pa.array([x[0] for x in name], pa.int64()),
                    pa.array([x[1] for x in name], pa.int32()),
                    pa.array(core.view(np.int64)),
                    pa.array(piece.view(np.int64)),
                    bases,
                    pa.array((base - last).astype(np.int32)),
                    pa.array((base - first).astype(np.int32)),
                    pa.array(edges, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["text_a", "text_b", "core", "piece", "bases", "low", "high", "edges"])

    return texts.mapInArrow(run, PIECES)


def repeated_windows(groups: list[list[tuple]], span: int, unit: int = 1) -> list[list[tuple[int, list[int]]]]:
    """For groups of (piece, low, high, edges), one core each: (piece, numbers of its repeated windows)."""
    if unit > 1:  # name the symbols by small numbers
        rank: dict[int, int] = {}
        groups = [[(p, low, high, [rank.setdefault(x, len(rank)) for x in np.frombuffer(edges, np.uint64).tolist()]) for p, low, high, edges in own] for own in groups]
        spare = len(rank)
    else:
        spare = 256
    text: list[int] = []
    origin: list[tuple[int, int]] = []
    for g, own in enumerate(groups):
        for i, (_, low, high, edges) in enumerate(own):
            symbols = [b + 2 for b in edges[:high]] + [2 + spare + g] + [b + 2 for b in edges[high:]] + [1]
            origin += [(g, i)] * len(symbols)
            text += symbols
    whole = np.array(text, np.int32)
    order = suffix_array(text)
    at = 0
    valid = bytearray(len(text))
    core_at: dict[tuple[int, int], int] = {}
    for g, own in enumerate(groups):
        for i, (_, low, high, edges) in enumerate(own):
            core_at[g, i] = at + high
            for k in range(low, high + 1):
                valid[at + high - k] = 1
            at += len(edges) + 2
    raw = whole.tobytes()
    width = span * 4
    out = [[(piece[0], []) for piece in own] for own in groups]
    last, last_raw, marked = -1, b"", bytearray(len(text))
    for s in order:
        if not valid[s]:
            continue  # no window starts here; those that do and agree still stand side by side
        own_raw = raw[s * 4 : s * 4 + width]
        if own_raw == last_raw:
            marked[s] = marked[last] = 1
        last, last_raw = s, own_raw
    for s in np.flatnonzero(np.frombuffer(marked, np.uint8)).tolist():
        g, i = origin[s]
        out[g][i][1].append(core_at[g, i] - s)
    return out


def _intervals(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for k in sorted(numbers):
        if out and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


RANGES = "core long, piece long, low int, high int"


def _by_suffixes(pieces: DataFrame, span: int, unit: int) -> DataFrame:
    """RANGES of repeated windows of ``pieces`` (core, piece, low, high, edges), whole cores of bounded size."""

    def run(batches):
        def solve(groups):
            rows = [(core, piece, a, b) for (core, _), found in zip(groups, repeated_windows([g[1] for g in groups], span, unit), strict=True) for piece, numbers in found for a, b in _intervals(numbers)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["core", "piece", "low", "high"])

        groups, symbols, now = [], 0, None
        for batch in batches:
            for core, *piece in zip(*batch.to_pydict().values(), strict=True):
                if core != now:
                    if symbols >= SYMBOLS:
                        yield solve(groups)
                        groups, symbols = [], 0
                    groups.append((core, []))
                    now = core
                groups[-1][1].append(tuple(piece))
                symbols += len(piece[3]) // unit + 2
        if groups:
            yield solve(groups)

    # Few bytes but much work each, so the number of partitions is not left to sizes.
    symbols = pieces.agg(F.coalesce(F.sum(F.octet_length("edges") / unit + 2), F.lit(0)).alias("n")).first()["n"]
    dealt = pieces.select("core", "piece", "low", "high", "edges").repartition(max(8, int(symbols // TASK_SYMBOLS) + 1), "core").sortWithinPartitions("core", "piece")
    return dealt.mapInArrow(run, RANGES)


def _by_halves(pieces: DataFrame, span: int, unit: int) -> DataFrame:
    """RANGES of repeated windows of cores with very many pieces, by halving the range of windows.

    Counts and joins only: a group's rows may lie in any number of tasks.
    """
    now = pieces.select("core", "piece", F.col("core").alias("key"), "low", "high", F.expr(f"substring(edges, 1, high * {unit})").alias("left"), F.expr(f"substring(edges, high * {unit} + 1)").alias("right"), "times", F.lit(0).alias("skip"))
    found = []
    width = span
    while True:
        # Windows low..high of the part, of ``width`` possible ones.
        shape = F.xxhash64("left", "right", "low", "high")
        marked = stored(now.withColumn("shape", shape))
        sizes = marked.groupBy("key").agg(F.sum("times").alias("total"), F.min("shape").alias("x"), F.max("shape").alias("y"))
        sizes = stored(sizes.select("key", "total", (F.col("x") == F.col("y")).alias("even")).where("total > 1"))
        joined = marked.join(sizes, "key")
        even = joined.where("even").select("core", "piece", (F.col("low") + F.col("skip")).alias("low"), (F.col("high") + F.col("skip")).alias("high"))
        found.append(even)
        rest = joined.where(~F.col("even"))
        if width == 1 or not rest.limit(1).count():
            break
        half = width // 2
        # Lower half: all its windows hold the first width - half bytes to the right.
        shared = width - half
        lower = rest.where(F.col("low") < half).select(
            "core",
            "piece",
            F.xxhash64("key", F.lit(0), F.expr(f"substring(right, 1, {shared * unit})")).alias("key"),
            "low",
            F.least("high", F.lit(half - 1)).alias("high"),
            F.expr(f"substring(left, length(left) - least(high, {half - 1}) * {unit} + 1)").alias("left"),
            F.expr(f"substring(right, {shared * unit + 1})").alias("right"),
            "times",
            "skip",
        )
        # Upper half: all its windows hold the last ``half`` bytes to the left.
        upper = rest.where(F.col("high") >= half).select(
            "core",
            "piece",
            F.xxhash64("key", F.lit(1), F.expr(f"substring(left, length(left) - {half * unit} + 1)")).alias("key"),
            (F.greatest("low", F.lit(half)) - half).alias("low"),
            (F.col("high") - half).alias("high"),
            F.expr(f"substring(left, 1, length(left) - {half * unit})").alias("left"),
            F.expr(f"substring(right, 1, ({width} - 1 - greatest(low, {half})) * {unit})").alias("right"),
            "times",
            (F.col("skip") + half).alias("skip"),
        )
        now = lower.unionByName(upper)
        width = half
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(texts: DataFrame, cutter: Cutter, bits: int = SKETCH_BITS, most: int = MOST) -> DataFrame:
    """text_a, text_b, spans: the ranges (in symbols) that repeated windows cover in each named text that has any."""
    spark = texts.sparkSession
    bounded_batches(spark)
    long_texts = texts.where(F.octet_length("text") >= cutter.length * cutter.unit)
    table = spark.sparkContext.broadcast(repeated_cells(long_texts, cutter, bits))
    rows = stored(pieces_of(long_texts, table, cutter, bits))
    kinds = ["core", "piece", "low", "high"]
    cores = rows.groupBy(*kinds).agg(F.sum(F.size("bases")).alias("times")).groupBy("core").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds"))
    cores = stored(cores.where("total > 1"))
    distinct = stored(rows.join(cores, "core").groupBy(*kinds, "edges", "kinds").agg(F.sum(F.size("bases")).alias("times")))
    certain = distinct.where("times > 1").select("core", "piece", "low", "high")
    several = distinct.where("kinds > 1")
    some = _by_suffixes(several.where(F.col("kinds") <= most), cutter.span, cutter.unit)
    ranges = certain.unionByName(some)
    wide = several.where(F.col("kinds") > most)
    if wide.limit(1).count():
        ranges = ranges.unionByName(_by_halves(wide, cutter.span, cutter.unit))
    ranges = stored(ranges.distinct())
    discard(cores, distinct)
    places = rows.select("text_a", "text_b", "core", "piece", "bases").join(ranges, ["core", "piece"]).withColumn("base", F.explode("bases"))
    spans = places.select("text_a", "text_b", (F.col("base") - F.col("high")).alias("start"), (F.col("base") - F.col("low") + cutter.length).alias("stop"))
    copies = long_texts.groupBy("text_a", "text_b").agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(F.octet_length("text") / cutter.unit)).alias("stop")).where("n > 1")
    spans = spans.unionByName(copies.select("text_a", "text_b", F.lit(0).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))
    return spans.groupBy("text_a", "text_b").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passage_spans(texts: DataFrame, words: int, bits: int = SKETCH_BITS, most: int = MOST) -> DataFrame:
    """text_a, text_b, spans: ranges of words that repeated passages of more than ``words`` words cover."""
    length = words + 1
    return repeated_spans(coded_texts(texts, words), Cutter(length, max(1, length // 3), max(1, length // 4), CODE), bits, most)


def _found(docs: DataFrame, cutter: Cutter | None, bits: int, most: int, words: int | None) -> DataFrame:
    """``docs`` hidden, its text, spans and passages (null where there are none)."""
    texts, spark = named_texts(docs.select("text")), docs.sparkSession
    names = ["text_a", "text_b"]
    with scratch(spark):  # the first search's tables go before the second begins
        found = stored(repeated_spans(texts, cutter or Cutter(), bits, most), keep=True).toDF(*names, "spans")
    if words is None:
        found = found.withColumn("passages", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"))
    else:
        with scratch(spark):
            more = stored(passage_spans(texts, words, bits, most), keep=True)
        found = found.join(more.toDF(*names, "passages"), names, "full")
    body = F.coalesce(F.col("text"), F.lit(""))
    named = hidden(docs, "text").withColumn("text_a", F.xxhash64(body)).withColumn("text_b", F.hash(body))
    return named.join(found, names, "left").select("doc", "text", "spans", "passages")


def with_spans(docs: DataFrame, cutter: Cutter | None = None, bits: int = SKETCH_BITS, most: int = MOST, words: int | None = None) -> DataFrame:
    """``docs`` with ``spans`` (array of start, stop in bytes; null where nothing repeats).

    With ``words`` also ``passages``, the spans of passages of more words, in words.
    """
    made = ("spans",) if words is None else ("spans", "passages")
    return _found(docs, cutter, bits, most, words).select(*shown(docs.columns, "text", without=made), *made)


def kept_bytes(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    merged = merge_spans(spans)
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), merged


def repeat_digests(docs: DataFrame, words: int | None = None, cutter: Cutter | None = None, bits: int = SKETCH_BITS, most: int = MOST) -> DataFrame:
    """``documents`` -> doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``words`` also ``n_passage_words``, the words of the text that repeated
    passages of more than so many words cover; these are reported, not removed.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]

    def run(batches):
        for batch in batches:
            rows = []
            for a, texts in text_slices(batch.column(1), CHUNK):
                spans, passages = (batch.column(i).slice(a, len(texts)).to_pylist() for i in (2, 3))
                for text, own, long in zip(texts, spans, passages, strict=True):
                    kept, merged = kept_bytes(text, own)
                    rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in merge_spans(long))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *made])

    found = _found(docs.select("doc_id", "text"), cutter, bits, most, words).select(F.col("doc.doc_id").alias("doc_id"), "text", "spans", "passages")
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")])
    digests = found.mapInArrow(run, out)
    return digests if words is not None else digests.drop("n_passage_words")


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def whole_words(text: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the start of a word to the end of one."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[first][0], at[stop - 1][1]) for first, stop in spans if stop - first > words]


def remove_repeats(docs: DataFrame, words: int | None = None, **options) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``; other columns stay.

    A character that is only partly covered stays; a null text stays null.  With
    ``words``, repeated passages of more than so many words go as well, whatever
    their length in bytes; the blanks around them stay.
    """

    def cut(text, spans, passages):
        if text is None or not (spans or passages):
            return text
        raw = text.encode()  # one text at a time
        whole = whole_characters(raw, merge_spans(spans))
        if passages:
            whole += whole_words(raw, merge_spans(passages), words)
        return kept_bytes(raw, [{"start": a, "stop": b} for a, b in whole])[0].decode()

    schema = T.StructType([docs.schema["text"]])

    def run(batches):
        for batch in batches:
            made = []
            for a, texts in text_slices(batch.column(1), CHUNK):
                own = [batch.column(i).slice(a, len(texts)).to_pylist() for i in (1, 2, 3)]
                made += [cut(*x) for x in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc", schema.names[0]])

    found = _found(docs, options.get("cutter"), options.get("bits", SKETCH_BITS), options.get("most", MOST), words)
    return found.mapInArrow(run, T.StructType([found.schema["doc"], *schema])).select(*shown(docs.columns, "text"))
