"""Alignment of two tokenizers' tokens through products of incidence matrices.

A text is taken as its bytes behind one space.  Tokenizer A (byte-level pairs) and
B (pieces, which adds the space itself) each cut these bytes into tokens.  The
token-byte incidence matrices of both are kept as compressed sparse rows; the
product A x B^T, row by row, holds for each pair of tokens how many bytes they
share.  Byte offsets where tokens of both end cut the tokens into groups; the
product of the token-group matrices holds the pairs that share a group.

``alignment_column`` gives the products themselves; ``alignment_digests`` counts
each pair of ids over the whole corpus and tells for each text how its links fare.

Both tokenizers always end a token where a space follows something that is not
white space, so a text falls into units that are aligned alone.  A flush of
documents aligns each of its distinct units once.  Its id pairs go, with their
counts, to the corpus-wide sums; each flush gets its own pairs' sums back and adds
them up for its documents, which were kept as unit numbers.  So what is shuffled
is the distinct pairs of each flush and the packed unit numbers, never a row for
each link.  The highest sums by B id, at most one for each id of the vocabulary, are
broadcast.

Defined results: null and empty texts, and those whose tokens' bytes differ from
space + text, have no tokens: zeros and an empty digest.  Special tokens' strings
are plain text.  Repeated rows count as often as they stand.  A stretch without
any space is one unit, however long.  ``alignment_column`` keeps other columns.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adder, bounded_batches, stored, text_slices
from .vocabulary import load

FLUSH_BYTES = 8 << 20  # of text whose pairs are counted before they are sent
BATCH_BYTES = 1 << 20
CHUNK_CHARS = 1 << 16  # of units that are encoded in one call
BLOCK_BYTES = 1 << 19  # of units whose products are made together
_CUT = re.compile(r"(?<=\S)(?= )")
_WHITE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]


def default_paths() -> tuple[str, str]:
    """The byte-level and the piece vocabulary of this machine's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """Tokenizer A: ids of space + text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        v = load(path)
        self.path, self.tokens = path, v.tokens
        # The same merge ranks and pattern in an encoder that keeps no offsets; special strings are text to it.
        self._fast = tiktoken.Encoding("alignment", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
        self._library = None

    def encode(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(" " + text)
        except BaseException as e:  # the Rust side panics on patterns it can't finish
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
                self._library.no_truncation()
                self._library.no_padding()
                self._library.encode_special_tokens = True
            return self._library.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: ids of text (it adds the space), and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        hexed = re.compile("<0x([0-9A-F]{2})>")
        self.tokens = [bytes([int(m[1], 16)]) if (m := hexed.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind something else, so texts don't fall into units")
        self._space = self._model.encode("a ")[-1:]

    def encode(self, text: str) -> list[int]:
        # An empty text gives nothing; a unit that is a single space is one piece.
        return self._model.encode(text) if text else self._space


class Encoded:
    """Token ids of units, one behind the other: n_a, n_b by unit, a, b; units whose tokens don't hold their bytes have none and aren't ``whole``."""

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray):
        self.n_a, self.n_b, self.a, self.b, self.whole = n_a, n_b, a, b, whole

    @staticmethod
    def joined(parts: list[Encoded]) -> Encoded:
        none = np.zeros(0, np.int64)
        return Encoded(*(np.concatenate([none.astype(kind), *(getattr(p, n) for p in parts)]) for n, kind in (("n_a", np.int64), ("n_b", np.int64), ("a", np.int64), ("b", np.int64), ("whole", bool))))

    def block(self, i: int, j: int, at_a: np.ndarray, at_b: np.ndarray) -> Encoded:
        """Units i to j; ``at_a``, ``at_b`` are the first places of all units."""
        return Encoded(self.n_a[i:j], self.n_b[i:j], self.a[at_a[i] : at_a[j]], self.b[at_b[i] : at_b[j]], self.whole[i:j])


class Tokenizers:
    """Both tokenizers with the lengths of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.length_a, self.length_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        ids = range(max(len(self.length_a), len(self.length_b)))
        self.ids = len(ids)
        #: Decimal ids behind each separator: none, comma, bar, semicolon.
        self.decimals = [f"{s}{i}".encode() for s in ("", ",", "|", ";") for i in ids]

    def _one(self, text: str) -> Encoded:
        a, b, raw = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        whole = b"".join(map(self.a.tokens.__getitem__, a)) == raw == b"".join(map(self.b.tokens.__getitem__, b))
        if not whole:
            a = b = []
        return Encoded(*(np.array([len(x)], np.int64) for x in (a, b)), *(np.array(x, np.int64) for x in (a, b)), np.array([whole]))

    def _together(self, own: list[str]) -> Encoded | None:
        """Units that end in no white space, encoded as the text that they make together; None if bytes differ."""
        text = " ".join(own)
        raw, sides = b" " + text.encode(), []
        sizes = np.array([len(u.encode()) + 1 for u in own])
        for side, lengths in ((self.a, self.length_a), (self.b, self.length_b)):
            ids = side.encode(text)
            if b"".join(map(side.tokens.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, np.int64)
            sides.append((np.diff(np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes), side="right"), prepend=0), ids))
        return Encoded(sides[0][0], sides[1][0], sides[0][1], sides[1][1], np.ones(len(own), bool))

    def encode(self, own: list[str]) -> Encoded:
        """Units (without their leading spaces), as if each were encoded alone."""
        parts: list[Encoded] = []
        chunk: list[str] = []
        size = 0

        def flush():
            nonlocal chunk, size
            if chunk:
                made = self._together(chunk)
                parts.extend([made] if made is not None else map(self._one, chunk))
            chunk, size = [], 0

        for u in own:
            if not u or u[-1].isspace():
                flush()
                parts.append(self._one(u))
                continue
            chunk.append(u)
            size += len(u) + 1
            if size >= CHUNK_CHARS:
                flush()
        flush()
        return Encoded.joined(parts)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def units(text: str) -> list[str]:
    """``text`` cut before each space that follows no white space; each unit without its leading space."""
    if any(w in text for w in _WHITE) or text.startswith(" "):
        return [u[1:] for u in _CUT.split(" " + text)]
    return text.split(" ")


class Rows:
    """A sparse 0/1 matrix by rows: the columns of row i are columns[start[i]:start[i + 1]]."""

    def __init__(self, start: np.ndarray, columns: np.ndarray):
        self.start, self.columns = start, columns

    def transposed(self, n_columns: int) -> Rows:
        """Counting sort by column; rows come in order."""
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        start = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=n_columns))])
        return Rows(start, row[np.argsort(self.columns, kind="stable")])

    def product_size(self, other: Rows) -> np.ndarray:
        """For each row of self x other, how many entries its row product adds up (the symbolic pass)."""
        wide = np.concatenate([[0], np.cumsum(np.diff(other.start)[self.columns])])
        return wide[self.start[1:]] - wide[self.start[:-1]]

    def product(self, other: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of self x other by Gustavson's row products.

        Row i of the result is the sum of other's rows at the columns of row i:
        they are laid out one behind the other and equal columns of a row added up.
        """
        wide = np.diff(other.start)[self.columns]
        total = int(wide.sum())
        row = np.repeat(np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), wide)
        inside = np.arange(total) - np.repeat(np.cumsum(wide) - wide, wide)
        column = other.columns[np.repeat(other.start[:-1][self.columns], wide) + inside]
        if total and ((row[1:] == row[:-1]) & (column[1:] < column[:-1])).any():
            order = np.lexsort((column, row))
            row, column = row[order], column[order]
        first = np.ones(total, bool)
        first[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
        at = np.flatnonzero(first)
        return row[at], column[at], np.diff(np.append(at, total))


def token_bytes(lengths: np.ndarray) -> Rows:
    """Tokens x bytes of tokens that lie one behind the other."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(start, np.arange(start[-1]))


def token_groups(ends: np.ndarray, common: np.ndarray) -> Rows:
    """Tokens x groups; a group ends at each offset of ``common``."""
    return Rows(np.arange(len(ends) + 1), np.searchsorted(common, ends))


class Aligned:
    """Both token sequences of many units side by side, with their links and groups."""

    def __init__(self, t: Tokenizers, x: Encoded):
        self.n_a, self.n_b, self.a, self.b = x.n_a, x.n_b, x.a, x.b
        numbers = np.arange(len(x.n_a))
        self.unit_a, self.unit_b = np.repeat(numbers, self.n_a), np.repeat(numbers, self.n_b)
        rows_a, rows_b = token_bytes(t.length_a[self.a]), token_bytes(t.length_b[self.b])
        self.row, self.column, self.shared_bytes = rows_a.product(rows_b.transposed(int(rows_b.start[-1])))
        ends_a, ends_b = rows_a.start[1:], rows_b.start[1:]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.groups_a, self.groups_b = token_groups(ends_a, common), token_groups(ends_b, common)
        self.n_common = len(common)
        per = lambda unit, weights=None: np.bincount(unit, weights, minlength=len(x.n_a)).astype(np.int64)
        self.n_links = per(self.unit_a[self.row])
        self.n_groups = per(self.unit_a[np.searchsorted(ends_a, common)])
        self.by_group = self.groups_b.transposed(len(common))
        self.n_shared = per(self.unit_a, self.groups_a.product_size(self.by_group))
        self._digits = t

    def group_texts(self) -> list[bytes]:
        """Each unit's groups in decimal: ``a1,a2|b1;a3|b2,b3``."""
        group = np.concatenate([2 * self.groups_a.columns, 2 * self.groups_b.columns + 1])
        order = np.argsort(group, kind="stable")
        group, unit, ids = group[order], np.concatenate([self.unit_a, self.unit_b])[order], np.concatenate([self.a, self.b])[order]
        mark = np.full(len(group), 3)  # a new group
        if len(group):
            mark[1:][group[1:] == group[:-1]] = 1
            mark[1:][(group[1:] == group[:-1] + 1) & (group[1:] % 2 == 1)] = 2
            mark[np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))] = 0
        codes = (mark * self._digits.ids + ids).tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        named = self._digits.decimals.__getitem__
        return [b"".join(map(named, codes[i:j])) for i, j in zip([0, *ends[:-1]], ends, strict=True)]


ALIGNMENT = "struct<a: array<int>, b: array<int>, links: array<struct<a: int, b: int, bytes: int>>, groups: array<struct<a_end: int, b_end: int>>, shared: array<struct<a: int, b: int>>>"


def alignment_column(df: DataFrame, path_a: str, path_b: str, text: str = "text", name: str = "alignment", shared: bool = False) -> DataFrame:
    """Add ``name``: both id lists, links (places in them and the bytes shared) and groups (where each ends).

    ``shared`` also lists the pairs that share a group; a group of x and y tokens has x * y of them.
    """
    kind = T.StructType.fromDDL(f"x {ALIGNMENT}")["x"].dataType
    schema, build = adder(df, [T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def one(t: Tokenizers, text: str) -> dict:
        x = Aligned(t, t.encode([text] if text else []))
        pairs = zip(*(v.tolist() for v in x.groups_a.product(x.by_group)[:2]), strict=True) if shared else ()
        last = lambda g: np.cumsum(np.bincount(g.columns, minlength=x.n_common)).tolist()
        return {
            "a": x.a.tolist(),
            "b": x.b.tolist(),
            "links": [{"a": i, "b": j, "bytes": n} for i, j, n in zip(x.row.tolist(), x.column.tolist(), x.shared_bytes.tolist(), strict=True)],
            "groups": [{"a_end": i, "b_end": j} for i, j in zip(last(x.groups_a), last(x.groups_b), strict=True)],
            "shared": [{"a": i, "b": j} for i, j in pairs],
        }

    def run(batches):
        t = tokenizers(path_a, path_b)
        for batch in batches:
            yield build(batch, [pa.array([one(t, x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()], arrow)])

    return df.mapInArrow(run, schema)


# kind 0: a flush's pairs and which of them each unit links; kind 1: a document.
_FLUSHED = "flush long, kind int, a array<int>, b array<int>, n array<long>, links binary, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, units binary"


def _packed(numbers: np.ndarray) -> bytes:
    small = numbers.astype(np.uint16 if not len(numbers) or numbers.max() < 1 << 16 else np.uint32)
    return bytes([small.itemsize]) + zstandard.compress(small.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), np.uint16 if data[0] == 2 else np.uint32)


class _Numbers(dict):
    """Numbers units as they come."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class _Flush:
    """Documents whose distinct units are aligned together."""

    def __init__(self, t: Tokenizers):
        self.t, self.size = t, 0
        self.number = _Numbers()
        self.docs: list[tuple[pa.Array, list[np.ndarray]]] = []

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        self.docs.append((ids, [np.array(list(map(self.number.__getitem__, units(x))) if x else [], np.uint32) for x in texts]))
        self.size += sum(map(len, texts))

    def encoded(self) -> Encoded:
        """All units; texts with a unit that isn't whole are decided by themselves, as further units."""
        names = list(self.number)
        found = self.t.encode(names)
        if found.whole.all():
            return found
        more: list[str] = []
        for _, own in self.docs:
            for i, k in enumerate(own):
                if not found.whole[k].all():
                    more.append(" ".join(map(names.__getitem__, k.tolist())))
                    own[i] = np.array([len(names) + len(more) - 1], np.uint32)
        later = Encoded.joined([self.t._one(x) for x in more])
        for _, own in self.docs:
            for i, k in enumerate(own):
                if len(k) == 1 and k[0] >= len(names) and not later.whole[k[0] - len(names)]:
                    own[i] = k[:0]
        return Encoded.joined([found, later])


class _Units:
    """What the documents of a flush need of its units, aligned a block at a time."""

    def __init__(self, t: Tokenizers, e: Encoded, times: np.ndarray):
        at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (e.n_a, e.n_b))
        size = np.concatenate([[0], np.cumsum(t.length_a[e.a])])[at_a]
        cuts = np.searchsorted(size, np.arange(BLOCK_BYTES, size[-1], BLOCK_BYTES)).tolist()
        counts: dict[str, list[np.ndarray]] = {n: [] for n in ("n_groups", "n_links", "n_shared")}
        keys, weights, used = [], [], []
        self.n_a, self.n_b, self.texts = e.n_a, e.n_b, []
        for i, j in zip([0, *cuts], [*cuts, len(e.n_a)], strict=True):
            if i < j:
                x = Aligned(t, e.block(i, j, at_a, at_b))
                for n, found in counts.items():
                    found.append(getattr(x, n))
                self.texts += x.group_texts()
                own = times[i:j][x.unit_a[x.row]]
                used.append(own > 0)  # not those of texts that turned out to have no tokens
                keys.append((x.a[x.row] << 32 | x.b[x.column])[own > 0])
                weights.append(own[own > 0])
        none = np.zeros(0, np.int64)
        self.n_groups, self.n_links, self.n_shared = (np.concatenate([none, *v]) for v in counts.values())
        self.pair, at = np.unique(np.concatenate([none, *keys]), return_inverse=True)
        self.n = np.zeros(len(self.pair), np.int64)
        np.add.at(self.n, at, np.concatenate([none, *weights]))
        used = np.concatenate([none.astype(bool), *used])
        self.place = np.zeros(len(used), np.uint32)
        self.place[used] = at


def _flushed(docs: DataFrame, path_a: str, path_b: str, flush_bytes: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*T.StructType.fromDDL(_FLUSHED), docs.schema["doc_id"]])

    def rows(f: _Flush, flush: int, fields: pa.Schema):
        e = f.encoded()
        f.number = None
        numbers = np.concatenate([np.zeros(0, np.uint32), *(k for _, own in f.docs for k in own)])
        x = _Units(f.t, e, np.bincount(numbers, minlength=len(e.n_a)))
        links = _packed(x.n_links)
        packed = len(links).to_bytes(8, "little") + links + _packed(x.place)

        def made(values: dict, count: int):
            return pa.RecordBatch.from_arrays([values[c.name] if c.name in values else pa.nulls(count, c.type) for c in fields], schema=fields)

        listed = {c: pa.array([v.tolist()], fields.field(c).type) for c, v in (("a", x.pair >> 32), ("b", x.pair & 0xFFFFFFFF), ("n", x.n))}
        yield made(listed | {"flush": pa.array([flush], pa.int64()), "kind": pa.array([0], pa.int32()), "links": pa.array([packed], pa.binary())}, 1)
        for ids, own in f.docs:
            sums = {c: pa.array([int(v[k].sum()) for k in own], pa.int64()) for c, v in (("n_a", x.n_a), ("n_b", x.n_b), ("n_groups", x.n_groups), ("n_links", x.n_links), ("n_shared", x.n_shared))}
            sha = [hashlib.sha256(b";".join(map(x.texts.__getitem__, k.tolist()))).hexdigest() if len(k) else "" for k in own]
            yield made(sums | {"flush": pa.array([flush] * len(own), pa.int64()), "kind": pa.array([1] * len(own), pa.int32()), "groups_sha256": pa.array(sha, pa.string()), "units": pa.array([_packed(k) for k in own], pa.binary()), "doc_id": ids}, len(own))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        t, fields = tokenizers(path_a, path_b), to_arrow_schema(schema)
        task, nth, f = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for at, texts in text_slices(batch.column(1), BATCH_BYTES):
                f = f or _Flush(t)
                f.add(batch.column(0).slice(at, len(texts)), [x.decode() for x in texts])
                if f.size >= flush_bytes:
                    yield from rows(f, task << 32 | nth, fields)
                    nth, f = nth + 1, None
        if f is not None:
            yield from rows(f, task << 32 | nth, fields)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


_OUT = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256")


def _summed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents with their links' sums; rows of a flush come as its links, its pairs' totals by place, its documents."""

    def run(batches):
        totals: list[np.ndarray] = []
        best: list[np.ndarray] = []
        sums = marks = packed = None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kinds = column["kind"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                cut = {n: c.slice(i, j - i) for n, c in column.items()}
                if kinds[i] == 0:
                    packed, totals, best, sums = cut["links"][-1].as_py(), [], [], None
                elif kinds[i] == 1:
                    totals.append(cut["total"].to_numpy())
                    best.append(cut["best"].to_numpy(zero_copy_only=False))
                else:
                    if sums is None:
                        size = int.from_bytes(packed[:8], "little")
                        start = np.concatenate([[0], np.cumsum(_unpacked(packed[8 : 8 + size]).astype(np.int64))])
                        place = _unpacked(packed[8 + size :])
                        # Places of links that no document has point at 0 and are never asked for.
                        value = np.concatenate(totals) if totals else np.zeros(1, np.int64)
                        mark = np.concatenate(best).astype(np.int64) if best else np.zeros(1, np.int64)
                        sums, marks = (np.diff(np.concatenate([[0], np.cumsum(v[place])])[start]) for v in (value, mark))
                    asked = [_unpacked(u) for u in cut["units"].to_pylist()]
                    made = {"count_sum": pa.array([int(sums[k].sum()) for k in asked], pa.int64()), "n_best": pa.array([int(marks[k].sum()) for k in asked], pa.int64())}
                    yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else cut[f.name] for f in schema], names=schema.names)

    return rows.repartition("flush").sortWithinPartitions("flush", "kind", "place").mapInArrow(run, schema)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """``documents`` -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_shared, groups_sha256.

    ``n_shared`` counts the token pairs that share a group.
    """
    flushed = stored(_flushed(docs, path_a, path_b, flush_bytes))
    first = flushed.where("kind = 0")
    pairs = first.select("flush", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p")).select("flush", "place", "p.a", "p.b", "p.n")
    totals = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))  # one row for each id of B at most
    known = totals.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = pairs.select("flush", "place", "a", "b").join(known, ["a", "b"]).select("flush", F.lit(1).alias("kind"), "place", "total", "best")
    own = flushed.where("kind = 1").select("flush", F.lit(2).alias("kind"), "doc_id", "units", *_OUT)
    rows = first.select("flush", "kind", "links").unionByName(answers, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.StringType() if n == "groups_sha256" else T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256"))])
    return _summed(rows, schema)
