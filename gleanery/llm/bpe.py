"""Byte-pair encoding by a priority queue of merge ranks, and decoding.

A piece of text (split by the vocabulary's pattern) is a doubly linked list of
symbols.  The queue holds the ranks of adjacent pairs; popping the lowest rank
(the leftmost on ties) joins its pair and queues the two new neighbours.  An
entry whose symbols have changed since it was queued is stale and skipped.
Decoding concatenates vocabulary strings and reads them as UTF-8.

Defined results: null and empty texts have no tokens and decode to ""; special
tokens inside texts become their id, as the library's default does; texts of any
length are encoded whole.  Equal texts give equal results, rows repeat as they
did, other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import adder, bounded_batches
from .vocabulary import load

CACHE_PIECES = 200_000  # encoded pieces that a worker remembers; then it starts anew
CACHE_CHARS = 48

# The split pattern in the standard library's dialect, equal for the characters
# in _PLAIN (a test compares all of them); other texts are split by the library.
_SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ͷ‐-‧‰-⁞₠-₿]*")


def merge_piece(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the symbols of one piece.

    ``merges`` maps a pair ``left << 17 | right`` to ``rank << 17 | joined``; a
    queue entry is ``rank << 32 | place``.  It is stale when the pair that now
    stands at its place has another rank.
    """
    n = len(symbols)
    sym = list(symbols)
    get = merges.get
    queue = []
    left = sym[0] << 17 if n else 0
    for i in range(1, n):
        s = sym[i]
        m = get(left | s)
        if m is not None:
            queue.append(m >> 17 << 32 | i - 1)
        left = s << 17
    if not queue:
        return sym
    heapify(queue)
    prev = list(range(-1, n - 1))
    succ = list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        i = entry & 0xFFFFFFFF
        j = succ[i]
        if j >= n or sym[i] < 0:
            continue
        m = get(sym[i] << 17 | sym[j])
        if m is None or m >> 17 != entry >> 32:
            continue
        joined = sym[i] = m & 0x1FFFF
        sym[j] = -1
        k = succ[i] = succ[j]
        if k < n:
            prev[k] = i
            m = get(joined << 17 | sym[k])
            if m is not None:
                heappush(queue, m >> 17 << 32 | i)
        h = prev[i]
        if h >= 0:
            m = get(sym[h] << 17 | joined)
            if m is not None:
                heappush(queue, m >> 17 << 32 | h)
    return [s for s in sym if s >= 0]


class _Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers; encodes what it doesn't hold."""

    def __init__(self, vocabulary):
        self.v = vocabulary

    def __missing__(self, piece: str) -> bytes:
        v = self.v
        ids = merge_piece([v.byte_ids[b] for b in piece.encode()], v.merges)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.v = path, load(path)
        self.pieces = _Pieces(self.v)
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.v.special, key=len, reverse=True))) if self.v.special else None
        self._library = None

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self._special is None or not self._special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.v.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.v.tokens.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for ``path``; pieces stay known from one task to the next."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_column(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int), the token ids of the whole ``text``."""
    schema, build = adder(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rows = [c.encode(x or "") for x in batch.column(at).to_pylist()]
            values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield build(batch, [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))])

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, decoded from the array ``ids``; a null array decodes to null."""
    schema, build = adder(df, [T.StructField(text, T.StringType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            made = [None if x is None else c.decode(x) for x in batch.column(at).to_pylist()]
            yield build(batch, [pa.array(made, pa.string())])

    return df.mapInArrow(run, schema)


class _Numbers(dict):
    def __missing__(self, i: int) -> str:
        out = self[i] = str(i)
        return out


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``documents`` -> doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes each text in one pass, so that ids don't cross to the
    JVM and back only to be hashed.
    """

    def run(batches):
        c, numbers = codec(path), _Numbers()
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "").tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(numbers.__getitem__, ids)).encode()))
                text_sha.append(sha(c.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    out = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(out))
