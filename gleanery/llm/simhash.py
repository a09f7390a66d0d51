"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint has 64 bits; a bit is 1 where more than half of the text's
word shingles have it in their XXH64.  Two fingerprints link when at most
``BUDGET`` bits differ.

The join walks a trie of fingerprints against itself: a pair of nodes of one
depth carries the bits in which their paths differ, and is dropped as soon as
these exceed the budget.  To deal the walk out to tasks, three tries are used.
The bits are cut into ``BUDGET`` + 1 runs and trie r has run r on top: two
fingerprints that differ in at most ``BUDGET`` bits agree on one run, so in that
trie their paths part below it, and above it only the pairs (node, itself) need
to be walked.  Each node at that depth is a group of its own.  A node with more
than ``NODE`` distinct fingerprints is not walked: the bits below it are cut into
runs again and its members go to deeper nodes in the same way, until 52 bits or
more are fixed and a node can't hold more.  Nothing is capped.

Each task answers with a forest of the links it found instead of all pairs; the
components of all forests are those of all links.

Defined results: a text that is null, empty or without words has the fingerprint
zero and links like any other; fewer words than a shingle make one shingle of all
of them; repeated rows and ids take part like others; a null doc_id can't be a
component's smallest unless there is no other.  Only doc_id and text are read, so
no other column can clash.  A text is hashed in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored, text_slices
from .components import components

WORDS = 3
SEED = 42
BUDGET = 2
NODE = 4096  # distinct fingerprints under a node that one task walks
BITS = 64
PIECE = 1 << 20
BATCH_BYTES = 4 << 20
#: Lower-cases A-Z only; words end at blanks and bytes 9 to 13, as bytes.split() has it.
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def _pieces(text: bytes, size: int):
    """The words of ``text``, a bounded run of bytes at a time."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, words: int = WORDS, piece: int = PIECE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    ones, total = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    carried: list[bytes] = []
    seen = 0
    for own in _pieces(text.translate(_LOWER), piece):
        seen += len(own)
        own = carried + own
        if len(own) >= words:
            joined, ends = b" ".join(own), np.cumsum([len(w) + 1 for w in own])
            starts = [0, *ends[: len(own) - words].tolist()]
            stops = (ends[words - 1 :] - 1).tolist()
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
            for i in range(0, len(hashes), 1 << 14):
                bits = np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carried = own[len(own) - words + 1 :] if len(own) >= words else own
    if 0 < seen < words:
        ones, total = np.array([digest(b" ".join(carried), SEED) >> BITS - 1 - i & 1 for i in range(BITS)], np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``documents`` -> doc_id, print (the fingerprint's bits as a signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [fingerprint(t, words) for _, texts in text_slices(batch.column(1), BATCH_BYTES) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("print", T.LongType())]))


def runs_of(bits: list[int], parts: int = BUDGET + 1) -> list[list[int]]:
    """``bits`` cut into runs of nearly equal length."""
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def order_of(path: tuple[int, ...]) -> tuple[list[int], int]:
    """The order of bits (0: highest) in the trie of ``path``, and how many of them stand above its nodes.

    Each entry of ``path`` puts one run of the bits below on top.
    """
    fixed: list[int] = []
    below = list(range(BITS))
    for r in path:
        run = runs_of(below)[r]
        fixed += run
        below = [b for b in below if b not in set(run)]
    return fixed + below, len(fixed)


def in_order(prints: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with their bits in the order of a trie."""
    out = np.zeros(len(prints), np.uint64)
    for to, at in enumerate(order):
        out |= (prints >> np.uint64(BITS - 1 - at) & np.uint64(1)) << np.uint64(BITS - 1 - to)
    return out


def trie_pairs(keys: np.ndarray, groups: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places within a group whose keys differ in 1 to ``budget`` bits.

    ``keys`` are distinct and sorted within their groups, ``groups`` holds each
    group's first place and the end; keys of a group agree above ``depth``.  All
    groups' tries are walked together, a level at a time: a node is a range of
    places, a pair of nodes has the number of bits in which their paths differ.
    """
    lo, hi = groups[:-1], groups[1:]
    keep = hi - lo > 1
    a0, a1 = lo[keep], hi[keep]
    b0, b1 = a0, a1
    diff = np.zeros(len(a0), np.int64)
    found_i, found_j = [], []
    ones = np.zeros(len(keys) + 1, np.int64)
    for level in range(depth, BITS + 1):
        # Two single fingerprints: the rest of both paths in one comparison.
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            near &= i != j
            found_i.append(i[near])
            found_j.append(j[near])
            a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
        if not len(a0) or level == BITS:
            break
        np.cumsum(keys >> np.uint64(BITS - 1 - level) & np.uint64(1), out=ones[1:], dtype=np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        children = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am[~own], a1[~own], b0[~own], bm[~own], diff[~own] + 1)]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, diff = (x[alive] for x in (a0, a1, b0, b1, diff))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(found_i), join(found_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of 0..n-1 the least that each can reach by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        x, y = root[i], root[j]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != (up := root[root])).any():
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _mask(path: tuple[int, ...]) -> int:
    """The bits above the nodes of a trie, as a signed long."""
    order, depth = order_of(path)
    held = sum(1 << BITS - 1 - b for b in order[:depth])
    return held - (1 << BITS) if held >> BITS - 1 else held


def _keyed(members: DataFrame, paths: list[tuple[int, ...]]) -> DataFrame:
    """trie (index of the path), node (its fixed bits, the others 0), print.

    A member of trie t (t = 0 at the start) goes to the tries t * parts, t * parts + 1, ...
    """
    parts = BUDGET + 1
    masks = F.array(*(F.lit(_mask(p)).cast("long") for p in paths))
    node = lambda r: F.struct((F.col("trie") * parts + r).alias("trie"), F.col("print").bitwiseAND(F.element_at(masks, F.col("trie") * parts + r + 1)).alias("node"))
    return members.select(F.explode(F.array(*map(node, range(parts)))).alias("n"), "print").select("n.trie", "n.node", "print")


def _walk(members: DataFrame, paths: list[tuple[int, ...]], budget: int) -> DataFrame:
    """Forests of links (a, b: long) of all nodes of ``members`` (trie, node, print)."""
    orders = [order_of(p) for p in paths]

    def links(trie, node, prints):
        order, depth = orders[trie]
        keys = in_order(prints, order)
        # Nodes differ above ``depth``, so sorting by key keeps each one's members together.
        by = np.argsort(keys)
        keys, node, prints = keys[by], node[by], prints[by]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        i, j = trie_pairs(keys, np.append(start, len(keys)), depth, budget)
        root = forest(len(keys), i, j)
        moved = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(prints[moved].view(np.int64)), pa.array(prints[root[moved]].view(np.int64))], names=["a", "b"])

    def run(batches):
        """Rows come sorted by trie and node; the last node of a batch waits for the next one."""
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            whole = int(np.argmax(last))
            held = [x[whole:] for x in now]
            if whole:
                yield from walk([x[:whole] for x in now])
        if held is not None:
            yield from walk(held)

    def walk(rows):
        for trie in np.unique(rows[0]):
            own = rows[0] == trie
            yield links(int(trie), rows[1][own], rows[2][own].view(np.uint64))

    return members.repartition("trie", "node").sortWithinPartitions("trie", "node").mapInArrow(run, "a long, b long")


def near_prints(prints: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """Distinct fingerprints (print) -> links (a, b) that connect what all links connect.

    Links are between fingerprints that differ in at most ``budget`` bits (2, as
    the runs are made for it).  Nodes of more than ``node`` members go deeper.
    """
    if budget != BUDGET:
        raise ValueError(f"the tries are made for {BUDGET} differing bits")
    paths: list[tuple[int, ...]] = [(r,) for r in range(BUDGET + 1)]
    members = _keyed(prints.select(F.lit(0).alias("trie"), "print"), paths)
    found = []
    while True:
        deepest = BITS - order_of(paths[0])[1] <= 12  # such nodes hold 4096 at most
        members = stored(members)
        sizes = members.groupBy("trie", "node").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        sizes = stored(sizes.withColumn("large", F.lit(False) if deepest else F.col("m") > node))
        found.append(stored(_walk(members.join(sizes.where("not large").select("trie", "node"), ["trie", "node"]), paths, budget)))
        if not sizes.where("large").limit(1).count():
            break
        paths = [(*p, r) for p in paths for r in range(BUDGET + 1)]
        members = _keyed(members.join(sizes.where("large").select("trie", "node"), ["trie", "node"]), paths)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, node: int = NODE) -> DataFrame:
    """``documents`` -> doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = stored(with_fingerprints(docs, words))
    heads = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(near_prints(heads.select("print"), node=node)).withColumnRenamed("node", "print")
    placed = stored(heads.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written out, so that the last join has no aggregate above its shuffle and a hot fingerprint can be split.
    named = stored(placed.join(least, "root").select("print", "component_id"))
    return rows.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
