"""N-gram Jaccard join by multiple global orders.

A text's set is its distinct word shingles.  Two sets whose Jaccard similarity
reaches t share a token among the first |x| - ceil(t |x|) + 1 tokens of both
under *every* total order of all tokens.  Two orders serve: by document
frequency, then token; by the frequency's bit length, then another permutation
of the tokens.

1. One pass makes the sets.  Tasks send their tokens, sorted and packed, to the
   parts of the token range (``packed_tokens``); a part counts documents exactly
   and answers only for tokens that more than one of them holds (``count_parts``).
   A set keeps those tokens: all others come first in both orders and can't be
   shared.  A set whose prefix has no shared token is done: it links with nothing.
2. The others meet in lists of their first order's prefix tokens, as ids only.
   Lists are linked through their smallest class, their components are cells;
   inside each cell the second order's lists split it again.  Similar classes
   share both kinds of list, so they share the final cell.
3. In a cell of bounded size the pairs that pass both prefix filters (and the
   size filter) are verified.  In a larger one every class is compared with a
   central one, the hub.  A class x that the hub c does not link can only link
   to a y of the cell with |x & y| >= k = ceil(t' (|x| + |y|)), and at most
   |x & c| of these tokens lie in c: so y shares one of the first
   |x - c| - (k - |x & c|) + 1 tokens of x outside c.  Short lists of such tokens
   give pairs to verify, long ones make smaller cells for another round.  The few
   x with |x & c| >= k, and what is still large after ``ROUNDS``, are compared in
   blocks.
4. Components of the found links, with the smallest doc_id of each.

Nothing is capped: all prefix tokens and all pairs that could still link are
looked at.  Shuffles are tokens once (about 6 bytes each), the shared ones once
more, and the few classes in cells.

Defined results: null texts and texts without words have an empty set, 0
shingles and stand alone; fewer words than a shingle make one shingle; repeated
rows and ids take part like others; a null doc_id can't be a component's
smallest unless there is no other.  ``near_duplicates`` carries no extra columns,
``one_of_each_component`` all of them, whatever their names.  The table must give
the same rows in the same order when a task is run again, as files do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, mix64, row_key, stored, text_slices
from .components import components
from .shingles import WORDS, shingle_sets

THRESHOLD = 80  # percent
TOKEN_BITS = 48
BATCH_BYTES = 400_000
FLUSH_TOKENS = 1_500_000
FLUSH_SETS = 60_000  # and up to 4096 more; a set's number in its flush takes 16 bits
PART_BYTES = 8_000_000  # of text whose tokens make a part
CELL = 256  # classes in a cell that one task compares
CELL_TOKENS = 1_000_000
ROUNDS = 8
LIST = 64  # members of a list whose pairs are verified one by one
SEEN = 200_000  # classes a task remembers; a forgotten one is merely sent again

_LOW = np.uint64((1 << TOKEN_BITS) - 1)


def class_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int((mix64(mix64(tokens).sum(dtype=np.uint64)[None] + np.uint64(len(tokens)))).view(np.int64)[0])


def part_base(part: int, parts: int) -> np.uint64:
    """The smallest token that a part can hold."""
    return np.uint64(-(-(part << 32) // parts) << TOKEN_BITS - 32)


def deltas(tokens: np.ndarray, base: np.uint64) -> bytes:
    """Sorted tokens as differences of four bytes, or eight if one needs more."""
    d = np.diff(tokens, prepend=base)
    return d.astype(np.uint32).tobytes() if not len(d) or d.max() < 1 << 32 else d.tobytes()


def undeltas(data: bytes, n: int, base: np.uint64) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.uint64), dtype=np.uint64) + base


def level(documents: np.ndarray) -> np.ndarray:
    """A document frequency in one byte, eight steps a doubling."""
    return np.minimum(255, np.round(8 * np.log2(documents.astype(np.float64)))).astype(np.uint8)


# kind 0: a document; kind 1: tokens (with their sets' numbers, later levels) of a flush.
_PACKED = "key int, flush long, kind int, owner int, row_a long, row_b int, n long, class long, tokens binary, owners binary, levels binary"


def _packed_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(_PACKED), docs.schema["doc_id"]])


def _token_rows(key, flush, tokens, owners, levels, schema: pa.Schema) -> pa.RecordBatch:
    n = len(tokens)
    null = lambda t: pa.nulls(n, t)
    made = {"key": pa.array(key, pa.int32()), "flush": pa.array(flush, pa.int64()), "kind": pa.array([1] * n, pa.int32()), "tokens": pa.array(tokens, pa.binary()), "owners": pa.array(owners, pa.binary()), "levels": pa.array(levels, pa.binary())}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else null(f.type) for f in schema], schema=schema)


def packed_tokens(docs: DataFrame, parts: int, words: int = WORDS) -> DataFrame:
    """A row for each document and, for each flush and part, one with all its tokens.

    The token range is cut into ``parts`` equal parts.  ``owner`` numbers the sets
    of a flush; it is null for empty sets and those the task has sent before.
    """

    def run(batches):
        seen: set[int] = set()
        pid, nth = TaskContext.get().partitionId(), 0
        rows, tokens, schema = [], [], None

        def flush():
            name = np.concatenate([r[1].to_numpy() for r in rows]).view(np.uint64)
            name = int(mix64(mix64(name + np.arange(len(name), dtype=np.uint64)).sum(dtype=np.uint64)[None] + np.uint64(pid << 32 | nth)).view(np.int64)[0])
            key = name % parts
            for doc_id, row_a, row_b, n, own, owner in rows:
                made = {"key": pa.array(np.full(len(n), key, np.int32)), "flush": pa.array(np.full(len(n), name, np.int64)), "kind": pa.array(np.zeros(len(n), np.int32)), "owner": owner, "row_a": row_a, "row_b": row_b, "n": n, "class": own, "doc_id": doc_id}
                yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(n), f.type)) for f in schema], schema=schema)
            if tokens:
                flat = np.concatenate(tokens)
                owners = np.repeat(np.arange(len(tokens), dtype=np.uint16), [len(t) for t in tokens])
                order = np.argsort(flat, kind="stable")
                flat, owners = flat[order], owners[order]
                new = np.ones(len(flat), bool)
                new[1:] = (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1])
                flat, owners = flat[new], owners[new]
                ends = np.searchsorted(_part_of(flat, parts), np.arange(parts + 1))
                own = np.flatnonzero(np.diff(ends)).tolist()
                yield _token_rows(own, [name] * len(own), [deltas(flat[ends[p] : ends[p + 1]], part_base(p, parts)) for p in own], [owners[ends[p] : ends[p + 1]].tobytes() for p in own], [None] * len(own), schema)

        total = 0
        for batch in batches:
            if schema is None:
                doc_id = batch.schema.field("doc_id")
                kinds = {"key": pa.int32(), "flush": pa.int64(), "kind": pa.int32(), "owner": pa.int32(), "row_a": pa.int64(), "row_b": pa.int32(), "n": pa.int64(), "class": pa.int64(), "tokens": pa.binary(), "owners": pa.binary(), "levels": pa.binary()}
                schema = pa.schema([*kinds.items(), ("doc_id", doc_id.type)])
            for a, texts in text_slices(batch.column(3), BATCH_BYTES):
                made = shingle_sets(texts, words)
                for low in range(0, len(made), 4096):
                    sets = made[low : low + 4096]
                    own, owner = [], []
                    for s in sets:
                        c = class_id(s) if len(s) else None
                        own.append(c)
                        if c is None or c in seen:
                            owner.append(None)
                            continue
                        if len(seen) < SEEN:
                            seen.add(c)
                        owner.append(len(tokens))
                        tokens.append(s >> np.uint64(64 - TOKEN_BITS))
                        total += len(s)
                    rows.append([*(batch.column(i).slice(a + low, len(sets)) for i in range(3)), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()), pa.array(owner, pa.int32())])
                    if total >= FLUSH_TOKENS or len(tokens) >= FLUSH_SETS:
                        yield from flush()
                        rows, tokens, total, nth = [], [], 0, nth + 1
        if rows:
            yield from flush()

    return docs.select("doc_id", *row_key(), "text").mapInArrow(run, _packed_schema(docs))


def _part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (tokens >> np.uint64(TOKEN_BITS - 32)) * np.uint64(parts) >> np.uint64(32)


def count_parts(packed: DataFrame, parts: int) -> DataFrame:
    """Token rows of ``packed`` with only the tokens that several documents hold, and their levels."""

    def run(batches):
        def answer(key, flush, tokens, owners, schema):
            sizes, base = [len(o) // 2 for o in owners], part_base(key, parts)
            flat = np.concatenate([undeltas(t, n, base) for t, n in zip(tokens, sizes, strict=True)])
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            first = np.ones(len(flat), bool)
            first[1:] = ranked[1:] != ranked[:-1]
            head = np.flatnonzero(first)
            many = np.diff(np.append(head, len(flat)))
            levels = np.zeros(len(flat), np.uint8)
            levels[order] = np.repeat(np.where(many > 1, level(many), 0), many)
            at, out = 0, []
            for f, o, n in zip(flush, owners, sizes, strict=True):
                own = levels[at : at + n]
                keep = own > 0
                if keep.any():
                    out.append((f, deltas(flat[at : at + n][keep], base), np.frombuffer(o, np.uint16)[keep].tobytes(), own[keep].tobytes()))
                at += n
            if out:
                yield _token_rows([key] * len(out), *map(list, zip(*out, strict=True)), schema)

        now, held = None, []
        for batch in batches:
            kind = batch.column(2).to_numpy()
            yield batch.filter(pa.array(kind == 0))
            few = batch.filter(pa.array(kind == 1))
            for key, *row in zip(*(few.column(n).to_pylist() for n in ("key", "flush", "tokens", "owners")), strict=True):
                if key != now:
                    if held:
                        yield from answer(now, *zip(*held, strict=True), batch.schema)
                    now, held = key, []
                held.append(row)
        if held:
            yield from answer(now, *zip(*held, strict=True), batch.schema)

    return packed.repartition(parts, "key").sortWithinPartitions("kind", "key", "flush").mapInArrow(run, packed.schema)


def prefix_size(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-n * threshold // 100) + 1


def needed(n: int, kept: int, threshold: int = THRESHOLD) -> int:
    """How many of a set's ``kept`` shared tokens its prefix reaches."""
    return max(0, prefix_size(n, threshold) - (n - kept))


def shared_sets(answers: DataFrame, parts: int, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row_a, row_b, n, class of every document; tokens, levels, weight where the prefix has a shared token.

    ``weight`` is the mean level of the set, high for a text that copies derive from.
    """
    kept = ["doc_id", "row_a", "row_b", "n", "class"]
    out = T.StructType([*(answers.schema[c] for c in kept), *T.StructType.fromDDL("tokens binary, levels binary, weight double")])

    def run(batches):
        def solve(rows, keys, tokens, owners, levels):
            if not rows:
                raise RuntimeError("a task was run again and gave other rows; write the table to files first")
            n_sets = sum(len(r) - r.column("owner").null_count for r in rows)
            if tokens:
                sizes = [len(o) // 2 for o in owners]
                flat = np.concatenate([undeltas(t, n, part_base(k, parts)) for k, t, n in zip(keys, tokens, sizes, strict=True)])
                whose = np.frombuffer(b"".join(owners), np.uint16)
                own = np.frombuffer(b"".join(levels), np.uint8)
                order = np.lexsort((flat, whose))
                flat, whose, own = flat[order], whose[order], own[order]
                cut = np.searchsorted(whose, np.arange(n_sets + 1))
            for r in rows:
                made = [[], [], []]
                for n, owner in zip(r.column("n").to_pylist(), r.column("owner").to_pylist(), strict=True):
                    a, b = (cut[owner], cut[owner + 1]) if tokens and owner is not None else (0, 0)
                    if needed(n, b - a, threshold) if b > a else 0:
                        row = (flat[a:b].tobytes(), own[a:b].tobytes(), float(own[a:b].sum()) / n)
                    else:
                        row = (None, None, None)
                    for m, x in zip(made, row, strict=True):
                        m.append(x)
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in kept), *map(pa.array, made, (pa.binary(), pa.binary(), pa.float64()))], names=out.names)

        now, rows, held = None, [], []
        for batch in batches:
            names = batch.column("flush").to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if names[a] != now:
                    if rows or held:
                        yield from solve(rows, *_columns(held))
                    now, rows, held = names[a], [], []
                own = batch.slice(a, b - a)
                kind = own.column("kind").to_numpy()
                if (kind == 0).any():
                    rows.append(own.filter(pa.array(kind == 0)))
                few = own.filter(pa.array(kind == 1))
                held += zip(*(few.column(n).to_pylist() for n in ("key", "tokens", "owners", "levels")), strict=True)
        if rows or held:
            yield from solve(rows, *_columns(held))

    return answers.repartition(parts, "flush").sortWithinPartitions("flush", "kind").mapInArrow(run, out)


def _columns(held: list) -> list:
    return list(zip(*held, strict=True)) if held else [(), (), (), ()]


def order_keys(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys of the tokens under the two global orders; no two tokens share one."""
    first = levels.astype(np.uint64) << np.uint64(TOKEN_BITS) | tokens
    other = tokens * np.uint64(0xD6E8FEB86659FD93) & _LOW
    other ^= other >> np.uint64(23)
    other = other * np.uint64(0x9E3779B97F4A7C15) & _LOW
    second = (levels >> np.uint8(3)).astype(np.uint64) << np.uint64(TOKEN_BITS) | other
    return first, second


def first_by(tokens: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    if n >= len(tokens):
        return tokens
    return tokens[np.argpartition(keys, n - 1)[:n]] if n > 0 else tokens[:0]


def _read(tokens: bytes, levels: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(tokens, np.uint64), np.frombuffer(levels, np.uint8)


def prefix_lists(members: DataFrame, order: int, threshold: int = THRESHOLD) -> DataFrame:
    """within, token, class for the prefix of ``members`` (within, class, n, tokens, levels) under one order."""

    def run(batches):
        for batch in batches:
            out, sizes = [], []
            for n, t, v in zip(*(batch.column(c).to_pylist() for c in ("n", "tokens", "levels")), strict=True):
                tokens, levels = _read(t, v)
                own = first_by(tokens, order_keys(tokens, levels)[order], needed(n, len(tokens), threshold))
                out.append(own)
                sizes.append(len(own))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("within").take(at), pa.array(flat), batch.column("class").take(at)], names=["within", "token", "class"])

    return members.select("within", "class", "n", "tokens", "levels").mapInArrow(run, "within long, token long, class long")


def joined_by_lists(lists: DataFrame) -> DataFrame:
    """class, cell: components of the classes that meet in lists (within, token, class).

    A class is tied to the smallest class of its lists; the smallest classes of its
    other lists are tied to that one.  These ties repeat for all that stand in the
    same lists, so there are about as many as classes.
    """
    keys = ["within", "token"]
    hubs = lists.groupBy(*keys).agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last").select(*keys, "hub")
    met = stored(lists.join(hubs, keys).select("class", "hub").distinct())
    least = met.groupBy("class").agg(F.min("hub").alias("least"))
    ties = met.join(least, "class").select(F.explode(F.array(F.struct(F.col("class").alias("a"), F.col("least").alias("b")), F.struct(F.col("hub").alias("a"), F.col("least").alias("b")))).alias("t"))
    found = components(ties.select("t.a", "t.b")).select(F.col("node").alias("class"), F.col("root").alias("cell"))
    discard(met)
    return found


def _incidence(sets: list[np.ndarray], common: np.ndarray, low: int, width: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
    own = (common[at] == flat) & (at >= low) & (at < low + width)
    out = np.zeros((len(sets), width), np.float32)
    out[rows[own], at[own] - low] = 1
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections, over the tokens that both sides have."""
    out = np.zeros((len(left), len(right)), np.int64)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right)) if left and right else np.zeros(0, np.uint64)
    for low in range(0, len(common), width):
        w = min(width, len(common) - low)
        out += (_incidence(left, common, low, w) @ _incidence(right, common, low, w).T).astype(np.int64)
    return out


def block_links(left: list[tuple], right: list[tuple], threshold: int = THRESHOLD) -> np.ndarray:
    """Matrix of links between two blocks of (n, tokens, levels): all filters intersected, then verification."""
    a, b = np.array([x[0] for x in left]), np.array([x[0] for x in right])
    mask = (a[:, None] * 100 >= threshold * b) & (b * 100 >= threshold * a[:, None])
    for k in range(2):
        tops = [[first_by(t, order_keys(t, v)[k], needed(n, len(t), threshold)) for n, t, v in side] for side in (left, right)]
        mask &= shared_counts(*tops) > 0
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if len(rows):
        both = shared_counts([left[i][1] for i in rows], [right[i][1] for i in columns])
        at = np.ix_(rows, columns)
        mask[at] &= 100 * both >= threshold * (a[rows][:, None] + b[columns] - both)
    return mask


def _forest(found: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Links that span what a matrix of links joins."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(found), strict=True):
        a, b = top(left[i]), top(right[j])
        if a != b:
            up[a] = b
            out.append((left[i], right[j]))
    return out


def _cell_links(members: DataFrame, threshold: int) -> DataFrame:
    """a, b: links inside cells of bounded size."""

    def run(batches):
        def solve(held):
            names = [h[0] for h in held]
            sets = [(h[1], *_read(*h[2:])) for h in held]
            return _forest(block_links(sets, sets, threshold), names, names)

        now, held, out = None, [], []
        for batch in batches:
            for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "class", "n", "tokens", "levels")), strict=True):
                if cell != now:
                    out += solve(held) if len(held) > 1 else []
                    now, held = cell, []
                held.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        out += solve(held) if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return members.select("cell", "class", "n", "tokens", "levels").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def least_overlap(a: int, b: int, threshold: int = THRESHOLD) -> int:
    """Shared tokens that sets of sizes a and b need."""
    return -(-threshold * (a + b) // (100 + threshold))


def _around_hubs(members: DataFrame, threshold: int) -> DataFrame:
    """class, cell, hub, linked, loose, asked, known of every class but the hubs (see the module's step 3).

    ``asked`` are the tokens outside the hub by which an unlinked class finds its
    partners, ``known`` all of them; ``loose`` classes may have partners without any.
    """
    hubs = members.groupBy("cell").agg(F.max_by(F.struct("class", "n", "tokens"), F.struct("weight", "class")).alias("hub"), F.min("n").alias("least"))
    pairs = members.join(hubs, "cell").where(F.col("class") != F.col("hub.class"))
    pairs = pairs.select("cell", "class", "n", "tokens", "levels", F.col("hub.class").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.tokens").alias("hub_tokens"), "least")

    def run(batches):
        for batch in batches:
            made = []
            for n, t, v, hub_n, hub_t, least in zip(*(batch.column(c).to_pylist() for c in ("n", "tokens", "levels", "hub_n", "hub_tokens", "least")), strict=True):
                tokens, levels = _read(t, v)
                inside = np.isin(tokens, np.frombuffer(hub_t, np.uint64))
                both = int(inside.sum())
                linked = 100 * both >= threshold * (n + hub_n - both)
                rest, keys = tokens[~inside], order_keys(tokens[~inside], levels[~inside])[0]
                more = least_overlap(n, max(least, -(-n * threshold // 100)), threshold) - both
                # Tokens that only this document holds come first and are not in ``rest``.
                n_asked = len(rest) - more + 1 if not linked and more > 0 else 0
                asked = first_by(rest, keys, n_asked)
                made.append((linked, not linked and more <= 0, asked.view(np.int64).tolist(), rest.view(np.int64).tolist()))
            columns = list(zip(*made, strict=True)) or [()] * 4
            kinds = (pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "cell", "hub")), *map(pa.array, map(list, columns), kinds)], names=["class", "cell", "hub", "linked", "loose", "asked", "known"])

    return pairs.mapInArrow(run, "class long, cell long, hub long, linked boolean, loose boolean, asked array<long>, known array<long>")


def _block_pairs(members: DataFrame, asking: DataFrame, threshold: int) -> DataFrame:
    """a, b: links between the classes of ``asking`` (cell, class) and all of their cells, block against block."""
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("levels")).alias("t"))
    asked = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("r"))
    half = CELL // 2
    many = F.ceil(F.greatest(F.col("m") / half, F.col("t") * 2 / CELL_TOKENS)).cast("int")
    blocks = stored(sizes.join(asked, "cell").select("cell", many.alias("nk"), F.ceil(F.col("r") * many / F.col("m")).cast("int").alias("nr")))
    columns = ["cell", "k", "j", "asks", "class", "n", "tokens", "levels"]
    own, ask = F.pmod(F.xxhash64("class"), F.col("nk")).cast("int"), F.pmod(F.xxhash64("class", F.lit(1)), F.col("nr")).cast("int")
    placed = members.join(blocks, "cell")
    known = placed.withColumns({"k": own, "asks": F.lit(False)}).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    left = placed.join(asking, ["cell", "class"]).withColumns({"j": ask, "asks": F.lit(True)}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nk") - 1)))
    spread = known.select(*columns).unionByName(left.select(*columns))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["asks"]], pdf[~pdf["asks"]]]
        out = []
        if all(len(s) for s in sides):
            sets = [[(n, *_read(t, v)) for n, t, v in zip(s["n"], s["tokens"], s["levels"], strict=True)] for s in sides]
            out = _forest(block_links(*sets, threshold), *(s["class"].tolist() for s in sides))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return spread.groupBy("cell", "k", "j").applyInPandas(compare, "a long, b long")


def _verified(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link: both orders' prefix filters and the exact comparison."""
    side = lambda c: members.select(F.col("class").alias(c), F.struct("n", "tokens", "levels").alias(f"set_{c}"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                one, two = ((v["n"], *_read(v["tokens"], v["levels"])) for v in (x, y))
                keep.append(bool(block_links([one], [two], threshold)[0, 0]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def links_in_cells(members: DataFrame, threshold: int = THRESHOLD, cell: int = CELL, cell_tokens: int = CELL_TOKENS, rounds: int = ROUNDS, short: int = LIST) -> DataFrame:
    """a, b: links that join all similar classes of ``members`` (cell, class, n, tokens, levels, weight)."""
    found: list[DataFrame] = []
    for turn in range(rounds + 1):
        sizes = stored(members.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("levels")).alias("t")).where("m > 1"))
        small = (F.col("m") <= cell) & (F.col("t") <= cell_tokens)
        found.append(stored(_cell_links(members.join(sizes.where(small).select("cell"), "cell"), threshold)))
        if not sizes.where(~small).limit(1).count():
            break
        large = stored(members.join(sizes.where(~small).select("cell"), "cell"))
        if turn == rounds:
            found.append(stored(_block_pairs(large, large.select("cell", "class"), threshold)))
            break
        star = stored(_around_hubs(large, threshold))
        found.append(star.where("linked").select(F.col("class").alias("a"), F.col("hub").alias("b")))
        if star.where("loose").limit(1).count():
            found.append(stored(_block_pairs(large, star.where("loose").select("cell", "class"), threshold)))
        keys = ["within", "token"]
        asked = star.select(F.col("cell").alias("within"), F.explode("asked").alias("token"), "class")
        known = star.select(F.col("cell").alias("within"), F.explode("known").alias("token"), "class")
        lists = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).join(asked.select(*keys).distinct(), keys).where("size > 1")
        lists = stored(lists)
        few = lists.where(F.col("size") <= short).select(*keys)
        pairs = asked.join(few, keys).withColumnRenamed("class", "a").join(known.withColumnRenamed("class", "b"), keys).where("a <> b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found.append(stored(_verified(pairs, large.select("class", "n", "tokens", "levels"), threshold)))
        cells = joined_by_lists(known.join(lists.where(F.col("size") > short).select(*keys), keys).select(*keys, "class"))
        members = stored(large.drop("cell").join(cells, "class"))
        discard(large, sizes, lists)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def similarity_rows(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, **options) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_a, row_b, n, class of every row; class, root of the classes that have links)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(8, -(-size // PART_BYTES))
    sets = stored(shared_sets(count_parts(packed_tokens(docs, parts, words), parts), parts, threshold))
    rows = sets.select("doc_id", "row_a", "row_b", "n", "class")
    # One row stands for each class; its copies in other tasks have equal sets.
    members = stored(sets.where("tokens is not null").groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "levels", "weight"))))
    cells = joined_by_lists(prefix_lists(members.withColumn("within", F.lit(0).cast("long")), 0, threshold))
    inside = stored(members.join(cells.withColumnRenamed("cell", "within"), "class"))
    cells = joined_by_lists(prefix_lists(inside, 1, threshold))
    links = links_in_cells(stored(members.join(cells, "class")), threshold, **options)
    return rows, components(links).select(F.col("node").alias("class"), "root")


def similarity_components(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, **options) -> DataFrame:
    """doc_id, row_a, row_b, n, component_id for every row of ``docs`` (doc_id, text)."""
    rows, roots = similarity_rows(docs, threshold, words, **options)
    heads = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = stored(heads.join(roots, "class", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "class")))
    least = heads.groupBy("root").agg(F.min("head").alias("component_id"))
    named = stored(heads.join(least, "root").select("class", "component_id"))
    return rows.join(named, "class", "left").select("doc_id", "row_a", "row_b", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``documents`` -> doc_id, n_shingles, component_id."""
    return similarity_components(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_component(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id; rows without words all stay."""
    rows, roots = similarity_rows(docs, **options)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_a", "row_b").alias("row")
    # Copies of a class are reduced first, so that a class of many copies is one row in its component.
    heads = rows.where("class is not null").groupBy("class").agg(F.min(row).alias("row")).join(roots, "class", "left")
    first = heads.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("row").alias("row")).select("row.row_a", "row.row_b", F.lit(True).alias("once"))
    kept = stored(first.unionByName(rows.where("class is null").select("row_a", "row_b", F.lit(False).alias("once")).distinct()))
    named = docs.select(*row_key(), F.struct(*docs.columns).alias("doc")).join(kept, ["row_a", "row_b"])
    nth = F.row_number().over(Window.partitionBy("row_a", "row_b").orderBy("once"))
    return named.withColumn("nth", nth).where("nth = 1 or not once").select("doc.*")
