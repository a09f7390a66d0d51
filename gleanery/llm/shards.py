"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are never split.  Only the histogram of their sizes reaches
the driver: it has no more than sqrt(2 * bytes) rows, since so many different sizes
already add up to all bytes.  The driver packs it: sizes fall, and each group
enters the bin with the tightest remaining capacity that still holds it, found in
a balanced tree.  Groups of one size that follow each other into a bin are placed
at once, as that bin stays the tightest while it holds them.  The capacity is the
smallest (by bisection) for which the shards suffice, which makes their sizes near
equal; a group above an equal share gets a shard alone and the rest share what is
left.

A size whose groups all go to one shard gives them that shard; where they go to
several, a group's rank inside its size (by hash cells, so that no task needs all
groups of a size) says to which.

Rows are numbered inside their shard without gathering it: shard and a hash cell
give bounded counts, their prefix sums are the offsets, and ``row_number`` runs
inside a cell.

Defined results: null text has no bytes and groups with empty ones; an empty
table gives no rows; repeated rows are rows of the same group and get slots of
their own; ties break by the group's hash; other columns stay (see ``common``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hidden, row_key, shown, stored

SHARDS = 24
CELLS = 256
FEW = 20_000  # rows of the driver's tables up to which they are broadcast


class Tree:
    """Size-balanced by construction: a treap of (remaining, bin) with hashed priorities."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        node = [key, hash((key, 0x9E3779B9)), None, None]
        self.root = self._join(self._join(low, node), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(low, high)

    def ceiling(self, key: tuple[int, int]):
        """The smallest key not below ``key``, or None."""
        node, best = self.root, None
        while node:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        """Trees of the keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._join(a[3], b)]
        return [b[0], b[1], self._join(a, b[2]), b[3]]


def best_fit(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(size, bin, number) runs in the order of placing; ``sizes`` are (size, number), falling, none above ``capacity``."""
    tree, bins, out = Tree(), 0, []
    for size, many in sizes:
        while many:
            found = tree.ceiling((size, -1))
            if found is None:
                remaining, b = capacity, bins
                bins += 1
            else:
                remaining, b = found
                tree.remove(found)
            now = min(many, remaining // size) if size else many
            tree.insert((remaining - now * size, b))
            out.append((size, b, now))
            many -= now
    return out


def pack(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, number) runs for a histogram, with shard sizes as near equal as whole groups allow."""
    left = sorted(([s, n] for s, n in sizes if n), reverse=True)
    out: list[tuple[int, int, int]] = []
    total, used = sum(s * n for s, n in left), 0
    while left and used < shards - 1 and left[0][0] * (shards - used) > total:
        size = left[0][0]
        out.append((size, used, 1))
        total, used = total - size, used + 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    if not left:
        return out
    rest, room = [(s, n) for s, n in left], shards - used
    low, high = max(rest[0][0], -(-total // room)), max(total, 1)
    fits = lambda c: max(b for _, b, _ in best_fit(rest, c)) < room
    step = max(1, low // 2000)
    while low + step < high and not fits(low + step):  # the answer is nearly always close to an equal share
        low, step = low + step + 1, step * 2
    high = min(high, low + step)
    while high - low > low // 5000:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return out + [(s, used + b, n) for s, b, n in best_fit(rest, high)]


def numbered(df: DataFrame, order: list, cells: int = CELLS) -> DataFrame:
    """Add ``slot``: gapless from 0 inside each ``shard``, in one shuffle of the rows.

    Needs row_a (a hash of the row) and shard.
    """
    celled = df.withColumn("cell", F.pmod(F.col("row_a"), F.lit(cells)).cast("int"))
    counts = celled.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy(*order)
    return celled.withColumn("at", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "cell"]).withColumn("slot", F.col("offset") + F.col("at") - 1).drop("cell", "at", "offset")


def assign_shards(df: DataFrame, group, size, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` to ``df``; rows with one value of ``group`` stay together.

    ``group`` is a 64-bit column expression (groups that share a value stay
    together, so a hash serves) and ``size`` a long one.
    """
    spark = df.sparkSession
    own, weight = ("_" * max(map(len, df.columns)) + x for x in ("_group", "_size"))  # longer than any other name
    keyed = hidden(df.withColumns({own: group, weight: size}), own, weight).withColumnsRenamed({own: "own", weight: "weight"})
    groups = stored(keyed.groupBy(F.col("own").alias("group")).agg(F.sum("weight").alias("bytes")))
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most sqrt(2 * all bytes) rows
    runs: dict[int, list[tuple[int, int]]] = {}
    for s, b, n in pack(sizes, shards):
        runs.setdefault(s, []).append((b, n))
    one = [(s, own[0][0]) for s, own in runs.items() if len({b for b, _ in own}) == 1]
    several, first = [], 0
    for s, own in runs.items():
        if len({b for b, _ in own}) > 1:
            first = 0
            for b, n in own:
                several.append((s, first, first + n, b))
                first += n
    table = lambda rows, ddl: (F.broadcast if len(rows) <= FEW else lambda x: x)(spark.createDataFrame(rows, ddl))
    whole = groups.join(table(one, "bytes long, shard int"), "bytes").select("group", "shard")
    split = groups.join(table(sorted({(r[0],) for r in several}), "bytes long"), "bytes").withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(CELLS)).cast("int"))
    counts = split.groupBy("bytes", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bytes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bytes", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("group"))
    ranked = split.withColumn("at", nth).join(offsets, ["bytes", "cell"]).select("bytes", "group", (F.col("offset") + F.col("at") - 1).alias("rank"))
    places = table(several, "bytes long, first long, stop long, shard int")
    split = ranked.join(places, "bytes").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))).select("group", "shard")
    placed = stored(whole.unionByName(split))
    discard(groups)
    return keyed.join(placed, F.col("own") == F.col("group")).select(*shown(df.columns, without=("shard",)), "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``documents`` -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_group"),
        row_key()[0],
    )
    placed = assign_shards(rows, F.col("text_group"), F.col("size"), shards)
    out = numbered(placed, ["doc_id", "text_group"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
