"""Spelling variants grouped through an index of variable-length grams.

1. Words are counted over all texts (``word_counts``).
2. A gram dictionary is built and pruned by frequency: a gram that more than
   ``line`` places of the words have is frequent, and only frequent grams are
   extended (``frequent_grams``; ``line`` is at least ``LINE`` and high enough that
   at most ``DICTIONARY`` grams of each length are frequent, which bounds what is
   broadcast).
3. A word is decomposed into one gram for each of its places: the shortest one of
   at least ``SHORTEST`` and at most ``LONGEST`` code points that is not frequent;
   at the word's end it may be frequent and shorter (``decompose``).  What
   a gram is depends on its own characters alone, so one edit changes only grams
   that hold its place; the largest number that any edit can change is the word's
   affected-gram bound.
4. If two words are near, all grams of the one but those affected also stand in the
   other, at most one place away.  Under one order of all grams (rare first) the
   first of the unaffected ones stands among the first bound + 1 grams of both.
   Only the lists of those are merged; a list member meets members whose length
   and place fit.  A list of a frequent gram has no bound: it is cut by what stands before
   the gram, and again by what stands behind it, as one edit leaves one of both sides
   as it is.
5. Each candidate pair is verified once by its edit distance.

All of it is exact for words of at least SHORTEST + LONGEST code points.

Defined results: null and empty texts have no words; a null doc_id is written as
an empty one where the text is changed by its number; repeated rows count as
often as they stand; ties of n are broken by code-point order.  Only doc_id and
text are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, stored

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST, LONGEST = 2, 5  # code points of a gram
LINE = 48  # places of words that share a gram which is not frequent
DICTIONARY = 200_000  # frequent grams of each length at most
LEAST_LENGTH, LEAST_TIMES, DOMINANT = 7, 2, 10
SLIPS = 31  # one in so many runs of a document loses a letter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column) -> Column:
    """``run`` without one code point if SLIPS divides the checksum of ``doc_id:run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n of all words of ``docs`` (doc_id, text) that are long and frequent enough."""
    # Runs that are too short stay so without a letter; the longest match is the whole run.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), F.translate("run", UPPER, LOWER)).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def frequent_grams(words: DataFrame, line: int = LINE, most: int = DICTIONARY, shortest: int = SHORTEST, longest: int = LONGEST) -> dict[str, int]:
    """The frequent grams of each length, with the number of places that have them.

    Fewer than places / line grams of a length can be frequent, so the line that
    is taken keeps them below ``most``.
    """
    places = words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0]
    line = max(line, -(-places // most))
    found: dict[str, int] = {}
    spark = words.sparkSession
    for length in range(shortest, longest + 1):
        cut = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - length + 1), lambda i: F.substring(F.col("word"), i, F.lit(length)))).alias("gram"))
        if length > shortest:  # a gram is frequent only if the one before its last character is
            shorter = F.broadcast(spark.createDataFrame([(g,) for g in found if len(g) == length - 1], "start string"))
            cut = cut.join(shorter, F.substring("gram", 1, length - 1) == F.col("start"), "left_semi")
        rows = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > line).collect()
        if not rows:
            break
        found |= {r["gram"]: r["places"] for r in rows}
    return found


def decompose(word: str, frequent, shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, end) of the gram at each place of ``word`` that has one."""
    n, out = len(word), []
    for i in range(n - shortest + 1):
        j, last = i + shortest, min(n, i + longest)
        while j < last and word[i:j] in frequent:
            j += 1
        out.append((i, j))
    return out


def affected_bound(word: str, grams: list[tuple[int, int]], frequent, longest: int = LONGEST) -> int:
    """The largest number of ``grams`` that one edit of ``word`` can change."""
    n = len(word)
    held, inside = [0] * (n + 1), [0] * (n + 1)
    for i, j in grams:
        for p in range(i, j):
            held[p] += 1  # the character at p replaced or deleted
        for p in range(i + 1, j):
            inside[p] += 1  # one inserted before p
        if j == n and j - i < longest and word[i:j] in frequent:
            inside[n] += 1  # one inserted at the end would make it longer
    return max(*held, *inside)


def _listed(words: DataFrame, frequent: dict[str, int], shortest: int, longest: int) -> DataFrame:
    """word, n, size, place and a list's key for the first grams of each word."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches):
        places = shared.value
        for batch in batches:
            out = [], [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = decompose(word, places, shortest, longest)
                bound = affected_bound(word, grams, places, longest)
                order = sorted((places.get(word[i:j], 0), word[i:j]) for i, j in grams)
                first = {g for _, g in order[: bound + 1]}
                keys = []
                for i, j in grams:
                    g = word[i:j]
                    if g in first:
                        keys += [(i, f"<{word[:j]}|{i}"), (i, f">{word[i:]}|{i - len(word)}")] if g in places else [(i, f"={g}")]
                for x, y in zip(out, ([word] * len(keys), [n] * len(keys), [len(word)] * len(keys), [i for i, _ in keys], [k for _, k in keys]), strict=True):
                    x += y
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["word", "n", "size", "place", "key"])

    bounded_batches(spark)
    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, place int, key string")


def near_words(words: DataFrame, line: int = LINE, most: int = DICTIONARY, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Pairs a < b of ``words`` (word, n; distinct, of at least shortest + longest code points) one edit apart: a, n_a, b, n_b."""
    if words.where(F.char_length("word") < shortest + longest).limit(1).count():
        raise ValueError(f"words must have at least {shortest + longest} code points")
    listed = _listed(words, frequent_grams(words, line, most, shortest, longest), shortest, longest)
    # Keys meet by their hash: short rows, and what a collision adds isn't near.
    listed = stored(listed.select(F.xxhash64("key").alias("key"), "word", "n", "size", "place"))
    left = listed.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    right = listed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    # One edit leaves a gram where it was, counted from the start or from the end.
    aligned = (F.col("place_a") == F.col("place_b")) | (F.col("place_a") - F.col("size_a") == F.col("place_b") - F.col("size_b"))
    fits = aligned & (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & (F.col("a") < F.col("b"))
    pairs = left.join(right, "key").where(fits & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def spelling_forms(words: DataFrame, dominant: int = DOMINANT, **options) -> DataFrame:
    """``words`` (word, n) -> word, form, root, n, n_near, form_n.

    n rises at least ``dominant`` times from a word to its form, so the way to the
    last has at most 18 steps and five rounds of pointer jumping follow it.
    """
    if dominant < 2:
        raise ValueError("a form must be more frequent than its word")
    pairs = stored(near_words(words, **options))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("near")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= dominant * F.col("n"), -F.col("best.m")))
    rows = stored(chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"))
    ends = stored(rows.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while ends.where("moved").limit(1).count():
        above = ends.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = stored(ends.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        discard(ends)
        ends = jumped
    return rows.join(ends.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``documents`` -> one row for each word: word, form, root, n, n_near, form_n."""
    return spelling_forms(stored(word_counts(docs.select("doc_id", "text"))))
