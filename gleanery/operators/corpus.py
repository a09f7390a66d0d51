"""Sentence corpus from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip, tolerant_int
from ..sources.jsonl import dense_index

BUCKET = 10_000


def sentences(pages: DataFrame, min_chars: int, limit_pages: int | None = None) -> DataFrame:
    """One row a sentence of every page: ord, id, place, sentence_id, text, long_enough.

    ``pages`` has ord, id, text, lines.  Pages without an id, and pages without
    any line or text, give one row without a place.
    """
    if limit_pages is not None:
        pages = pages.where(F.col("ord") <= limit_pages)
    from_lines = F.transform(
        lines(F.col("lines")),
        lambda line, i: F.struct(
            tolerant_int(F.split(line, "\t", -1)[0], i).alias("sentence_id"),
            strip(F.coalesce(F.try_element_at(F.split(line, "\t", -1), F.lit(2)), line)).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("sentence_id"), strip(F.col("text")).alias("text")))
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    found = F.when(F.coalesce(F.col("id"), F.lit("")) == "", None).when(filled("lines"), from_lines).when(filled("text"), whole)
    rows = pages.select("ord", "id", F.posexplode_outer(found).alias("place", "s"))
    return rows.select("ord", "id", "place", F.col("s.sentence_id").alias("sentence_id"), F.col("s.text").alias("text"), F.coalesce(F.char_length("s.text") >= min_chars, F.lit(False)).alias("long_enough"))


def sentence_corpus(pages: DataFrame, min_chars: int = 5, limit_pages: int | None = None) -> DataFrame:
    """Passages with ids ``feverwiki_00000001_sent_0000``, numbered over all pages in order."""
    kept = sentences(pages, min_chars, limit_pages).where("long_enough")
    numbered = dense_index(kept, F.floor(F.col("ord") / BUCKET), ["ord", "place"], "number")
    return numbered.select(
        F.format_string("feverwiki_%08d_sent_%04d", "number", "sentence_id").alias("doc_id"),
        F.col("id").alias("title"),
        "text",
        F.struct(F.lit("fever_wiki_pages").alias("source"), F.col("id").alias("page_id"), F.col("sentence_id").alias("sentence_id")).alias("meta"),
    )


def keyed_sentences(pages: DataFrame, min_chars: int = 5) -> DataFrame:
    """key, id, sentence_id, text of the passages; ``key`` is a number that rises with page and place, which needs no shuffle (not dense; ``ord`` from 0 to 2^32 - 1)."""
    kept = sentences(pages, min_chars).where("long_enough")
    ord_ = F.when(F.col("ord").between(0, (1 << 32) - 1), F.col("ord")).otherwise(F.raise_error(F.concat(F.lit("page out of the range of keys: "), F.col("ord").cast("string"))).cast("long"))
    return kept.select((F.shiftleft(ord_, 31) + F.col("place")).alias("key"), "id", "sentence_id", "text")


def corpus_stats(pages: DataFrame, min_chars: int = 5, limit_pages: int | None = None) -> DataFrame:
    """One row: pages, passages, skipped.

    A short sentence is a skip, and a page without any passage is one more.
    """
    rows = sentences(pages, min_chars, limit_pages)
    by_page = rows.groupBy("ord").agg(F.count_if("long_enough").alias("passages"), F.count_if(F.col("place").isNotNull() & ~F.col("long_enough")).alias("short"))
    skipped = F.col("short") + F.when(F.col("passages") == 0, 1).otherwise(0)
    return by_page.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("passages"), F.lit(0)).alias("passages"), F.coalesce(F.sum(skipped), F.lit(0)).alias("skipped"))
