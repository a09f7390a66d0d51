"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space at the ends of a text.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Fixed value: what ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at both ends (all of Unicode's, not only blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, with repeats, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; a last end doesn't open another line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tolerant_int(text: Column, default: Column) -> Column:
    """The integer that the stripped text is, else ``default`` (also for fractions and over 32 bits)."""
    own = strip(text)
    return F.coalesce(F.when(own.rlike("^[+-]?[0-9]+$"), own.try_cast("int")), default)


def indexed_text(title: Column, text: Column) -> Column:
    """What the retrieval index reads: title and text; a null title reads ``None``."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("None")), text)


def titled(title: Column, text: Column) -> Column:
    """``title: text``, or whichever there is."""
    blank = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(": ", blank(title), blank(text))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' canonical JSON (nulls kept, order as given)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
