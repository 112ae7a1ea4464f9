"""Word and line expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), SPACE, " "))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def word_span(text: Column, start: Column, end: Column) -> Column:
    """The text from word number start (from 0) up to word number end, white space between them as it is."""
    begun = F.regexp_replace(text, f"^{SPACE}", "")
    with_space = F.split(begun, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.array_join(F.slice(with_space, start.cast("int") + 1, (end - start).cast("int")), "")
