"""Pagination expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioweave.functions.text import bind, not_blank

# Words that are not part of a page number, in order of removal.
PAGE_NOISE = (
    "Suppl:", "suppl:", "Suppl", "suppl", "passim", "CR", "concl", "cntd",
    "discussion", "author reply",
)

# Placeholders for unknown pages in repository records.
UNKNOWN_PAGES = ("n/a", "n/a-n/a")

PAGES = "struct<start:string,end:string,start_int:int,end_int:int,raw:string>"


def first_page(c: Column) -> Column:
    """The part of a page field before the first comma, hyphen or space."""
    return F.get(F.split(F.trim(c), "[,\\- ]"), F.lit(0))


def expand_page_range(c: Column) -> Column:
    """Struct of start and end page; a shortened end page is completed.

    ``117-26`` is pages 117 to 126, a single page is both ends.  A start page
    that is no plain number is replaced by its first run of digits when there
    is one, and the cleaned text is kept in ``raw``.
    """
    text = F.when(~c.isin(*UNKNOWN_PAGES), c)
    for noise in PAGE_NOISE:
        text = F.replace(text, F.lit(noise), F.lit(""))
    return bind(F.trim(text), lambda t: F.when(F.length(t) > 0, bind(_ends(t), lambda e: _pages(t, e))))


def _ends(text: Column) -> Column:
    """First and last page as written; no separator means one page."""
    mark = F.when(F.instr(text, "-") > 0, F.instr(text, "-")).otherwise(F.instr(text, ","))
    split = F.when(mark > 0, mark).otherwise(F.length(text) + 1)
    return F.struct(
        text.substr(F.lit(1), split - 1).alias("first"),
        F.when(mark > 0, text.substr(mark + 1, F.length(text))).otherwise(text).alias("last"),
    )


def _pages(text: Column, ends: Column) -> Column:
    start, tail = ends["first"], ends["last"]
    missing = F.length(start) - F.length(tail)
    end = F.when(missing > 0, F.concat(start.substr(F.lit(1), missing), tail)).otherwise(tail)
    start_int, end_int = start.try_cast("int"), end.try_cast("int")
    digits = F.regexp_extract(text, r"(\d+)", 1)
    shown = F.when(start_int.isNull() & (F.length(start) > 0) & (digits != ""), digits).otherwise(start)
    odd = ((F.length(start) > 0) & start_int.isNull()) | ((F.length(end) > 0) & end_int.isNull())
    return F.struct(
        F.when(F.length(shown) > 0, shown).alias("start"),
        F.when(F.length(end) > 0, end).alias("end"),
        shown.try_cast("int").alias("start_int"),
        end_int.alias("end_int"),
        F.when(F.coalesce(odd, F.lit(False)), text).alias("raw"),
    )


def page_range(start: Column, end: Column) -> Column:
    """``start-end``, one value when equal or only one is known, else empty."""
    s, e = F.when(not_blank(start), start), F.when(not_blank(end), end)
    return F.when(s == e, s).otherwise(F.concat_ws("-", s, e))
