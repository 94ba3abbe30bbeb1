"""Partial dates: struct ``(year, month, day)`` with optional month and day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioweave.functions.text import bind

PARTIAL_DATE = "struct<year:int,month:int,day:int>"

# English month abbreviations in calendar order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Order in which a work's dates are tried for its publication year.
YEAR_SOURCES = ("issued", "published", "published-online", "published-print", "created")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def month_number(c: Column) -> Column:
    """Month from an English abbreviation or a number, else null."""
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(c))
    return F.when(place > 0, place.cast("int")).otherwise(_int(c))


def clip_day(day: Column, month: Column) -> Column:
    """Last valid day for short months, February always having 28."""
    return (
        F.when(month.isin(4, 6, 9, 11), F.least(day, F.lit(30)))
        .when(month == 2, F.least(day, F.lit(28)))
        .otherwise(day)
    )


def partial_date(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """Partial date from text parts; null when there is no valid year."""
    parts = F.struct(
        _int(year).alias("y"),
        (month_number(month) if month is not None else F.lit(None).cast("int")).alias("m"),
        (_int(day) if day is not None else F.lit(None).cast("int")).alias("d"),
    )
    # numbers are read once: repeated for each use, they make code too long to be compiled
    return bind(
        parts,
        lambda p: F.when(
            p["y"].isNotNull(),
            F.struct(
                p["y"].alias("year"),
                p["m"].alias("month"),
                F.when(p["m"].isNotNull(), clip_day(p["d"], p["m"])).alias("day"),
            ),
        ),
    )


def partial_date_from_iso(c: Column) -> Column:
    """Partial date from ``yyyy[-MM[-dd]]`` text of repository records."""
    parts = F.split(c, "-")
    return F.when(
        F.length(c) >= 4,
        partial_date(
            F.get(parts, F.lit(0)),
            F.when(F.length(c) >= 7, F.substring(F.get(parts, F.lit(1)), 1, 2)),
            F.when(F.length(c) > 7, F.get(parts, F.lit(2))),
        ),
    )


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_partial_date(c: Column, day_first: bool = False) -> Column:
    """``yyyy[-MM[-dd]]``, or ``[[dd-]MM-]yyyy`` when ``day_first``."""
    year, month = c["year"].cast("string"), _pad2(c["month"])
    day = F.when(c["month"].isNotNull(), _pad2(c["day"]))
    parts = (day, month, year) if day_first else (year, month, day)
    return F.when(c["year"].isNotNull(), F.concat_ws("-", *parts))


def parse_partial_date(c: Column, day_first: bool = False) -> Column:
    """Partial date from text of length 4, 7 or 10 in either order, else null."""
    size = F.length(c)
    if day_first:
        year = F.when(size == 4, c).when(size == 7, F.substring(c, 4, 4)).when(
            size == 10, F.substring(c, 7, 4)
        )
        month = F.when(size == 7, F.substring(c, 1, 2)).when(size == 10, F.substring(c, 4, 2))
        day = F.when(size == 10, F.substring(c, 1, 2))
    else:
        year = F.when(size.isin(4, 7, 10), F.substring(c, 1, 4))
        month = F.when(size.isin(7, 10), F.substring(c, 6, 2))
        day = F.when(size == 10, F.substring(c, 9, 2))
    y, m, d = _int(year), _int(month), _int(day)
    bad = (month.isNotNull() & m.isNull()) | (day.isNotNull() & d.isNull())
    return F.when(
        y.isNotNull() & ~F.coalesce(bad, F.lit(False)),
        F.struct(y.alias("year"), m.alias("month"), d.alias("day")),
    )


def partial_to_date(c: Column) -> Column:
    """Full date with missing month and day set to one."""
    month, day = F.coalesce(c["month"], F.lit(1)), F.coalesce(c["day"], F.lit(1))
    text = F.concat_ws("-", F.lpad(c["year"].cast("string"), 4, "0"), _pad2(month), _pad2(day))
    return F.when(c["year"].isNotNull(), text.try_cast("date"))


def _size(c: Column) -> Column:
    return F.when(c["month"].isNull(), 1).when(c["day"].isNull(), 2).otherwise(3)


def partial_size(c: Column) -> Column:
    """Number of parts present in a partial date, null for a null date."""
    return F.when(c["year"].isNotNull(), _size(c))


def oldest_date(printed: Column, electronic: Column) -> Column:
    """The earlier of two partial dates; of equal prefixes the more specific."""
    by_part = F.lit(None).cast("boolean")
    for part in ("day", "month", "year"):
        p, e = printed[part], electronic[part]
        by_part = F.when(p.isNotNull() & e.isNotNull() & (p != e), p < e).otherwise(by_part)
    printed_first = F.coalesce(by_part, _size(printed) > _size(electronic))
    return (
        F.when(printed["year"].isNull(), electronic)
        .when(electronic["year"].isNull(), printed)
        .when(printed_first, printed)
        .otherwise(electronic)
    )


def _year_at(json: Column, path: str) -> Column:
    nested = F.get_json_object(json, f"{path}[0][0]")
    flat = F.get_json_object(json, f"{path}[0]")
    year = F.coalesce(nested, F.when(~flat.startswith("["), flat))
    return F.when(year.rlike(r"\S") & (year != "null"), year)


def year_of_date_parts(date_json: Column) -> Column:
    """First date part of a JSON date object with nested or flat parts."""
    return _year_at(date_json, "$['date-parts']")


def publication_year(record_json: Column) -> Column:
    """Year of the first usable date of a work record."""
    return F.coalesce(*[_year_at(record_json, f"$['{n}']['date-parts']") for n in YEAR_SOURCES])


def indexed_timestamp(record_json: Column) -> Column:
    """Index date of a work record as a UTC timestamp, null when unusable."""
    return F.try_to_timestamp(F.get_json_object(record_json, "$.indexed['date-time']"))


def complete_date(c: Column, this_year: Column | None = None) -> Column:
    """Full date text for a date given as year, year-month or longer.

    Missing parts become the last of their period; results that are not
    ``yyyy-MM-dd`` with a year from 1900 to this year are empty.
    """
    this_year = F.year(F.current_date()) if this_year is None else this_year
    text = F.regexp_replace(c, "-$", "")
    year = F.substring(text, 1, 4)
    raw_month = F.regexp_extract(text, r"-(.*)$", 1)
    month_text = F.when(F.instr(text, "-") == 0, text).otherwise(raw_month)
    month = F.when(F.length(month_text) == 1, F.concat(F.lit("0"), month_text)).otherwise(month_text)
    last_day = (
        F.when(month == "02", "28").when(month.isin("04", "06", "09", "11"), "30").otherwise("31")
    )
    in_year = F.when(_int(month).between(1, 12), month).otherwise(F.lit("12"))
    size = F.length(text)
    value = (
        F.when(size < 4, "")
        .when(size == 4, F.concat(text, F.lit("-12-31")))
        .when(size.isin(6, 7), F.concat_ws("-", year, in_year, last_day))
        .otherwise(F.trim(text))
    )
    value = F.replace(value, F.lit(" "), F.lit("T"))
    ok = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & _int(F.substring(value, 1, 4)).between(
        F.lit(1900), this_year
    )
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.when(c.isNotNull(), F.lit("")))


def clean_display_date(c: Column) -> Column:
    """``yyyy-00[-00]`` to ``yyyy``, a valid ``yyyy-MM-dd`` to ``dd-MM-yyyy``."""
    year, month, day = F.substring(c, 1, 4), F.substring(c, 6, 2), F.substring(c, 9, 2)
    return (
        F.when(c.rlike(r"^\d{4}-00(-00)?$"), year)
        .when(
            c.rlike(r"^\d{4}-(0[1-9]|1[012])-(0[1-9]|[12][0-9]|3[01])$"),
            F.concat_ws("-", day, month, year),
        )
        .otherwise(c)
    )
