"""From raw work records to clean works and search records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.ids import record_id
from biblioweave.functions.pages import first_page
from biblioweave.functions.people import author_families, first_author
from biblioweave.functions.text import clean_titles, not_blank, null_if_blank

# Members removed from stored records, and the type never indexed.
IGNORED_FIELDS = ("reference", "abstract", "indexed")
FILTERED_TYPES = ("component",)


def rejected(doi: Column, kind: Column, invalid: Column | None = None) -> Column:
    """True for a record without DOI, of a filtered type, or not readable."""
    bad = ~not_blank(doi) | F.coalesce(kind.isin(*FILTERED_TYPES), F.lit(False))
    return bad if invalid is None else bad | F.coalesce(invalid, F.lit(False))


def reject_incomplete(
    df: DataFrame, *, doi: str = "doi", kind: str = "type", invalid: str | None = None
) -> DataFrame:
    """Rows that may be stored: readable, with DOI, of an accepted type."""
    return df.filter(~rejected(F.col(doi), F.col(kind), F.col(invalid) if invalid else None))


def drop_ignored_fields(json: Column, fields: tuple[str, ...] = IGNORED_FIELDS) -> Column:
    """JSON object text without the given top-level members and ``_id``."""
    names = [*fields, "_id"]
    members = F.from_json(json, "map<string,variant>")
    return F.to_json(F.map_filter(members, lambda k, v: ~k.isin(*names)))


def is_filtered_type(kind: Column) -> Column:
    """True for record types kept out of the search table."""
    return F.coalesce(kind.isin(*FILTERED_TYPES), F.lit(False))


def container_titles(titles: Column) -> Column:
    """Cleaned journal or book titles, null when none is left."""
    cleaned = clean_titles(titles)
    return F.when(F.size(cleaned) > 0, cleaned)


def bibliographic_text(
    author: Column,
    first: Column,
    title: Column,
    journal: Column,
    abbreviated: Column,
    volume: Column,
    issue: Column,
    page: Column,
    year: Column,
) -> Column:
    """The usual citation fields of a record joined by spaces."""
    return null_if_blank(
        F.concat_ws(
            " ",
            F.coalesce(null_if_blank(author), null_if_blank(first)),
            F.get(title, F.lit(0)),
            F.array_join(journal, " "),
            F.array_join(abbreviated, " "),
            null_if_blank(volume),
            null_if_blank(issue),
            null_if_blank(page),
            null_if_blank(year),
        )
    )


def build_search_records(works: DataFrame, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Search records of works with a supported source and an indexed type.

    ``works`` has the typed fields of ``sources.works``; ``carry`` names
    further columns to keep.
    """
    fields = works.filter(F.col("source").isNotNull() & ~is_filtered_type(F.col("type"))).select(
        record_id(F.col("source"), F.col("doi"), F.col("hal_id")).alias("id"),
        "doi",
        "hal_id",
        F.lower("source").alias("source"),
        "type",
        clean_titles(F.col("title")).alias("title"),
        first_author(F.col("author")).alias("first_author"),
        author_families(F.col("author")).alias("author"),
        first_page(F.col("page")).alias("first_page"),
        container_titles(F.col("container_title")).alias("journal"),
        container_titles(F.col("short_container_title")).alias("abbreviated_journal"),
        null_if_blank(F.col("volume")).alias("volume"),
        null_if_blank(F.col("issue")).alias("issue"),
        "year",
        *carry,
    )
    text = bibliographic_text(
        F.col("author"), F.col("first_author"), F.col("title"), F.col("journal"),
        F.col("abbreviated_journal"), F.col("volume"), F.col("issue"), F.col("first_page"),
        F.col("year"),
    )
    return fields.filter(F.col("id").isNotNull()).withColumn("bibliographic", text)


def load_metrics(
    df: DataFrame, *, doi: str = "doi", kind: str = "type", source: str | None = None,
    invalid: str | None = None,
) -> DataFrame:
    """One row of counts for a load: seen, stored, rejected, indexed, failed."""
    bad = rejected(F.col(doi), F.col(kind), F.col(invalid) if invalid else None)
    known = (
        F.lower(F.col(source)).isin("crossref", "hal") if source else F.lit(True)
    )
    known = F.coalesce(known, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~bad).alias("stored"),
        F.count_if(bad).alias("rejected"),
        F.count_if(~bad & known).alias("indexed"),
        F.count_if(~bad & ~known).alias("failed"),
    )


def high_water_mark(df: DataFrame, *, ts: str = "indexed_ts") -> DataFrame:
    """One row with the latest index date; unusable dates are null and ignored."""
    return df.agg(F.max(ts).alias("last_indexed"))
