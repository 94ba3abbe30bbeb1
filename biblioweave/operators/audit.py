"""Audits over a whole collection of search records, and table reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.text import not_blank
from biblioweave.operators.ranking import accept, best_match, pairwise_rank
from biblioweave.operators.search import Index, match_biblio_conditional, minmax_blocking_score

RANKING_COLUMNS = (
    "doi", "hal_id", "first_author", "title", "journal", "abbreviated_journal", "year",
)


def candidate_fields(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with the record fields used for ranking, prefixed ``c_``."""
    first = lambda c: F.get(F.col(c), F.lit(0))
    side = records.select(
        "id",
        F.col("doi").alias("c_doi"),
        F.col("hal_id").alias("c_hal_id"),
        F.col("first_author").alias("c_first_author"),
        first("title").alias("c_title"),
        first("journal").alias("c_journal"),
        first("abbreviated_journal").alias("c_abbreviated_journal"),
        F.col("year").alias("c_year"),
    )
    return candidates.join(side, "id")


def record_requests(records: DataFrame, *, key: str = "hal_id") -> DataFrame:
    """Search records as matching requests of their own."""
    return records.filter(not_blank(F.col("bibliographic"))).select(
        F.col(key).alias("req_id"),
        F.col("bibliographic").alias("biblio"),
        F.col("id").alias("own_id"),
        F.get("title", F.lit(0)).alias("atitle"),
        "first_author",
        F.get("journal", F.lit(0)).alias("jtitle"),
        "year",
    )


def _best_accepted(
    requests: DataFrame, candidates: DataFrame, records: DataFrame
) -> DataFrame:
    """Accepted best candidates; requests without author cannot be validated."""
    scaled = candidate_fields(minmax_blocking_score(candidates), records)
    pairs = scaled.join(
        requests.select("req_id", "atitle", "first_author", "jtitle", "year"), "req_id"
    )
    ranked = pairwise_rank(pairs, has_strong_id=F.col("c_doi").isNotNull())
    return accept(best_match(ranked), author="first_author").filter("status = 'found'")


def audit_missing_doi(
    records: DataFrame, index: Index, *, own_source: str = "hal",
    sources: tuple[str, ...] | None = None, pruned: bool = True, **options,
) -> DataFrame:
    """Repository records without DOI and the DOI of their accepted match."""
    requests = record_requests(
        records.filter((F.col("source") == own_source) & ~not_blank(F.col("doi")))
    )
    candidates = match_biblio_conditional(
        requests, index, sources=sources, pruned=pruned, **options
    )
    best = _best_accepted(requests, candidates, records)
    return best.filter(not_blank(F.col("c_doi"))).select(
        F.col("req_id").alias("hal_id"), F.col("c_doi").alias("doi"),
        F.col("matching_score").alias("score"),
    )


def audit_duplicates(
    records: DataFrame, index: Index, *, own_source: str = "hal",
    sources: tuple[str, ...] | None = None, pruned: bool = True, **options,
) -> DataFrame:
    """Repository records and the other repository record that matches them best."""
    requests = record_requests(
        records.filter((F.col("source") == own_source) & not_blank(F.col("hal_id")))
    )
    candidates = match_biblio_conditional(
        requests, index, exclude="own_id", sources=sources, pruned=pruned, **options
    )
    best = _best_accepted(requests, candidates, records)
    return best.filter(
        not_blank(F.col("c_hal_id")) & (F.col("c_hal_id") != F.col("req_id"))
    ).select(
        F.col("req_id").alias("hal_id"), F.col("c_hal_id").alias("duplicate_of"),
        F.col("matching_score").alias("score"),
    )


def audit_summary(
    records: DataFrame, missing: DataFrame, duplicates: DataFrame, *, own_source: str = "hal"
) -> DataFrame:
    """One row: visited, with DOI, looked up, DOIs found, duplicates."""
    own = records.filter(F.col("source") == own_source)
    seen = own.agg(
        F.count(F.lit(1)).alias("visited"),
        F.count_if(not_blank(F.col("doi"))).alias("has_doi"),
        F.count_if(~not_blank(F.col("doi")) & not_blank(F.col("bibliographic"))).alias("lookups"),
        F.lit(0).cast("long").alias("dois_found"),
        F.lit(0).cast("long").alias("duplicates"),
    )
    zero = F.lit(0).cast("long")

    def counted(df: DataFrame, name: str) -> DataFrame:
        names = ("visited", "has_doi", "lookups", "dois_found", "duplicates")
        return df.agg(
            *[(F.count(F.lit(1)) if n == name else zero).alias(n) for n in names]
        )

    parts = seen.unionByName(counted(missing, "dois_found")).unionByName(
        counted(duplicates, "duplicates")
    )
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def sample_rows(table: DataFrame, *key: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows in key order."""
    return table.orderBy(*key).limit(n)
