"""The request router: identifiers first, then text matching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.session import materialise
from biblioweave.functions.text import not_blank
from biblioweave.operators import lookup as L
from biblioweave.operators.audit import candidate_fields
from biblioweave.operators.ranking import (
    NO_CANDIDATE, accept, best_match, pairwise_rank, with_parsed_fields,
)
from biblioweave.operators.search import (
    Index, match_biblio, match_journal, match_title_author, minmax_blocking_score,
)

STRONG_IDS = ("doi", "halid", "pmid", "pmc", "pii", "istexid")
NOT_ENOUGH = "The supplied parameters were not sufficient to select the query"

RESULT = (
    "req_id", "route", "status", "reason", "id", "doi", "hal_id", "blocking_score",
    "matching_score", "json",
)


@dataclass(frozen=True)
class Store:
    """The key tables a request can be answered from.

    ``works`` and ``hal_works`` carry ``json``, ``record_title`` and
    ``record_author`` for validation; the index carries ``volume`` and
    ``first_page`` of the records.
    """

    works: DataFrame
    hal_works: DataFrame
    pmid_maps: dict[str, DataFrame]
    istex_maps: dict[str, DataFrame]
    oa_links: DataFrame
    doi_hal: DataFrame
    records: DataFrame
    index: Index


def route_column() -> Column:
    """The route of a request: its first usable identifier or field set."""
    given = lambda c: not_blank(F.col(c))
    route = F.when(given("doi"), "doi")
    for name in STRONG_IDS[1:]:
        route = route.when(given(name), name)
    return (
        route.when(given("biblio"), "biblio")
        .when(given("atitle") & given("first_author"), "title_author")
        .when(given("jtitle") & given("volume") & given("first_page"), "journal")
        .otherwise("none")
    )


def _result(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            F.col(c).alias(c) if c in have else F.lit(None).cast(
                "double" if c.endswith("_score") else "string"
            ).alias(c)
            for c in RESULT
        ]
    )


def _by_identifier(requests: DataFrame, store: Store) -> list[DataFrame]:
    columns = ("json", "record_title", "record_author")
    maps, archive = store.pmid_maps, store.istex_maps
    branch = {
        "doi": lambda r: L.lookup_by_doi(r, store.works, columns=columns),
        "halid": lambda r: L.lookup_by_halid(r, store.hal_works, columns=columns),
        "pmid": lambda r: L.lookup_by_pmid(r, maps["pmid"], store.works, columns=columns),
        "pmc": lambda r: L.lookup_by_pmc(r, maps["pmcid"], store.works, columns=columns),
        "pii": lambda r: L.lookup_by_pii(r, archive["pii"], store.works, columns=columns),
        "istexid": lambda r: L.lookup_by_istexid(
            r, archive["istex_id"], store.works, columns=columns
        ),
    }
    results = []
    for route, find in branch.items():
        found = L.post_validate(find(requests.filter(F.col("route") == route)))
        ok = F.col("status") == "found"
        hal = F.col("record_hal_id") if "record_hal_id" in found.columns else F.lit(None)
        results.append(
            found.select(
                "req_id", "route", "status", "reason",
                F.lit(None).cast("string").alias("id"),
                F.when(ok, F.col("record_doi")).alias("doi"),
                F.when(ok, hal).cast("string").alias("hal_id"),
                F.lit(None).cast("double").alias("blocking_score"),
                F.lit(None).cast("double").alias("matching_score"),
                F.when(ok, F.col("json")).alias("json"),
            )
        )
    return results


def _ranked(
    requests: DataFrame, candidates: DataFrame, store: Store, criteria: dict, author: str | None
) -> DataFrame:
    """Best accepted candidate per request, with a reason for the others."""
    docs = L.join_candidates_to_docs(
        candidates.join(store.records.select("id", "doi", "hal_id"), "id"),
        store.works, store.hal_works,
    ).select("req_id", "id", "raw_score", "blocking_rank", "json")
    pairs = candidate_fields(minmax_blocking_score(docs), store.records).join(
        requests, "req_id"
    )
    best = accept(
        best_match(
            pairwise_rank(pairs, has_strong_id=F.col("c_doi").isNotNull(), **criteria)
        ),
        author=author,
    )
    chosen = best.select(
        "req_id", "status", "reason", "id", F.col("c_doi").alias("doi"),
        F.col("c_hal_id").alias("hal_id"), "blocking_score", "matching_score", "json",
    )
    out = requests.select("req_id", "route").join(chosen, "req_id", "left")
    found = F.coalesce(F.col("status") == "found", F.lit(False))
    hidden = {
        c: F.when(found, F.col(c))
        for c in ("id", "doi", "hal_id", "blocking_score", "matching_score", "json")
    }
    return _result(
        out.withColumns(
            {
                **hidden,
                "reason": F.when(F.col("status").isNull(), NO_CANDIDATE).otherwise(F.col("reason")),
                "status": F.coalesce("status", F.lit("not_found")),
            }
        )
    )


def _match_biblio_route(requests: DataFrame, store: Store, parsed: DataFrame | None) -> DataFrame:
    rows = requests if parsed is None else with_parsed_fields(requests, parsed)
    return _ranked(rows, match_biblio(rows, store.index), store, {}, "first_author")


def _match_title_route(requests: DataFrame, store: Store) -> DataFrame:
    candidates = match_title_author(requests, store.index)
    return _ranked(requests, candidates, store, {"journal": None, "year": None}, None)


def _match_journal_route(requests: DataFrame, store: Store) -> DataFrame:
    candidates = match_journal(requests, store.index)
    return _ranked(requests, candidates, store, {"year": None}, None)


def resolve_requests(
    requests: DataFrame, store: Store, *, parsed: DataFrame | None = None, enrich: bool = True
) -> DataFrame:
    """One result row per request.

    A given identifier decides: when it fails the request is not found.  A
    title and author match that fails falls through to the journal match when
    all journal fields are given.
    """
    # written once: each route reads it, and a route's result is read by several others
    routed = materialise(requests.withColumn("route", route_column()), "routed-requests")
    results = _by_identifier(routed, store)

    results.append(
        _match_biblio_route(routed.filter("route = 'biblio'"), store, parsed)
    )
    by_title = routed.filter("route = 'title_author'")
    title_result = materialise(_match_title_route(by_title, store), "title-results")
    has_journal = (
        not_blank(F.col("jtitle")) & not_blank(F.col("volume")) & not_blank(F.col("first_page"))
    )
    retry = by_title.filter(has_journal).join(
        title_result.filter("status <> 'found'").select("req_id"), "req_id", "left_semi"
    )
    second = materialise(
        _match_journal_route(routed.filter("route = 'journal'").unionByName(retry), store),
        "journal-results",
    )
    results.append(second.filter("route = 'journal'"))
    better = second.filter("route = 'title_author' AND status = 'found'")
    results.append(title_result.join(better.select("req_id"), "req_id", "left_anti"))
    results.append(better)
    results.append(
        _result(
            routed.filter("route = 'none'").select("req_id", "route").withColumns(
                {"status": F.lit("bad_request"), "reason": F.lit(NOT_ENOUGH)}
            )
        )
    )
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part.select(*out.columns))
    if not enrich:
        return out
    enriched = L.enrich_ids(
        out, doi="doi", istex_by_doi=store.istex_maps["doi"],
        pmid_by_doi=store.pmid_maps["doi"],
        doi_hal=store.doi_hal, oa_links=store.oa_links, prefix="_e_",
    )
    json = F.when(F.col("doi").isNotNull(), L.inject_ids(F.col("json"), "_e_")).otherwise(
        F.col("json")
    )
    return enriched.withColumn("json", json).select(*RESULT)
