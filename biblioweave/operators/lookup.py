"""Identifier lookups, validation, id enrichment, open-access resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.ids import normalise_doi, normalise_key, normalise_pmc
from biblioweave.functions.similarity import reaches
from biblioweave.functions.text import not_blank, null_if_blank
from biblioweave.operators.keys import left_lookup

# Threshold, messages and the archive's full-text address.
MATCH_THRESHOLD = 0.7
NO_RECORD = "No bibliographical record found"
NOT_VALIDATED = "Best bibliographical record did not passed the post-validation"
ARCHIVE_URL = "https://api.istex.fr/document/"
ARCHIVE_PDF = "/fulltext/pdf"


def _outcome(df: DataFrame, found: Column, reason: Column) -> DataFrame:
    ok = F.coalesce(found, F.lit(False))
    return df.withColumns(
        {
            "status": F.when(ok, "found").otherwise("not_found"),
            "reason": F.when(~ok, reason),
        }
    )


def lookup_by_doi(
    requests: DataFrame,
    works: DataFrame,
    *,
    doi: str | Column = "doi",
    reason: Column | None = None,
    columns: tuple[str, ...] = ("json",),
    req_id: str = "req_id",
) -> DataFrame:
    """Record per request by DOI, with ``record_doi``, ``status`` and ``reason``."""
    key = normalise_doi(F.col(doi) if isinstance(doi, str) else doi)
    out = left_lookup(
        requests, key, works, "doi",
        {"doi": "record_doi", **{c: c for c in columns}}, spread_by=req_id,
    )
    return _outcome(
        out, F.col("record_doi").isNotNull(), F.lit(NO_RECORD) if reason is None else reason
    )


def lookup_by_halid(
    requests: DataFrame,
    hal_works: DataFrame,
    *,
    halid: str = "halid",
    columns: tuple[str, ...] = ("json",),
    req_id: str = "req_id",
) -> DataFrame:
    """Record per request by repository id; these carry no DOI to enrich by."""
    table = hal_works.select("hal_id", *columns).withColumn("record_hal_id", F.col("hal_id"))
    out = left_lookup(
        requests, normalise_key(F.col(halid)), table, "hal_id",
        {"record_hal_id": "record_hal_id", **{c: c for c in columns}}, spread_by=req_id,
    )
    out = out.withColumn("record_doi", F.lit(None).cast("string"))
    return _outcome(out, F.col("record_hal_id").isNotNull(), F.lit(NO_RECORD))


def _via_map(
    requests: DataFrame, key: Column, table: DataFrame, table_key: str, doi: str,
    works: DataFrame, message: str, asked: str, columns: tuple[str, ...], req_id: str,
    also: dict[str, str] | None = None,
) -> DataFrame:
    mapped = left_lookup(
        requests, key, table, table_key, {doi: "mapped_doi", **(also or {})}, spread_by=req_id
    )
    mapped = mapped.withColumn("mapped_doi", null_if_blank(F.col("mapped_doi")))
    # only what an unmapped request needs for its reason goes through the second join
    missed = F.col("mapped_doi").isNull()
    mapped = mapped.withColumns({"_missed": missed, "_asked": F.when(missed, F.col(asked))})
    reason = F.when(F.col("_missed"), F.concat(F.lit(message), F.col("_asked"))).otherwise(F.lit(NO_RECORD))
    return lookup_by_doi(
        mapped, works, doi="mapped_doi", reason=reason, columns=columns, req_id=req_id
    ).drop("_missed", "_asked")


def lookup_by_pmid(
    requests: DataFrame, by_pmid: DataFrame, works: DataFrame, *, pmid: str = "pmid",
    columns: tuple[str, ...] = ("json",), req_id: str = "req_id",
) -> DataFrame:
    """PMID to DOI to record."""
    message = "Cannot find bibliographical record with PMID "
    return _via_map(
        requests, null_if_blank(F.col(pmid)), by_pmid, "pmid", "doi", works, message, pmid, columns, req_id
    )


def lookup_by_pmc(
    requests: DataFrame, by_pmc: DataFrame, works: DataFrame, *, pmc: str = "pmc",
    columns: tuple[str, ...] = ("json",), req_id: str = "req_id",
) -> DataFrame:
    """PMC id, with or without prefix, to DOI to record."""
    message = "Cannot find bibliographical record with PMC ID "
    return _via_map(
        requests, normalise_pmc(null_if_blank(F.col(pmc))), by_pmc, "pmcid", "doi", works,
        message, pmc, columns, req_id,
    )


def _first_doi(archive: DataFrame) -> DataFrame:
    return archive.withColumn("first_doi", F.get("doi", F.lit(0)))


def lookup_by_pii(
    requests: DataFrame, by_pii: DataFrame, works: DataFrame, *, pii: str = "pii",
    columns: tuple[str, ...] = ("json",), req_id: str = "req_id",
) -> DataFrame:
    """Publisher item id to the archive row's first DOI to record."""
    message = "Cannot find bibliographical record by PII "
    return _via_map(
        requests, normalise_key(F.col(pii)), _first_doi(by_pii), "key", "first_doi", works,
        message, pii, columns, req_id, {"istex_id": "archive_id"},
    )


def lookup_by_istexid(
    requests: DataFrame, by_istex: DataFrame, works: DataFrame, *, istexid: str = "istexid",
    columns: tuple[str, ...] = ("json",), req_id: str = "req_id",
) -> DataFrame:
    """Archive id to the row's first DOI to record."""
    message = "Cannot find bibliographical record by ISTEX ID "
    return _via_map(
        requests, null_if_blank(F.col(istexid)), _first_doi(by_istex), "key", "first_doi", works,
        message, istexid, columns, req_id, {"istex_id": "archive_id"},
    )


def post_validate(
    found: DataFrame,
    *,
    atitle: str = "atitle",
    author: str = "first_author",
    record_title: str = "record_title",
    record_author: str = "record_author",
    threshold: float = MATCH_THRESHOLD,
    strict: bool = False,
) -> DataFrame:
    """Turn found records that do not resemble the request into not found.

    Fields the request leaves blank are not compared; with ``strict`` a blank
    author counts as a mismatch as soon as a title is given.
    """
    has_title, has_author = not_blank(F.col(atitle)), not_blank(F.col(author))
    title_ok = reaches(F.col(atitle), F.col(record_title), threshold)
    author_ok = reaches(F.col(author), F.col(record_author), threshold)
    ok = (~has_title | title_ok) & ((F.lit(not strict) & ~has_author) | author_ok)
    ok = ~(has_title | has_author) | ok
    failed = (F.col("status") == "found") & ~F.coalesce(ok, F.lit(False))
    return found.withColumns(
        {
            "status": F.when(failed, "not_found").otherwise(F.col("status")),
            "reason": F.when(failed, NOT_VALIDATED).otherwise(F.col("reason")),
        }
    )


ENRICHED = ("istexId", "ark", "pmid", "pmcid", "mesh", "pii", "halId", "oaLink")


def enrich_ids(
    df: DataFrame,
    *,
    doi: str,
    istex_by_doi: DataFrame,
    pmid_by_doi: DataFrame,
    doi_hal: DataFrame | None,
    oa_links: DataFrame,
    spread_by: str = "req_id",
    prefix: str = "",
) -> DataFrame:
    """Ids and open-access link of a DOI as extra columns.

    Archive ids come first, the PubMed map fills what they lack.
    """
    key = normalise_doi(F.regexp_replace(F.col(doi), "^crossref:", ""))
    archive = istex_by_doi.select(
        "key",
        "istex_id",
        *[F.get(F.col(c), F.lit(0)).alias(f"{c}0") for c in ("ark", "pmid", "pmc", "mesh", "pii")],
    )
    out = left_lookup(
        df, key, archive, "key",
        {
            "istex_id": "_istexId", "ark0": "_ark", "pmid0": "_pmid", "pmc0": "_pmc",
            "mesh0": "_mesh", "pii0": "_pii",
        },
        spread_by=spread_by,
    )
    out = left_lookup(
        out, key, pmid_by_doi, "doi", {"pmid": "_mpmid", "pmcid": "_mpmc"}, spread_by=spread_by
    )
    hal = F.lit(None).cast("string")
    if doi_hal is not None:
        out = left_lookup(out, key, doi_hal, "doi", {"hal_id": "_hal"}, spread_by=spread_by)
        hal = F.regexp_replace(null_if_blank(F.col("_hal")), "^hal:", "")
    out = left_lookup(out, key, oa_links, "doi", {"oa_url": "_oa"}, spread_by=spread_by)
    values = {
        "istexId": null_if_blank(F.col("_istexId")),
        "ark": F.col("_ark"),
        "pmid": F.coalesce("_pmid", null_if_blank(F.col("_mpmid"))),
        "pmcid": F.coalesce("_pmc", null_if_blank(F.col("_mpmc"))),
        "mesh": F.col("_mesh"),
        "pii": F.col("_pii"),
        "halId": hal,
        "oaLink": null_if_blank(F.col("_oa")),
    }
    out = out.withColumns({prefix + name: value for name, value in values.items()})
    return out.drop(
        "_istexId", "_ark", "_pmid", "_pmc", "_mesh", "_pii", "_mpmid", "_mpmc", "_hal", "_oa"
    )


def inject_ids(json: Column, prefix: str = "") -> Column:
    """Record JSON with the columns of ``enrich_ids`` added as members."""
    extra = F.to_json(F.struct(*[F.col(prefix + n).alias(n) for n in ENRICHED]))
    body = F.regexp_replace(json, r"\}\s*$", "")
    merged = F.concat(
        body, F.when(body.rlike(r"^\s*\{\s*$"), "").otherwise(", "), F.substr(extra, F.lit(2))
    )
    return F.when(extra == "{}", json).when(~not_blank(json), extra).otherwise(merged)


def _archive_pdf(archive_id: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_URL), archive_id, F.lit(ARCHIVE_PDF))


def resolve_oa(
    requests: DataFrame, by: str, oa_links: DataFrame, *, ids: DataFrame | None = None,
    key: str | None = None, req_id: str = "req_id",
) -> DataFrame:
    """Best open-access PDF link by ``doi``, ``pmid``, ``pmc`` or ``pii``."""
    mapped = _request_doi(requests, by, ids, key or by, req_id)
    out = left_lookup(
        mapped, F.col("_doi"), oa_links, "doi", {"oa_url": "oa_url"}, spread_by=req_id
    ).drop("_doi", "_archive")
    reason = F.concat(
        F.lit(f"Open Access URL was not found for {_NAMES[by]} "), F.col(key or by)
    )
    return _outcome(out, not_blank(F.col("oa_url")), reason)


_NAMES = {"doi": "DOI", "pmid": "PMID", "pmc": "PMC ID", "pii": "pii"}


def _request_doi(
    requests: DataFrame, by: str, ids: DataFrame | None, key: str, req_id: str
) -> DataFrame:
    """Requests with the DOI their id stands for, and the archive id for PIIs."""
    none = F.lit(None).cast("string")
    value = F.col(key)
    if by == "doi":
        return requests.withColumn("_doi", normalise_doi(value)).withColumn("_archive", none)
    if by == "pii":
        out = left_lookup(
            requests, normalise_key(value), _first_doi(ids), "key",
            {"first_doi": "_doi", "istex_id": "_archive"}, spread_by=req_id,
        )
    else:
        wanted = normalise_pmc(null_if_blank(value)) if by == "pmc" else null_if_blank(value)
        out = left_lookup(
            requests, wanted, ids, "pmcid" if by == "pmc" else "pmid", {"doi": "_doi"},
            spread_by=req_id,
        ).withColumn("_archive", none)
    return out.withColumn("_doi", normalise_doi(F.col("_doi")))


def resolve_oa_istex(
    requests: DataFrame, by: str, oa_links: DataFrame, istex_by_doi: DataFrame, *,
    ids: DataFrame | None = None, key: str | None = None, req_id: str = "req_id",
) -> DataFrame:
    """Pair of open-access link and archive PDF; not found only without both."""
    out = _request_doi(requests, by, ids, key or by, req_id)
    out = left_lookup(
        out, F.col("_doi"), oa_links, "doi", {"oa_url": "oa_url"}, spread_by=req_id
    )
    out = left_lookup(
        out, F.col("_doi"), istex_by_doi, "key", {"istex_id": "_by_doi"}, spread_by=req_id
    )
    out = out.withColumn("istex_url", _archive_pdf(F.coalesce("_archive", "_by_doi"))).withColumn(
        "oa_url", null_if_blank(F.col("oa_url"))
    )
    reason = F.concat(
        F.lit(f"Open Access and Istex URL were not found for {_NAMES[by]} "), F.col(key or by)
    )
    return _outcome(
        out.drop("_doi", "_archive", "_by_doi"),
        F.col("oa_url").isNotNull() | F.col("istex_url").isNotNull(),
        reason,
    )


def map_ids(
    requests: DataFrame, table: DataFrame, *, key: str, table_key: str,
    columns: dict[str, str], req_id: str = "req_id",
) -> DataFrame:
    """Id row of each request, under the given new names."""
    marked = table.withColumn("_hit", F.lit(True))
    out = left_lookup(
        requests, normalise_key(F.col(key)) if table_key == "key" else null_if_blank(F.col(key)),
        marked, table_key, {**columns, "_hit": "_hit"}, spread_by=req_id,
    )
    return _outcome(
        out, F.col("_hit"), F.concat(F.lit("No ids found for "), F.col(key))
    ).drop("_hit")


def join_candidates_to_docs(
    candidates: DataFrame,
    works: DataFrame,
    hal_works: DataFrame | None = None,
    *,
    columns: tuple[str, ...] = ("json",),
    spread_by: str = "id",
) -> DataFrame:
    """Candidates with their record by DOI, else by repository id; others dropped."""
    out = left_lookup(
        candidates, normalise_doi(F.col("doi")),
        works.select(F.col("doi").alias("_wdoi"), *columns).withColumn("_w", F.lit(True)),
        "_wdoi", {**{c: f"_w_{c}" for c in columns}, "_w": "_w"}, spread_by=spread_by,
    )
    if hal_works is None:
        picked = {c: F.col(f"_w_{c}") for c in columns}
        return out.filter("_w").withColumns(picked).drop("_w", *[f"_w_{c}" for c in columns])
    key = F.when(F.col("_w").isNull(), normalise_key(F.col("hal_id")))
    out = left_lookup(
        out, key, hal_works.select(F.col("hal_id").alias("_hid"), *columns).withColumn("_h", F.lit(True)),
        "_hid", {**{c: f"_h_{c}" for c in columns}, "_h": "_h"}, spread_by=spread_by,
    )
    picked = {c: F.when(F.col("_w"), F.col(f"_w_{c}")).otherwise(F.col(f"_h_{c}")) for c in columns}
    dropped = ["_w", "_h", *[f"_{s}_{c}" for s in "wh" for c in columns]]
    return out.filter("_w OR _h").withColumns(picked).drop(*dropped)
