"""Key tables: build, dedupe, enrich, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.dates import format_partial_date, partial_size
from biblioweave.functions.ids import (
    doi_prefix, doi_url, format_issn, normalise_doi, normalise_key, normalise_pmc,
)
from biblioweave.functions.mesh import mesh_record
from biblioweave.functions.pages import page_range
from biblioweave.functions.text import not_blank, null_if_blank, simple_clean
from biblioweave.operators.keys import last_written, latest_per_key, left_lookup
from biblioweave.operators.records import drop_ignored_fields, reject_incomplete
from biblioweave.session import materialise

PMC_PDF = "https://www.ncbi.nlm.nih.gov/pmc/articles/"


def build_works(
    records: DataFrame,
    *,
    order_by: tuple[str, ...] = ("indexed_ts", "seq"),
    ignored_fields: tuple[str, ...] | None = None,
    kind: str = "type",
    invalid: str | None = None,
) -> DataFrame:
    """One accepted record per lower-case DOI, the last in ``order_by`` winning."""
    rows = reject_incomplete(records, kind=kind, invalid=invalid)
    rows = rows.withColumn("doi", normalise_doi(F.col("doi")))
    order = [F.col(c).desc_nulls_last() for c in order_by if c in rows.columns]
    rows = latest_per_key(rows, "doi", order or last_written(rows, "doi"))
    if "json" in rows.columns and ignored_fields is not None:
        rows = rows.withColumn("json", drop_ignored_fields(F.col("json"), ignored_fields))
    return rows


def build_oa_links(
    locations: DataFrame,
    *,
    doi: str = "doi",
    url: str | Column = "best_oa_location.url_for_pdf",
    order_by: tuple[str, ...] = ("updated",),
) -> DataFrame:
    """DOI to the best open-access PDF link; rows without link are left out."""
    link = F.col(url) if isinstance(url, str) else url
    order = [F.col(c).desc_nulls_last() for c in order_by if c in locations.columns]
    rows = locations.select(
        normalise_doi(F.col(doi)).alias("doi"), link.alias("oa_url"),
        *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order_by) if c in locations.columns],
    ).filter(not_blank(F.col("oa_url")))
    order = [F.col(c).desc_nulls_last() for c in rows.columns if c.startswith("_order")]
    return latest_per_key(rows, "doi", [*order, F.col("oa_url").desc()]).select("doi", "oa_url")


def build_pmid_maps(
    pmid_map: DataFrame, *, order_by: list[Column] | None = None
) -> dict[str, DataFrame]:
    """The id table keyed three ways: by ``doi``, ``pmid`` and ``pmcid``."""
    rows = pmid_map.withColumns(
        {"doi": normalise_doi(F.col("doi")), "pmcid": null_if_blank(F.col("pmcid"))}
    )
    return {
        key: latest_per_key(rows, key, order_by or last_written(rows, key))
        for key in ("doi", "pmid", "pmcid")
    }


def enrich_pmid_with_oa_files(
    pmid_map: DataFrame, oa_files: DataFrame, *, order_by: str | None = None, spread_by: str = "pmid"
) -> DataFrame:
    """License and archive path by PMC id; empty new values keep the old ones.

    Of several rows for one PMC id the last non-empty value by ``order_by``
    counts (by ``seq`` if the reader gave it), the greatest value without an order.
    """
    if order_by is None and "seq" in oa_files.columns:
        order_by = "seq"

    def last_value(name: str) -> Column:
        filled = F.length(name) > 0
        if order_by is None:
            return F.max(F.when(filled, F.col(name)))
        return F.max(F.when(filled, F.struct(F.col(order_by), F.col(name))))[name]

    files = oa_files.filter(not_blank(F.col("pmcid"))).groupBy("pmcid").agg(
        last_value("license").alias("license"), last_value("subpath").alias("subpath")
    )
    joined = left_lookup(
        pmid_map, F.col("pmcid"), files, "pmcid",
        {"license": "_license", "subpath": "_subpath"}, spread_by=spread_by,
    )
    return joined.withColumns(
        {
            "license": F.coalesce("_license", "license"),
            "subpath": F.coalesce("_subpath", "subpath"),
        }
    ).drop("_license", "_subpath")


def count_unknown_pmc(pmid_map: DataFrame, oa_files: DataFrame) -> DataFrame:
    """Number of file-list rows whose PMC id is not in the id table."""
    named = oa_files.filter(not_blank(F.col("pmcid")))
    missing = named.join(pmid_map.select("pmcid"), "pmcid", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("unknown_pmc"))


def _written(df: DataFrame) -> list[Column]:
    return [F.col("seq").desc_nulls_last()] if "seq" in df.columns else []


ISTEX_FIELDS = ("corpus_name", "istex_id", "doi", "pmid", "pmc", "ark", "mesh", "pii")


def build_istex_maps(
    istex: DataFrame, *, order_by: list[Column] | None = None
) -> dict[str, DataFrame]:
    """Archive id rows keyed by ``doi``, ``pii`` (lower-cased) and ``istex_id``."""
    maps = {}
    for key in ("doi", "pii"):
        keyed = istex.select(
            "*", F.explode(key).alias("_raw")
        ).withColumn("key", normalise_key(F.col("_raw"))).drop("_raw")
        maps[key] = latest_per_key(
            keyed, "key", order_by or _written(istex) or [F.col("istex_id").desc_nulls_last()]
        )
    keyed = istex.withColumn("key", F.col("istex_id"))
    maps["istex_id"] = latest_per_key(
        keyed, "key", order_by or _written(istex) or [F.to_json(F.struct(*istex.columns)).desc_nulls_last()]
    )
    return maps


def add_missing_istex(current: DataFrame, new: DataFrame, *, key: str = "key") -> DataFrame:
    """Rows of ``new`` whose key is not known yet, added to ``current``."""
    fresh = new.join(current.select(key), key, "left_anti")
    return current.unionByName(fresh)


def build_hal_works(
    biblio: DataFrame, *, order_by: list[Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Repository id to record JSON, and DOI to the repository id written last for it."""
    rows = biblio_to_work(biblio, source="hal").withColumn("hal_id", normalise_key(F.col("hal_id")))
    works = latest_per_key(
        rows, "hal_id", order_by or _written(rows) or [F.col("json").desc()]
    ).select("hal_id", "doi", "json")
    by_doi = rows.withColumn("doi", normalise_doi(F.col("doi"))).filter(not_blank(F.col("hal_id")))
    doi_hal = latest_per_key(
        by_doi, "doi", [*(order_by or _written(rows)), F.col("hal_id").desc()]
    ).select("doi", "hal_id")
    return works, doi_hal


def _date_member(date: Column) -> Column:
    parts = F.filter(F.array(date["year"], date["month"], date["day"]), lambda p: p.isNotNull())
    return F.when(
        date["year"].isNotNull(),
        F.struct(
            parts.alias("date-parts"),
            F.coalesce(format_partial_date(date), F.lit("")).alias("date-time"),
        ),
    )


def _one(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.array(simple_clean(c)))


def biblio_to_work(biblio: DataFrame, *, source: str) -> DataFrame:
    """Adds the common record as ``json`` to ``biblio`` rows.

    ``license`` and ``subpath`` columns, when present, give the license and
    the archive link.
    """
    c = F.col

    def author(a: Column, i: Column) -> Column:
        orcid = F.filter(a["identifiers"], lambda x: F.lower(x["name"]) == "orcid")
        return F.struct(
            F.when(
                a["first_name"].isNotNull(), F.concat_ws(" ", a["first_name"], a["middle_name"])
            ).alias("given"),
            a["last_name"].alias("family"),
            F.when(i == 0, "first").otherwise("additional").alias("sequence"),
            F.try_element_at(orcid, F.lit(-1))["value"].alias("ORCID"),
            F.when(
                F.size(a["affiliations"]) > 0,
                F.transform(a["affiliations"], lambda n: F.struct(n.alias("name"))),
            ).alias("affiliation"),
        )

    def issn(kind: str, column: str) -> Column:
        return F.when(
            c(column).isNotNull(),
            F.struct(format_issn(c(column)).alias("value"), F.lit(kind).alias("type")),
        )

    issn_types = F.filter(
        F.array(issn("print", "issn"), issn("electronic", "eissn")), lambda x: x.isNotNull()
    )
    journal = F.filter(
        F.array(
            F.when(F.length("title") > 0, simple_clean(c("title"))),
            F.when(
                (F.length("title") > 0) & (F.length("collection_title") > 0),
                simple_clean(c("collection_title")),
            ),
        ),
        lambda t: t.isNotNull(),
    )
    issue = F.when(F.length("issue") > 0, simple_clean(c("issue")))
    funder = F.transform(
        "grants",
        lambda g: F.struct(
            F.when(F.length(g["agency"]) > 0, g["agency"]).otherwise("unknown").alias("name"),
            g["country"].alias("country"),
            F.array(g["grant_id"]).alias("award"),
        ),
    )
    license_code = c("license") if "license" in biblio.columns else F.lit(None).cast("string")
    subpath = c("subpath") if "subpath" in biblio.columns else F.lit(None).cast("string")
    links = F.filter(
        F.array(
            F.when(
                not_blank(subpath),
                F.struct(
                    subpath.alias("URL"), F.lit("application/tar+gzip").alias("content-type")
                ),
            ),
            F.when(
                c("pmc").isNotNull(),
                F.struct(
                    F.concat(F.lit(PMC_PDF), c("pmc"), F.lit("/pdf/")).alias("URL"),
                    F.lit("application/pdf").alias("content-type"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    reference = F.transform(
        "references",
        lambda r: F.struct(
            r["unstructured"].alias("unstructured"), r["pmid"].alias("pmid"),
            r["doi"].alias("DOI"), r["pmc"].alias("pmcid"), r["pii"].alias("pii"),
        ),
    )
    pages = page_range(c("start_page"), c("end_page"))
    nonempty = lambda a: F.when(F.size(a) > 0, a)
    members = {
        "source": F.lit(source),
        "indexed": _date_member(c("update_date")),
        "DOI": c("doi"),
        "prefix": doi_prefix(c("doi")),
        "URL": doi_url(c("doi")),
        "type": c("raw_type"),
        "publisher": c("publisher"),
        "volume": c("volume"),
        "journal-issue": F.when(issue.isNotNull(), F.struct(issue.alias("issue"))),
        "issue": issue,
        "page": F.when(F.length(pages) > 0, pages),
        "title": _one(c("article_title")),
        "container-title": nonempty(journal),
        "short-container-title": _one(c("journal_abbrev")),
        "author": nonempty(F.transform("authors", author)),
        "published": _date_member(c("publication_date")),
        "ISSN": nonempty(F.transform(issn_types, lambda x: x["value"])),
        "issn-type": nonempty(issn_types),
        "abstract": F.when(F.length("abstract") > 0, c("abstract")),
        "language": c("language"),
        "pmid": c("pmid"),
        "pmcid": c("pmc"),
        "pii": c("pii"),
        "halId": c("hal_id"),
        "halUri": c("hal_uri"),
        "funder": nonempty(funder),
        "mesh": nonempty(F.transform("mesh", mesh_record)),
        "license": F.when(not_blank(license_code), F.array(F.struct(license_code.alias("code")))),
        "link": nonempty(links),
        "reference-count": F.when(F.size("references") > 0, F.size("references")),
        "reference": nonempty(reference),
    }
    record = F.struct(*[value.alias(name) for name, value in members.items()])
    return biblio.withColumn("json", F.to_json(record, {"ignoreNullFields": "true"}))


def fill_missing_ids(
    df: DataFrame,
    maps: dict[str, DataFrame],
    *,
    spread_by: str,
    pmid: str = "pmid",
    doi: str = "doi",
    pmc: str = "pmc",
) -> DataFrame:
    """Fill DOI from PMID then PMC, PMID from DOI then PMC, PMC from PMID then DOI."""
    by_pmid, by_pmc, by_doi = maps["pmid"], maps["pmcid"], maps["doi"]
    out = left_lookup(
        df, F.when(F.col(doi).isNull() | F.col(pmc).isNull(), F.col(pmid)), by_pmid, "pmid",
        {"doi": "_doi1", "pmcid": "_pmc1"}, spread_by=spread_by,
    )
    out = left_lookup(
        out, F.when(F.coalesce(doi, "_doi1").isNull() | F.col(pmid).isNull(), normalise_pmc(F.col(pmc))),
        by_pmc, "pmcid", {"doi": "_doi2", "pmid": "_pmid2"}, spread_by=spread_by,
    )
    out = out.withColumn(doi, F.coalesce(doi, null_if_blank(F.col("_doi1")), null_if_blank(F.col("_doi2"))))
    out = left_lookup(
        out, F.when(F.col(pmid).isNull() | F.col(pmc).isNull(), normalise_doi(F.col(doi))),
        by_doi, "doi", {"pmid": "_pmid3", "pmcid": "_pmc3"}, spread_by=spread_by,
    )
    return out.withColumns(
        {
            pmid: F.coalesce(pmid, null_if_blank(F.col("_pmid3")), null_if_blank(F.col("_pmid2"))),
            pmc: F.coalesce(pmc, null_if_blank(F.col("_pmc1")), null_if_blank(F.col("_pmc3"))),
        }
    ).drop("_doi1", "_doi2", "_pmc1", "_pmc3", "_pmid2", "_pmid3")


def numbered_records(biblio: DataFrame) -> DataFrame:
    """The records with ``_owner``, a number of their own, written so that it stays."""
    return materialise(biblio.withColumn("_owner", F.monotonically_increasing_id()), "numbered-records")


def filled_references(rows: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """``_owner, _references`` of numbered records with references: ids filled, order kept."""
    refs = rows.filter(F.size("references") > 0).select("_owner", F.posexplode("references").alias("_pos", "r"))
    refs = refs.select(
        "_owner", "_pos", "r.unstructured", "r.pmid", "r.doi", "r.pmc", "r.pii"
    )
    refs = refs.withColumn("_ref", F.concat_ws("#", "_owner", "_pos"))
    filled = fill_missing_ids(refs, maps, spread_by="_ref")
    return filled.groupBy("_owner").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("_pos", "unstructured", "pmid", "doi", "pmc", "pii"))
            ),
            lambda r: F.struct(
                r["unstructured"].alias("unstructured"), r["pmid"].alias("pmid"),
                r["doi"].alias("doi"), r["pmc"].alias("pmc"), r["pii"].alias("pii"),
            ),
        ).alias("_references")
    )


def fill_reference_ids(
    biblio: DataFrame, maps: dict[str, DataFrame]
) -> DataFrame:
    """``fill_missing_ids`` for the references of each record, order kept.

    Records are numbered and written once, so a record's references find it again by
    its number; no list of references, however common, is a key.
    """
    rows = numbered_records(biblio)
    joined = rows.join(filled_references(rows, maps), "_owner", "left")
    return joined.withColumn("references", F.coalesce("_references", "references")).select(
        *biblio.columns
    )


def build_pubmed_mesh_table(biblio: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Per PMID: own or mapped DOI, own or mapped PMC id, MeSH classes."""
    rows = biblio.select("pmid", "doi", "pmc", "mesh")
    rows = left_lookup(rows, F.col("pmid"), maps["pmid"], "pmid", {"doi": "_doi"}, spread_by="pmid")
    rows = left_lookup(
        rows, F.when(F.col("pmc").isNull(), normalise_doi(F.col("_doi"))), maps["doi"], "doi",
        {"pmcid": "_pmc"}, spread_by="pmid",
    )
    return rows.select(
        "pmid",
        F.coalesce("doi", "_doi").alias("doi"),
        F.coalesce("pmc", normalise_pmc(F.col("_pmc"))).alias("pmc"),
        "mesh",
    )


def upsert_works(
    current: DataFrame, updates: DataFrame, *, key: str = "doi", order_by: tuple[str, ...] = ("indexed_ts", "seq")
) -> DataFrame:
    """Current rows and updates with the latest row per key.

    With equal order values an update wins over the current row.
    """
    both = current.withColumn("_fresh", F.lit(0)).unionByName(
        updates.withColumn("_fresh", F.lit(1))
    )
    order = [F.col(c).desc_nulls_last() for c in order_by]
    return latest_per_key(both, key, [*order, F.col("_fresh").desc()]).drop("_fresh")


def drop_column_and_reindex(records: DataFrame, *columns: str) -> DataFrame:
    """The search table without bulky columns."""
    return records.drop(*columns)


def drop_components(records: DataFrame, *, kind: str = "type", dropped: tuple[str, ...] = ("component",)) -> DataFrame:
    """The search table without sub-parts of publications."""
    return records.filter(~F.coalesce(F.col(kind).isin(*dropped), F.lit(False)))


CORRECTED_FIELDS = (
    "host_type", "document_type", "doi", "pii", "pmc", "pmid", "title", "volume", "issue",
    "start_page", "end_page", "publisher", "article_title", "collection_title",
    "journal_abbrev", "issn", "eissn", "isbn", "abstract",
)


def correct_records(
    target: DataFrame,
    source: DataFrame,
    *,
    key: str,
    fields: tuple[str, ...] = CORRECTED_FIELDS,
    lists: tuple[str, ...] = ("authors",),
    dates: tuple[str, ...] = ("publication_date",),
) -> DataFrame:
    """Field-wise correction of ``target`` by the row of ``source`` with the same key.

    A present source field replaces; a source list replaces when it is at
    least as long; a source date when it is at least as precise.
    """
    used = [c for c in (*fields, *lists, *dates) if c in source.columns and c in target.columns and c != key]
    side = source.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in used], F.lit(True).alias("_s"))
    joined = target.join(side, key, "left")
    columns = []
    for name in target.columns:
        new, old = F.col(f"_s_{name}"), F.col(name)
        if name not in used:
            columns.append(old)
        elif name in lists:
            longer = F.coalesce(F.size(new), F.lit(0)) >= F.coalesce(F.size(old), F.lit(0))
            columns.append(F.when(F.col("_s").isNotNull() & longer, new).otherwise(old).alias(name))
        elif name in dates:
            precise = F.coalesce(partial_size(new) >= partial_size(old), F.lit(False))
            columns.append(F.when(partial_size(old).isNull() | precise, F.coalesce(new, old)).otherwise(old).alias(name))
        else:
            columns.append(F.coalesce(new, old).alias(name))
    return joined.select(*columns)
