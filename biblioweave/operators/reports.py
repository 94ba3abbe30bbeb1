"""Coverage, id mapping, corpus export and enrichment merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.functions.dates import format_partial_date
from biblioweave.functions.ids import normalise_doi
from biblioweave.functions.mesh import has_major_topic
from biblioweave.functions.people import author_list
from biblioweave.functions.text import clean_article_title, not_blank, null_if_blank
from biblioweave.operators.keys import latest_per_key, left_lookup
from biblioweave.operators.tables import biblio_to_work, fill_missing_ids, filled_references, numbered_records
from biblioweave.schemas import EXPORT_COLUMNS


def coverage_ids(ids: DataFrame, kind: str) -> DataFrame:
    """Id rows that count for the coverage total of an input kind.

    ``archive``  every row, DOI the first of the list
    ``pmc``      rows with a PMID
    ``list``     every row
    """
    if kind == "archive":
        rows = ids.withColumn("doi", F.get("doi", F.lit(0)))
    elif kind == "pmc":
        rows = ids.filter(not_blank(F.col("pmid")))
    elif kind == "list":
        rows = ids
    else:
        raise ValueError(f"unknown input kind {kind!r}")
    keep = [c for c in ("pmid", "pmcid") if c in rows.columns and kind == "pmc"]
    return rows.select(normalise_doi(F.col("doi")).alias("doi"), *keep)


def _with_links(ids: DataFrame, kind: str, oa_links: DataFrame) -> DataFrame:
    rows = coverage_ids(ids, kind).withColumn("_row", F.monotonically_increasing_id())
    return left_lookup(
        rows, F.col("doi"), oa_links, "doi", {"oa_url": "oa_url"}, spread_by="_row"
    ).drop("_row")


def oa_hits(ids: DataFrame, kind: str, oa_links: DataFrame) -> DataFrame:
    """Ids with their open-access PDF link, as written to the hit file."""
    found = _with_links(ids, kind, oa_links).filter(not_blank(F.col("oa_url")))
    return found.select(
        *[c for c in found.columns if c != "oa_url"],
        F.struct(F.col("oa_url").alias("url_for_pdf")).alias("best_oa_location"),
    )


def oa_coverage(ids: DataFrame, kind: str, oa_links: DataFrame) -> DataFrame:
    """One row: total, hits and their ratio."""
    counts = _with_links(ids, kind, oa_links).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(not_blank(F.col("oa_url"))).alias("hits")
    )
    return counts.withColumn(
        "ratio", F.round(F.try_divide(F.col("hits").cast("double"), F.col("total")), 6)
    )


def map_istex(
    istex: DataFrame, by_doi: DataFrame, mesh: DataFrame | None = None, *, spread_by: str = "istex_id"
) -> DataFrame:
    """Every archive row with existing, mapped and chosen PMID and mapped PMC id.

    The existing PMID wins over the mapped one.  ``mesh`` is keyed by ``pmid``.
    """
    first = lambda c: F.get(F.col(c), F.lit(0))
    number = first("pmid").try_cast("int")
    rows = istex.select(
        "corpus_name", "istex_id",
        first("doi").alias("doi"), first("ark").alias("ark"), first("pii").alias("pii"),
        F.when(number != 0, number.cast("string")).alias("existing_pmid"),
    )
    rows = left_lookup(
        rows, normalise_doi(F.col("doi")), by_doi, "doi",
        {"pmid": "mapped_pmid", "pmcid": "pmcid"}, spread_by=spread_by,
    )
    rows = rows.withColumn("pmid", F.coalesce("existing_pmid", "mapped_pmid"))
    if mesh is None:
        return rows
    return left_lookup(
        rows, F.col("pmid"), mesh, "pmid", {"mesh": "mesh"}, spread_by=spread_by
    )


def map_istex_to_pubmed(
    istex: DataFrame, by_doi: DataFrame, mesh: DataFrame | None = None
) -> DataFrame:
    """Archive rows that have a PMID, in the shape of the mapping file."""
    rows = map_istex(istex, by_doi, mesh).filter(F.col("pmid").isNotNull())
    listed = lambda c: F.array_compact(F.array(F.col(c))).alias(c)
    shaped = [
        "corpus_name", "istex_id", listed("doi"), listed("ark"), listed("pmid"),
        F.array_compact(F.array(F.col("pmcid"))).alias("pmc"), listed("pii"),
    ]
    if mesh is not None:
        shaped.append("mesh")
    return rows.select(*shaped)


def istex_mapping_stats(mapped: DataFrame) -> DataFrame:
    """One row of totals over ``map_istex``."""
    existing = F.col("existing_pmid").isNotNull()
    found = F.col("mapped_pmid").isNotNull()
    classes = F.greatest(F.size("mesh"), F.lit(0)) if "mesh" in mapped.columns else F.lit(0)
    stats = mapped.agg(
        F.count(F.lit(1)).alias("ids"),
        F.count_if(found).alias("pmids_found"),
        F.count("pmcid").alias("pmcs_found"),
        F.count_if(existing).alias("already_present"),
        (F.count_if(found) - F.count_if(existing)).alias("added"),
        F.count_if(existing).alias("present_kept"),
        F.count_if(existing & ~found).alias("present_not_mapped"),
        F.count_if(classes > 0).alias("ids_with_mesh"),
        F.sum(classes).alias("mesh_classes"),
        F.count_if(existing & found & (F.col("existing_pmid") != F.col("mapped_pmid"))).alias(
            "conflicts"
        ),
    )
    mean = F.try_divide(F.col("mesh_classes").cast("double"), F.col("ids_with_mesh"))
    return stats.withColumn("mean_classes", F.round(mean, 6))


def select_by_mesh(
    mesh_table: DataFrame,
    selection: DataFrame,
    *,
    major: bool = True,
    only_pmc: bool = False,
    keep_repeats: bool = False,
) -> DataFrame:
    """Rows carrying a selected descriptor, per level 1 and level 2 class.

    With ``major`` the descriptor or one of its qualifiers must be a major
    topic.  A row is given once per class unless ``keep_repeats``.
    """
    rows = mesh_table.filter(F.col("pmid").isNotNull())
    if only_pmc:
        rows = rows.filter(F.col("pmc").isNotNull())
    classes = rows.select("pmid", F.explode("mesh").alias("m"))
    if major:
        classes = classes.filter(has_major_topic(F.col("m")))
    wanted = selection.select(
        "descriptor",
        F.explode(
            F.array(
                F.struct(F.lit("level1").alias("level_kind"), F.col("level1").alias("level")),
                F.struct(F.lit("level2").alias("level_kind"), F.col("level2").alias("level")),
            )
        ).alias("l"),
    )
    hits = classes.select("pmid", F.col("m.descriptor.meshId").alias("descriptor")).filter(
        F.col("descriptor").isNotNull()
    ).distinct().join(wanted, "descriptor").select("pmid", "l.level_kind", "l.level", "descriptor")
    if keep_repeats:
        return hits
    return hits.select("pmid", "level_kind", "level").distinct()


def export_records_csv(biblio: DataFrame) -> DataFrame:
    """The 16 export columns of ``biblio`` rows."""
    terms = F.filter(
        F.transform("mesh", lambda m: m["descriptor"]["term"]), lambda t: t.isNotNull()
    )
    host = (
        F.when(F.col("host_type").isin("journal", "proceedings"), F.col("title"))
        .when(F.col("host_type") == "collection", F.col("collection_title"))
        .otherwise(F.coalesce("title", F.lit("")))
    )
    values = {
        "pmid": F.col("pmid"),
        "doi": F.col("doi"),
        "pmc": F.col("pmc"),
        "title": clean_article_title(F.col("article_title")),
        "abstract": F.col("abstract"),
        "MeSH Terms": F.array_join(terms, ", "),
        "publication year": F.coalesce(format_partial_date(F.col("publication_date")), F.lit("")),
        "authors": F.coalesce(author_list(F.col("authors")), F.lit("")),
        "keywords": F.array_join(F.transform("keywords", lambda k: k["value"]), ", "),
        "publisher": F.col("publisher"),
        "host": host,
    }
    return biblio.select(
        *[values.get(name, F.lit("")).alias(name) for name in EXPORT_COLUMNS]
    )


def export_medline_as_works(biblio: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Work records as JSON of MEDLINE rows, ids completed from the id maps.

    Only ids go through the lookups; a record itself is moved once, to meet its ids
    and references by its number.
    """
    rows = numbered_records(biblio)
    ids = fill_missing_ids(rows.select("_owner", "pmid", "doi", "pmc"), maps, spread_by="_owner")
    ids = left_lookup(
        ids, F.col("pmc"), maps["pmcid"], "pmcid",
        {"license": "license", "subpath": "subpath"}, spread_by="_owner",
    )
    filled = (
        rows.drop("pmid", "doi", "pmc").join(ids, "_owner").join(filled_references(rows, maps), "_owner", "left")
        .withColumn("references", F.coalesce("_references", "references"))
    )
    return biblio_to_work(filled, source="pubmed").select("pmid", "doi", "json")


def enrichment_by_doi(entries: DataFrame, *, order: str = "entry_no") -> DataFrame:
    """One enrichment row per lower-case DOI, from the first entry that names it."""
    dois = F.array_distinct(
        F.transform(
            F.filter("external_ids", lambda i: (i["type"] == "doi") & i["value"].isNotNull()),
            lambda i: F.lower(i["value"]),
        )
    )
    keyed = entries.withColumn("doi", F.explode(dois))
    first = latest_per_key(keyed, "doi", [F.col(order)])

    def joined(values: Column) -> Column:
        return F.array_join(F.array_distinct(F.array_compact(values)), ";")

    affiliations = F.flatten(
        F.filter(
            F.transform("authors", lambda a: a["affiliations"]), lambda a: a.isNotNull()
        )
    )
    grids = F.filter(F.transform(affiliations, lambda a: a["grid"]), lambda g: g.isNotNull())
    addresses = F.flatten(
        F.filter(F.transform(grids, lambda g: g["addresses"]), lambda a: a.isNotNull())
    )
    return first.select(
        "doi",
        F.col("abstract").alias("new_abstract"),
        joined(
            F.transform(affiliations, lambda a: F.regexp_replace(a["name"], r"\.$", ""))
        ).alias("new_affiliation"),
        joined(F.transform(addresses, lambda a: a["country_code"])).alias("new_countries"),
        joined(F.transform(grids, lambda g: g["id"])).alias("new_grid"),
        joined(F.transform("funding", lambda f: f["org"])).alias("new_funder"),
        joined(F.transform("funding", lambda f: f["country"])).alias("new_funder_country"),
    )


FILLED_COLUMNS = {
    "affiliation": "new_affiliation",
    "author countries": "new_countries",
    "grid": "new_grid",
    "funding_organization": "new_funder",
    "funding country": "new_funder_country",
}


def match_enrichment(records: DataFrame, entries: DataFrame, *, spread_by: str = "pmid") -> DataFrame:
    """Export records with the enrichment values of their DOI beside them."""
    by_doi = enrichment_by_doi(entries).withColumn("matched", F.lit(True))
    new = [*FILLED_COLUMNS.values(), "new_abstract", "matched"]
    out = left_lookup(
        records, F.lower(null_if_blank(F.col("doi"))), by_doi, "doi", {c: c for c in new},
        spread_by=spread_by,
    )
    return out.withColumn("matched", F.coalesce("matched", F.lit(False)))


def merge_enrichment(records: DataFrame, entries: DataFrame, *, spread_by: str = "pmid") -> DataFrame:
    """Export records whose empty cells are filled from the enrichment entries."""
    out = match_enrichment(records, entries, spread_by=spread_by)
    filled = {**FILLED_COLUMNS, "abstract": "new_abstract"}

    def cell(name: str) -> Column:
        old = F.col(f"`{name}`")
        if name not in filled:
            return old
        new = F.col(filled[name])
        take = F.col("matched") & (F.length(F.coalesce(old, F.lit(""))) == 0)
        return F.when(take & (F.length(new) > 0), new).otherwise(old).alias(name)

    return out.select(*[cell(name) for name in records.columns])


def merge_enrichment_stats(records: DataFrame, entries: DataFrame, *, spread_by: str = "pmid") -> DataFrame:
    """One row: records, with DOI, matched, countries, affiliations, funders."""
    out = match_enrichment(records, entries, spread_by=spread_by)
    has = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    return out.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(has("doi")).alias("with_doi"),
        F.count_if(F.col("matched")).alias("matched"),
        F.count_if(F.col("matched") & has("new_countries")).alias("countries"),
        F.count_if(F.col("matched") & ~has("affiliation")).alias("affiliations"),
        F.count_if(F.col("matched") & has("new_funder")).alias("funders"),
    )
