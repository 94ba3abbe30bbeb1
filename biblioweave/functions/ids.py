"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioweave.functions.text import bind, not_blank

# Fixed value: a DOI inside JSON text.
DOI_IN_JSON = r'"DOI"\s?:\s?"(10\.\d{4,5}/[^"\s]+[^;,.\s])"'


def normalise_doi(c: Column) -> Column:
    """Lower-case DOI without resolver prefix; blank becomes null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", "")
    return F.when(not_blank(bare), bare)


def strip_doi_resolver(c: Column) -> Column:
    """DOI of an id-map file: quotes and resolver prefix removed, case kept."""
    bare = F.regexp_replace(F.replace(c, F.lit('"'), F.lit("")), r"^https?://doi\.org/", "")
    return F.when(not_blank(bare), bare)


def normalise_key(c: Column) -> Column:
    """Lower-case key; blank becomes null."""
    return F.when(not_blank(c), F.lower(c))


def normalise_pmc(c: Column) -> Column:
    """Add the ``PMC`` prefix unless it is there in any case."""
    return F.when(F.lower(c).startswith("pmc"), c).otherwise(F.concat(F.lit("PMC"), c))


def clean_pubmed_id(pmid: Column, doi: Column | None = None, pmc: Column | None = None) -> Column:
    """Struct ``(pmid, doi, pmc)`` from a raw PubMed id field.

    Prefixes and URLs are stripped; a value that is really a DOI or a PMC id
    moves to that field when the field is still empty.
    """
    doi = F.lit(None).cast("string") if doi is None else doi
    pmc = F.lit(None).cast("string") if pmc is None else pmc
    raw = F.when(F.length(F.trim(pmid)) > 0, pmid)
    value = F.when(
        raw.rlike("^(PMID|pmid):"), F.regexp_replace(raw, "PMID:|pmid:", "")
    ).otherwise(raw)
    value = F.when(
        value.rlike(r"^(https://)?pubmed\.ncbi\.nlm\.nih\.gov/"),
        F.regexp_replace(value, r"(https://)?pubmed\.ncbi\.nlm\.nih\.gov/", ""),
    ).otherwise(value)
    value = F.regexp_replace(value, r"^https?://www\.ncbi\.nlm\.nih\.gov/pmc/articles/(?=pmc)", "")
    value = F.when(value.endswith("/"), F.replace(value, F.lit("/"), F.lit(""))).otherwise(value)
    return bind(value, lambda v: _routed(v, doi, pmc))


def _routed(value: Column, doi: Column, pmc: Column) -> Column:
    as_doi = F.coalesce(value.rlike(r"^(doi\.org/)?10\..*/"), F.lit(False)) & doi.isNull()
    as_pmc = ~as_doi & F.coalesce(value.rlike("^(PMC|pmc)"), F.lit(False)) & pmc.isNull()
    plain = F.when(value.endswith("DOI"), F.replace(value, F.lit("DOI"), F.lit(""))).otherwise(value)
    return F.struct(
        F.when(~as_doi & ~as_pmc, F.trim(plain)).alias("pmid"),
        F.when(as_doi, F.trim(F.regexp_replace(value, r"^doi\.org/", ""))).otherwise(doi).alias("doi"),
        F.when(as_pmc, value).otherwise(pmc).alias("pmc"),
    )


def record_id(source: Column, doi: Column, hal_id: Column) -> Column:
    """``source:identifier`` for the two supported sources, else null."""
    name = F.lower(source)
    return F.when(name == "crossref", F.concat(name, F.lit(":"), doi)).when(
        name == "hal", F.concat(name, F.lit(":"), hal_id)
    )


def format_issn(c: Column) -> Column:
    """``####-####`` for an eight character ISSN, other values unchanged."""
    return F.when(
        F.length(c) == 8, F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 4))
    ).otherwise(c)


def isbn10_to_13(c: Column) -> Column:
    """ISBN without hyphens; ten digits become thirteen, invalid ten become null."""
    bare = F.replace(c, F.lit("-"), F.lit(""))
    body = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    digits = F.filter(F.split(body, ""), lambda d: d != "")
    total = F.aggregate(
        F.transform(digits, lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 1).otherwise(3)),
        F.lit(0),
        lambda acc, d: acc + d,
    )
    check = F.pmod(F.lit(10) - total % 10, F.lit(10))
    return F.when(
        F.length(bare) == 10,
        F.when(body.rlike(r"^\d{12}$"), F.concat(body, check.cast("string"))),
    ).otherwise(bare)


def doi_prefix(c: Column) -> Column:
    """Registrant prefix of a DOI, null when there is no slash."""
    return F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1))


def doi_url(c: Column) -> Column:
    return F.concat(F.lit("http://dx.doi.org/"), c)


def extract_doi(c: Column) -> Column:
    """First DOI member of a JSON text, null when there is none."""
    found = F.regexp_extract(c, DOI_IN_JSON, 1)
    return F.when(found != "", found)
