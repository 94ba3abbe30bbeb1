"""Readers for XML records: MEDLINE, repository TEI, parsed citations.

All produce ``biblio`` rows (see ``schemas.BIBLIO``).  Each document is parsed
once against an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions.codes import lang3_to_lang2, map_document_type
from biblioweave.functions.dates import partial_date, partial_date_from_iso
from biblioweave.functions.ids import clean_pubmed_id, isbn10_to_13
from biblioweave.functions.mesh import MESH_CLASS, mesh_chemical, mesh_struct
from biblioweave.functions.pages import expand_page_range
from biblioweave.functions.people import dedupe_authors
from biblioweave.functions.text import (
    bind, clean_reference_string, not_blank, null_if_blank, strip_markup,
)
from biblioweave.schemas import BIBLIO
from biblioweave.sources.works import line_place, place_of

_TEXT = "_VALUE:string"
_DATE = "struct<Year:string,Month:string,Day:string>"
_ARTICLE_IDS = f"struct<ArticleId:array<struct<_IdType:string,{_TEXT}>>>"
_MESH_NAME = f"struct<_UI:string,_MajorTopicYN:string,{_TEXT}>"

MEDLINE_ARTICLE = f"""
    MedlineCitation struct<
        PMID:struct<{_TEXT}>,
        DateRevised:{_DATE},
        Article:struct<
            Journal:struct<
                ISSN:array<struct<_IssnType:string,{_TEXT}>>,
                JournalIssue:struct<Volume:string,Issue:string,PubDate:{_DATE}>,
                Title:string,ISOAbbreviation:string>,
            ArticleTitle:string,
            Pagination:struct<StartPage:string,EndPage:string,MedlinePgn:string>,
            ELocationID:array<struct<_EIdType:string,_ValidYN:string,{_TEXT}>>,
            Abstract:struct<AbstractText:array<string>>,
            AuthorList:struct<Author:array<struct<
                LastName:string,ForeName:string,Suffix:string,Initials:string,
                Identifier:array<struct<_Source:string,{_TEXT}>>,
                AffiliationInfo:array<struct<Affiliation:string>>>>>,
            Language:array<string>,
            GrantList:struct<Grant:array<struct<
                GrantID:string,Acronym:string,Agency:string,Country:string>>>,
            PublicationTypeList:struct<PublicationType:array<struct<_UI:string,{_TEXT}>>>,
            ArticleDate:array<{_DATE}>>,
        ChemicalList:struct<Chemical:array<struct<
            RegistryNumber:string,NameOfSubstance:struct<_UI:string,{_TEXT}>>>>,
        MeshHeadingList:struct<MeshHeading:array<struct<
            DescriptorName:{_MESH_NAME},QualifierName:array<{_MESH_NAME}>>>>,
        KeywordList:array<struct<_Owner:string,
            Keyword:array<struct<_MajorTopicYN:string,{_TEXT}>>>>>,
    PubmedData struct<
        ArticleIdList:{_ARTICLE_IDS},
        ReferenceList:array<struct<Reference:array<struct<
            Citation:string,ArticleIdList:{_ARTICLE_IDS}>>>>>
"""


def _last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def _first_id(ids: Column, kind: str) -> Column:
    found = F.filter(ids["ArticleId"], lambda i: i["_IdType"] == kind)
    return null_if_blank(F.trim(F.get(found, F.lit(0))["_VALUE"]))


def _last_id(ids: Column, kind: str) -> Column:
    found = F.filter(ids["ArticleId"], lambda i: i["_IdType"] == kind)
    return null_if_blank(F.trim(_last(found)["_VALUE"]))


def _date_of(c: Column) -> Column:
    return partial_date(c["Year"], c["Month"], c["Day"])


def _as_biblio(df: DataFrame, values: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    missing = set(values) - set(BIBLIO)
    assert not missing, missing
    return df.select(
        *[F.col(k) for k in keep],
        *[
            values.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in BIBLIO.items()
        ],
    )


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """``biblio`` rows of MEDLINE files, plain or gzip."""
    rows = (
        spark.read.format("xml").option("rowTag", "PubmedArticle").schema(MEDLINE_ARTICLE).load(path)
    )
    citation, article = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    journal, ids = F.col("MedlineCitation.Article.Journal"), F.col("PubmedData.ArticleIdList")

    def issn(kind: str) -> Column:
        found = F.filter(journal["ISSN"], lambda i: i["_IssnType"] == kind)
        return null_if_blank(_last(found)["_VALUE"])

    valid_doi = F.filter(
        article["ELocationID"], lambda e: (e["_EIdType"] == "doi") & (e["_ValidYN"] == "Y")
    )
    pages = expand_page_range(article["Pagination"]["MedlinePgn"])
    start, end = (null_if_blank(article["Pagination"][n]) for n in ("StartPage", "EndPage"))
    language = F.filter(article["Language"], lambda x: not_blank(x) & (x != "und"))

    def person(a: Column) -> Column:
        return F.struct(
            null_if_blank(a["ForeName"]).alias("first_name"),
            F.lit(None).cast("string").alias("middle_name"),
            null_if_blank(a["LastName"]).alias("last_name"),
            null_if_blank(a["Suffix"]).alias("suffix"),
            null_if_blank(a["Initials"]).alias("initials"),
            F.transform(
                a["Identifier"],
                lambda i: F.struct(i["_Source"].alias("name"), i["_VALUE"].alias("value")),
            ).alias("identifiers"),
            F.filter(
                F.transform(a["AffiliationInfo"], lambda x: x["Affiliation"]), not_blank
            ).alias("affiliations"),
        )

    authors = F.filter(
        F.transform(article["AuthorList"]["Author"], person), lambda p: p["last_name"].isNotNull()
    )

    def descriptor(h: Column) -> Column:
        name = h["DescriptorName"]
        return mesh_struct(
            name["_VALUE"],
            name["_UI"],
            F.coalesce(name["_MajorTopicYN"] == "Y", F.lit(False)),
            F.transform(
                h["QualifierName"],
                lambda q: F.struct(
                    q["_VALUE"].alias("term"),
                    q["_UI"].alias("meshId"),
                    F.coalesce(q["_MajorTopicYN"] == "Y", F.lit(False)).alias("majorTopic"),
                ),
            ),
        )

    none = F.lit(None).cast(f"array<{MESH_CLASS}>")
    chemicals = F.transform(
        F.filter(
            citation["ChemicalList"]["Chemical"], lambda c: not_blank(c["NameOfSubstance"]["_UI"])
        ),
        lambda c: mesh_chemical(
            c["NameOfSubstance"]["_VALUE"], c["NameOfSubstance"]["_UI"], c["RegistryNumber"]
        ),
    )
    headings = F.transform(
        F.filter(
            citation["MeshHeadingList"]["MeshHeading"],
            lambda h: not_blank(h["DescriptorName"]["_UI"]),
        ),
        descriptor,
    )
    empty = F.array().cast(f"array<{MESH_CLASS}>")
    mesh = F.concat(
        F.coalesce(chemicals.cast(f"array<{MESH_CLASS}>"), empty),
        F.coalesce(headings.cast(f"array<{MESH_CLASS}>"), empty),
    )
    keywords = F.flatten(
        F.transform(
            citation["KeywordList"],
            lambda k: F.transform(
                k["Keyword"],
                lambda w: F.struct(
                    w["_VALUE"].alias("value"),
                    k["_Owner"].alias("origin"),
                    F.coalesce(w["_MajorTopicYN"] == "Y", F.lit(False)).alias("major_topic"),
                ),
            ),
        )
    )
    references = F.flatten(
        F.transform(
            F.filter(F.col("PubmedData.ReferenceList"), lambda r: r["Reference"].isNotNull()),
            lambda l: F.transform(
                l["Reference"],
                lambda r: F.struct(
                    clean_reference_string(strip_markup(r["Citation"])).alias("unstructured"),
                    _last_id(r["ArticleIdList"], "pubmed").alias("pmid"),
                    _last_id(r["ArticleIdList"], "doi").alias("doi"),
                    _last_id(r["ArticleIdList"], "pmc").alias("pmc"),
                    _last_id(r["ArticleIdList"], "pii").alias("pii"),
                ),
            ),
        )
    )
    abstract = F.array_join(
        F.filter(
            F.transform(article["Abstract"]["AbstractText"], strip_markup), not_blank
        ),
        " ",
    )
    return _as_biblio(
        rows,
        {
            "pmid": F.trim(citation["PMID"]["_VALUE"]),
            "doi": F.coalesce(
                null_if_blank(F.trim(_last(valid_doi)["_VALUE"])), _first_id(ids, "doi")
            ),
            "pmc": _first_id(ids, "pmc"),
            "pii": _first_id(ids, "pii"),
            "update_date": _date_of(citation["DateRevised"]),
            "publication_date": F.coalesce(
                _date_of(_last(article["ArticleDate"])),
                _date_of(journal["JournalIssue"]["PubDate"]),
            ),
            "article_title": bind(strip_markup(article["ArticleTitle"]), null_if_blank),
            "title": null_if_blank(journal["Title"]),
            "journal_abbrev": null_if_blank(journal["ISOAbbreviation"]),
            "volume": null_if_blank(journal["JournalIssue"]["Volume"]),
            "issue": null_if_blank(journal["JournalIssue"]["Issue"]),
            "start_page": F.coalesce(pages["start"], start),
            "end_page": F.coalesce(pages["end"], end),
            "start_page_int": F.coalesce(pages["start_int"], start.try_cast("int")),
            "end_page_int": F.coalesce(pages["end_int"], end.try_cast("int")),
            "raw_pages": pages["raw"],
            "issn": issn("Print"),
            "eissn": issn("Electronic"),
            "abstract": bind(abstract, null_if_blank),
            "language": lang3_to_lang2(_last(language)),
            "raw_language": F.when(
                lang3_to_lang2(_last(language)).isNull(), _last(language)
            ),
            "raw_type": _last(article["PublicationTypeList"]["PublicationType"])["_VALUE"],
            "authors": dedupe_authors(authors),
            "grants": F.transform(
                article["GrantList"]["Grant"],
                lambda g: F.struct(
                    g["GrantID"].alias("grant_id"), g["Acronym"].alias("acronym"),
                    g["Agency"].alias("agency"), g["Country"].alias("country"),
                ),
            ),
            "mesh": F.when(F.size(mesh) > 0, mesh).otherwise(none),
            "keywords": keywords,
            "references": references,
        },
    )


_IDNO = f"array<struct<_type:string,{_TEXT}>>"
_TITLE = f"array<struct<_level:string,_type:string,{_TEXT}>>"
_FORENAME = f"array<struct<_type:string,{_TEXT}>>"
_TEI_AUTHOR = (
    f"array<struct<_role:string,persName:struct<forename:{_FORENAME},surname:string>,"
    f"idno:{_IDNO}>>"
)
_IMPRINT = (
    f"struct<publisher:array<string>,biblScope:array<struct<_unit:string,{_TEXT}>>,"
    f"date:array<struct<_type:string,{_TEXT}>>>"
)
_BIBL_FULL = f"""struct<
    publicationStmt:struct<idno:{_IDNO}>,
    sourceDesc:struct<biblStruct:struct<
        analytic:struct<title:{_TITLE},author:{_TEI_AUTHOR}>,
        monogr:struct<idno:{_IDNO},title:{_TITLE},imprint:{_IMPRINT}>,
        series:struct<title:{_TITLE}>,
        idno:{_IDNO}>>,
    profileDesc:struct<
        langUsage:struct<language:array<struct<_ident:string,{_TEXT}>>>,
        textClass:struct<classCode:array<struct<_scheme:string,_n:string,{_TEXT}>>>,
        abstract:array<string>>>"""
HAL_TEI = f"""
    text struct<body:struct<listBibl:struct<biblFull:{_BIBL_FULL}>>>, _bad string
"""


# Elements that mark up words within a title or a name.
INLINE_TAGS = r"</?(?:hi|i|b|u|em|emph|strong|italic|bold|sub|sup|sc)(?:\s[^<>]*)?/?>"


def _parse_xml(c: Column, schema: str) -> Column:
    """The fields of TEI text; inline markup is taken away first, its words stay."""
    return F.from_xml(
        F.regexp_replace(c, INLINE_TAGS, ""), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "attributePrefix": "_"}
    )


def parse_hal_tei(df: DataFrame, col: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``biblio`` rows of repository TEI records in a text column.

    Text that cannot be parsed gives a row without a repository id.
    """
    rows = df.withColumn("_tei", _parse_xml(F.col(col), HAL_TEI))
    rows = rows.withColumn("_full", F.col("_tei.text.body.listBibl.biblFull"))
    struct = F.col("_full.sourceDesc.biblStruct")
    analytic, monogr = struct["analytic"], struct["monogr"]
    profile = F.col("_full.profileDesc")
    no_ids = F.array().cast(_IDNO)
    ids = F.concat(
        F.coalesce(F.col("_full.publicationStmt.idno"), no_ids),
        F.coalesce(monogr["idno"], no_ids),
        F.coalesce(struct["idno"], no_ids),
    )

    def idno(kind: str) -> Column:
        found = F.filter(ids, lambda i: (i["_type"] == kind) & not_blank(i["_VALUE"]))
        return F.trim(_last(found)["_VALUE"])

    def scope(*units: str) -> Column:
        found = F.filter(
            monogr["imprint"]["biblScope"],
            lambda s: s["_unit"].isin(*units) & not_blank(s["_VALUE"]) & (s["_VALUE"] != "n/a"),
        )
        return _last(found)["_VALUE"]

    def title(titles: Column, keep_title) -> Column:
        found = F.filter(titles, lambda t: not_blank(t["_VALUE"]) & keep_title(t))
        return _last(found)["_VALUE"]

    abbreviated = lambda t: F.coalesce(t["_type"] == "abbrev", F.lit(False))
    dates = F.filter(
        monogr["imprint"]["date"],
        lambda d: d["_type"].isin("datePub", "dateDefended") & not_blank(d["_VALUE"]),
    )
    pages = expand_page_range(scope("pp", "page"))
    pubmed = clean_pubmed_id(idno("pubmed"), idno("doi"))

    def person(a: Column) -> Column:
        middle = F.filter(a["persName"]["forename"], lambda f: f["_type"] == "middle")
        plain = F.filter(
            a["persName"]["forename"],
            lambda f: F.coalesce(f["_type"] != "middle", F.lit(True)),
        )
        return F.struct(
            null_if_blank(_last(plain)["_VALUE"]).alias("first_name"),
            null_if_blank(_last(middle)["_VALUE"]).alias("middle_name"),
            null_if_blank(a["persName"]["surname"]).alias("last_name"),
            F.lit(None).cast("string").alias("suffix"),
            F.lit(None).cast("string").alias("initials"),
            F.lit(None).cast("array<struct<name:string,value:string>>").alias("identifiers"),
            F.lit(None).cast("array<string>").alias("affiliations"),
        )

    authors = F.filter(
        F.transform(
            F.filter(
                analytic["author"], lambda a: a["_role"].isNull() | (a["_role"] == "aut")
            ),
            person,
        ),
        lambda p: p["last_name"].isNotNull(),
    )
    language = _last(profile["langUsage"]["language"])
    code = F.when(F.length(language["_ident"]) == 3, lang3_to_lang2(language["_ident"])).otherwise(
        language["_ident"]
    )
    typology = _last(
        F.filter(profile["textClass"]["classCode"], lambda c: c["_scheme"] == "halTypology")
    )
    kinds = map_document_type(typology["_n"])
    return _as_biblio(
        rows,
        {
            "pmid": pubmed["pmid"],
            "doi": pubmed["doi"],
            "pmc": pubmed["pmc"],
            "hal_id": idno("halId"),
            "hal_uri": idno("halUri"),
            "issn": idno("issn"),
            "isbn": isbn10_to_13(idno("isbn")),
            "volume": scope("volume"),
            "issue": scope("issue"),
            "collection_title": scope("serie", "series"),
            "start_page": pages["start"],
            "end_page": pages["end"],
            "start_page_int": pages["start_int"],
            "end_page_int": pages["end_int"],
            "raw_pages": pages["raw"],
            "title": title(
                monogr["title"], lambda t: t["_level"].isin("j", "m") & ~abbreviated(t)
            ),
            "journal_abbrev": title(
                monogr["title"], lambda t: (t["_level"] == "j") & abbreviated(t)
            ),
            "article_title": title(analytic["title"], lambda t: F.lit(True)),
            "publisher": null_if_blank(_last(monogr["imprint"]["publisher"])),
            "language": code,
            "raw_language": null_if_blank(language["_VALUE"]),
            "publication_date": partial_date_from_iso(_last(dates)["_VALUE"]),
            "raw_type": null_if_blank(typology["_VALUE"]),
            "document_type": kinds["document_type"],
            "host_type": kinds["host_type"],
            "authors": dedupe_authors(authors),
        },
        keep,
    )


def hal_page_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of landed repository response pages, with ``invalid`` for those
    that cannot be parsed or carry no repository id, and ``seq``, their place."""
    docs = (
        spark.read.schema("response struct<docs:array<struct<label_xml:string>>>")
        .option("multiLine", True)
        .json(path)
        .select(
            place_of(F.lit(0), F.lit(0)).alias("seq"), F.posexplode("response.docs").alias("line", "doc")
        )
        .select("doc.label_xml", F.col("seq").withField("line", F.col("line").cast("long")).alias("seq"))
    )
    rows = parse_hal_tei(docs, "label_xml", keep=("seq",))
    return rows.withColumn("invalid", ~not_blank(F.col("hal_id")) | F.col("hal_id").isNull())


def read_hal_pages(spark: SparkSession, path: str) -> DataFrame:
    """``biblio`` rows of landed repository response pages that carry an id."""
    return hal_page_records(spark, path).filter(~F.col("invalid")).drop("invalid")


def count_hal_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many records of the pages are accepted, and how many are invalid."""
    return _counted(hal_page_records(spark, path))


def _counted(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(~F.col("invalid")).alias("accepted"), F.count_if(F.col("invalid")).alias("invalid")
    )


def oai_pmh_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of landed OAI-PMH pages with metadata, the ``tei:`` prefix dropped;
    ``invalid`` and ``seq`` as for repository response pages."""
    records = (
        spark.read.format("xml").option("rowTag", "record").schema("metadata string").load(path)
        .select("metadata", line_place())
    )
    tei = records.select(
        F.regexp_replace("metadata", r"(</?)tei:", "$1").alias("tei"), "seq"
    ).filter(not_blank(F.col("tei")))
    rows = parse_hal_tei(tei, "tei", keep=("seq",))
    return rows.withColumn("invalid", ~not_blank(F.col("hal_id")) | F.col("hal_id").isNull())


def read_oai_pmh_pages(spark: SparkSession, path: str) -> DataFrame:
    """``biblio`` rows of landed OAI-PMH pages that carry an id."""
    return oai_pmh_records(spark, path).filter(~F.col("invalid")).drop("invalid")


def count_oai_pmh_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many records of the pages are accepted, and how many are invalid."""
    return _counted(oai_pmh_records(spark, path))


CITATION_TEI = f"""
    analytic struct<title:{_TITLE},author:array<struct<persName:array<struct<
        forename:{_FORENAME},surname:string>>>>>,
    monogr struct<title:{_TITLE},author:array<struct<persName:array<struct<
        forename:{_FORENAME},surname:string>>>>,
        imprint:struct<date:array<struct<_when:string,{_TEXT}>>>>,
    _bad string
"""


def _first_surname(authors: Column) -> Column:
    """First surname whose name has a forename of type ``first``."""
    names = F.flatten(
        F.filter(F.transform(authors, lambda a: a["persName"]), lambda p: p.isNotNull())
    )
    named = F.filter(
        names,
        lambda n: F.coalesce(F.exists(n["forename"], lambda f: f["_type"] == "first"), F.lit(False))
        & n["surname"].isNotNull(),
    )
    return F.get(named, F.lit(0))["surname"]


def parse_citation_tei(df: DataFrame, col: str) -> DataFrame:
    """Adds the fields of a parsed citation: title, authors, journal, year."""
    rows = df.withColumn("_bibl", _parse_xml(F.col(col), CITATION_TEI))
    analytic, monogr = F.col("_bibl.analytic"), F.col("_bibl.monogr")
    main = F.filter(
        analytic["title"], lambda t: (t["_level"] == "a") & (t["_type"] == "main")
    )
    when = F.filter(monogr["imprint"]["date"], lambda d: d["_when"].isNotNull())
    return rows.select(
        *[F.col(c) for c in df.columns],
        F.get(main, F.lit(0))["_VALUE"].alias("parsed_atitle"),
        _first_surname(analytic["author"]).alias("parsed_first_author"),
        _first_surname(monogr["author"]).alias("parsed_monograph_author"),
        F.get(monogr["title"], F.lit(0))["_VALUE"].alias("parsed_jtitle"),
        F.substring(_last(when)["_when"], 1, 4).alias("parsed_year"),
    )
