"""Vectors for the column expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from biblioweave.functions import codes, dates, ids, pages, people, text


@pytest.mark.parametrize(
    "raw, want",
    [
        ("abc, .", "abc"), ("  abc", "abc"), ("", None), ("abc;", "abc"), ("a &lt;", "a &lt;"),
        ("(abc)", "abc"), ("a,,b", "a,b"), ("&quot;long enough&quot;", "long enough"),
        (",abc", ",abc"), ("..abc", ".abc"),
    ],
)
def test_clean_field(value, raw, want):
    assert value(text.clean_field, c=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [('""a  b\nc"', "a b c"), ("  x ", "x"), ('"', "")],
)
def test_simple_clean(value, raw, want):
    assert value(text.simple_clean, c=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("[Title].", "Title"), ("Title..", "Title."), ("Ti[t]le", "Ti[t]le")],
)
def test_clean_article_title(value, raw, want):
    assert value(text.clean_article_title, c=raw) == want


def test_strip_markup(value):
    assert value(text.strip_markup, c="A <i>RAS</i> &amp;\n &lt;b") == "A RAS & <b"


def test_fold_ascii(value):
    assert value(text.fold_ascii, c="Ærøskøbing Straße Žižek naïve Łódź") == (
        "AEroskobing Strasse Zizek naive Lodz"
    )


@pytest.mark.parametrize(
    "analyzer, want",
    [
        ("keyword", ["the élan of 2-fold"]),
        ("keyword_fold", ["the elan of 2-fold"]),
        ("words", ["the", "elan", "of", "2", "fold"]),
        ("words_stop", ["elan", "2", "fold"]),
    ],
)
def test_analyze(value, analyzer, want):
    assert value(lambda c: text.analyze(c, analyzer), c="The Élan of 2-fold") == want


@pytest.mark.parametrize(
    "raw, pmid, doi, pmc",
    [
        ("PMID:123", "123", None, None),
        ("pmid:123", "123", None, None),
        ("https://pubmed.ncbi.nlm.nih.gov/123/", "123", None, None),
        ("doi.org/10.1/x", None, "10.1/x", None),
        ("10.1/x", None, "10.1/x", None),
        ("http://www.ncbi.nlm.nih.gov/pmc/articles/pmc99/", None, None, "pmc99"),
        ("PMC5", None, None, "PMC5"),
        ("123DOI", "123", None, None),
        (" ", None, None, None),
    ],
)
def test_clean_pubmed_id(value, raw, pmid, doi, pmc):
    assert value(ids.clean_pubmed_id, c=raw) == {"pmid": pmid, "doi": doi, "pmc": pmc}


def test_clean_pubmed_id_keeps_known_doi(value):
    got = value(lambda p, d: ids.clean_pubmed_id(p, d), p="10.1/x", d="10.9/known")
    assert got == {"pmid": "10.1/x", "doi": "10.9/known", "pmc": None}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("0-306-40615-2", "9780306406157"), ("978-0-306-40615-7", "9780306406157"),
        ("0-306-4061X-2", None), ("8090273416", "9788090273412"), ("123", "123"),
    ],
)
def test_isbn(value, raw, want):
    assert value(ids.isbn10_to_13, c=raw) == want


def test_small_id_functions(value):
    assert value(ids.format_issn, c="12345678") == "1234-5678"
    assert value(ids.format_issn, c="1234-5678") == "1234-5678"
    assert value(ids.normalise_doi, c=" HTTPS://doi.org/10.1/AB ") == "10.1/ab"
    assert value(ids.normalise_doi, c=" ") is None
    assert value(ids.strip_doi_resolver, c='"https://doi.org/10.1103/PhysRev"') == "10.1103/PhysRev"
    assert value(ids.doi_prefix, c="10.1/a/b") == "10.1"
    assert value(ids.doi_prefix, c="10.1") is None
    assert value(ids.extract_doi, c='{"DOI" : "10.1234/ab.c"}') == "10.1234/ab.c"
    assert value(ids.extract_doi, c="no") is None
    assert value(lambda s, d, h: ids.record_id(s, d, h), s="HAL", d="d", h="h") == "hal:h"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("117-26", ("117", "126", 117, 126, None)),
        ("5911-5924", ("5911", "5924", 5911, 5924, None)),
        ("12,15", ("12", "15", 12, 15, None)),
        ("e5", ("5", "e5", 5, None, "e5")),
        ("S12-5", ("12", "S15", 12, None, "S12-5")),
        ("Suppl: 7", ("7", "7", 7, 7, None)),
        ("30 discussion", ("30", "30", 30, 30, None)),
    ],
)
def test_expand_page_range(value, raw, want):
    got = value(pages.expand_page_range, c=raw)
    assert tuple(got[k] for k in ("start", "end", "start_int", "end_int", "raw")) == want


def test_unknown_pages(value):
    for raw in ("n/a", "n/a-n/a", "passim", None):
        assert value(pages.expand_page_range, c=raw) is None


def test_page_range(value):
    make = lambda s, e: pages.page_range(s, e)
    assert value(make, s="1", e="5") == "1-5"
    assert value(make, s="1", e="1") == "1"
    assert value(make, s="1", e=" ") == "1"
    assert value(make, s=None, e="5") == "5"
    assert value(make, s=None, e=None) == ""


def test_first_page(value):
    assert value(pages.first_page, c=" 279-293") == "279"
    assert value(pages.first_page, c="12,15") == "12"


@pytest.mark.parametrize(
    "y, m, d, want",
    [
        ("2016", "Sep", "31", (2016, 9, 30)), ("2016", "02", "30", (2016, 2, 28)),
        ("2016", "Dec", None, (2016, 12, None)), ("2016", None, "3", (2016, None, None)),
        ("x", "1", "1", None), ("2016", "Fall", "2", (2016, None, None)),
    ],
)
def test_partial_date(value, y, m, d, want):
    got = value(lambda a, b, c: dates.partial_date(a, b, c), y=y, m=m, d=d)
    assert (got and tuple(got.values())) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2019", (2019, None, None)), ("2019-05", (2019, 5, None)),
        ("2019-05-31", (2019, 5, 31)), ("2019-06-31", (2019, 6, 30)), ("20", None), (None, None),
    ],
)
def test_partial_date_from_iso(value, raw, want):
    got = value(dates.partial_date_from_iso, c=raw)
    assert (got and tuple(got.values())) == want


@pytest.mark.parametrize(
    "raw, day_first, want",
    [
        ("2001", False, "2001"), ("2001-05", False, "2001-05"), ("2001-05-07", False, "2001-05-07"),
        ("05-2001", True, "2001-05"), ("07-05-2001", True, "2001-05-07"),
        ("2001-5", False, None), ("ab-cd-2001", True, None),
    ],
)
def test_parse_partial_date(value, raw, day_first, want):
    make = lambda c: dates.format_partial_date(dates.parse_partial_date(c, day_first))
    assert value(make, c=raw) == want


def test_partial_to_date(value):
    make = lambda c: dates.partial_to_date(dates.parse_partial_date(c))
    assert value(make, c="2001") == datetime.date(2001, 1, 1)
    assert value(make, c="2001-02-31") is None


@pytest.mark.parametrize(
    "printed, electronic, want",
    [
        ("2001", None, "2001"), (None, "2001", "2001"), ("2001-03", "2001-02-01", "2001-02-01"),
        ("2001", "2001-02", "2001-02"), ("2001-02-03", "2001-02", "2001-02-03"), ("2000-12", "2001", "2000-12"),
    ],
)
def test_oldest_date(value, printed, electronic, want):
    make = lambda p, e: dates.format_partial_date(
        dates.oldest_date(dates.parse_partial_date(p), dates.parse_partial_date(e))
    )
    assert value(make, p=printed, e=electronic) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2001", "2001-12-31"), ("2001-02", "2001-02-28"), ("2001-4", "2001-04-30"),
        ("2001-13", "2001-12-31"), ("2001-07-09", "2001-07-09"), ("2001-", "2001-12-31"),
        ("1899", ""), ("2999", ""), ("20", ""), ("2001-07-09 10:00", ""), ("garbage!!", ""),
    ],
)
def test_complete_date(value, raw, want):
    assert value(dates.complete_date, c=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("2001-00", "2001"), ("2001-00-00", "2001"), ("2001-03-09", "09-03-2001"), ("2001-13-09", "2001-13-09")],
)
def test_clean_display_date(value, raw, want):
    assert value(dates.clean_display_date, c=raw) == want


@pytest.mark.parametrize(
    "json, want",
    [
        ('{"issued":{"date-parts":[[2001,2]]}}', "2001"),
        ('{"issued":{"date-parts":[2002,2]}}', "2002"),
        ('{"published":{"date-parts":[[2003]]}}', "2003"),
        ('{"published-online":{"date-parts":[[2004]]}}', "2004"),
        ('{"published-print":{"date-parts":[[2005]]}}', "2005"),
        ('{"created":{"date-parts":[[2006]]}}', "2006"),
        ('{"issued":{"date-parts":[[null]]},"created":{"date-parts":[[2007]]}}', "2007"),
        ("{}", None),
    ],
)
def test_publication_year(value, json, want):
    assert value(dates.publication_year, c=json) == want


@pytest.mark.parametrize(
    "raw, want",
    [("JEAN-PIERRE", "Jean-Pierre"), ("o. mcDONALD", "O. Mcdonald"), ("a,b;c", "A,B;C")],
)
def test_normalise_person_name(value, raw, want):
    assert value(people.normalise_person_name, c=raw) == want


AUTHORS = "array<struct<family:string,sequence:string>>"


@pytest.mark.parametrize(
    "authors, first, first_marked, families, first_family",
    [
        ([("A", None), ("B", None)], "A", None, "A B", "A"),
        ([("A", "first"), ("B", "first")], "B", "A", "A B", "A"),
        ([(None, None), ("B", None)], None, None, "B", "B"),
        ([(None, "first"), ("B", "additional")], None, None, "B", "B"),
        ([], None, None, None, None),
        (None, None, None, None, None),
    ],
)
def test_author_fields(spark, authors, first, first_marked, families, first_family):
    df = spark.createDataFrame([(authors,)], f"a {AUTHORS}")
    got = df.select(
        people.first_author(F.col("a")), people.sequence_first_family(F.col("a")),
        people.author_families(F.col("a")), people.first_family_name(F.col("a")),
    ).collect()[0]
    assert tuple(got) == (first, first_marked, families, first_family)


def test_dedupe_authors(spark):
    person = "struct<first_name:string,middle_name:string,last_name:string,initials:string>"
    rows = [
        ("Ann", None, "X", "A"), ("Ann", None, "X", "B"), (None, None, "X", "A"), ("Bob", None, "Y", None),
        ("Bob", None, "Y", None), ("Cid", None, "Y", None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(rows,)], f"a array<{person}>")
    got = df.select(people.dedupe_authors(F.col("a")).alias("a")).collect()[0]["a"]
    # a newcomer without first name is compared by its initials
    assert [(p.first_name, p.last_name) for p in got] == [("Ann", "X"), ("Bob", "Y"), ("Cid", "Y")]


def test_languages(value):
    assert value(codes.lang3_to_lang2, c="eng") == "en"
    assert value(codes.lang3_to_lang2, c="deu") == "de"
    assert value(codes.lang3_to_lang2, c="ger") is None
    assert len(codes.LANGUAGE_CODES.split()) == len(set(codes.LANGUAGE_CODES.split()))


def test_document_types(value):
    assert value(codes.map_document_type, c="COMM") == {
        "document_type": "article", "host_type": "proceedings",
    }
    assert value(codes.map_document_type, c="?") == {"document_type": None, "host_type": None}
