"""Readers over small files of every format, and the writers."""

import gzip
import io
import json
import lzma
import tarfile

import pytest
from pyspark.sql import functions as F

from biblioweave.operators import records as R
from biblioweave.operators import reports, tables
from biblioweave.plans.loading import audit_collection, export_mesh_corpus, load_dump
from biblioweave.sources import idfiles, sinks, works, xml

WORKS = [
    {"DOI": "10.1/A", "type": "journal-article", "source": "Crossref", "title": ["First\n  title", " "],
     "author": [{"given": "A", "family": "Alpha", "sequence": "first"}, {"family": "Beta"}],
     "container-title": ["Journal"], "volume": "7", "issue": "2", "page": "279-293",
     "issued": {"date-parts": [[2001, 2]]}, "indexed": {"date-time": "2020-01-01T00:00:00Z"},
     "reference": [1], "abstract": "x", "_id": {"$oid": "1"}},
    {"DOI": "10.1/b", "type": "component", "source": "Crossref"},
    {"DOI": " ", "type": "book"},
    {"DOI": "10.1/c", "title": "Plain [title]", "volume": 12, "published": {"date-parts": [1999]},
     "indexed": {"date-time": "not a date"}},
]


def lines(rows):
    return "\n".join(json.dumps(r) for r in rows)


def write(path, data, opener=open):
    with opener(path, "wt") as out:
        out.write(data)


def test_works_jsonl(spark, tmp_path):
    write(tmp_path / "w.json", lines(WORKS) + "\n{broken\n{'DOI': '10.1/quoted'}\n\n")
    rows = {r.doi: r for r in works.read_works_jsonl(spark, str(tmp_path / "w.json")).collect()}
    assert len(rows) == 6 and sum(r.invalid for r in rows.values()) == 1
    first = rows["10.1/A"]
    assert first.title == ["First\n  title", " "] and first.author[1].family == "Beta"
    assert first.year == "2001" and first.indexed_ts.year == 2020
    assert rows["10.1/c"].title == ["Plain [title]"] and rows["10.1/c"].volume == "12"
    assert rows["10.1/c"].year == "1999" and rows["10.1/c"].indexed_ts is None
    assert "10.1/quoted" in rows


def test_array_text_detection():
    assert works.is_array_text('{"items":[{"DOI"', "")
    assert works.is_array_text("{", '  "items" : [')
    assert works.is_array_text("{", '"items": [')
    assert not works.is_array_text('{"DOI":"1"}', '{"DOI":"2"}')


def test_works_directory_of_all_formats(spark, tmp_path):
    dump = tmp_path / "dump"
    dump.mkdir()

    def work(name):
        return {"DOI": f"10.1/{name}"}

    write(dump / "plain.json", lines([work("plain1"), work("plain2")]))
    write(dump / "zipped.JSON.gz", lines([work("gz")]), gzip.open)
    write(dump / "array.json", json.dumps({"items": [work("array1"), work("array2")]}, separators=(",", ":")))
    write(dump / "pretty.json.gz", '{\n"items" : [\n' + lines([work("pretty")]) + "\n]}", gzip.open)
    write(dump / "packed.json.xz", lines([work("xz1"), work("xz2")]), lzma.open)
    write(dump / "other.txt", lines([work("ignored")]))
    with tarfile.open(dump / "set.tar.gz", "w:gz") as archive:
        for name, data in (
            ("d/a.json", json.dumps({"items": [work("tar1")]}).encode()),
            ("d/b.json.gz", gzip.compress(json.dumps({"items": [work("tar2")]}).encode())),
            ("d/readme", b"no record"),
        ):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    got = {r.doi[5:] for r in works.read_works(spark, str(dump)).collect()}
    assert got == {
        "plain1", "plain2", "gz", "array1", "array2", "pretty", "xz1", "xz2", "tar1", "tar2",
    }
    assert works.read_works(spark, str(dump / "packed.json.xz")).count() == 2


def test_array_file_without_items(spark, tmp_path):
    write(tmp_path / "x.json", '{"other": []}')
    assert works.read_works_array(spark, str(tmp_path / "x.json")).count() == 0


def test_api_pages(spark, tmp_path):
    write(tmp_path / "p.json", json.dumps({"status": "ok", "message": {"next-cursor": "c", "items": WORKS[:2]}}))
    assert works.read_api_pages(spark, str(tmp_path / "p.json")).count() == 2


def test_load_dump(spark, tmp_path):
    newer = {**WORKS[0], "DOI": "10.1/a", "volume": "8", "indexed": {"date-time": "2021-01-01T00:00:00Z"}}
    write(tmp_path / "w.json", lines([newer, *WORKS]) + "\n{broken")
    metrics = load_dump(spark, str(tmp_path / "w.json"), str(tmp_path / "out")).collect()[0]
    assert tuple(metrics) == (6, 3, 3, 3, 0)
    stored = {r.doi: r for r in spark.read.parquet(str(tmp_path / "out/works")).collect()}
    assert set(stored) == {"10.1/a", "10.1/c"} and stored["10.1/a"].volume == "8"
    assert not {"reference", "abstract", "indexed", "_id"} & set(json.loads(stored["10.1/a"].json))
    search = {r.id: r for r in spark.read.parquet(str(tmp_path / "out/search")).collect()}
    record = search["crossref:10.1/a"]
    assert record.title == ["First title"] and record.first_page == "279"
    assert record.bibliographic == "Alpha Beta First title Journal 8 2 279 2001"
    mark = spark.read.parquet(str(tmp_path / "out/state")).collect()[0].last_indexed
    assert mark.year == 2021


def test_pmid_map(spark, tmp_path):
    write(
        tmp_path / "ids.csv",
        'PMID,PMCID,DOI\n7300001,,"https://doi.org/10.5555/own.fixture.7"\n1,PMC1,"10.1/X"\n2,PMC2,\n3,a,b,c\n4\n',
    )
    got = {r.pmid: (r.pmcid, r.doi) for r in idfiles.read_pmid_map(spark, str(tmp_path / "ids.csv")).collect()}
    assert got == {
        "7300001": (None, "10.5555/own.fixture.7"), "1": ("PMC1", "10.1/X"), "2": ("PMC2", None),
        "4": (None, None),
    }


def test_oa_file_list_and_update(spark, tmp_path):
    write(tmp_path / "oa.tsv", "by\tc\tPMC1\tx\tp1\n\tc\tPMC1\tx\tp2\nby\tc\tPMC9\tx\tp\nshort\tx\n")
    files = idfiles.read_oa_file_list(spark, str(tmp_path / "oa.tsv"))
    assert files.count() == 3
    ids = spark.createDataFrame(
        [("1", "PMC1", "10.1/x", None, None), ("2", None, None, None, "keep")],
        "pmid string, pmcid string, doi string, license string, subpath string",
    )
    got = {r.pmid: (r.license, r.subpath) for r in tables.enrich_pmid_with_oa_files(ids, files).collect()}
    assert got == {"1": ("by", "p2"), "2": (None, "keep")}
    assert tables.count_unknown_pmc(ids, files).collect()[0][0] == 1


def test_oa_locations(spark, tmp_path):
    rows = [
        {"doi": "10.1/A", "best_oa_location": {"url_for_pdf": "http://a"}, "updated": "2"},
        {"doi": "10.1/a", "best_oa_location": {"url_for_pdf": "http://old"}, "updated": "1"},
        {"doi": "10.1/b", "best_oa_location": None}, {"doi": "10.1/c", "best_oa_location": {"url_for_pdf": " "}},
    ]
    write(tmp_path / "oa.json", lines(rows) + "\nnot json\n")
    links = tables.build_oa_links(idfiles.read_oa_locations(spark, str(tmp_path / "oa.json")))
    assert [tuple(r) for r in links.collect()] == [("10.1/a", "http://a")]


def test_istex_ids(spark, tmp_path):
    rows = [
        {"corpusName": "c", "istexId": "I1", "doi": ["10.1/A", "10.1/B"], "pii": ["S1"], "ark": ["ark:/1"]},
        {"corpusName": "c", "istexId": "I2", "doi": []}, {"corpusName": "c", "istexId": "I3"},
    ]
    write(tmp_path / "i.json", lines(rows))
    istex = idfiles.read_istex_ids(spark, str(tmp_path / "i.json"))
    assert [r.istex_id for r in istex.collect()] == ["I1"]
    maps = tables.build_istex_maps(istex)
    assert {r.key for r in maps["doi"].collect()} == {"10.1/a", "10.1/b"}
    assert {r.key for r in maps["pii"].collect()} == {"s1"}


CITATION = """<biblStruct><analytic><title level="a" type="main">A <hi>long</hi> title</title>
<author><persName xmlns="http://www.tei-c.org/ns/1.0"><forename type="first">Jo</forename>
<surname>Doe</surname></persName></author></analytic>
<monogr><title level="j">Some Journal</title><imprint><date type="published" when="2016-05" /></imprint></monogr></biblStruct>"""
MONOGRAPH = """<biblStruct ><monogr><author><persName xmlns="http://www.tei-c.org/ns/1.0">
<forename type="first">R</forename><forename type="middle">K</forename><surname>Roe</surname></persName>
<persName><forename type="first">Second</forename><surname>Two</surname></persName></author>
<title level="m">Particles</title></monogr></biblStruct>"""


def test_parsed_citations(spark):
    df = spark.createDataFrame(
        [("a", CITATION), ("m", MONOGRAPH), ("bad", "<biblStruct><x>"), ("none", None)],
        "req_id string, tei string",
    )
    got = {r.req_id: tuple(r)[2:] for r in xml.parse_citation_tei(df, "tei").collect()}
    assert got["a"] == ("A long title", "Doe", None, "Some Journal", "2016")
    assert got["m"] == (None, None, "Roe", "Particles", None)
    assert got["bad"] == got["none"] == (None,) * 5


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:hal="http://hal.example"><text><body><listBibl><biblFull>
<publicationStmt><idno type="halId">hal-001</idno><idno type="halUri">https://hal/hal-001</idno></publicationStmt>
<sourceDesc><biblStruct><analytic><title xml:lang="en">English title</title><title xml:lang="fr">Titre</title>
<author role="aut"><persName><forename type="first">Ann</forename><forename type="middle">B</forename><surname>Aa</surname></persName></author>
<author role="edt"><persName><forename type="first">Ed</forename><surname>Ee</surname></persName></author>
<author><persName><forename type="first">No</forename><surname>Nn</surname></persName></author></analytic>
<monogr><idno type="issn">1234-5678</idno><idno type="isbn">0-306-40615-2</idno><title level="j">Journal J</title>
<title level="j" type="abbrev">J. J.</title><imprint><publisher>Pub</publisher><biblScope unit="volume">n/a</biblScope>
<biblScope unit="issue">4</biblScope><biblScope unit="serie">Series</biblScope><biblScope unit="pp">117-26</biblScope>
<date type="datePub">2019-06-31</date></imprint></monogr><idno type="doi">10.1/H</idno><idno type="pubmed">77</idno>
</biblStruct></sourceDesc><profileDesc><langUsage><language ident="fra">French</language></langUsage>
<textClass><classCode scheme="halDomain" n="x">y</classCode><classCode scheme="halTypology" n="COMM">Conference papers</classCode>
</textClass></profileDesc></biblFull></listBibl></body></text></TEI>"""


def check_hal(row):
    assert (row.hal_id, row.hal_uri, row.doi, row.pmid) == ("hal-001", "https://hal/hal-001", "10.1/H", "77")
    assert (row.issn, row.isbn) == ("1234-5678", "9780306406157")
    assert (row.article_title, row.title, row.journal_abbrev) == ("Titre", "Journal J", "J. J.")
    assert (row.volume, row.issue, row.collection_title, row.publisher) == (None, "4", "Series", "Pub")
    assert (row.start_page, row.end_page) == ("117", "126")
    assert tuple(row.publication_date) == (2019, 6, 30)
    assert (row.language, row.raw_language) == ("fr", "French")
    assert (row.raw_type, row.document_type, row.host_type) == ("Conference papers", "article", "proceedings")
    assert [(a.first_name, a.middle_name, a.last_name) for a in row.authors] == [
        ("Ann", "B", "Aa"), ("No", None, "Nn"),
    ]


def test_hal_pages_and_works(spark, tmp_path):
    page = {"response": {"docs": [{"label_xml": TEI}, {"label_xml": "<TEI><broken>"}]}, "nextCursorMark": "x"}
    write(tmp_path / "p.json", json.dumps(page))
    biblio = xml.read_hal_pages(spark, str(tmp_path / "p.json"))
    rows = biblio.collect()
    assert len(rows) == 1
    check_hal(rows[0])
    hal_works, doi_hal = tables.build_hal_works(biblio)
    record = json.loads(hal_works.collect()[0].json)
    assert record["source"] == "hal" and record["title"] == ["Titre"] and record["page"] == "117-126"
    assert record["container-title"] == ["Journal J", "Series"] and record["halId"] == "hal-001"
    assert record["published"] == {"date-parts": [2019, 6, 30], "date-time": "2019-06-30"}
    assert record["author"][0] == {"given": "Ann B", "family": "Aa", "sequence": "first"}
    assert record["issn-type"] == [{"value": "1234-5678", "type": "print"}]
    assert [tuple(r) for r in doi_hal.collect()] == [("10.1/h", "hal-001")]


def test_oai_pmh_pages(spark, tmp_path):
    import re

    prefixed = re.sub(r"<(/?)(\w)", r"<\1tei:\2", TEI).replace("xmlns=", "xmlns:tei=")
    write(
        tmp_path / "o.xml",
        f"<OAI-PMH><ListRecords><record><metadata>{prefixed}</metadata></record>"
        "<resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>",
    )
    rows = xml.read_oai_pmh_pages(spark, str(tmp_path / "o.xml")).collect()
    assert len(rows) == 1
    check_hal(rows[0])


MEDLINE = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">123</PMID>
<DateRevised><Year>2020</Year><Month>09</Month><Day>30</Day></DateRevised><Article><Journal>
<ISSN IssnType="Electronic">1111-2222</ISSN><JournalIssue><Volume>11</Volume><Issue>3</Issue>
<PubDate><Year>2016</Year><Month>Sep</Month><Day>31</Day></PubDate></JournalIssue><Title>Cancer J</Title>
<ISOAbbreviation>Canc J</ISOAbbreviation></Journal><ArticleTitle>Effects of <i>RAS</i> in cells.</ArticleTitle>
<Pagination><StartPage>S12</StartPage><MedlinePgn>5911-24</MedlinePgn></Pagination>
<ELocationID EIdType="doi" ValidYN="N">10.1/bad</ELocationID><ELocationID EIdType="doi" ValidYN="Y">10.1/good</ELocationID>
<Abstract><AbstractText Label="A">Part <b>one</b>.</AbstractText><AbstractText>Part two.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName><Initials>J</Initials>
<Identifier Source="ORCID">0000-1</Identifier><AffiliationInfo><Affiliation>Lab 1</Affiliation></AffiliationInfo></Author>
<Author><CollectiveName>Group</CollectiveName></Author></AuthorList><Language>und</Language><Language>eng</Language>
<GrantList><Grant><GrantID>G1</GrantID><Agency>NIH</Agency><Country>US</Country></Grant></GrantList>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType><PublicationType UI="D2">Journal Article</PublicationType></PublicationTypeList>
</Article><ChemicalList><Chemical><RegistryNumber>0</RegistryNumber><NameOfSubstance UI="D9">Iron</NameOfSubstance></Chemical></ChemicalList>
<MeshHeadingList><MeshHeading><DescriptorName UI="D003446" MajorTopicYN="N">Crutches</DescriptorName>
<QualifierName UI="Q1" MajorTopicYN="Y">therapy</QualifierName></MeshHeading>
<MeshHeading><DescriptorName UI="D2" MajorTopicYN="N">Canes</DescriptorName></MeshHeading></MeshHeadingList>
<KeywordList Owner="NOTNLM"><Keyword MajorTopicYN="Y">one</Keyword><Keyword MajorTopicYN="N">two</Keyword></KeywordList>
<CommentsCorrectionsList><CommentsCorrections><PMID>999</PMID></CommentsCorrections></CommentsCorrectionsList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">123</ArticleId><ArticleId IdType="doi">10.1/other</ArticleId>
<ArticleId IdType="pmc">PMC5</ArticleId><ArticleId IdType="pii">S5</ArticleId></ArticleIdList>
<ReferenceList><Reference><Citation>Ann Oncol.
 2019</Citation><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId></ArticleIdList></Reference>
<Reference><Citation>Other</Citation></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>"""


@pytest.fixture
def medline(spark, tmp_path):
    write(tmp_path / "m.xml.gz", MEDLINE, gzip.open)
    return xml.read_medline(spark, str(tmp_path / "m.xml.gz"))


def id_maps(spark):
    rows = [("123", None, "10.1/good", "cc", "oa/5"), ("7", "PMC7", "10.1/seven", None, None), ("124", "PMC5", None, "by", "p/5")]
    return tables.build_pmid_maps(
        spark.createDataFrame(rows, "pmid string, pmcid string, doi string, license string, subpath string")
    )


def test_medline(medline):
    (row,) = medline.collect()
    assert (row.pmid, row.doi, row.pmc, row.pii) == ("123", "10.1/good", "PMC5", "S5")
    assert tuple(row.publication_date) == (2016, 9, 30) and tuple(row.update_date) == (2020, 9, 30)
    assert row.article_title == "Effects of RAS in cells." and row.abstract == "Part one. Part two."
    assert (row.title, row.journal_abbrev, row.volume, row.issue) == ("Cancer J", "Canc J", "11", "3")
    assert (row.start_page, row.end_page, row.eissn, row.issn) == ("5911", "5924", "1111-2222", None)
    assert (row.language, row.raw_type) == ("en", "Journal Article")
    assert [(a.last_name, a.first_name, a.affiliations) for a in row.authors] == [("Doe", "Jo", ["Lab 1"])]
    assert row.authors[0].identifiers[0].value == "0000-1"
    assert row.grants[0].agency == "NIH"
    assert [m.chemical and m.chemical.term for m in row.mesh] == ["Iron", None, None]
    assert row.mesh[1].descriptor.meshId == "D003446" and row.mesh[1].qualifiers[0].majorTopic
    assert [(k.value, k.origin, k.major_topic) for k in row.keywords] == [("one", "NOTNLM", True), ("two", "NOTNLM", False)]
    assert [(r.unstructured, r.pmid) for r in row.references] == [("Ann Oncol. 2019", "7"), ("Other", None)]


def test_medline_as_works(spark, medline, tmp_path):
    out = reports.export_medline_as_works(medline, id_maps(spark))
    sinks.write_jsonl(out, str(tmp_path / "out"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    record = json.loads(line)
    assert record["DOI"] == "10.1/good" and record["pmcid"] == "PMC5" and record["reference-count"] == 2
    assert record["license"] == [{"code": "by"}]
    assert [x["URL"] for x in record["link"]] == ["p/5", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC5/pdf/"]
    assert record["reference"][0] == {"unstructured": "Ann Oncol. 2019", "pmid": "7", "DOI": "10.1/seven", "pmcid": "PMC7"}
    assert record["author"][0]["ORCID"] == "0000-1"
    assert record["funder"] == [{"name": "NIH", "country": "US", "award": ["G1"]}]
    assert record["mesh"][0] == {"chemical": {"term": "Iron", "meshId": "D9", "chemicalRegistryNumber": "0"}}


def test_mesh_corpus(spark, medline, tmp_path):
    write(tmp_path / "sel.csv", "mobility,aids,crutches,D003446\nmobility,aids,canes,D2\nonly,three,fields\n")
    selection = idfiles.read_mesh_selection(spark, str(tmp_path / "sel.csv"))
    assert selection.count() == 2
    mesh_table = tables.build_pubmed_mesh_table(medline, id_maps(spark))
    export_mesh_corpus(medline, mesh_table, selection, str(tmp_path / "corpus"))
    got = spark.read.option("header", True).csv(str(tmp_path / "corpus"))
    assert {(r.level, r.pmid, r["MeSH Terms"]) for r in got.collect()} == {
        ("mobility", "123", "Crutches, Canes"), ("aids", "123", "Crutches, Canes"),
    }
    hits = reports.select_by_mesh(mesh_table, selection, major=False, keep_repeats=True)
    assert hits.count() == 4


def test_enrichment_merge(spark, tmp_path):
    entries = [
        {"external_ids": [{"type": "doi", "value": "10.1/A"}], "abstract": "new", "funding": [{"org": "F", "country": None}],
         "authors": [{"affiliations": [{"name": "Lab.", "grid": {"id": "g1", "addresses": [{"country_code": "FR"}]}},
                                       {"name": "Lab", "grid": None}]}, {}]},
        {"external_ids": [{"type": "doi", "value": "10.1/a"}], "abstract": "later"},
    ]
    write(tmp_path / "e.json", json.dumps(entries))
    from biblioweave.schemas import EXPORT_COLUMNS

    cells = {c: "" for c in EXPORT_COLUMNS}
    header = ",".join(f'"{c}"' for c in EXPORT_COLUMNS)
    row = lambda **kw: ",".join(f'"{v}"' for v in {**cells, **kw}.values())
    write(tmp_path / "r.csv", "\n".join([header, row(pmid="1", doi="10.1/A", grid="own"), row(pmid="2", doi="10.1/z"), row(pmid="3")]))
    records = idfiles.read_records_csv(spark, str(tmp_path / "r.csv"))
    loaded = idfiles.read_enrichment_json(spark, str(tmp_path / "e.json"))
    got = {r.pmid: r for r in reports.merge_enrichment(records, loaded).collect()}
    one = got["1"]
    assert (one.abstract, one.affiliation, one["author countries"], one.grid) == ("new", "Lab", "FR", "own")
    assert (one.funding_organization, one["funding country"]) == ("F", None)
    assert got["2"].affiliation is None
    assert tuple(reports.merge_enrichment_stats(records, loaded).collect()[0]) == (3, 2, 1, 1, 1, 1)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", 'q"q')], "level string, text string")
    sinks.write_report_tsv(df, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 2
    sinks.write_classes_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {(r.level, r.text) for r in back.collect()} == {("a", "x y"), ("b", 'q"q')}
    sinks.write_oa_hits(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_key_table(df, str(tmp_path / "key"))
    assert spark.read.parquet(str(tmp_path / "key")).count() == 2


def test_audit_collection(spark, tmp_path):
    from test_matching import audit_records

    row = audit_collection(audit_records(spark), str(tmp_path)).collect()[0]
    assert tuple(row) == (5, 2, 3, 2, 4)
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "duplicates")).count() == 4


def test_search_record_rules(spark, tmp_path):
    rows = [
        {"DOI": "10.1/a"}, {"DOI": "10.1/b", "source": "other"}, {"halId": "h", "source": "HAL", "title": "T"},
        {"DOI": "10.1/c", "source": "crossref", "type": "component"},
    ]
    write(tmp_path / "w.json", lines(rows))
    records = R.build_search_records(works.read_works_jsonl(spark, str(tmp_path / "w.json")))
    assert [(r.id, r.bibliographic) for r in records.collect()] == [("hal:h", "T")]
    assert F is not None


def test_packed_files_are_told_apart_by_their_first_two_lines(spark, tmp_path):
    nested = json.dumps({"DOI": "10.1/n", "license": {"items": [1]}})
    write(tmp_path / "one.json.xz", nested + "\n", lzma.open)
    write(tmp_path / "two.json.xz", nested + "\n" + nested.replace("10.1/n", "10.1/m") + "\n", lzma.open)
    late = '{"note": "' + "x" * 400 + '",\n"items" : [' + json.dumps({"DOI": "10.1/late1"}) + ",\n" + json.dumps({"DOI": "10.1/late2"}) + "]}"
    write(tmp_path / "late.json.xz", late, lzma.open)
    found = lambda name: sorted(r.doi for r in works.read_works(spark, str(tmp_path / name)).collect())
    assert found("one.json.xz") == ["10.1/n"]
    assert found("two.json.xz") == ["10.1/m", "10.1/n"]
    assert [d[-5:] for d in found("late.json.xz")] == ["late1", "late2"]


def test_later_rows_win(spark, tmp_path):
    write(tmp_path / "ids.csv", "9,,10.1/x\n10,,10.1/x\n")
    maps = tables.build_pmid_maps(idfiles.read_pmid_map(spark, str(tmp_path / "ids.csv")))
    assert maps["doi"].collect()[0].pmid == "10"
    write(tmp_path / "oa.tsv", "z-old\tc\tPMC1\tx\tp\na-new\tc\tPMC1\tx\tp\n")
    ids = spark.createDataFrame(
        [("1", "PMC1", None, None, None)], "pmid string, pmcid string, doi string, license string, subpath string"
    )
    files = idfiles.read_oa_file_list(spark, str(tmp_path / "oa.tsv"))
    assert tables.enrich_pmid_with_oa_files(ids, files).collect()[0].license == "a-new"


def test_records_keep_their_order(spark, tmp_path):
    write(tmp_path / "b.json", lines([{"DOI": "10.1/same"}, {"DOI": "10.1/other"}]))
    write(tmp_path / "a.json", lines([{"DOI": "10.1/same"}] * 2))
    rows = works.read_works_jsonl(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq.file[-6:] for r in rows] == ["a.json", "a.json", "b.json", "b.json"]
    assert [r.doi[-5:] for r in rows[2:]] == ["/same", "other"]


def test_references_of_records_without_pmid_are_filled(spark):
    reference = "unstructured string, pmid string, doi string, pmc string, pii string"
    rows = spark.createDataFrame(
        [(None, [(None, "5", None, None, None)]), (None, [(None, None, "10.1/y", None, None)] * 2), ("8", None)],
        f"pmid string, `references` array<struct<{reference.replace(' string', ': string')}>>",
    )
    ids = spark.createDataFrame(
        [("5", "PMC5", "10.1/x"), ("6", "PMC6", "10.1/y")], "pmid string, pmcid string, doi string"
    )
    got = tables.fill_reference_ids(rows, tables.build_pmid_maps(ids)).collect()
    filled = sorted([(x.pmid, x.doi, x.pmc) for x in r["references"]] for r in got if r["references"])
    assert filled == [[("5", "10.1/x", "PMC5")], [("6", "10.1/y", "PMC6")] * 2]
    assert len(got) == 3


def test_items_keep_their_text_and_files_are_read_once(spark, tmp_path):
    items = ['{"DOI": "10.1/é", "n":1.10,  "a":["x\\u00e9", 1e2]}', '{"DOI":"10.1/b"}']
    body = '\ufeff{"message":{"next-cursor":"c","items":[' + ",\n".join(items) + ']}}'
    (tmp_path / "p").mkdir()
    write(tmp_path / "p" / "a.json", body)
    write(tmp_path / "p" / "b.json.gz", body, gzip.open)
    write(tmp_path / "p" / "c.json", '{"message":')
    pages = works.read_api_pages(spark, str(tmp_path / "p"))
    assert sorted(r.doi for r in pages.collect()) == ["10.1/b", "10.1/b", "10.1/é", "10.1/é"]
    assert {r.json for r in pages.collect()} == set(items)
    write(tmp_path / "w.json", '{"items":[' + ",".join(items) + "]}")
    arrays = works.read_works_array(spark, str(tmp_path / "w.json"))
    assert {r.json for r in arrays.collect()} == set(items)
    # the multi-line reader went back to a plain file for each item, and changed the text of those in a gzip file
    for rows in (pages, arrays):
        logical = rows._jdf.queryExecution().optimizedPlan()
        options = logical.collectLeaves().head().relation().options()
        assert options.get("multiLine").isEmpty() and options.get("lineSep").isDefined()


def test_update_files_are_bounded_not_three(spark, monkeypatch):
    from types import SimpleNamespace

    from biblioweave.catalog import landed
    from biblioweave.streaming import updates

    events = spark.range(100).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit(1).alias("user_id"))
    seen = {}

    def stream(session, landing, *rest, **options):
        seen.update(options, count=session.read.format("binaryFile").load(landing).count(), largest=max(r.n for r in spark.read.text(landing).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()))
        return updates.stream_work_updates(session, landing, *rest, **options)

    monkeypatch.setattr(landed, "RECORDS_PER_UPDATE", 10)
    monkeypatch.setattr(landed, "stream_work_updates", stream)
    rows = landed.clean_applied_files(SimpleNamespace(spark=spark, events=events)).collect()
    assert seen["count"] == 13 and seen["largest"] <= 20 and seen["files_per_batch"] == 4
    assert {r.doi for r in rows} == {f"10.9/e{k}" for k in range(100)} and all(r.cleaned for r in rows)


def test_medline_export_moves_records_once(spark):
    from biblioweave.catalog import Tables
    from biblioweave.catalog import shapes
    from biblioweave.operators.reports import export_medline_as_works

    t = Tables(spark, "/root/testdata/sf0.001")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        works_rows = export_medline_as_works(shapes.order_biblio(t), tables.build_pmid_maps(shapes.pmid_rows(t)))
        text = works_rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    blocks = [b for b in text.split("\n\n") if ") Exchange\n" in b]
    assert len(blocks) > 5
    assert sum("article_title#" in b.split("Arguments")[0] for b in blocks) == 1
