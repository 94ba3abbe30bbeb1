"""The request router over a small store."""

import json

from pyspark.sql import functions as F

from biblioweave.operators import search, tables
from biblioweave.plans.matching import NOT_ENOUGH, Store, resolve_requests

FIELDS = (
    "doi", "halid", "pmid", "pmc", "pii", "istexid", "biblio", "atitle", "first_author", "jtitle",
    "volume", "first_page", "year",
)


def make_store(spark):
    rows = [
        ("crossref:10.1/a", "10.1/a", None, "Deep sea corals", "Smith", "Marine Notes", "7", "10", "2001"),
        ("crossref:10.1/b", "10.1/b", None, "Quantum walks", "Kim", "Physics Letters", "8", "20", "2010"),
        ("hal:hal-1", None, "hal-1", "Thesis on rivers", "Roe", "University", "1", "1", "1990"),
        ("crossref:10.1/gone", "10.1/gone", None, "Quantum walks gone", "Kim", "Physics Letters", "8", "20", "2010"),
    ]
    records = spark.createDataFrame(
        rows, "id string, doi string, hal_id string, t string, first_author string, j string, volume string, "
        "first_page string, year string",
    ).withColumns(
        {
            "title": F.array("t"), "journal": F.array("j"), "abbreviated_journal": F.array(F.substring("j", 1, 4)),
            "bibliographic": F.concat_ws(" ", "first_author", "t", "j", "volume", "first_page", "year"),
        }
    )
    stored = records.filter("id <> 'crossref:10.1/gone'").withColumns(
        {"json": F.to_json(F.struct("t")), "record_title": F.col("t"), "record_author": F.col("first_author")}
    )
    ids = spark.createDataFrame(
        [("1", "PMC1", "10.1/A", None, None), ("2", None, None, None, None)],
        "pmid string, pmcid string, doi string, license string, subpath string",
    )
    istex = spark.createDataFrame(
        [("c", "IX1", ["10.1/b"], [], [], ["ark:/1"], [], ["S1"])],
        "corpus_name string, istex_id string, doi array<string>, pmid array<string>, pmc array<string>, "
        "ark array<string>, mesh array<string>, pii array<string>",
    )
    return Store(
        works=stored.filter("doi IS NOT NULL"), hal_works=stored.filter("hal_id IS NOT NULL"),
        pmid_maps=tables.build_pmid_maps(ids), istex_maps=tables.build_istex_maps(istex),
        oa_links=spark.createDataFrame([("10.1/a", "http://oa")], "doi string, oa_url string"),
        doi_hal=spark.createDataFrame([("10.1/a", "hal-9")], "doi string, hal_id string"),
        records=records, index=search.build_index(records, carry=("volume", "first_page")),
    )


REQUESTS = {
    "doi": {"doi": "10.1/A"},
    "doi, wrong author": {"doi": "10.1/A", "first_author": "Zzzz"},
    "unknown doi hides the rest": {"doi": "10.1/zzz", "atitle": "Deep sea corals", "first_author": "Smith"},
    "hal": {"halid": "HAL-1"},
    "pmid": {"pmid": "1"},
    "pmid without doi": {"pmid": "2"},
    "pmc": {"pmc": "1"},
    "pii": {"pii": "s1"},
    "istex": {"istexid": "IX1"},
    "biblio": {"biblio": "Smith, Deep sea corals. Marine Notes 7, 10 (2001)", "first_author": "Smith", "atitle": "Deep sea corals"},
    "biblio, no author": {"biblio": "Smith, Deep sea corals. Marine Notes 7, 10 (2001)"},
    "biblio, nothing": {"biblio": "zzz yyy", "first_author": "Smith"},
    "parsed": {"biblio": "Kim Quantum walks Physics Letters"},
    "title": {"atitle": "Quantum walks", "first_author": "KIM"},
    "title fails, journal works": {"atitle": "Rivers zzzzzzzzzz", "first_author": "Kim", "jtitle": "Physics Letters", "volume": "8", "first_page": "20"},
    "journal": {"jtitle": "Physics Letters", "volume": "8", "first_page": "20"},
    "journal fails": {"jtitle": "Physics Letters", "volume": "8", "first_page": "21"},
    "none": {"atitle": "only a title"},
}


def test_router(spark):
    rows = [(name, *[given.get(f) for f in FIELDS]) for name, given in REQUESTS.items()]
    requests = spark.createDataFrame(rows, "req_id string, " + ", ".join(f"{f} string" for f in FIELDS))
    parsed = spark.createDataFrame(
        [("parsed", "Quantum walks", None, "Kim", "Physics Letters", None)],
        "req_id string, parsed_atitle string, parsed_first_author string, parsed_monograph_author string, "
        "parsed_jtitle string, parsed_year string",
    )
    got = {r.req_id: r for r in resolve_requests(requests, make_store(spark), parsed=parsed).collect()}
    assert set(got) == set(REQUESTS)
    found = {name: (r.doi or r.hal_id) for name, r in got.items() if r.status == "found"}
    assert found == {
        "doi": "10.1/a", "hal": "hal-1", "pmid": "10.1/a", "pmc": "10.1/a", "pii": "10.1/b", "istex": "10.1/b",
        "biblio": "10.1/a", "parsed": "10.1/b", "title": "10.1/b", "title fails, journal works": "10.1/b",
        "journal": "10.1/b",
    }
    assert got["none"].status == "bad_request" and got["none"].reason == NOT_ENOUGH
    assert got["pmid without doi"].reason == "Cannot find bibliographical record with PMID 2"
    assert "not passed" in got["doi, wrong author"].reason
    assert got["biblio, no author"].reason == "No metadata available for post-validation"
    assert got["biblio, nothing"].reason == "Cannot find records for the input query."
    assert json.loads(got["doi"].json) == {
        "t": "Deep sea corals", "pmid": "1", "pmcid": "PMC1", "halId": "hal-9", "oaLink": "http://oa",
    }
    assert json.loads(got["pii"].json)["istexId"] == "IX1"
    assert json.loads(got["hal"].json) == {"t": "Thesis on rivers"}
    assert got["title fails, journal works"].route == "title_author"
