"""Schemas of files and tables, as DDL text."""

from biblioweave.functions.dates import PARTIAL_DATE
from biblioweave.functions.mesh import MESH_CLASS

# The member names of the file formats that are read.

AUTHOR = (
    "struct<given:string,family:string,sequence:string,ORCID:string,"
    "affiliation:array<struct<name:string>>>"
)

# Members of a work record that are used; titles may be text or an array and
# dates have two shapes, so both stay JSON text until they are normalised.
WORK_JSON = f"""
    DOI string, type string, source string, publisher string, volume string, issue string,
    page string, title string, `container-title` array<string>,
    `short-container-title` array<string>, author array<{AUTHOR}>,
    issued string, published string, `published-online` string, `published-print` string,
    created string, indexed struct<`date-time`:string>, halId string, _bad string
"""

OA_LOCATION = (
    "struct<url:string,url_for_pdf:string,url_for_landing_page:string,pmh_id:string,"
    "is_best:boolean,evidence:string,host_type:string,license:string,version:string,updated:string>"
)
OA_RECORD = f"""
    doi string, year int, genre string, is_oa boolean, title string, doi_url string,
    updated string, publisher string, z_authors array<struct<family:string,given:string>>,
    journal_name string, oa_locations array<{OA_LOCATION}>, data_standard int,
    journal_is_oa boolean, journal_issns string, published_date string,
    journal_is_in_doaj boolean, best_oa_location {OA_LOCATION}
"""

ISTEX_RECORD = """
    corpusName string, istexId string, ark array<string>, doi array<string>,
    pmid array<string>, pmc array<string>, mesh array<string>, pii array<string>
"""

IDENTIFIER = "struct<name:string,value:string>"
PERSON = (
    "struct<first_name:string,middle_name:string,last_name:string,suffix:string,"
    f"initials:string,identifiers:array<{IDENTIFIER}>,affiliations:array<string>>"
)
GRANT = "struct<grant_id:string,acronym:string,agency:string,country:string>"
KEYWORD = "struct<value:string,origin:string,major_topic:boolean>"
REFERENCE = "struct<unstructured:string,pmid:string,doi:string,pmc:string,pii:string>"

# Columns of a rich bibliographic row.
BIBLIO = {
    "pmid": "string",
    "doi": "string",
    "pmc": "string",
    "pii": "string",
    "hal_id": "string",
    "hal_uri": "string",
    "update_date": PARTIAL_DATE,
    "publication_date": PARTIAL_DATE,
    "article_title": "string",
    "title": "string",
    "collection_title": "string",
    "journal_abbrev": "string",
    "publisher": "string",
    "volume": "string",
    "issue": "string",
    "start_page": "string",
    "end_page": "string",
    "start_page_int": "int",
    "end_page_int": "int",
    "raw_pages": "string",
    "issn": "string",
    "eissn": "string",
    "isbn": "string",
    "abstract": "string",
    "language": "string",
    "raw_language": "string",
    "raw_type": "string",
    "document_type": "string",
    "host_type": "string",
    "authors": f"array<{PERSON}>",
    "grants": f"array<{GRANT}>",
    "mesh": f"array<{MESH_CLASS}>",
    "keywords": f"array<{KEYWORD}>",
    "references": f"array<{REFERENCE}>",
}

ENRICHMENT_RECORD = """
    external_ids array<struct<type:string,value:string>>, abstract string,
    authors array<struct<affiliations:array<struct<name:string,
        grid:struct<id:string,addresses:array<struct<country_code:string>>>>>>>,
    funding array<struct<org:string,country:string>>
"""

# Columns of the record export, in file order.
EXPORT_COLUMNS = (
    "pmid", "doi", "pmc", "title", "abstract", "MeSH Terms", "publication year", "authors",
    "keywords", "publisher", "host", "affiliation", "author countries", "grid",
    "funding_organization", "funding country",
)
