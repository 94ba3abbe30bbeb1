"""Code tables: languages and repository document types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 639-1 codes with their ISO 639-2 (terminology) codes.
LANGUAGE_CODES = """
aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze
ba:bak be:bel bg:bul bh:bih bi:bis bm:bam bn:ben bo:bod br:bre bs:bos ca:cat ce:che
ch:cha co:cos cr:cre cs:ces cu:chu cv:chv cy:cym da:dan de:deu dv:div dz:dzo ee:ewe
el:ell en:eng eo:epo es:spa et:est eu:eus fa:fas ff:ful fi:fin fj:fij fo:fao fr:fra
fy:fry ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv ha:hau he:heb hi:hin ho:hmo hr:hrv
ht:hat hu:hun hy:hye hz:her ia:ina id:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl
it:ita iu:iku ja:jpn jv:jav ka:kat kg:kon ki:kik kj:kua kk:kaz kl:kal km:khm kn:kan
ko:kor kr:kau ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz lg:lug li:lim ln:lin
lo:lao lt:lit lu:lub lv:lav mg:mlg mh:mah mi:mri mk:mkd ml:mal mn:mon mr:mar ms:msa
mt:mlt my:mya na:nau nb:nob nd:nde ne:nep ng:ndo nl:nld nn:nno no:nor nr:nbl nv:nav
ny:nya oc:oci oj:oji om:orm or:ori os:oss pa:pan pi:pli pl:pol ps:pus pt:por qu:que
rm:roh rn:run ro:ron ru:rus rw:kin sa:san sc:srd sd:snd se:sme sg:sag si:sin sk:slk
sl:slv sm:smo sn:sna so:som sq:sqi sr:srp ss:ssw st:sot su:sun sv:swe sw:swa ta:tam
te:tel tg:tgk th:tha ti:tir tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi
ty:tah ug:uig uk:ukr ur:urd uz:uzb ve:ven vi:vie vo:vol wa:wln wo:wol xh:xho yi:yid
yo:yor za:zha zh:zho zu:zul
"""

# Repository type code, document type, host type.
DOCUMENT_TYPES = (
    ("ART", "article", "journal"),
    ("COMM", "article", "proceedings"),
    ("POSTER", "article", "proceedings"),
    ("COUV", "article", "book"),
    ("REPORT", "report", None),
    ("OTHERREPORT", "report", None),
    ("CREPORT", "article", "report"),
    ("OUV", "book", None),
    ("PROCEEDINGS", "proceedings", None),
    ("ISSUE", "journal", None),
    ("THESE", "report", None),
    ("HDR", "report", None),
    ("MEM", "report", None),
    ("ETABTHESE", "report", None),
)


def _lookup(pairs: list[tuple[str, str | None]], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, key)


def lang3_to_lang2(c: Column) -> Column:
    """Two-letter language code of a three-letter one, null when unknown."""
    pairs = [tuple(reversed(p.split(":"))) for p in LANGUAGE_CODES.split()]
    return _lookup(pairs, c)


def map_document_type(code: Column) -> Column:
    """Struct ``(document_type, host_type)`` of a repository type code."""
    types = _lookup([(c, d) for c, d, _ in DOCUMENT_TYPES], code)
    hosts = _lookup([(c, h) for c, _, h in DOCUMENT_TYPES if h], code)
    return F.struct(types.alias("document_type"), hosts.alias("host_type"))
