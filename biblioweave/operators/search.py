"""Text-relevance blocking: postings, BM25 scores and top candidates.

The score of a record for a request is the sum over the distinct request
tokens of ``idf * tf / (tf + K)`` with global statistics (k1 = 1.2, b = 0.75).

Matching is a join of request tokens with postings.  Three things keep it
bounded when a few tokens, or copies of one text, make up a large part of the
records:

* records of equal content are indexed once, with their number, and so are
  requests of equal content matched once.  Copies score the same and are
  ranked by id, so the smallest ids of a content stand for all of them;
* postings of such tokens are salted, so no task holds a whole token;
* a stored index keeps its tokens record by record, and matching scores groups of
  requests against groups of records (``cells``), so that pairs that share a
  token are never shuffled.  The result is the same as that of the plain join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions.text import analyze, fold_ascii, not_blank
from biblioweave.operators.blocks import build_blocks
from biblioweave.operators.cells import cell_scores
from biblioweave.session import materialise

K1, B = 1.2, 0.75
BLOCK_SIZE = 4
SCORE_DIGITS = 6
# A token is salted when it has more than one in HOT_SHARE of a field's
# postings; so there are fewer than HOT_SHARE salted tokens per field.
HOT_SHARE = 2000

# Analyzer per search field.
FIELD_ANALYZERS = {
    "title": "words_stop",
    "first_author": "keyword_fold",
    "author": "words",
    "first_page": "keyword_fold",
    "journal": "words_stop",
    "abbreviated_journal": "keyword_fold",
    "volume": "keyword_fold",
    "issue": "keyword_fold",
    "year": "keyword_fold",
    "bibliographic": "words_stop",
}


@dataclass(frozen=True)
class Index:
    """Search tables.

    ``postings``     field, token, id, tf, doc_len, place among the record's
                     distinct tokens, copies, and carried record columns
    ``token_stats``  field, token, df, idf, bound (largest score share), salts
    ``field_stats``  field, n_docs, avg_len, n_postings: one row per field
    ``members``      rep, id: the ``keep`` smallest ids of each content whose
                     postings stand under the smallest id; None when every
                     record is indexed on its own
    ``packed``       id, field, doc_len, tokens, tfs, copies and carried columns:
                     the postings of a record and field in one row; None when
                     the index is not stored
    ``carry``        the carried columns
    ``condition``    what the records must meet, on carried columns
    """

    postings: DataFrame
    token_stats: DataFrame
    field_stats: DataFrame
    members: DataFrame | None = None
    keep: int = 0
    packed: DataFrame | None = None
    carry: tuple[str, ...] = ()
    condition: Column | None = None

    def where(self, condition: Column) -> Index:
        """The index limited to some records, with unchanged statistics."""
        both = condition if self.condition is None else self.condition & condition
        return replace(self, postings=self.postings.filter(condition), condition=both)

    def held(self) -> DataFrame:
        """The packed postings of the records that meet the condition, with the field's statistics."""
        packed = self.packed if self.condition is None else self.packed.filter(self.condition)
        # one row for each indexed field
        return packed.join(F.broadcast(self.field_stats), "field")

    @cached_property
    def _blocked(self) -> tuple[DataFrame, DataFrame]:
        return build_blocks(self.postings.join(F.broadcast(self.field_stats), "field"), _share(), self.carry)

    @property
    def blocks(self) -> DataFrame:
        """The postings in blocks with upper bounds, written when first asked for."""
        return self._blocked[0]

    @property
    def spans(self) -> DataFrame:
        """Bounds of larger ranges than blocks."""
        return self._blocked[1]


def _run_starts(tokens: Column) -> Column:
    """Where the runs of equal tokens of a sorted array begin."""
    first = lambda i: ~F.get(tokens, i).eqNullSafe(F.get(tokens, i - 1))
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), first)


def pack_postings(
    records: DataFrame, fields: dict[str, tuple[str, str]], *, id: str = "id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The distinct tokens of each record and ``field: (column, analyzer)`` in one row, with
    their term frequencies and the field length.  Records without a token have no row.

    A record's tokens are counted within its row, so nothing is shuffled.
    """
    parts = []
    for field, (column, analyzer) in fields.items():
        value = F.col(column)
        if records.schema[column].dataType.typeName() == "array":
            tokens = F.flatten(F.transform(value, lambda v: analyze(v, analyzer)))
        else:
            tokens = analyze(value, analyzer)
        parts.append(F.struct(F.lit(field).alias("field"), F.sort_array(tokens).alias("tokens")))
    # the generators keep the sorted words and the starts of runs as columns that are computed once
    rows = records.select(F.col(id).alias("id"), *carry, F.explode(F.array(*parts)).alias("f"))
    rows = rows.select("id", *carry, F.col("f.field").alias("field"), F.col("f.tokens").alias("_sorted")).where("size(_sorted) > 0")
    runs = rows.select("*", F.explode(F.array(_run_starts(F.col("_sorted")))).alias("_starts"))
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_sorted"))
    # no name of an input is given to an output: a lambda would read the output
    return runs.select(
        "id", *carry, "field", F.size("_sorted").alias("doc_len"),
        F.transform("_starts", lambda start: F.get("_sorted", start)).alias("tokens"),
        F.transform("_starts", lambda start, k: end(k) - start).alias("tfs"),
    )


def unpack_postings(packed: DataFrame, *carry: str) -> DataFrame:
    """One row per record, field and distinct token with its place among the distinct ones."""
    rows = packed.select(
        "id", *carry, "field", "doc_len", F.posexplode(F.arrays_zip("tokens", "tfs")).alias("place", "t")
    )
    return rows.select(
        "field", F.col("t.tokens").alias("token"), "id", *carry, F.col("t.tfs").alias("tf"), "doc_len", "place"
    )


def build_postings(
    records: DataFrame, fields: dict[str, tuple[str, str]], *, id: str = "id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Token table of the given ``field: (column, analyzer)`` of each record.

    One row per record, field and distinct token with its term frequency, the
    field length and the token's place among the distinct ones.
    """
    return unpack_postings(pack_postings(records, fields, id=id, carry=carry), *carry)


def build_field_stats(packed: DataFrame) -> DataFrame:
    """Records and mean length per field, and rows of its postings; a record with tokens has one row."""
    docs = F.sum("copies")
    length = F.sum(F.col("doc_len") * F.col("copies"))
    return packed.groupBy("field").agg(
        docs.alias("n_docs"),
        (length / docs).alias("avg_len"),
        F.sum(F.size("tokens")).cast("long").alias("n_postings"),
    )


def _norm() -> Column:
    """What a term frequency is weighed against: the length of the record's field."""
    return F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len"))


def _share() -> Column:
    """The part of a posting's score that is not idf."""
    return F.col("tf") / (F.col("tf") + _norm())


def build_token_stats(postings: DataFrame, field_stats: DataFrame) -> DataFrame:
    """Document frequency, idf, score bound and salt count per field and token."""
    # field_stats has one row per indexed field
    joined = postings.join(F.broadcast(field_stats), "field")
    grouped = joined.groupBy("field", "token").agg(
        F.sum("copies").alias("df"),
        F.count(F.lit(1)).alias("rows"),
        F.max(_share()).alias("share"),
        F.first("n_docs").alias("n_docs"),
        F.first("n_postings").alias("n_postings"),
    )
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return grouped.select(
        "field", "token", "df",
        idf.alias("idf"),
        (idf * F.col("share")).alias("bound"),
        F.ceil(F.col("rows") * HOT_SHARE / F.col("n_postings")).cast("int").alias("salts"),
    )


def _content(df: DataFrame, columns: list[str]) -> Column:
    """Key of the values of some columns; equal keys mean equal values."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)


def collapse_copies(
    records: DataFrame, columns: list[str], *, id: str, carry: tuple[str, ...], keep: int
) -> tuple[DataFrame, DataFrame]:
    """One record per content with its number of copies, and the members table.

    Only keys and ids are grouped: counts are combined map-side, and at most
    ``keep`` ids per content and task are shuffled.
    """
    keyed = records.select(F.col(id).alias("id"), *carry, _content(records, columns).alias("content"))
    counts = keyed.groupBy("content", *carry).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    same = Window.partitionBy("content", *carry)
    members = (
        keyed.withColumn("n", F.row_number().over(same.orderBy("id")))
        .filter(F.col("n") <= keep)
        .select(F.min("id").over(same).alias("rep"), "id")
    )
    firsts = counts.select(F.col("id").alias("_first"), "copies")
    kept = records.join(firsts, records[id] == firsts["_first"]).drop("_first")
    return kept, members


def build_index(
    records: DataFrame,
    fields: dict[str, tuple[str, str]] | None = None,
    *,
    id: str = "id",
    carry: tuple[str, ...] = (),
    stored: bool = True,
    collapse: bool = True,
    keep: int = BLOCK_SIZE + 1,
) -> Index:
    """Search tables over records with unique ids.

    ``carry`` columns stay on the postings for conditions.  ``stored`` writes
    the tables: all matching steps read them, so an index that is used at all
    is worth storing.  With ``collapse`` copies are indexed once; ``keep`` must
    exceed the number of candidates asked for later by one.
    """
    if fields is None:
        fields = {f: (f, a) for f, a in FIELD_ANALYZERS.items() if f in records.columns}
    columns = sorted({column for column, _ in fields.values()})
    kept, members = records.withColumn("copies", F.lit(1).cast("long")), None
    if collapse:
        kept, members = collapse_copies(records, columns, id=id, carry=carry, keep=keep)
    carried = (*carry, "copies")
    packed = pack_postings(kept, fields, id=id, carry=carried)
    if stored:
        packed = materialise(packed, "packed-postings")
        members = materialise(members, "members") if collapse else None
    postings = unpack_postings(packed, *carried)
    field_stats = build_field_stats(packed)
    if stored:
        field_stats = materialise(field_stats, "field-stats")
    token_stats = build_token_stats(postings, field_stats)
    if stored:
        token_stats = materialise(token_stats, "token-stats")
    return Index(postings, token_stats, field_stats, members, keep, packed if stored else None, carry)


def request_tokens(
    requests: DataFrame, fields: dict[str, tuple[str, str]], *, req_id: str = "req_id",
    repeats: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct tokens per request and field; ``repeats`` counts occurrences."""
    tokens = build_postings(requests, fields, id=req_id, carry=carry)
    weight = F.col("tf") if repeats else F.lit(1)
    return tokens.select(F.col("id").alias("req_id"), "field", "token", weight.alias("weight"), *carry)


def weighted_terms(tokens: DataFrame, index: Index) -> DataFrame:
    """Request tokens known to the index, with weight, score bound and salts."""
    return tokens.join(index.token_stats, ["field", "token"]).withColumns(
        {
            "weight": F.col("weight") * F.col("idf"),
            "bound": F.col("weight") * F.col("bound"),
        }
    ).drop("idf")


def _salted_terms(terms: DataFrame) -> DataFrame:
    return terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _salted_postings(index: Index) -> DataFrame:
    """Postings with score share and salt; only tokens over the hot share get salts."""
    hot = index.token_stats.filter("salts > 1").select("field", "token", "salts")
    shared = index.postings.join(F.broadcast(index.field_stats), "field").withColumn("share", _share())
    # fewer than HOT_SHARE tokens per field can have that share of the postings
    salted = shared.join(F.broadcast(hot), ["field", "token"], "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), "salts")).otherwise(0)
    return salted.withColumn("salt", salt.cast("int")).select(
        "field", "token", "salt", "id", "share"
    )


def bm25(terms: DataFrame, index: Index) -> DataFrame:
    """Score of every indexed record that shares a term with a request."""
    hits = _salted_terms(terms).join(_salted_postings(index), ["field", "token", "salt"])
    return hits.groupBy("req_id", "id").agg(
        F.sum(F.col("weight") * F.col("share")).alias("score")
    )


def all_scores(terms: DataFrame, index: Index, fields: list[str]) -> DataFrame:
    """The same, in cells where the index is stored, so that no pair of a token and a record is shuffled.

    ``terms`` are read several times.
    """
    if index.packed is None:
        return bm25(terms, index)
    return cell_scores(terms, index.held(), _norm(), fields, None)


def best_k(scores: DataFrame, k: int = BLOCK_SIZE) -> DataFrame:
    """The k best candidates per request by rounded score, then id."""
    rounded = scores.withColumn("raw_score", F.round("score", SCORE_DIGITS))
    order = Window.partitionBy("req_id").orderBy(F.col("raw_score").desc(), F.col("id"))
    return (
        rounded.withColumn("blocking_rank", F.row_number().over(order))
        .filter(F.col("blocking_rank") <= k)
        .select("req_id", "id", "raw_score", "blocking_rank")
    )


def _full_scores(pairs: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """Exact scores of given (request, record) pairs over given terms."""
    wanted = pairs.join(terms.select("req_id", "field", "token", "weight"), "req_id")
    shares = index.postings.join(F.broadcast(index.field_stats), "field").select(
        "field", "token", "id", _share().alias("share")
    )
    return (
        wanted.join(shares, ["field", "token", "id"])
        .groupBy("req_id", "id")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("score"))
    )


def distinct_requests(
    requests: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """One request per content, and for all requests the id that stands for them.

    The smallest ``req_id`` stands for a content; ``whole_requests`` undoes this.
    """
    keyed = requests.withColumn("_content", _content(requests, columns))
    first = keyed.groupBy("_content").agg(F.min("req_id").alias("_first"))
    distinct = requests.select("req_id", *columns).join(
        first.select(F.col("_first").alias("req_id")), "req_id", "left_semi"
    )
    return distinct, keyed.join(first, "_content").drop("_content")


def whole_requests(
    best: DataFrame, keyed: DataFrame, index: Index, *, k: int, exclude: str | None = None
) -> DataFrame:
    """Candidates of every request from those of its content.

    Contents expand to their member ids; the id in the ``exclude`` column of a
    request is left out.
    """
    if index.members is not None:
        if index.keep < k + (exclude is not None):
            raise ValueError("the index keeps fewer copies than candidates are asked for")
        best = best.withColumnRenamed("id", "rep").join(index.members, "rep").drop("rep")
    scored = best.select(F.col("req_id").alias("_first"), "id", F.col("raw_score").alias("score"))
    rows = keyed.select("req_id", "_first", *([exclude] if exclude else [])).join(scored, "_first")
    if exclude:
        rows = rows.filter(~F.col("id").eqNullSafe(F.col(exclude)))
    return best_k(rows.select("req_id", "id", "score"), k)


def top_candidates(
    requests: DataFrame,
    fields: dict[str, tuple[str, str]],
    index: Index,
    *,
    k: int = BLOCK_SIZE,
    exclude: str | None = None,
    pruned: bool = True,
) -> DataFrame:
    """The k best records per request: ``req_id, id, raw_score, blocking_rank``.

    ``fields`` maps index fields to request columns.  A stored index is searched in
    cells; ``pruned=False`` joins all postings.  The weighted terms are stored so
    that their size is known when the joins are planned.
    """
    distinct, keyed = distinct_requests(requests, sorted({c for c, _ in fields.values()}))
    terms = materialise(
        weighted_terms(request_tokens(distinct, fields), index), "request-terms"
    )
    # one more content, as one of them may be the excluded record alone
    n = k + (exclude is not None)
    if pruned and index.packed is not None:
        scores = cell_scores(terms, index.held(), _norm(), sorted(fields), n)
    else:
        scores = bm25(terms, index)
    return whole_requests(best_k(scores, n), keyed, index, k=k, exclude=exclude)


def minmax_blocking_score(candidates: DataFrame) -> DataFrame:
    """Adds ``blocking_score``: raw scores scaled per request.

    The lower end is at most 1 and the upper at least 0; when both meet every
    candidate of the request scores 1.
    """
    per_request = Window.partitionBy("req_id")
    low = F.least(F.min("raw_score").over(per_request), F.lit(1.0))
    high = F.greatest(F.max("raw_score").over(per_request), F.lit(0.0))
    scaled = F.when(high == low, 1.0).otherwise((F.col("raw_score") - low) / (high - low))
    return candidates.withColumn("blocking_score", scaled)


BIBLIO_FIELD = {"bibliographic": ("biblio", "words_stop")}


def match_biblio(requests: DataFrame, index: Index, **options) -> DataFrame:
    """Candidates for raw citation strings; blank strings have none."""
    usable = requests.filter(not_blank(F.col("biblio")))
    return top_candidates(usable, BIBLIO_FIELD, index, **options)


TITLE_FIELDS = {
    "title": ("atitle", "words_stop"),
    "first_author": ("first_author", "keyword_fold"),
}


def match_title_author(requests: DataFrame, index: Index, **options) -> DataFrame:
    """Candidates by article title words and exact folded first author."""
    usable = requests.filter(not_blank(F.col("atitle")) & not_blank(F.col("first_author")))
    return top_candidates(usable, TITLE_FIELDS, index, **options)


# The journal title of a request is looked for in two fields of the records.
JOURNAL_FIELDS = {
    "journal": ("jtitle", "words_stop"),
    "abbreviated_journal": ("jtitle", "keyword_fold"),
    "first_author": ("first_author", "keyword_fold"),
}
ISSUE_FIELDS = {
    "volume": ("volume", "keyword_fold"),
    "first_page": ("first_page", "keyword_fold"),
}


def match_journal(requests: DataFrame, index: Index, *, k: int = BLOCK_SIZE) -> DataFrame:
    """Candidates of equal volume and first page, ranked by journal and author.

    The index must carry ``volume`` and ``first_page``.  The required fields
    add their own term scores, as every required clause of the search does.
    Within an issue and page, records that share a journal or author token are
    compared; all others score alike there, so the smallest ids stand for them.
    """
    usable = requests.filter(
        not_blank(F.col("jtitle")) & not_blank(F.col("volume")) & not_blank(F.col("first_page"))
    )
    fields = {**JOURNAL_FIELDS, **ISSUE_FIELDS}
    distinct, keyed = distinct_requests(usable, sorted({c for c, _ in fields.values()}))
    place = [fold_ascii(F.lower(c)).alias(f"_{c}") for c in ("volume", "first_page")]
    keys = ["_volume", "_first_page"]
    places = distinct.select("req_id", *place)
    terms = materialise(
        weighted_terms(request_tokens(distinct, fields), index).join(places, "req_id"),
        "request-terms",
    )
    should = terms.filter(F.col("field").isin(*JOURNAL_FIELDS)).select("req_id", "field", "token", *keys)
    sharing = should.join(
        index.postings.select("field", "token", "id", *place), ["field", "token", *keys]
    ).select("req_id", "id")
    smallest = (
        index.postings.filter((F.col("field") == "volume") & (F.col("place") == 0))
        .select("id", *place)
        .withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
        .filter(F.col("_n") <= k)
    )
    others = places.join(smallest, keys).select("req_id", "id")
    pairs = sharing.unionByName(others).distinct()
    best = best_k(_full_scores(pairs, terms, index), k)
    return whole_requests(best, keyed, index, k=k)


def match_biblio_conditional(
    requests: DataFrame,
    index: Index,
    *,
    exclude: str | None = None,
    sources: tuple[str, ...] | None = None,
    **options,
) -> DataFrame:
    """Candidates for citation strings under a condition.

    Without ``exclude`` records must have a DOI (carried as ``has_doi``); with
    it, the record whose id is in that request column is left out.  ``sources``
    limits the records to some sources (carried as ``source``).
    """
    if exclude is None:
        index = index.where(F.col("has_doi"))
    if sources is not None:
        index = index.where(F.col("source").isin(*sources))
    usable = requests.filter(not_blank(F.col("biblio")))
    return top_candidates(usable, BIBLIO_FIELD, index, exclude=exclude, **options)
