"""Pairwise ranking of candidates, acceptance and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions.similarity import ratcliff_obershelp
from biblioweave.functions.text import not_blank
from biblioweave.operators.lookup import MATCH_THRESHOLD, NOT_VALIDATED

NO_CANDIDATE = "Cannot find records for the input query."
NO_METADATA = "No metadata available for post-validation"


def _similarity(wanted: Column, candidate: Column) -> Column:
    return F.coalesce(ratcliff_obershelp(wanted, candidate), F.lit(0.0))


def pairwise_rank(
    pairs: DataFrame,
    *,
    title: tuple[str, str] | None = ("atitle", "c_title"),
    author: tuple[str, str] | None = ("first_author", "c_first_author"),
    journal: tuple[str, str] | None = ("jtitle", "c_journal"),
    abbreviated: str | None = "c_abbreviated_journal",
    year: tuple[str, str] | None = ("year", "c_year"),
    has_strong_id: Column | None = None,
) -> DataFrame:
    """Adds ``matching_score`` and ``match_rank`` to candidate rows.

    The score is the mean over the criteria the request gives: title, first
    author, blocking score (always), journal in full or abbreviated form (only
    for candidates with a strong id) and equal year.  A field the candidate
    lacks scores 0.  Each pair is ``(request column, candidate column)``.
    """
    criteria: list[tuple[Column, Column]] = [(F.lit(True), F.col("blocking_score"))]
    for pair in (title, author):
        if pair:
            wanted, candidate = F.col(pair[0]), F.col(pair[1])
            criteria.append((not_blank(wanted), _similarity(wanted, candidate)))
    if journal:
        wanted = F.col(journal[0])
        strong = F.lit(True) if has_strong_id is None else has_strong_id
        # no text is compared where the criterion does not count
        compared = F.when(not_blank(wanted) & strong, wanted)
        score = _similarity(compared, F.col(journal[1]))
        if abbreviated:
            score = F.greatest(score, _similarity(compared, F.col(abbreviated)))
        criteria.append((not_blank(wanted) & strong, score))
    if year:
        wanted, candidate = F.col(year[0]), F.col(year[1])
        criteria.append(
            (not_blank(wanted), F.when(wanted == candidate, 1.0).otherwise(0.0))
        )
    total = sum((F.when(used, score).otherwise(0.0) for used, score in criteria), F.lit(0.0))
    count = sum((F.when(used, 1).otherwise(0) for used, _ in criteria), F.lit(0))
    order = Window.partitionBy("req_id").orderBy(F.col("matching_score").desc(), "blocking_rank")
    return pairs.withColumn("matching_score", F.round(total / count, 6)).withColumn(
        "match_rank", F.row_number().over(order)
    )


def best_match(ranked: DataFrame) -> DataFrame:
    return ranked.filter("match_rank = 1")


def accept(
    best: DataFrame, *, threshold: float = MATCH_THRESHOLD, author: str | None = None
) -> DataFrame:
    """Status and reason of the best candidates by score.

    With ``author`` a request whose author is blank cannot be validated.
    """
    passed = F.col("matching_score") >= threshold
    reason = F.when(~passed, NOT_VALIDATED)
    if author:
        known = not_blank(F.col(author))
        passed = passed & known
        reason = F.when(~known, NO_METADATA).otherwise(reason)
    return best.withColumns(
        {"status": F.when(passed, "found").otherwise("not_found"), "reason": reason}
    )


def with_parsed_fields(requests: DataFrame, parsed: DataFrame) -> DataFrame:
    """Requests completed by the fields of their parsed citation.

    ``parsed`` has ``req_id`` and the columns of ``sources.xml.parse_citation_tei``;
    the author of a monograph stands in for a missing article author.
    """
    fields = parsed.select(
        "req_id", "parsed_atitle", "parsed_first_author", "parsed_monograph_author",
        "parsed_jtitle", "parsed_year",
    )
    given = lambda c: F.when(not_blank(F.col(c)), F.col(c))
    use = F.coalesce("parse_reference", F.lit(True)) if "parse_reference" in requests.columns else F.lit(True)
    from_parse = lambda *cs: F.when(use, F.coalesce(*[given(c) for c in cs]))
    return requests.join(fields, "req_id", "left").withColumns(
        {
            "atitle": F.coalesce(given("atitle"), from_parse("parsed_atitle")),
            "first_author": F.coalesce(
                given("first_author"), from_parse("parsed_first_author", "parsed_monograph_author")
            ),
            "jtitle": F.coalesce(given("jtitle"), from_parse("parsed_jtitle")),
            "year": F.coalesce(given("year"), from_parse("parsed_year")),
        }
    ).drop(*[c for c in fields.columns if c != "req_id"])


def evaluate_matching(
    predicted: DataFrame, truth: DataFrame, *, key: str = "req_id", value: str = "doi"
) -> DataFrame:
    """Attempted, found and correct counts with precision, recall and F1."""
    joined = truth.select(key, F.col(value).alias("_truth")).join(
        predicted.select(key, F.col(value).alias("_pred")), key, "left"
    )
    counts = joined.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count("_pred").alias("found"),
        F.count_if(F.col("_pred") == F.col("_truth")).alias("correct"),
    )
    precision = F.try_divide(F.col("correct").cast("double"), F.col("found"))
    recall = F.try_divide(F.col("correct").cast("double"), F.col("attempted"))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return counts.select(
        "attempted", "found", "correct",
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(f1, 6).alias("f1"),
    )
