"""Blocked postings with upper bounds, for the best records of many requests at once.

Records are numbered by length and id and cut into slices of ``SLICE`` records and
spans of ``SPAN`` slices.  A block holds the postings of one token in one slice
with the greatest score share among them; the table of blocks is range-partitioned
and sorted by field, token and slice, so its files and row groups can be skipped.

The sum of a request's weights times the greatest shares of a span, or of a slice,
is an upper bound of the score of any record there.  The best slices of the best
spans are scored first; their k-th best score is a floor under the request's final
k-th score.  Spans, then slices, that cannot reach the floor are left out, and only
blocks of the others are opened.  The k best records are those of the plain join:
bounds only leave out what is below the floor.

Records of about equal length share a slice, so the bounds of a slice are close to
the scores in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.operators.keys import numbered
from biblioweave.session import materialise

SLICE = 64
SPAN = 64
# Slices whose scores give the first floor: the best of the best spans.
LEADING_SPANS, LEADING_SLICES = 2, 4
# Rounded scores closer than this may still be ties, so bounds keep that distance.
SLACK = 2e-6


def build_blocks(postings: DataFrame, share: Column, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Written tables of blocks (field, token, span, slice, best, postings) and spans (field, token, span, best).

    ``postings`` has field, token, id, doc_len, place (0 once per record and field) and the ``carry`` columns.
    """
    lengths = postings.where("place = 0").groupBy("id").agg(F.sum("doc_len").alias("length"))
    slices = numbered(lengths, "length", "id").select("id", F.floor(F.col("number") / SLICE).alias("slice"))
    placed = postings.withColumn("share", share).join(slices, "id")
    members = F.collect_list(F.struct("id", "share", *carry))  # at most SLICE
    blocks = placed.groupBy("field", "token", "slice").agg(F.max("share").alias("best"), members.alias("postings"))
    blocks = blocks.withColumn("span", F.floor(F.col("slice") / SPAN))
    order = ("field", "token", "slice")
    blocks = materialise(blocks.repartitionByRange(*order).sortWithinPartitions(*order), "blocks")
    spans = blocks.groupBy("field", "token", "span").agg(F.max("best").alias("best"))
    return blocks, materialise(spans, "block-spans")


def _reach(terms: DataFrame, bounds: DataFrame, *place: str) -> DataFrame:
    """Upper bound of a request's scores in each span or slice."""
    met = terms.select("req_id", "field", "token", "weight").join(bounds, ["field", "token"])
    return met.groupBy("req_id", *place).agg(F.sum(F.col("weight") * F.col("best")).alias("reach"))


def _slice_reach(terms: DataFrame, blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Bounds of the slices in given (req_id, span)."""
    wanted = spans.select("req_id", "span").join(terms.select("req_id", "field", "token", "weight"), "req_id")
    met = wanted.join(blocks.select("field", "token", "span", "slice", "best"), ["field", "token", "span"])
    return met.groupBy("req_id", "slice").agg(F.sum(F.col("weight") * F.col("best")).alias("reach"))


def _best(rows: DataFrame, n: int, *ties: str) -> DataFrame:
    order = Window.partitionBy("req_id").orderBy(F.col("reach").desc(), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def open_blocks(slices: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of each request's tokens in its slices, with the weight: what is read to score them."""
    wanted = slices.select("req_id", "slice").join(terms.select("req_id", "field", "token", "weight"), "req_id")
    return wanted.join(blocks.select("field", "token", "slice", "postings"), ["field", "token", "slice"])


def score_slices(slices: DataFrame, terms: DataFrame, blocks: DataFrame, condition: Column | None = None) -> DataFrame:
    """Exact scores of the records in given slices (req_id, slice)."""
    hits = open_blocks(slices, terms, blocks).select("req_id", "weight", F.explode("postings").alias("p"))
    hits = hits.select("req_id", "weight", "p.*")
    if condition is not None:
        hits = hits.where(condition)
    return hits.groupBy("req_id", "id").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))


def surviving_slices(terms: DataFrame, blocks: DataFrame, spans: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """req_id and slice wherever a record can be among the k best of a request."""
    reach = materialise(_reach(terms, spans, "span"), "span-reach")
    leading = _best(_slice_reach(terms, blocks, _best(reach, LEADING_SPANS, "span")), LEADING_SLICES, "slice")
    scores = score_slices(leading, terms, blocks, condition)
    ranked = scores.withColumn("_n", F.row_number().over(Window.partitionBy("req_id").orderBy(F.col("score").desc())))
    floor = materialise(ranked.where(F.col("_n") == k).select("req_id", F.col("score").alias("floor")), "score-floors")
    high = lambda rows: rows.join(floor, "req_id", "left").where(F.col("reach") >= F.coalesce("floor", F.lit(0.0)) - F.lit(SLACK))
    return high(_slice_reach(terms, blocks, high(reach))).select("req_id", "slice")


def blocked_scores(terms: DataFrame, blocks: DataFrame, spans: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """Scores that contain the k best records of every request."""
    slices = materialise(surviving_slices(terms, blocks, spans, k, condition), "surviving-slices")
    return score_slices(slices, terms, blocks, condition)
