"""How filters interact: what each removes in every order, alone and on top of others.

For each part of the corpus (a column's values) a filter has the sorted list of the
rows that fail it.  Rows are numbered once, and lists are kept by ranges of
2^``RANGE_BITS`` numbers: a list holds at most so many ids however many rows a part has.
Unions of several lists (what a set of filters removes together) and differences
(what a filter removes after others) are k-way merges that gallop: a run of one
list up to the next id of the others is found by doubling steps and taken as a
whole, so a short list meets a long one in few steps.  Sizes are summed over the
ranges of a part; orders, shares and losses follow from the sums.

Null text: empty.  A null part is the empty string.  Copies fail the copy filter
but for those with the smallest id; rows of equal id and text are equals, and a
null id neither fails it nor makes others fail.  Labels count once per id (the
greatest where they repeat).  Every row counts, repeated ones too.  Parts of
documents only; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.llm import exact
from biblioweave.llm.common import words
from biblioweave.session import materialise

RANGE_BITS = 16
PARTS_AT_ONCE = 1_000


def gallop(ids: list[int], wanted: int, start: int) -> int:
    """First place from ``start`` on whose id is ``wanted`` or greater."""
    step, end = 1, start
    while end < len(ids) and ids[end] < wanted:
        start, end, step = end + 1, end + step, 2 * step
    return bisect_left(ids, wanted, start, min(end, len(ids)))


def union(lists: list[list[int]]) -> list[int]:
    """Ids of some sorted lists, each once, sorted."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heap)
    out: list[int] = []
    while len(heap) > 1:
        head, k, place = heap[0]
        following = min(heap[1:3])[0]
        end = gallop(lists[k], following, place)
        # an id that another list has too is left to that list
        out += lists[k][place:end]
        end += end == place and head == following
        if end < len(lists[k]):
            heapreplace(heap, (lists[k][end], k, end))
        else:
            heappop(heap)
    for _, k, place in heap:
        out += lists[k][place:]
    return out


def difference(ids: list[int], others: list[list[int]]) -> list[int]:
    """Ids of a sorted list that none of the other sorted lists has."""
    others = [x for x in others if x]
    places = [0] * len(others)
    out: list[int] = []
    place = 0
    while place < len(ids):
        nearest = None
        for k, other in enumerate(others):
            at = places[k] = gallop(other, ids[place], places[k])
            if at < len(other) and (nearest is None or other[at] < nearest):
                nearest = other[at]
        if nearest is None:
            return out + ids[place:]
        end = gallop(ids, nearest, place)
        out += ids[place:end]
        place = end + (end < len(ids) and ids[end] == nearest)
    return out


def failures(docs: DataFrame, labels: DataFrame, filters: dict, copies: str, *, doc_id="doc_id", text="text", part="lang", marks=("quality", "toxic")) -> DataFrame:
    """One row per document: part, place (its number), and whether it fails each filter and has each mark.

    ``filters`` maps a name to a function of the text; ``copies`` names the filter
    of rows whose text another row with a smaller id has.  ``marks`` are 0/1
    columns of ``labels``.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    judge = lambda t: F.struct(*[F.coalesce(fails(t), F.lit(False)).alias(name) for name, fails in filters.items()])
    found = exact.refine(keyed, doc_id="id", keep=["id", "part"], normal=lambda t: t, longest=False, extra=judge)
    told = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("string").alias("key")).agg(
        *[F.max(F.col(m) == 1).alias(m) for m in marks]
    )
    filler = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    rows = found.select(
        F.coalesce(F.col("row.id").cast("string"), filler).alias("key"),
        "row.part",
        "extra.*",
        F.coalesce(F.col("row.id") > F.col("keep_id"), F.lit(False)).alias(copies),
    )
    joined = rows.join(told, "key", "left").select(
        "part", *filters, copies, *[F.coalesce(m, F.lit(False)).alias(m) for m in marks]
    )
    return materialise(joined.withColumn("place", F.monotonically_increasing_id()), "filter-failures")


def posting_lists(failing: DataFrame, names: list[str], marks: tuple[str, ...] = ()) -> DataFrame:
    """Per part and range of places: its number of rows, and the sorted places that fail each filter or have each mark."""
    listed = [F.sort_array(F.collect_list(F.when(F.col(name), F.col("place")))).alias(name) for name in (*names, *marks)]
    return failing.groupBy("part", F.shiftright("place", RANGE_BITS).alias("range")).agg(F.count("*").alias("rows"), *listed)


def _cells(names: list[str]) -> list[tuple[int, int]]:
    """Each filter with each set of other filters (as bits) that may have gone before."""
    return [(k, before) for k in range(len(names)) for before in range(1 << len(names)) if not before >> k & 1]


def _measure(lists: list[list[int]], marked: list[list[int]], cells) -> list[list[int]]:
    """For each cell: ids failing the filter, those it removes, its marked ones, and all removed up to then."""
    gone = {}
    out = []
    for k, before in cells:
        after = before | 1 << k
        if after not in gone:
            gone[after] = len(union([ids for j, ids in enumerate(lists) if after >> j & 1]))
        removed = difference(lists[k], [ids for j, ids in enumerate(lists) if before >> j & 1])
        lost = [len(removed) - len(difference(removed, [ids])) for ids in marked]
        out.append([len(lists[k]), len(removed), gone[after], *lost])
    return out


def merge_sizes(lists: DataFrame, names: list[str], marks: tuple[str, ...]) -> DataFrame:
    """Per part, filter and set of filters before it: rows, fails, removed, gone and the marks lost, summed over ranges."""
    cells = _cells(names)
    sums = ["fails", "removed", "gone", *[f"lost_{m}" for m in marks]]

    def merged(batches):
        totals: dict[str, list] = {}

        def flush():
            rows = [(part, names[k], before, n, *x) for part, (n, xs) in totals.items() for (k, before), x in zip(cells, xs)]
            totals.clear()
            columns = list(zip(*rows)) or [[]] * (4 + len(sums))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (1 + len(sums))]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "filter", "before", "rows", *sums])

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                found = _measure([row[n] for n in names], [row[m] for m in marks], cells)
                n, old = totals.get(row["part"], (0, None))
                totals[row["part"]] = (n + row["rows"], found if old is None else [[a + b for a, b in zip(x, y)] for x, y in zip(old, found)])
                if len(totals) >= PARTS_AT_ONCE:
                    yield flush()
        if totals:
            yield flush()

    schema = "part string, filter string, before int, rows long, " + ", ".join(f"{s} long" for s in sums)
    sizes = lists.mapInArrow(merged, schema)
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("rows", *sums)])


def audit(docs: DataFrame, labels: DataFrame, filters: dict, copies: str, *, marks=("quality", "toxic"), **columns) -> DataFrame:
    """One row per part, order of the filters and step.

    part, filter_order, step, kept, removed, redundant, unique_fails, lost_<mark>
    of each mark, and shapley: the filter's removed rows summed over all orders.
    """
    names = [*filters, copies]
    lists = posting_lists(failures(docs, labels, filters, copies, marks=marks, **columns), names, marks)
    sizes = materialise(merge_sizes(lists, names, marks), "filter-sizes")
    steps = [
        ("".join(order), step + 1, name, sum(1 << names.index(x) for x in order[:step]))
        for order in permutations(names)
        for step, name in enumerate(order)
    ]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    # orders in which a given set goes before a filter
    ways = [factorial(k) * factorial(len(names) - 1 - k) for k in range(len(names))]
    weight = F.element_at(F.array(*map(F.lit, ways)), F.bit_count("before") + 1)
    last = F.bit_count("before") == len(names) - 1
    shares = sizes.groupBy("part", "filter").agg(
        F.sum(weight * F.col("removed")).cast("long").alias("shapley"), F.sum(F.when(last, F.col("removed"))).alias("unique_fails")
    )
    # all orders of the filters: a fixed number of rows
    cells = sizes.join(shares, ["part", "filter"]).join(F.broadcast(orders), ["filter", "before"])
    return cells.select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *[f"lost_{m}" for m in marks],
        "shapley",
    )


def text_filters() -> dict:
    """Few words, few distinct words, many capitals, symbols."""
    return {
        "A": lambda t: F.size(words(t)) < 100,
        "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < 80 * F.size(words(t)),
        "C": lambda t: 100 * (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) > 10 * F.length(t),
        "D": lambda t: t.rlike(r"[#$%&*|]"),
    }
