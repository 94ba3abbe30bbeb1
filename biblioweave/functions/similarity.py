"""Pairwise string similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from biblioweave.functions.text import not_blank


def gestalt_ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters, longest blocks first."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _gestalt_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    done: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in done:
            done[(x, y)] = gestalt_ratio(x, y)
        out.append(done[(x, y)])
    return pd.Series(out, dtype="float64")


# Characters counted one by one in the bound below; all others count as one kind.
COUNTED = "etaoinsrhldcumfpgwybvk0123456789 "


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """A bound of the similarity from the two lengths alone."""
    la, lb = F.length(a), F.length(b)
    return 2.0 * F.least(la, lb) / (la + lb)


def shared_upper_bound(a: Column, b: Column) -> Column:
    """A closer bound: matched characters are at most those both texts have, whatever their order."""
    la, lb = F.length(a), F.length(b)
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    shared = sum((F.least(count(a, c), count(b, c)) for c in COUNTED), F.lit(0))
    others = F.least(F.length(F.translate(a, COUNTED, "")), F.length(F.translate(b, COUNTED, "")))
    return 2.0 * (shared + others) / (la + lb)


def undecided(a: Column, b: Column, threshold: float) -> Column:
    """Whether two different texts have to be compared to know that they reach the threshold."""
    x, y = F.lower(a), F.lower(b)
    open_ = not_blank(a) & not_blank(b) & (x != y)
    close = F.when(ratio_upper_bound(x, y) < threshold, False).otherwise(shared_upper_bound(x, y) >= threshold)
    return F.when(open_, close).otherwise(False)


def reaches(a: Column, b: Column, threshold: float) -> Column:
    """``ratcliff_obershelp(a, b) >= threshold``, false for null; pairs that bounds decide stay in the JVM."""
    x, y = F.lower(a), F.lower(b)
    open_ = undecided(a, b, threshold)
    measured = F.pandas_udf(_gestalt_batch, DoubleType())(F.when(open_, x), F.when(open_, y))
    equal = F.coalesce(not_blank(a) & not_blank(b) & (x == y), F.lit(False))
    return F.when(equal, F.lit(threshold <= 1.0)).otherwise(F.coalesce(measured >= threshold, F.lit(threshold <= 0.0)))


def ratcliff_obershelp(a: Column, b: Column) -> Column:
    """Case-insensitive similarity in 0..1; blank text scores 0.

    Blank and equal values are settled in the JVM, only the remaining pairs
    cross to Python in Arrow batches.
    """
    x, y = F.lower(a), F.lower(b)
    both = not_blank(a) & not_blank(b)
    compare = both & (x != y)
    measured = F.pandas_udf(_gestalt_batch, DoubleType())(F.when(compare, x), F.when(compare, y))
    return F.when(~both, 0.0).when(x == y, 1.0).otherwise(measured)
