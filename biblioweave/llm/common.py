"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the word rule: space, tab, line feed to carriage return.
SPACE = r"\x20\x09-\x0D"
ROWS_PER_STEP = 512


def whole(text: Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words between white space, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def steps(batches: Iterator, rows: int = ROWS_PER_STEP) -> Iterator:
    """Arrow batches cut into small ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_steps(batches: Iterator, column: int, size: int, rows: int = ROWS_PER_STEP) -> Iterator:
    """The same, cut also after about ``size`` bytes of a text column; a longer text is a step of its own."""
    for batch in steps(batches, rows):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def texts(column) -> list[str]:
    """A text column of an Arrow batch as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def carried(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``row``: the columns to keep (all unless named) in one struct, where no name can clash; and ``text``."""
    return docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text).alias("text"))


def with_new_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``_row`` with the text from ``_clean``, and n_chars renewed if it is among them."""
    row = F.col("_row").withField(text, F.col("_clean"))
    if "n_chars" in columns:
        row = row.withField("n_chars", F.length("_clean").cast("long"))
    return df.select(row.alias("_row")).select("_row.*")


def folding(lower_all: bool) -> np.ndarray:
    """Code of each code point for hashing: 0 for white space, lower case for all letters or only A to Z."""
    codes = np.arange(1, 0x110001, dtype=np.uint64)
    for point in range(0x110000 if lower_all else 128):
        low = chr(point).lower()
        if len(low) == 1:
            codes[point] = ord(low) + 1
    codes[[0x20, *range(0x09, 0x0E)]] = 0
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(docs: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of some texts, and where each text's words begin (one more place at the end)."""
    joined = " " + " ".join(docs) + " "
    folded = codes[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    owner = np.concatenate([[0], np.repeat(np.arange(len(docs)), [len(x) + 1 for x in docs])])
    at = np.flatnonzero(folded)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(docs) + 1, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    lengths = np.diff(np.append(starts, len(at)))
    within = np.arange(len(at)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(lengths.max(), 6364136223846793005, np.uint64), dtype=np.uint64)
    hashes = mix(np.add.reduceat(folded[at] * powers[within], starts))
    return hashes, np.searchsorted(owner[at[starts]], np.arange(len(docs) + 1))
