"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three letters,
words padded with a boundary) of a language, counted over all of its learning
documents.  A document is compared with each profile by the sum of out-of-place
distances of its own most frequent n-grams; the nearest profile wins.

Null texts and texts without a letter are ``und`` with score 0.  Rows without a
language are not learned from; without any learned language all is ``und``.
Ties in frequency go by n-gram code, ties in distance by language name.  Equal
texts get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioweave.llm.common import carried, sized_steps, texts

PROFILE_SIZE = 300
UNDETERMINED = "und"
MERGE_EVERY = 16
# A step takes about a hundred bytes for each of its characters.
STEP_BYTES = 300_000
_CHAR_BITS = 11


@cache
def _letter_codes() -> np.ndarray:
    """Code of each code point: 0 for other than letters, folded case, rarer scripts hashed into 1024 places."""
    codes = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            low = ord(low) if len(low) == 1 else point
            codes[point] = low if low < 1024 else 1024 + low % 1024
    return codes


def grams(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, n-gram code) of every n-gram of one to three letters."""
    joined = "\n" + "\n".join(docs) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    codes = _letter_codes()[points]
    owner = np.repeat(np.arange(len(docs)), [len(x) + 1 for x in docs])
    owner = np.concatenate([[0], owner])
    # runs of other characters become one boundary
    stays = np.ones(len(codes), bool)
    stays[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    codes, owner = codes[stays], owner[stays]
    one = codes > 0
    two = (codes[:-1] > 0) | (codes[1:] > 0)
    first = np.where(codes[:-1] > 0, owner[:-1], owner[1:])
    three = codes[1:-1] > 0
    pair = (codes[:-1] << _CHAR_BITS) | codes[1:]
    triple = (pair[:-1] << _CHAR_BITS) | codes[2:]
    kind = 3 * _CHAR_BITS
    found = np.concatenate([codes[one], pair[two] | (1 << kind), triple[three] | (2 << kind)])
    return np.concatenate([owner[one], first[two], owner[1:-1][three]]), found


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with how often they occur, or with the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights[order], starts)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of n-gram counts per language over the whole partition."""
    waiting: dict[str, list] = {}

    def merge(lang: str) -> None:
        keys, counts = zip(*waiting[lang])
        waiting[lang] = [_counted(np.concatenate(keys), np.concatenate(counts))]

    for batch in sized_steps(batches, 1, STEP_BYTES):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            by.setdefault(lang, []).append(text)
        for lang, docs in by.items():
            waiting.setdefault(lang, []).append(_counted(grams(docs)[1]))
            if len(waiting[lang]) > MERGE_EVERY:
                merge(lang)
    for lang in waiting:
        merge(lang)
        keys, counts = waiting[lang][0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"]
        )


def learn_profiles(docs: DataFrame, text="text", lang="lang", size: int = PROFILE_SIZE) -> DataFrame:
    """lang, gram, place: the ``size`` most frequent n-grams of each language, over all rows with a language."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = labelled.mapInArrow(_count_partition, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("place", place).where(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """Learned profiles as arrays; as many rows as there are languages."""

    def __init__(self, rows, size: int = PROFILE_SIZE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
        self.places = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for r in rows:
            self.places[self.langs.index(r["lang"]), np.searchsorted(self.grams, r["gram"])] = r["place"]

    def nearest(self, docs: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the runner-up's share of the two smallest distances."""
        owner, found = grams(docs)
        if not len(found) or not self.langs:
            return [UNDETERMINED] * len(docs), [0.0] * len(docs)
        keys, counts = _counted((owner << 36) | found)
        owner, found = keys >> 36, keys & ((1 << 36) - 1)
        order = np.argsort((owner << 34) | ((1 << 34) - 1 - counts), kind="stable")
        owner, found = owner[order], found[order]
        starts = np.searchsorted(owner, np.arange(len(docs)))
        place = np.arange(len(owner)) - starts[owner]
        top = place < self.size
        owner, found, place = owner[top], found[top], place[top]
        at = np.searchsorted(self.grams, found)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != found)] = len(self.grams)
        theirs = self.places[:, at]
        off = np.where(theirs < 0, self.size, np.abs(theirs - place))
        sums = np.array([np.bincount(owner, row, len(docs)) for row in off])
        some = np.bincount(owner, minlength=len(docs)) > 0
        best = sums.argmin(axis=0)
        least = np.sort(sums, axis=0)[:2]
        both = least.sum(axis=0)
        score = np.where(both > 0, least[-1] / np.maximum(both, 1e-9), 0.5) if len(self.langs) > 1 else np.ones(len(docs))
        return [self.langs[b] if s else UNDETERMINED for b, s in zip(best, some)], np.where(some, score, 0.0).tolist()


def identify(docs: DataFrame, learn_from: Column, text="text", lang="lang", size: int = PROFILE_SIZE, keep=None) -> DataFrame:
    """``row`` (the columns in ``keep``, or all), lang_pred and score; learned from the rows where ``learn_from`` holds."""
    profiles = Profiles(learn_profiles(docs.where(learn_from), text, lang, size).collect(), size)

    def predict(batches):
        for batch in sized_steps(batches, 1, STEP_BYTES):
            langs, scores = profiles.nearest(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"]
            )

    packed = carried(docs, text, keep)
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, text="text", lang="lang") -> DataFrame:
    """The documents in a learned language: those whose language cannot be determined go."""
    found = identify(docs, F.lit(True), text, lang)
    return found.where(F.col("lang_pred") != UNDETERMINED).select("row.*")
