"""Collocations: phrases whose words occur together more often than apart.

Texts are split into pieces and words once and kept, by blocks of about
``BLOCK_CHARS`` characters, as local word numbers.  Words that can be part of a
frequent phrase get dense ids; each block asks for the ids of its words and counts
its n-grams in counting quotient filters (``quotient``), one for each shard of the
permuted n-grams.  The filters of a shard are merged, which gives exact counts: an
n-gram crosses the network once for each block, however often it occurs, and
common phrases weigh no more than rare ones.  The number of shards grows with the
corpus.  Scores are computed from the counts by joins.

Null text: no words.  Null language: ``und``.  Repeated rows count as often as
they are there.  Languages without a frequent phrase have no row, and neither has
an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.llm import quotient
from biblioweave.llm.common import steps
from biblioweave.session import materialise

MIN_COUNT = 10
MAX_WORDS = 3
CONTAINED_PERCENT = 50
TOP = 2_000
BLOCK_CHARS = 8_000_000
SLICE_BYTES = 4_000_000
SHARD_WORDS = 4_000_000
# Characters between pieces, and between words of a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"


def _folding() -> bytes:
    """Bytes with A-Z in lower case, breaks as line feeds and spaces as space."""
    table = bytearray(range(256))
    for capital in range(ord("A"), ord("Z") + 1):
        table[capital] = ord(chr(capital).lower())
    for byte in BREAKS:
        table[byte] = ord("\n")
    for byte in SPACES:
        table[byte] = ord(" ")
    return bytes(table)


class _Words:
    """Words of one language in a block, numbered from 1 as they come; 0 ends a piece."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.numbers[b"\n"], self.numbers[b""]  # 0 and 1: breaks, and nothing between two spaces
        self.parts: list[np.ndarray] = []

    def add(self, folded: bytes) -> None:
        at = 0
        while at < len(folded):
            end = len(folded)
            if end - at > SLICE_BYTES:  # cut between pieces
                end = folded.rfind(b"\n", at, at + SLICE_BYTES) + 1 or folded.find(b"\n", at + SLICE_BYTES) + 1 or end
            found = folded[at:end].replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
            self.parts.append(numbers[numbers != 1])
            at = end

    def row(self):
        """Numbers of the words in order, the words, and their counts."""
        numbers = np.concatenate(self.parts)
        numbers = np.where(numbers > 1, numbers - 1, 0).astype(np.int32)
        words = [w.decode("utf-8", "replace") for w in list(self.numbers)[2:]]
        return numbers.tobytes(), words, np.bincount(numbers, minlength=len(words) + 1)[1:]


def blocks(docs: DataFrame, text="text", lang="lang") -> DataFrame:
    """block, lang, numbers (of the words in order, 0 between pieces), words and counts."""
    folding = _folding()

    def run(batches):
        held, chars, serial = defaultdict(_Words), 0, count(TaskContext.get().partitionId() << 32)

        def flush():
            for language, words in held.items():
                numbers, names, counts = words.row()
                yield pa.record_batch(
                    [pa.array([next(serial)]), pa.array([language]), pa.array([numbers]), pa.array([names], pa.list_(pa.string())),
                     pa.array([counts], pa.list_(pa.int64()))],
                    ["block", "lang", "numbers", "words", "counts"],
                )
            held.clear()

        for batch in steps(batches):
            texts = defaultdict(list)
            for language, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts[language].append(value.encode("utf-8", "replace"))
            for language, values in texts.items():
                folded = b"\n".join(values).translate(folding) + b"\n"
                held[language].add(folded)
                chars += len(folded)
            if chars >= BLOCK_CHARS:
                yield from flush()
                chars = 0
        yield from flush()

    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return named.where("text IS NOT NULL").mapInArrow(run, "block long, lang string, numbers binary, words array<string>, counts array<long>")


def word_counts(blocked: DataFrame) -> DataFrame:
    """lang, word and f, the number of its occurrences."""
    pairs = blocked.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return pairs.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))


def with_ids(words: DataFrame) -> DataFrame:
    """Words with dense ids from 1 on, the same at every later read."""
    placed = materialise(words.withColumn("at", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("at", 33)
    # one row for each partition of the written table
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    firsts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    numbered = placed.withColumn("part", part).join(F.broadcast(firsts), "part")
    return numbered.select("lang", "word", "f", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id"))


def _ngram_filters(lengths: range, bits: int, shard_bits: int):
    """Filters of a block's n-grams of words with ids, one for each length and shard."""

    def run(block: pa.Table, ids: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if block.num_rows:
            numbers = np.frombuffer(block.column("numbers")[0].as_py(), np.int32)
            known = np.zeros(int(numbers.max(initial=0)) + 1, np.uint64)
            known[ids.column("number").to_numpy()] = ids.column("id").to_numpy().astype(np.uint64)
            words = known[numbers]
            for n in lengths:
                whole = np.ones(max(0, len(words) - n + 1), bool)
                for k in range(n):
                    whole &= words[k : len(words) - n + 1 + k] > 0
                starts = np.flatnonzero(whole)
                _, width = quotient.layout(n, bits)
                lower, upper = quotient.pack_ids([words[starts + k] for k in range(n)], bits)
                lower, upper, counts = quotient.counted(quotient.permute(lower, width), upper)
                by = min(shard_bits, width)
                shards = (lower >> np.uint64(width - by)).astype(np.int64) if by else np.zeros(len(lower), np.int64)
                lower = lower & np.uint64((1 << (width - by)) - 1)
                cuts = np.flatnonzero(np.diff(shards)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                    if a < b:
                        rows.append((n, int(shards[a]), quotient.encode(lower[a:b], upper[a:b], counts[a:b], width - by)))
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["n", "shard", "filter"])

    return run


def _merged(bits: int, shard_bits: int, least: int):
    """The n-grams of a shard that occur ``least`` times or more."""

    def run(filters: pa.Table) -> pa.Table:
        n, shard = filters.column("n")[0].as_py(), filters.column("shard")[0].as_py()
        lower, upper, counts = quotient.merge(filters.column("filter").to_pylist())
        _, width = quotient.layout(n, bits)
        by = min(shard_bits, width)
        often = counts >= least
        lower = lower[often] | (np.uint64(shard) << np.uint64(width - by) if by else np.uint64(0))
        words = quotient.unpack_ids(quotient.restore(lower, width), upper[often], n, bits)
        ends = pa.array(np.arange(0, words.size + 1, n, dtype=np.int32))
        return pa.table([pa.ListArray.from_arrays(ends, pa.array(words.ravel())), pa.array(counts[often])], ["ids", "f"])

    return run


def frequent_ngrams(blocked: DataFrame, vocabulary: DataFrame, total: int, *, max_words=MAX_WORDS, least=MIN_COUNT) -> DataFrame:
    """ids (of the words, in order) and f of every n-gram of 2 to ``max_words`` words that occurs ``least`` times.

    ``vocabulary`` has every word that occurs so often; ``total`` is the number of all words.
    """
    bits = max(1, int(vocabulary.agg(F.max("id")).first()[0] or 1).bit_length())
    shard_bits = max(0, (total // SHARD_WORDS).bit_length())
    names = blocked.select(F.col("block").alias("of"), "lang", F.posexplode("words").alias("place", "word"))
    ids = names.join(vocabulary, ["lang", "word"]).select("of", (F.col("place") + 1).alias("number"), "id")
    grouped = blocked.select("block", "numbers").groupBy("block").cogroup(ids.groupBy("of"))
    filters = grouped.applyInArrow(_ngram_filters(range(2, max_words + 1), bits, shard_bits), "n int, shard long, filter binary")
    return filters.groupBy("n", "shard").applyInArrow(_merged(bits, shard_bits, least), "ids array<long>, f long")


def _scored(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """ids, a, l, r and score of the lowest-scoring cut of each candidate."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    sides = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    known = lambda side, name: grams.select(F.col("ids").alias(side), F.col("f").alias(name))
    both = sides.join(known("left", "l"), "left").join(known("right", "r"), "right")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumns({"_top": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "_under": wide("l") * wide("r")})
    scored = both.withColumn("score", F.expr("_top div _under").cast("long"))
    lowest = scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("ids", "a", "m.l", "m.r", "m.score")


def _not_contained(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates but for those that lie within a longer one about as frequent."""
    longer = candidates.where(F.size("ids") > 2)
    starts = F.sequence(F.lit(1), F.size("ids") - 1)
    inner = F.flatten(
        F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.size("ids") - i + 1, F.lit(2))), lambda n: F.slice("ids", i, n)))
    )
    within = longer.select("a", F.explode(F.array_distinct(F.filter(inner, lambda x: F.size(x) < F.size("ids")))).alias("ids"))
    most = within.groupBy("ids").agg(F.max("a").alias("_longer"))
    kept = candidates.join(most, "ids", "left")
    return kept.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def collocations(
    docs: DataFrame, text="text", lang="lang", *, max_words=MAX_WORDS, least=MIN_COUNT, contained_percent=CONTAINED_PERCENT, top=TOP
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a (its count), l, r (its parts'), n (all words) and score."""
    blocked = materialise(blocks(docs, text, lang), "phrase-blocks")
    words = materialise(word_counts(blocked), "phrase-word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    vocabulary = materialise(with_ids(words.where(F.col("f") >= least)), "phrase-vocabulary")
    candidates = materialise(frequent_ngrams(blocked, vocabulary, total, max_words=max_words, least=least), "phrase-candidates")
    candidates = candidates.withColumnRenamed("f", "a")
    grams = candidates.withColumnRenamed("a", "f").unionByName(vocabulary.select(F.array("id").alias("ids"), "f"))
    kept = materialise(_not_contained(_scored(candidates, grams), contained_percent), "phrase-scores")
    spelled = kept.select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    phrases = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    named = kept.join(phrases.select("ids", "lang", F.array_join("w.word", " ").alias("phrase")), "ids")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
