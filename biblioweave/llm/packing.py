"""Mixture-controlled packing of tokenised documents into sequences.

Each source is a queue of its documents' tokens.  Deficit round-robin serves the
queues: in every window (one sequence) a queue has its share of the tokens, and
what rounding withholds from it is a deficit that the next windows make good, so
after any number of windows a queue is at most one token from its target.  When
a queue is empty its share goes to the others.  Because deficits are carried
exactly, the tokens a queue has had before window k are a closed formula of k,
and every task places its own documents without knowing the others' windows.

Targets are the given weights, or the queues' own sizes.  Sources below
1/``MAX_QUEUES`` of the target share one queue, in file order, which bounds the
number of queues and keeps each one's part of a window above some tokens.  Every
token lies in exactly one piece; only the last sequence is not full.

Null texts are empty and keep their end token.  A null source is the source "".
Equal rows are packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioweave.llm.common import steps, texts, whole
from biblioweave.session import materialise

SEQUENCE_TOKENS = 2048
END_ID = 1
MAX_QUEUES = 64
PARTS_PER_BLOCK = 256
WORD_ENTRIES, CHUNK_ENTRIES = 600_000, 400_000

# Lower-case words of the Latin-1 range and what may follow them: tokenised apart, as the tokenizer does.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")


class Memo(dict):
    """A dictionary of bounded size: what was not asked for since it last filled up is forgotten."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def find(self, key):
        known = self.get(key)
        if known is None:
            known = self.old.get(key)
            if known is not None:
                self.put(key, known)
        return known

    def put(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies, keyed for str.translate."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, each word tokenised once and remembered."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        self.model, self.names = self.tokenizer.model, _byte_names()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self._words, self._chunks = Memo(WORD_ENTRIES), Memo(CHUNK_ENTRIES)

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a plain word, which normalising and splitting leave as it is."""
        known = self._words.find(word)
        if known is None:
            merged = self.model.tokenize(word.encode().decode("latin-1").translate(self.names))
            known = array(self.code, [t.id for t in merged]).tobytes()
            if len(word) <= 64:
                self._words.put(word, known)
        return known

    def _chunk(self, text: str) -> bytes:
        known = self._chunks.find(text)
        if known is None:
            plain = _PLAIN.fullmatch(text.lower())
            if plain is None:
                known = self._ids(text)
            else:
                mark = plain[2]
                known = self._word(plain[1])
                if mark:
                    after = self._words.find(mark)
                    if after is None:
                        after = self._ids(mark)
                        self._words.put(mark, after)
                    known += after
            if len(text) <= 64:
                self._chunks.put(text, known)
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian integers of ``kind``.  No token spans a space or line feed."""
        known, chunk = self._chunks.get, self._chunk
        return b"".join([known(x) or chunk(x) for x in text.replace("\n", " ").split(" ") if x])


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int, doc_id, text, source) -> tuple[DataFrame, str]:
    """Written table of doc_id, source, part, start, n and ids, and the kind of the ids.

    ``start`` counts the tokens of the same source before the document in its part.
    """
    with open(tokenizer_file, "rb") as f:
        data = f.read()
    kind = WordTokenizer(data).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(data)
        end = np.array([end_id], kind).tobytes()
        part, before = TaskContext.get().partitionId(), {}
        for batch in steps(batches):
            names = batch.column(1).to_pylist()
            ids = [words.encode(t) + end for t in texts(batch.column(2))]
            counts = [len(x) // len(end) for x in ids]
            starts = []
            for name, n in zip(names, counts):
                starts.append(before.get(name, 0))
                before[name] = starts[-1] + n
            rows = len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * rows, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "part", "start", "n", "ids"],
            )

    plain = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(source)).alias("source"), F.col(text).alias("text"))
    fields = [("part", T.IntegerType()), ("start", T.LongType()), ("n", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([plain.schema["doc_id"], plain.schema["source"], *(T.StructField(*f) for f in fields)])
    return materialise(plain.mapInArrow(run, schema), "packing-tokens"), kind


class Schedule:
    """Where tokens of each queue go: the closed form of the round-robin with carried deficits.

    ``sizes`` and ``weights`` are per queue.  A phase lasts until a queue is empty;
    within it queue q has had floor(share of q and those before it) minus
    floor(share of those before it) tokens.
    """

    def __init__(self, sizes: list[int], weights: list[Fraction], window: int):
        self.window, self.total = window, sum(sizes)
        self.starts, self.lengths, self.bases, self.gains = [], [], [], []
        had, at = [0] * len(sizes), 0
        while at < self.total:
            open_ = [q for q in range(len(sizes)) if had[q] < sizes[q]]
            if not any(weights[q] for q in open_):  # what has no target comes last, by size
                weights = [Fraction(s) for s in sizes]
            scale = sum(weights[q] for q in open_)
            rounds = min((sizes[q] - had[q]) * scale / weights[q] for q in open_ if weights[q])
            gain = [int(rounds * weights[q] / scale) if q in open_ else 0 for q in range(len(sizes))]
            self.starts.append(at)
            self.lengths.append(sum(gain))
            self.bases.append(list(np.cumsum([0, *had]).tolist()))
            self.gains.append(list(np.cumsum([0, *gain]).tolist()))
            had = [h + g for h, g in zip(had, gain)]
            at += sum(gain)

    def before(self, place: int, queue: int) -> int:
        """Tokens of the queues before ``queue`` among the first ``place`` tokens of all."""
        p = bisect_right(self.starts, place) - 1
        return self.bases[p][queue] + (place - self.starts[p]) * self.gains[p][queue] // self.lengths[p]

    def had(self, window: int, queue: int) -> int:
        place = min(window * self.window, self.total)
        return self.before(place, queue + 1) - self.before(place, queue)

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before, length, window, offset there) of ``n`` tokens from ``start`` of the queue."""
        low, high = 0, -(-self.total // self.window)
        while high - low > 1:  # the last window that begins at or before start
            mid = (low + high) // 2
            if self.had(mid, queue) <= start:
                low = mid
            else:
                high = mid
        done = 0
        while done < n:
            begins, ends = self.had(low, queue), self.had(low + 1, queue)
            length = min(n - done, ends - start - done)
            if length > 0:
                here, there = (min(k * self.window, self.total) for k in (low, low + 1))
                earlier = self.before(there, queue) - self.before(here, queue)
                yield done, length, low, earlier + start + done - begins
                done += length
            low += 1


def _queues(totals: DataFrame, weights: dict[str, float] | None) -> tuple[list[str], list[int], list[Fraction]]:
    """Names of the queues with a target of their own (the last queue is the rest), their sizes and weights.

    At most MAX_QUEUES sources reach a share of 1/MAX_QUEUES, or have a weight that large.
    """
    everything = totals.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        own = totals.groupBy("source").agg(F.sum("n").alias("n")).where(F.col("n") * MAX_QUEUES >= everything)
    else:
        scale = sum(weights.values())
        names = [s for s, w in weights.items() if w * MAX_QUEUES >= scale]
        own = totals.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n").alias("n"))
    rows = sorted((r["source"], r["n"]) for r in own.collect())
    rest = everything - sum(n for _, n in rows)
    if rows and weights is None and 0 < rest * MAX_QUEUES < everything:
        smallest = min(rows, key=lambda r: (r[1], r[0]))
        rows.remove(smallest)
        rest += smallest[1]
    sizes = [*(n for _, n in rows), rest]
    names = [s for s, _ in rows]
    if weights is None:
        shares = [Fraction(n) for n in sizes]
    else:
        shares = [Fraction(weights[s]) for s in names]
        shares.append(Fraction(sum(weights.values())) - sum(shares))
    return names, sizes, shares


def _bases(totals: DataFrame, names: list[str]) -> DataFrame:
    """queue and base: the tokens of the same queue before each source's part, summed by blocks of parts."""
    queue = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("source")) - 1, F.lit(len(names))) if names else F.lit(0)
    queue = F.when(queue < 0, len(names)).otherwise(queue).cast("int")
    placed = totals.withColumns({"queue": queue, "block": F.floor(F.col("part") / PARTS_PER_BLOCK)})
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("queue", "block").agg(F.sum("n").alias("all")).select(
        "queue", "block", F.coalesce(F.sum("all").over(earlier.partitionBy("queue").orderBy("block")), F.lit(0)).alias("blocks_before")
    )
    within = F.coalesce(F.sum("n").over(earlier.partitionBy("queue", "block").orderBy("part", "source")), F.lit(0))
    joined = placed.withColumn("within", within).join(blocks, ["queue", "block"])
    return joined.select("source", "part", "queue", (F.col("blocks_before") + F.col("within")).alias("base"))


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    weights: dict[str, float] | None = None,
    length: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    doc_id="doc_id",
    text="text",
    source="source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``weights``: target shares by source; sources without one fill the end.
    """
    tokens, kind = tokenise(docs, tokenizer_file, end_id, doc_id, text, source)
    totals = materialise(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-totals")
    names, sizes, shares = _queues(totals, weights)
    bases = materialise(_bases(totals, names), "packing-bases")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(sizes, shares, length)
        for batch in steps(batches):
            rows, out = [], []
            for i, (queue, start, n, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
                for done, size, window, offset in schedule.pieces(queue, start, n):
                    rows.append(i)
                    out.append((done, size, wide[4 * done : 4 * (done + size)], n, window, offset))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    placed = tokens.join(bases, ["source", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("start")).alias("start"), "n", "ids"
    )
    long = T.LongType()
    names_and_types = [("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)]
    schema = T.StructType([placed.schema["doc_id"], *(T.StructField(*f) for f in names_and_types)])
    return placed.mapInArrow(place, schema)
