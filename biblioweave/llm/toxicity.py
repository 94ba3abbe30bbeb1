"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The input at each word is a learned word vector beside the mean of the vectors of
its groups of three and five characters.  Windows of WINDOW words, overlapping by WINDOW - STRIDE, cover
the whole text; each is read in both directions, pooled by attention and scored,
and a text's score is that of its worst window.  The network is trained here, in
numpy, on a bounded sample of labelled documents (``Sample``): as labels are per
document, each step learns from the window that counts, the worst one.

A null or empty text, or one without a letter or digit, is scored as an empty
window.  Rows without a label are not learned from; without both labels every
score is 0.  Equal texts get equal scores.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioweave.llm.common import carried, steps, texts

WINDOW, STRIDE = 32, 16
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 8, 8
GRAMS = 1 << 14
CLEAR = 2.6
# Characters of the sample that are numbers at a time: some 50 MB.
CHARS_PER_STEP = 1 << 18
_POWERS = np.cumprod(np.full(64, 6364136223846793005, np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents of each label, their length, words in the vocabulary
    and the share of the sample's documents from which on a word is in it without telling anything."""

    toxic: int = 1200
    clean: int = 1800
    chars: int = 20_000
    words: int = 8192
    word_share: float = 0.005
    epochs: int = 10


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter or digit, 0 for all others."""
    codes = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalnum():
            low = char.lower()
            codes[point] = ord(low) if len(low) == 1 else point
    return codes


class Words:
    """Words of some texts as flat arrays: their text, hash, and groups of three and five characters."""

    def __init__(self, docs: list[str]):
        joined = "\n" + "\n".join(docs) + "\n"
        codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
        owner = np.concatenate([[0], np.repeat(np.arange(len(docs)), [len(x) + 1 for x in docs])])
        at = np.flatnonzero(codes)
        padded = np.concatenate([codes, [0, 0]])
        left, right = padded[at - 1], padded[at + 1]
        three = left * 7919 + padded[at] * 104729 + right * 1299709
        five = three * 31 + np.where(left > 0, padded[at - 2], 0) * 15485863 + np.where(right > 0, padded[at + 2], 0) * 32452843 + 1
        mixed = np.stack([three, five])
        self.grams = (mixed ^ (mixed >> 11)) % GRAMS
        self.starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
        self.lengths = np.diff(np.append(self.starts, len(at)))
        within = np.arange(len(at)) - np.repeat(self.starts, self.lengths)
        scaled = codes[at].astype(np.uint64) * _POWERS[np.minimum(within, 63)]
        self.hashes = np.add.reduceat(scaled, self.starts) if len(at) else np.zeros(0, np.uint64)
        self.owner = owner[at[self.starts]] if len(at) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.owner, np.arange(len(docs) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document and first word of each window, and its number of words; the last one ends with the text."""
        counts = np.diff(self.first)
        many = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(counts)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.minimum(nth * STRIDE, np.maximum(counts - WINDOW, 0)[doc])
        return doc, self.first[:-1][doc] + begin, np.minimum(counts[doc], WINDOW)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, scoring and training of the network."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        size = WORD_SIZE + CHAR_SIZE
        self.order = np.argsort(vocabulary)
        self.sorted = vocabulary[self.order]
        self.p = {
            "word": normal(len(vocabulary) + 1, WORD_SIZE, scale=0.1),
            "char": normal(GRAMS, CHAR_SIZE, scale=0.1),
            "attend": normal(2 * HIDDEN, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p["x" + way] = normal(size, 3 * HIDDEN, scale=size**-0.5)
            self.p["c" + way] = np.zeros(3 * HIDDEN, np.float32)
            self.p["h" + way] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
        self.p["word"][0] = 0
        # a first guess at what words and parts of words say
        self.p["word"][1:, 0] = odds
        self.p["char"][:, 0] = gram_odds
        self.shift = 0.0

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32)
        table = self.p["char"]
        chars = np.add.reduceat(table[words.grams[0]] + table[words.grams[1]], words.starts, axis=0) / words.lengths[:, None]
        return np.hstack([self.p["word"][self.word_ids(words.hashes)], chars]).astype(np.float32)

    def _run(self, x: np.ndarray, at: np.ndarray, live: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [step, window, HIDDEN]; ``at`` and ``live`` are [step, window]."""
        projected = x @ self.p["x" + way] + self.p["c" + way]
        weights = self.p["h" + way]
        states = np.zeros((len(at), at.shape[1], HIDDEN), np.float32)
        h = np.zeros((at.shape[1], HIDDEN), np.float32)
        whole = live.all(axis=1)
        for t in range(len(at)) if way == "f" else range(len(at) - 1, -1, -1):
            given = projected[at[t]]
            from_h = h @ weights
            gates = _sigmoid(given[:, : 2 * HIDDEN] + from_h[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(given[:, 2 * HIDDEN :] + r * from_h[:, 2 * HIDDEN :])
            after = new + z * (h - new)
            if not whole[t]:
                after = np.where(live[t][:, None], after, h)
            if keep is not None:
                keep.append((t, h, z, r, new, from_h[:, 2 * HIDDEN :]))
            h = states[t] = after
        return states

    def logits(self, x, begin, count, keep: dict | None = None) -> np.ndarray:
        """Score of each window before the sigmoid; ``x`` has the inputs of all words."""
        live = np.arange(WINDOW)[:, None] < count
        at = np.where(live, begin + np.arange(WINDOW)[:, None], 0)
        if not len(x):
            x = np.zeros((1, WORD_SIZE + CHAR_SIZE), np.float32)
        caches = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._run(x, at, live, way, c) for way, c in zip("fb", caches)], axis=2)
        weight = np.where(live, states @ self.p["attend"], -30.0)
        weight = np.exp(weight - weight.max(axis=0)) * live
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        value = states @ self.p["out"]
        if keep is not None:
            keep.update(x=x, at=at, live=live, caches=caches, states=states, weight=weight, value=value)
        return (weight * value).sum(axis=0) + self.p["bias"][0]

    def worst(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, Words]:
        """The highest score of each text's windows, and which of its words that window begins with."""
        words = Words(docs)
        doc, begin, count = words.windows()
        logits = self.logits(self.inputs(words), begin, count)
        order = np.lexsort((-logits, doc))
        top = order[np.searchsorted(doc[order], np.arange(len(docs)))]
        return logits[top], begin[top], words

    def scores(self, docs: list[str]) -> np.ndarray:
        return _sigmoid(self.worst(docs)[0].astype(np.float64) - self.shift)

    def gradients(self, words: Words, begin, count, labels) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over some windows."""
        kept: dict = {}
        logits = self.logits(self.inputs(words), begin, count, kept)
        x, at, live, states, weight, value = (kept[k] for k in ("x", "at", "live", "states", "weight", "value"))
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = (_sigmoid(logits) - labels).astype(np.float32) / len(labels)
        g["bias"][0] = d.sum()
        d_value = weight * d
        pooled = (weight * value).sum(axis=0)
        d_weight = d_value * (value - pooled)
        g["out"] = np.tensordot(d_value, states, 2)
        g["attend"] = np.tensordot(d_weight, states, 2)
        d_states = d_value[:, :, None] * self.p["out"] + d_weight[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for half, (way, cache_) in enumerate(zip("fb", kept["caches"])):
            d_h = np.zeros((at.shape[1], HIDDEN), np.float32)
            weights = self.p["h" + way]
            for t, h, z, r, new, from_n in reversed(cache_):
                d_h = d_h + d_states[t][:, half * HIDDEN : (half + 1) * HIDDEN]
                on = live[t][:, None]
                d_new = np.where(on, d_h * (1 - z), 0) * (1 - new * new)
                d_z = np.where(on, d_h * (h - new), 0) * z * (1 - z)
                d_r = d_new * from_n * r * (1 - r)
                d_given = np.hstack([d_z, d_r, d_new])
                d_from = np.hstack([d_z, d_r, d_new * r])
                g["h" + way] += h.T @ d_from
                g["c" + way] += d_given.sum(axis=0)
                g["x" + way] += x[at[t]].T @ d_given
                np.add.at(d_x, at[t], d_given @ self.p["x" + way].T)
                d_h = np.where(on, d_h * z, d_h) + d_from @ weights.T
        used = np.unique(at[live])
        if len(words.starts):
            np.add.at(g["word"], self.word_ids(words.hashes[used]), d_x[used, :WORD_SIZE])
            g["word"][0] = 0
            share = d_x[used, WORD_SIZE:] / words.lengths[used][:, None]
            places = np.repeat(words.starts[used] - np.cumsum(words.lengths[used]) + words.lengths[used], words.lengths[used])
            for grams in words.grams:
                np.add.at(g["char"], grams[places + np.arange(len(places))], np.repeat(share, words.lengths[used], axis=0))
        return g

    def learn(self, docs: list[str], labels: np.ndarray, odds_of, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on each document's counting window; first that of the most telling word, later the worst."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for start in range(0, len(order), batch):
                some = order[start : start + batch]
                part = [docs[i] for i in some]
                if epoch < 2:
                    words = Words(part)
                    doc, begin, count = words.windows()
                    tell = np.concatenate([odds_of(words), np.full(WINDOW, -9.0)])
                    best = tell[begin[:, None] + np.arange(WINDOW)]
                    best = np.where(np.arange(WINDOW) < count[:, None], best, -9.0).max(axis=1)
                    by = np.lexsort((-best, doc))
                    begin = begin[by[np.searchsorted(doc[by], np.arange(len(part)))]]
                else:
                    _, begin, words = self.worst(part)
                count = np.minimum(np.diff(words.first), WINDOW)
                step += 1
                for k, grad in self.gradients(words, begin, count, labels[some]).items():
                    first[k] += 0.1 * (grad - first[k])
                    second[k] += 0.001 * (grad * grad - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        logits = np.concatenate([self.worst(docs[start:end])[0] for start, end in _parts(docs, 64)])
        self.shift = _best_cut(logits, labels)


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F-measure, in the middle of its gap."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    measure = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    at = int(measure.argmax())
    low = logits[order[at + 1]] if at + 1 < len(order) else logits[order[at]] - 1
    return float((logits[order[at]] + low) / 2)


def _odds(counts: np.ndarray, bad: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Log odds that a document with an item is marked, from how many documents and marked ones have it;
    0 where they are less than CLEAR times their standard error."""
    bad = bad.astype(marks.dtype)
    odds = np.log((bad + 0.5) / (marks.sum() + 1)) - np.log((counts - bad + 0.5) / ((1 - marks).sum() + 1))
    clear = np.abs(odds) > CLEAR * np.sqrt(1 / (bad + 0.5) + 1 / (counts - bad + 0.5))
    return np.where((counts >= 3) & clear, odds, 0)


def _parts(docs: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many texts and about CHARS_PER_STEP characters; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(docs):
        if k > start and (k - start == most or size + len(text) > CHARS_PER_STEP):
            yield start, k
            start, size = k, 0
        size += len(text)
    if docs:
        yield start, len(docs)


def _counted(docs: list[str], marks: np.ndarray):
    """Distinct word hashes with how many documents and marked documents have each, and these two numbers of
    each character group.  A few texts at a time, as the numbers of whole texts' characters are many times the texts."""
    found, gram_counts, gram_bad = [], np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)
    for start, end in _parts(docs, len(docs)):
        words, marked = Words(docs[start:end]), marks[start:end] > 0
        pairs = np.unique(np.stack([words.hashes, words.owner.astype(np.uint64)], axis=1), axis=0)
        found.append(_added(pairs[:, 0], np.ones(len(pairs), np.int64), marked[pairs[:, 1].astype(np.int64)].astype(np.int64)))
        if len(found) > 8:
            found = [_added(*map(np.concatenate, zip(*found)))]
        of_char = np.repeat(words.owner, words.lengths)
        # each group once per document and as one number
        groups = np.unique(words.grams * (end - start) + of_char)
        gram, owner = groups // (end - start), groups % (end - start)
        gram_counts += np.bincount(gram, minlength=GRAMS)
        gram_bad += np.bincount(gram[marked[owner]], minlength=GRAMS)
    return _added(*map(np.concatenate, zip(*found))), (gram_counts, gram_bad)


def _added(items: np.ndarray, counts: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items in order, and the sums of their numbers."""
    if not len(items):
        return items, counts, bad
    order = np.argsort(items, kind="stable")
    distinct, starts = np.unique(items[order], return_index=True)
    return distinct, np.add.reduceat(counts[order], starts), np.add.reduceat(bad[order], starts)


def train(docs: list[str], labels: list[int], sample: Sample = Sample()) -> Network | None:
    """A network from labelled texts; None without both labels."""
    marks = np.array(labels, np.float32)
    if not len(marks) or marks.min() == marks.max():
        return None
    (hashes, counts, bad), (gram_counts, gram_bad) = _counted(docs, marks)
    odds = _odds(counts, bad, marks)
    often = np.flatnonzero((odds != 0) | (counts >= sample.word_share * len(docs)) & (counts >= 3))
    often = often[np.lexsort((hashes[often], -counts[often]))][: sample.words]
    vocabulary, odds = hashes[often], odds[often].astype(np.float32)
    gram_odds = _odds(gram_counts, gram_bad, marks).astype(np.float32)
    network = Network(vocabulary, odds, gram_odds)

    def odds_of(some: Words):
        by_word = np.concatenate([[0], odds])[network.word_ids(some.hashes)]
        by_gram = np.maximum.reduceat(gram_odds[some.grams].max(axis=0), some.starts) if len(some.starts) else by_word
        return np.maximum(by_word, by_gram)

    network.learn(docs, marks, odds_of, sample.epochs)
    return network


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, sample: Sample, doc_id="doc_id", text="text", label="toxic"):
    """At most ``sample.toxic`` and ``sample.clean`` labelled texts, chosen by a hash of their id."""
    known = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1)).groupBy("_id").agg(F.max("_label").alias("_label"))
    ids = [
        known.where(F.col("_label") == mark).orderBy(F.xxhash64("_id"), "_id").limit(most)
        for mark, most in ((1, sample.toxic), (0, sample.clean))
    ]
    # bounded by the sample, so it may be broadcast
    chosen = F.broadcast(ids[0].unionAll(ids[1]))
    fit = docs.where(learn_from & (F.length(text) <= sample.chars)).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = fit.join(chosen, "_id").dropDuplicates(["_id"]).orderBy("_id").collect()
    return [r["_text"] for r in rows], [r["_label"] for r in rows]


def score(docs: DataFrame, network: Network | None, text="text", keep=None) -> DataFrame:
    """``row`` (the columns in ``keep``, or all) and the score of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 128):
            found = network.scores(texts(batch.column(1))) if network else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    packed = carried(docs, text, keep)
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
