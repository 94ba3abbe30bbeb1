"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and single tokens with
the uniform distribution.  The mixture depends on how often the context was
seen: contexts of about the same frequency (powers of two) share their weights,
which expectation-maximisation learns on the counts of a part of the learning
documents, with estimates from the counts of the others.

Documents are dealt to blocks by a hash; learning, tuning and other documents
are in blocks of their own.  A block sends its distinct n-grams, each as a hash
with its count, to the part its hash belongs to; the part adds up all blocks'
counts and sends them back in the same order; the block then scores its
documents.  So each n-gram crosses the network once for each block, not for each
of its occurrences, and hot n-grams weigh no more than others.

Tokens are words with A-Z in lower case, and one end for each document; n-grams
stand for themselves by 55 bits of a hash.  Null texts are empty: one token, the
end.  Equal texts get equal scores.  Without a learning document every
probability is uniform; without tuning documents weights are equal.  An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioweave.llm.common import folding, mix, texts, whole, word_hashes
from biblioweave.session import materialise

BLOCK_CHARS = 8_000_000
BUCKETS = 32
EM_ROUNDS = 60
# Log2 steps of the estimates that mixture weights are learned from.
STEPS = 4
_ID_BITS = 56
_END, _START = np.uint64(0x51ED270B7A3C9F15), np.uint64(0x2545F4914F6CDD1D)
_OTHER, _LEARN, _TUNE = 0, 1, 2


@cache
def _codes() -> np.ndarray:
    return folding(lower_all=False)


def tokens(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each token and of it with the token before, how many tokens each text has, where each text begins.

    The lowest bit of an id tells single tokens (0) from pairs (1).
    """
    words, first = word_hashes(docs, _codes())
    counts = np.diff(first) + 1
    starts = np.cumsum(counts) - counts
    hashes = np.full(len(words) + len(docs), _END, np.uint64)
    hashes[np.arange(len(words)) + np.repeat(np.arange(len(docs)), counts - 1)] = words
    before = np.concatenate([[_START], hashes[:-1]]).astype(np.uint64)
    before[starts] = _START
    cut, low = np.uint64(64 - _ID_BITS), np.uint64(1)
    single = (mix(hashes) >> cut) & ~low
    pair = (mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes) >> cut) | low
    return single, pair, counts, starts


def _pack_ids(ids: np.ndarray) -> bytes:
    """Sorted ids as differences of as few bytes as the largest needs."""
    steps = np.diff(ids, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_ids(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel().astype(np.uint64))


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; the large ones follow in eight bytes each."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def _request(parts: int):
    """Rows of part, block, n, ids and counts for a block's distinct n-grams."""

    def run(block: pa.Table) -> pa.Table:
        single, pair, _, _ = tokens(texts(block.column("text")))
        ids, counts = np.unique(np.concatenate([single, pair]), return_counts=True)
        bounds = np.searchsorted(ids, np.array([(p << _ID_BITS) // parts for p in range(parts)], np.uint64))
        rows = {k: [] for k in ("part", "n", "ids", "counts")}
        for p, (a, b) in enumerate(zip(bounds, np.append(bounds[1:], len(ids)))):
            if a < b:
                rows["part"].append(p)
                rows["n"].append(int(b - a))
                rows["ids"].append(_pack_ids(ids[a:b]))
                rows["counts"].append(_pack_counts(counts[a:b]))
        size = len(rows["part"])
        kind, number = block.column("kind")[0].as_py(), block.column("block")[0].as_py()
        return pa.table(
            [pa.array(rows["part"], pa.int32()), pa.array([kind] * size, pa.int32()), pa.array([number] * size, pa.int64()),
             pa.array(rows["n"], pa.int64()), pa.array(rows["ids"], pa.binary()), pa.array(rows["counts"], pa.binary())],
            ["part", "kind", "block", "n", "ids", "counts"],
        )

    return run


def _add_up(requests: pa.Table) -> pa.Table:
    """Counts over all blocks for each block's n-grams of one part, and the sums over the part (block -1)."""
    rows = requests.to_pylist()
    ids = np.concatenate([_unpack_ids(r["ids"]) for r in rows])
    distinct, place = np.unique(ids, return_inverse=True)
    counts = np.concatenate([_unpack_counts(r["counts"], r["n"]) for r in rows])
    kinds = np.repeat([r["kind"] for r in rows], [r["n"] for r in rows])
    tuned = np.bincount(place, counts * (kinds == _TUNE), len(distinct)).astype(np.int64)
    learned = np.bincount(place, counts * (kinds != _OTHER), len(distinct)).astype(np.int64)
    single = distinct & np.uint64(1) == 0
    out = {k: [] for k in ("block", "n", "learned", "tuned")}
    at = 0
    for r in rows:
        here = place[at : at + r["n"]]
        at += r["n"]
        for k, v in (("block", r["block"]), ("n", r["n"]), ("learned", _pack_counts(learned[here])), ("tuned", _pack_counts(tuned[here]))):
            out[k].append(v)
    size = len(rows)
    sums = [int(learned[single].sum()), int(tuned[single].sum()), int((learned[single] > 0).sum())]
    kinds_of = [("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("learned", pa.binary()), ("tuned", pa.binary()),
                ("all_learned", pa.int64()), ("all_tuned", pa.int64()), ("distinct", pa.int64())]
    columns = [[rows[0]["part"]] * (size + 1), [*out["block"], -1], [*out["n"], 0], [*out["learned"], b""], [*out["tuned"], b""]]
    columns += [[None] * size + [s] for s in sums]
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds_of)], [n for n, _ in kinds_of])


class Counts:
    """What a block's tokens and their contexts count in the corpus."""

    def __init__(self, docs: list[str], answers: pa.Table):
        single, pair, self.sizes, self.starts = tokens(docs)
        ids, place = np.unique(np.concatenate([single, pair]), return_inverse=True)
        rows = sorted(answers.to_pylist(), key=lambda r: r["part"])
        learned = np.concatenate([_unpack_counts(r["learned"], r["n"]) for r in rows])
        tuned = np.concatenate([_unpack_counts(r["tuned"], r["n"]) for r in rows])
        if len(learned) != len(ids):
            raise ValueError("a block's answer does not fit its documents")
        one, two = place[: len(single)], place[len(single) :]
        end = np.searchsorted(ids, (mix(np.array([_END])) >> np.uint64(64 - _ID_BITS)) & ~np.uint64(1))[0]
        context = np.concatenate([[end], one[:-1]])
        context[self.starts] = end  # as many texts begin as end
        self.token, self.pair, self.context = learned[one], learned[two], learned[context]
        self.token_tuned, self.pair_tuned, self.context_tuned = tuned[one], tuned[two], tuned[context]


def _bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 more than the binary logarithm."""
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _level(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-300))) + 1, 0).astype(np.int64)


def mixture(rows: list[tuple[int, int, int, int]], uniform: float) -> np.ndarray:
    """Weights [bucket, (pair, token, uniform)] by expectation-maximisation.

    ``rows``: bucket, levels of the two estimates, and how many tuning tokens had
    these.  A bucket without any takes the weights of all buckets together.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if rows:
        bucket, pair, token, n = (np.array(c) for c in zip(*rows))
        back = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / STEPS), 0.0)
        p = np.stack([back(pair), back(token), np.full(len(n), uniform)], axis=1)
        every = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = weights[bucket] * p
            share /= share.sum(axis=1, keepdims=True)
            all_ = every * p
            every = (all_ / all_.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            sums = np.stack([np.bincount(bucket, share[:, k] * n, BUCKETS) for k in range(3)], axis=1)
            seen = sums.sum(axis=1) > 0
            weights = np.where(seen[:, None], sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300), every)
        # no weight may vanish, so that no text is impossible
        weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, learn: Column, tune: Column, doc_id="doc_id", text="text", keep: list[str] | None = None) -> DataFrame:
    """Each document's row (columns in ``keep``, or all), n_tokens, n_known, train_tokens, base_score and score.

    ``learn``: which documents are learned from; ``tune``: which of these give the
    held-out counts for the mixture.
    """
    marked = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"),
        whole(F.col(text)).alias("text"),
        F.when(learn & tune, _TUNE).when(learn, _LEARN).otherwise(_OTHER).alias("kind"),
        F.xxhash64(doc_id, text).alias("hash"),
    )
    sizes = {r["kind"]: r["n"] for r in marked.groupBy("kind").agg(F.sum(F.length("text") + 1).alias("n")).collect()}
    blocks = {k: -(-n // BLOCK_CHARS) for k, n in sizes.items()}
    firsts = {_OTHER: 0, _LEARN: blocks.get(_OTHER, 0), _TUNE: blocks.get(_OTHER, 0) + blocks.get(_LEARN, 0)}
    parts = max(1, sum(blocks.values()))
    number = F.lit(-1).cast("long")
    for kind, n in blocks.items():
        number = F.when(F.col("kind") == kind, firsts[kind] + F.pmod("hash", F.lit(n))).otherwise(number)
    dealt = marked.withColumn("block", number.cast("long")).drop("hash")

    request = "part int, kind int, block long, n long, ids binary, counts binary"
    asked = dealt.select("block", "kind", "text").groupBy("block").applyInArrow(_request(parts), request)
    answer = "part int, block long, n long, learned binary, tuned binary, all_learned long, all_tuned long, distinct long"
    answers = materialise(asked.groupBy("part").applyInArrow(_add_up, answer), "ngram-counts")
    sums = answers.where("block = -1").agg(F.sum("all_learned").alias("n"), F.sum("all_tuned").alias("t"), F.sum("distinct").alias("v")).first()
    total, tuned, distinct = (sums[k] or 0 for k in ("n", "t", "v"))
    uniform = 1 / (distinct + 1)
    replies = answers.where("block >= 0").select("block", "part", "n", "learned", "tuned")

    def levels(block: pa.Table, reply: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if block.num_rows:
            c = Counts(texts(block.column("text")), reply)
            context = c.context - c.context_tuned
            pair, token = _ratio(c.pair - c.pair_tuned, context), (c.token - c.token_tuned) / max(1, total - tuned)
            keys = (_bucket(context).astype(np.int64) << 40) | (_level(pair) << 20) | _level(token)
            keys, n = np.unique(keys, return_counts=True)
            found = [keys >> 40, (keys >> 20) & 0xFFFFF, keys & 0xFFFFF, n]
        return pa.table([pa.array(x, pa.int64()) for x in found], ["bucket", "pair", "token", "n"])

    # as many rows as there are buckets and levels of probability
    from_tuning = dealt.where(F.col("kind") == _TUNE).select("block", "text").groupBy("block")
    tuning_replies = replies.where(F.col("block") >= firsts[_TUNE]).groupBy("block")
    histogram = from_tuning.cogroup(tuning_replies).applyInArrow(levels, "bucket long, pair long, token long, n long")
    rows = histogram.groupBy("bucket", "pair", "token").agg(F.sum("n").alias("n")).collect() if tuned else []
    weights = mixture([tuple(r) for r in sorted(rows)], uniform) if total else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    kinds = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([dealt.schema["row"], *(T.StructField(*k) for k in kinds)])

    def judge(block: pa.Table, reply: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table([block.column("row"), *([pa.array([], t)] for t in (pa.int64(),) * 3 + (pa.float64(),) * 2)], schema.names)
        c = Counts(texts(block.column("text")), reply)
        w = weights[_bucket(c.context)]
        p = w[:, 0] * _ratio(c.pair, c.context) + w[:, 1] * c.token / max(1, total) + w[:, 2] * uniform
        base = np.log10((c.token + 1) / (total + distinct + 1))
        by_text = lambda x: np.add.reduceat(x, c.starts)
        columns = [c.sizes, by_text((c.token > 0).astype(np.int64)), np.full(len(c.sizes), total), by_text(base), by_text(np.log10(p))]
        return pa.table([block.column("row"), *map(pa.array, columns)], schema.names)

    everything = dealt.select("block", "row", "text").groupBy("block")
    return everything.cogroup(replies.groupBy("block")).applyInArrow(judge, schema)
