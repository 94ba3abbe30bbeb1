"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its five-word shingles, weighted by count times inverse
document frequency, 1 + ln(N / df) / ln(N) for N documents: from 1 for a shingle of
all documents to 2 for one of a single document.  SAMPLES consistent weighted
samples agree between two texts with a chance equal to their weighted Jaccard
similarity; bands of samples bring likely pairs into one bucket, and pairs are
verified on the whole texts.

Document frequencies are counted over all documents in a sketch of CELLS counters
(bounded memory, one broadcast).  What other shingles add to a counter on average
is taken off; frequencies below three standard deviations of that noise count as
that much, which is 1 as long as the corpus has fewer shingles than counters.

Equal texts are one node.  The members of a small bucket (of all, once that is
no more than PAIRS_PER_TEXT pairs for each text, four times as many in each further
level) are compared with each other; those of a large one with its centre, the member that meets most others in
all its buckets, so that the bands of a group share a centre from its middle.  What is left
are pairs of which one, f, is not linked to the centre.  Let D be the weight in
which a text differs from the centre, m its own weight, k = (1 - threshold) /
(1 + threshold) and A = D - k m.  Two texts are linked if and only if their
differences to the centre overlap by (A(f) + A(y)) / 2 or more.  With the elements of
a difference in one order (those the centre lacks, rarest first, then those that
only the centre has, which far texts share anyway), the first element that both share must
leave that much in both from there on.  So candidates share an element of their
differences that passes this test; the others are ruled out by scalars.  Elements
with more than FAR_LIMIT texts (eight times as many in each further level) that are
not linked to the centre become buckets of the next level, without their centre.  So every pair of a bucket is compared,
ruled out, or in one class already.  Links are contracted to classes after each
level, and buckets within one class are closed.  Classes are the connected groups.

Texts of fewer than five words are one shingle; texts without a word (null ones
too) are one class.  A class is named by its smallest id (null if none has one).
Equal ids in several rows are rows of their own.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioweave.llm.common import folding, mix, sized_steps, texts, whole, word_hashes
from biblioweave.session import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 20, 4
SAMPLES = BANDS * BAND_ROWS
SMALL_BUCKET = 8
FAR_LIMIT = 64
PAIRS_PER_TEXT = 2
CELLS = 1 << 22
_CHUNK = 1 << 16
_TASKS_AT_ONCE = 1024
# Frequencies are kept in eighths of an octave.
_STEPS = 8
NODES_PER_FILE = 50_000
_TABLE_BITS = 16
_ID_BITS = 53
_STEP_DOCS, _STEP_BYTES = 128, 1 << 18


@cache
def _codes() -> np.ndarray:
    return folding(lower_all=True)


def shingles(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, id and count, ordered by owner and id."""
    hashes, first = word_hashes(docs, _codes())
    counts = np.diff(first)
    rolled = np.zeros(max(0, len(hashes) - SHINGLE_WORDS + 1), np.uint64)
    for k in range(SHINGLE_WORDS):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)]
    owner = np.repeat(np.arange(len(docs)), counts)
    inside = owner[: len(rolled)] == owner[SHINGLE_WORDS - 1 :] if len(rolled) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    few = np.array([_fold(hashes[first[i] : first[i + 1]]) for i in short], np.uint64)
    ids = mix(np.concatenate([rolled[inside], few])) >> np.uint64(64 - _ID_BITS)
    owner = np.concatenate([owner[: len(rolled)][inside], short]).astype(np.uint64)
    keys = np.sort((owner << np.uint64(_ID_BITS)) | ids)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    many = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return (keys >> np.uint64(_ID_BITS)).astype(np.int64), keys & np.uint64((1 << _ID_BITS) - 1), many


def _fold(words: np.ndarray) -> int:
    total = len(words)
    for w in words.tolist():
        total = (total * 0x9E3779B97F4A7C15 + w) & ((1 << 64) - 1)
    return total


class Weights:
    """Weights of shingles: count times inverse document frequency, by the counters of all documents."""

    def __init__(self, counters: np.ndarray, docs: int):
        self.cells = len(counters)
        noise = counters.sum(dtype=np.int64) / self.cells
        least = max(1.0, 3 * np.sqrt(noise))
        found = np.maximum(counters - (noise if noise > 1 else 0.0), least)
        self._codes = zlib.compress(np.round(_STEPS * np.log2(found)).astype(np.uint8).tobytes(), 1)
        self._table = None
        self.idf = np.maximum(1.0, 2 - np.arange(256) * np.log(2) / _STEPS / np.log(max(docs, 2)))
        self.usual = float(self.idf[int(np.round(_STEPS * np.log2(least)))])

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def idf_of(self, ids: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.frombuffer(zlib.decompress(self._codes), np.uint8)
        return self.idf[self._table[_cell(ids, self.cells)]]

    def of(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf_of(ids)


def _cell(ids: np.ndarray, cells: int) -> np.ndarray:
    return (ids & np.uint64(cells - 1)).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling.

    The random numbers r, c (gamma) and beta (uniform) of a shingle in sample j
    stand in a table at a hash of both.  A sample is the least
    ln c - r (t - beta + 1) with t = floor(ln w / r + beta), with the shingle and
    t that gave it, packed into one number.
    """

    def __init__(self, weights: Weights, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = 1 << _TABLE_BITS
        self.r, self.c, self.beta = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.random(size)
        self.spread = rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.weights = weights
        self.usual = self._upper(np.arange(size), np.log(weights.usual))

    def _upper(self, at: np.ndarray, log_weight) -> np.ndarray:
        """The value in order-preserving form above bit 32, t in the lowest byte."""
        t = np.floor(log_weight / self.r[at] + self.beta[at])
        value = (self.c[at] - self.r[at] * (t - self.beta[at] + 1)).astype(np.float32)
        bits = value.view(np.int32).astype(np.int64)
        ordered = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)
        return (ordered << np.uint64(32)) | (t.astype(np.int64) & 0xFF).astype(np.uint64)

    def bands(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes [text, BANDS], and the sum of each text's weights; texts without a word have the same hashes."""
        owner, ids, counts = shingles(docs)
        out, mass = np.zeros((len(docs), SAMPLES), np.uint64), np.zeros(len(docs))
        if len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            weight = self.weights.of(ids, counts)
            mass = np.bincount(owner, weight, len(docs))
            odd = np.flatnonzero(weight != self.weights.usual)
            log_odd = np.log(weight[odd])
            low = (ids & np.uint64(0xFFFFFF)) << np.uint64(8)
            spread_ids = mix(ids)
            for j in range(SAMPLES):
                at = ((spread_ids * self.spread[j]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
                upper = self.usual[at]
                if len(odd):
                    upper[odd] = self._upper(at[odd], log_odd)
                out[owner[starts], j] = np.minimum.reduceat(upper | low, starts)
        bands = np.zeros((len(docs), BANDS), np.uint64)
        for k in range(BAND_ROWS):
            bands = mix(bands * np.uint64(31) + out[:, k::BAND_ROWS] + np.uint64(k))
        return mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), mass


def compare(one: str, other: str, weights: Weights) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """Similarity of two whole texts, their weights, and in what the other differs: elements, those it has more of and rare ones first, and weights."""
    owner, ids, counts = shingles([one, other])
    cut = np.searchsorted(owner, 1)
    distinct, place = np.unique(ids, return_inverse=True)
    changes = np.bincount(place[cut:], counts[cut:], len(distinct)) - np.bincount(place[:cut], counts[:cut], len(distinct))
    idf = weights.idf_of(distinct)
    own = idf[place] * counts
    mass, other_mass, apart = own[:cut].sum(), own[cut:].sum(), (np.abs(changes) * idf).sum()
    found = np.flatnonzero(changes)
    order = found[np.lexsort((distinct[found], -idf[found], changes[found] < 0))]
    elements = (distinct[order] << np.uint64(1)) | (changes[order] > 0)
    total = mass + other_mass
    return float((total - apart) / (total + apart)) if total else 1.0, mass, other_mass, elements, np.abs(changes[order]) * idf[order]


def similarity(one: str, other: str, weights: Weights) -> float:
    """Weighted Jaccard similarity of two whole texts."""
    return compare(one, other, weights)[0]


def _packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Places (none if all are listed) and values of counters: one byte each, large ones in eight more."""
    places = np.flatnonzero(counts)
    dense = 3 * len(places) > len(counts)
    values = (counts if dense else counts[places]).astype(np.int64)
    large = values[values >= 255]
    return b"" if dense else places.astype("<u2").tobytes(), np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _unpacked(places: bytes, values: bytes, size: int) -> np.ndarray:
    at = np.frombuffer(places, "<u2").astype(np.int64) if places else np.arange(size if values else 0)
    found = np.frombuffer(values, np.uint8, len(at)).astype(np.int64)
    found[found == 255] = np.frombuffer(values, "<i8", offset=len(at))
    counts = np.zeros(size, np.int64)
    counts[at] = found
    return counts


def document_frequencies(docs: DataFrame, text: str) -> Weights:
    """Weights by how many documents have each shingle; repeated rows count as documents.

    Tasks count into counters of their own; these are added up in chunks, those of
    at most _TASKS_AT_ONCE tasks first.
    """
    cells, chunk = CELLS, min(_CHUNK, CELLS)

    def count(batches):
        total, docs_seen = np.zeros(cells, np.int32), 0
        for batch in sized_steps(batches, 0, _STEP_BYTES, _STEP_DOCS):
            found, n = np.unique(_cell(shingles(texts(batch.column(0)))[1], cells), return_counts=True)
            total[found] += n.astype(np.int32)
            docs_seen += batch.num_rows
        if docs_seen:
            parts = [(k, *_packed(total[k * chunk : (k + 1) * chunk]), 0) for k in range(cells // chunk)]
            rows = [(k, *rest) for k, *rest in parts if rest[1]] + [(-1, b"", b"", docs_seen)]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
            ours = pa.array([TaskContext.get().partitionId() // _TASKS_AT_ONCE] * len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), ours], ["chunk", "places", "values", "docs", "part"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for places, values in zip(rows.column("places").to_pylist(), rows.column("values").to_pylist()):
            total += _unpacked(places, values, chunk)
        places, values = _packed(total)
        docs_seen = sum(rows.column("docs").to_pylist())
        return pa.table([[rows.column("chunk")[0].as_py()], [places], [values], [docs_seen], [0]], _sketch)

    _sketch = pa.schema([("chunk", pa.int32()), ("places", pa.binary()), ("values", pa.binary()), ("docs", pa.int64()), ("part", pa.int32())])
    schema = "chunk int, places binary, values binary, docs long, part int"
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    summed = counted.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    counters, docs_seen = np.zeros(cells, np.int64), 0
    for row in summed.collect():  # cells / chunk rows
        if row["chunk"] < 0:
            docs_seen = row["docs"]
        else:
            counters[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = _unpacked(row["places"], row["values"], chunk)
    return Weights(counters, docs_seen)


def sign(docs: DataFrame, weights: Weights, doc_id="doc_id", text="text") -> DataFrame:
    """Written table of doc_id, key (hash of the whole text), mass (sum of its weights) and the band hashes."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        sampler = Sampler(weights)
        for batch in sized_steps(batches, 1, _STEP_BYTES, _STEP_DOCS):
            some = texts(batch.column(1))
            keys = [hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in some]
            hashes, mass = sampler.bands(some)
            flat = hashes.astype(np.int64).ravel()
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(mass), bands], ["doc_id", "key", "mass", "bands"])

    fields = [T.StructField("key", T.StringType()), T.StructField("mass", T.DoubleType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return materialise(plain.mapInArrow(run, T.StructType([plain.schema["doc_id"], *fields])), "signatures")


def _reaches(found, threshold: float) -> tuple[float, list[int], list[float]]:
    """Excess A of a star's member, and the elements it may share first with a linked text, with the weight from there on."""
    near, centre_mass, mass, elements, weight = found
    k = (1 - threshold) / (1 + threshold)
    left = np.cumsum(weight[::-1])[::-1]
    excess = (left[0] if len(left) else 0.0) - k * mass
    # the other text's excess is more than k * centre_mass if this one is linked to the centre, else at least -k * centre_mass
    least = excess + k * centre_mass if near >= threshold else excess - k * centre_mass
    kept = 2 * left >= least - 1e-6
    return float(excess), elements[kept].astype(np.int64).tolist(), left[kept].tolist()


def _verify(pairs: DataFrame, involved: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``pairs`` (a, b, star) with their similarity, as a written table.

    For stars (a is the centre) also the excess of b, and its elements with reaches.
    """
    left = involved.select(F.col("key").alias("a"), F.col("text").alias("one"))
    right = involved.select(F.col("key").alias("b"), F.col("text").alias("other"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "star", "one", "other")

    def run(batches):
        for batch in sized_steps(batches, 4, _STEP_BYTES, _STEP_DOCS):
            rows = []
            for star, one, other in zip(batch.column(2).to_pylist(), texts(batch.column(3)), texts(batch.column(4))):
                found = compare(one, other, weights)
                rows.append((found[0], *(_reaches(found, threshold) if star else (0.0, [], []))))
            columns = zip(list(zip(*rows)) or [[]] * 4, (pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(*c) for c in columns)], ["a", "b", "star", "similarity", "excess", "elements", "reaches"])

    schema = "a string, b string, star boolean, similarity double, excess double, elements array<long>, reaches array<double>"
    return materialise(joined.mapInArrow(run, schema), "verified-pairs")


def _written(df: DataFrame, label: str, files: int) -> DataFrame:
    """A written table of narrow rows in ``files`` files, so that small ones are not cut into very many."""
    return materialise(df.coalesce(files), label)


def _relabelled(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The classes at both ends of ``edges`` (a, b), each pair of different ones once."""
    for end in ("a", "b"):
        edges = _labelled(edges, labels, end).select(F.col("group").alias(end), *[c for c in ("a", "b") if c != end])
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contract(edges: DataFrame, files: int) -> DataFrame | None:
    """node and label (its group's representative) for all ends of ``edges`` (a, b); None without an edge.

    Every node hooks onto its least neighbour, chains are shortened to their roots,
    and what is left between roots is contracted again.
    """
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = _written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "hooks", files)
        while True:
            to = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            shorter = hooks.join(to, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
            shorter = _written(shorter, "hooks", files)
            hooks = shorter.select("node", "label")
            if shorter.where("moved").isEmpty():
                break
        labels = hooks if labels is None else _then(labels, hooks, files)
        edges = _written(_relabelled(edges, hooks), "edges", files)
    return labels


def _then(labels: DataFrame, later: DataFrame, files: int) -> DataFrame:
    """First ``labels``, then the labels of these."""
    first = labels.select("node", F.col("label").alias("was"))
    second = later.select(F.col("node").alias("was"), F.col("label").alias("now"))
    both = first.join(second, "was", "full").select(F.coalesce("node", "was").alias("node"), F.coalesce("now", "was").alias("label"))
    # a class that is named by one of its own nodes has that node among the first labels already
    return _written(both.groupBy("node").agg(F.first("label").alias("label")), "labels", files)


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, key (hash of its text), label (its class), class_id (its class's
    smallest id), class_size (documents) and similarity (the greatest verified with another text, else null)."""
    weights = document_frequencies(docs, text)
    signed = sign(docs, weights, doc_id, text)
    nodes = signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("mass").alias("mass"))
    total = nodes.count()
    files = total // NODES_PER_FILE + 4
    places = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    active = _written(places.join(shared, "bucket").withColumn("above", F.lit(0).cast("long")), "bucket-members", files)
    labels, links = None, None
    if not active.isEmpty():
        keyed = docs.select(F.md5(whole(F.col(text))).alias("key"), whole(F.col(text)).alias("text"))
        involved = materialise(
            keyed.join(active.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "involved-texts"
        )
        masses = materialise(nodes.join(active.select("key").distinct(), "key", "left_semi").select("key", "mass"), "text-masses")
        labels, links = _classes(active, involved, masses, total, files, weights, threshold)
    grouped = _labelled(signed.select("doc_id", "key"), labels).withColumnRenamed("group", "label")
    best = docs.sparkSession.createDataFrame([], "key string, similarity double")
    if links is not None:
        best = links.select(F.col("a").alias("key"), "similarity").union(links.select("b", "similarity")).groupBy("key").agg(F.max("similarity").alias("similarity"))
    named = grouped.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return grouped.join(named, "label").join(best, "key", "left").select("doc_id", "key", "label", "class_id", "class_size", "similarity")


def _possible(pairs: DataFrame, masses: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sums of weights do not rule a link out: similarity is at most their ratio."""
    of = lambda end: masses.select(F.col("key").alias(end), F.col("mass").alias(f"{end}_mass"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(F.least("a_mass", "b_mass") >= (threshold - 1e-9) * F.greatest("a_mass", "b_mass")).select("a", "b")


def _classes(active: DataFrame, involved: DataFrame, masses: DataFrame, nodes: int, files: int, weights: Weights, threshold: float):
    """Labels of the texts that are linked, and all verified links: see the head of the module."""
    labels = links = known = candidates = None
    budget, far_limit = PAIRS_PER_TEXT * nodes, FAR_LIMIT
    while True:
        members = _labelled(active, labels)
        open_ = members.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("group") != F.max("group")).alias("mixed"))
        members = _written(members.join(open_.where("mixed").drop("mixed"), "bucket"), "open-buckets", files)
        # one row of each bucket in n stands for (n - 1) / 2 of its pairs
        every = members.agg(F.sum((F.col("n") - 1) / 2)).first()[0] or 0
        small = F.lit(True) if every <= budget else F.col("n") <= SMALL_BUCKET
        budget *= 4
        large = members.where(~small)
        # a text that meets many others is in the middle of its group
        met = large.groupBy("key").agg(F.struct((-F.sum("n")).alias("met"), F.xxhash64("key").alias("hash"), "key").alias("order"))
        centres = large.join(met, "key").groupBy("bucket").agg(F.min("order")["key"].alias("centre"))
        few = members.where(small).select("bucket", "key", "group")
        others = few.select("bucket", F.col("key").alias("b"), F.col("group").alias("b_group"))
        pairs = few.join(others, "bucket").where((F.col("key") < F.col("b")) & (F.col("group") != F.col("b_group")))
        pairs = _possible(pairs.select(F.col("key").alias("a"), "b").distinct(), masses, threshold)
        if candidates is not None:
            apart = _labelled(_labelled(candidates, labels, "a").withColumnRenamed("group", "a_group"), labels, "b")
            pairs = pairs.union(apart.where("a_group != group").select("a", "b")).distinct().join(known, ["a", "b"], "left_anti")
        star = F.xxhash64("above", "centre").alias("star_id")
        stars = large.join(centres, "bucket").where(F.col("key") != F.col("centre")).select(star, F.col("centre").alias("a"), F.col("key").alias("b"))
        stars = _written(stars.distinct(), "stars", files)
        asked = pairs.withColumn("star", F.lit(False)).unionByName(stars.select("a", "b").distinct().withColumn("star", F.lit(True)))
        verified = _verify(asked, involved, weights, threshold)
        compared = verified.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        known = compared if known is None else known.union(compared)
        linked = verified.where(F.col("similarity") >= threshold).select("a", "b", "similarity")
        links = linked if links is None else links.union(linked)
        more = contract(_written(_relabelled(linked.select("a", "b"), labels), "edges", files), files)
        if more is not None:
            labels = more if labels is None else _then(labels, more, files)
        if stars.isEmpty():
            return labels, links
        active, candidates = _beyond_centres(stars, verified.where("star"), threshold, files, far_limit)
        far_limit *= 8


def _beyond_centres(stars: DataFrame, verified: DataFrame, threshold: float, files: int, far_limit: int) -> tuple[DataFrame, DataFrame]:
    """What may be linked within stars besides the links to the centre: buckets (bucket, key, above), and pairs (a, b)."""
    found = stars.join(verified.drop("star"), ["a", "b"])
    shared = F.explode(F.arrays_zip("elements", "reaches")).alias("e")
    rows = found.select("star_id", F.col("b").alias("key"), (F.col("similarity") < threshold).alias("far"), "excess", shared)
    rows = rows.select("star_id", F.col("e.elements").alias("element"), "key", "far", "excess", F.col("e.reaches").alias("reach"))
    rows = _written(rows, "star-elements", files)
    place = ["star_id", "element"]
    # what the other text must at least bring: its excess, and that less twice its reach
    gap = F.col("excess") - 2 * F.col("reach")
    kinds = {"": F.lit(True), "_far": F.col("far")}
    bounds = {f"{name}{kind}": F.min(F.when(of, c)) for kind, of in kinds.items() for name, c in (("least", F.col("excess")), ("gap", gap))}
    least = rows.groupBy(*place).agg(*[c.alias(name) for name, c in bounds.items()], F.count("*").alias("shared"))
    other = lambda name: F.when(F.col("far"), F.col(name)).otherwise(F.col(f"{name}_far"))
    can = (F.col("excess") + other("least") <= 2 * F.col("reach") + 1e-6) & (F.col("excess") + other("gap") <= 1e-6)
    # an element of one text alone, as most of a far one's are, leads nowhere
    rows = rows.join(least.where("least_far IS NOT NULL AND shared > 1").drop("shared"), place).where(can).drop(*bounds)
    sizes = rows.groupBy(*place).agg(F.count_if("far").alias("n_far"), F.count("*").alias("n")).where("n_far > 0 AND n > 1")
    rows = _written(rows.join(sizes.drop("n"), place), "star-elements", files)
    few = rows.where(F.col("n_far") <= far_limit)
    far = few.where("far").select("star_id", "element", F.col("key").alias("f"), F.col("excess").alias("f_excess"), F.col("reach").alias("f_reach"))
    once = ~F.col("far") | (F.col("key") < F.col("f"))
    enough = F.col("excess") + F.col("f_excess") <= 2 * F.least("reach", "f_reach") + 1e-6
    pairs = few.join(far, place).where((F.col("key") != F.col("f")) & once & enough)
    pairs = _written(pairs.select(F.least("key", "f").alias("a"), F.greatest("key", "f").alias("b")).distinct(), "star-pairs", files)
    many = rows.where(F.col("n_far") > far_limit)
    buckets = many.select(F.xxhash64("star_id", "element").alias("bucket"), "key", F.col("star_id").alias("above"))
    return _written(buckets, "bucket-members", files), pairs


def _labelled(members: DataFrame, labels: DataFrame | None, key: str = "key") -> DataFrame:
    """``members`` with their group: the class found so far, or the key itself."""
    if labels is None:
        return members.withColumn("group", F.col(key))
    return members.join(labels.select(F.col("node").alias(key), "label"), key, "left").withColumn("group", F.coalesce("label", key)).drop("label")


def keep_one(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One document of each class: the one with the smallest id, of equal ids any; columns as given."""
    classes = near_duplicates(docs, doc_id, text)
    kept = classes.groupBy("label").agg(F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_kept_id"), F.col("k.key").alias("_kept_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("_id"), F.md5(whole(F.col(text))).alias("_key"))
    same = (F.col("_key") == F.col("_kept_key")) & F.col("_id").eqNullSafe(F.col("_kept_id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_key"]).select("row.*")
