"""The best records of many requests, scored in cells of a group of requests and a group of records.

Requests and records are dealt into groups by a hash of their ids; a cell is one pair of
groups.  Each group is packed once into one compressed row, its words numbered, and a
Cartesian product brings the two rows of a cell together: a task reads the groups where
they are, so what is written to disk grows with the postings alone, neither with the
number of groups nor with the pairs that share a word.  A task holds two groups.

Within a cell a request's words are added up from the greatest bound down, first those in
few records, for the records that have them only.  Once the words left cannot lift a record
over the ``n``-th best score of those looked at, only records near it are scored in full.
Requests for which words in many records decide are put off, and the shares of these words
are then found for many requests at a time, by a product of matrices.  The result contains
the n best records of the plain join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Postings of a group, about: some 400 MB in a task.
GROUP_POSTINGS = 6_000_000
# Cells for each core, so that tasks even out, while groups have more postings than that.
CELLS_PER_CORE, LEAST_POSTINGS = 4, 20_000
# To look at a request in one more group costs about as much as setting up so many postings in one more cell.
REQUEST_COST = 1_000
# A posting read record by record costs about as much as so many read word by word.
GATHER_COST = 4
# Where all scores are asked for, pairs of a request and a record in a cell: some 150 MB in a task.
CELL_PAIRS = 2_000_000
# A posting in a product of matrices costs this part of one that is added up; elements of such a matrix.
PRODUCT_COST, PRODUCT_SIZE = 0.005, 16_000_000
# Requests put off that a product of matrices is worth while for, and requests in one.
LEAST_PUT_OFF, PRODUCT_ROWS = 16, 64
# Requests after which a cell judges whether words in few records are worth looking at first.
TRIED = 64
# Rounded scores closer than this may still be ties, so bounds keep that distance.
SLACK = 2e-6


def groups(asked: int, held: int, cores: int, requests: int | None = None) -> tuple[int, int]:
    """Numbers of request groups and record groups for so many request terms and postings."""
    q, r = max(1, math.ceil(asked / GROUP_POSTINGS)), max(1, math.ceil(held / GROUP_POSTINGS))
    while q * r < CELLS_PER_CORE * cores:
        # more record groups repeat the requests, more request groups the records
        more_records = (asked if requests is None else requests * REQUEST_COST) * r <= held * q
        if (held / r if more_records else asked / q) < LEAST_POSTINGS:
            break
        q, r = (q, 2 * r) if more_records else (2 * q, r)
    return q, r


def smaller(q: int, r: int, asked: int, held: int, requests: int, records: int) -> tuple[int, int]:
    """More groups, until the pairs of a cell are few enough to be held all at once."""
    while requests / q * (records / r) > CELL_PAIRS:
        q, r = (q, 2 * r) if asked * r <= held * q and r < records else (2 * q, r)
    return q, r


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Length of each list and all elements."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column)
    return lengths, flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the elements among the distinct ones, and these."""
    if not pa.types.is_dictionary(flat.type):
        flat = flat.dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)


def _by_code(code: np.ndarray) -> np.ndarray:
    """Places in the order of codes, equal ones as they come; 16 bits at a time are sorted by counting."""
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
    return order[np.argsort((code >> 16).astype(np.uint16)[order], kind="stable")] if len(code) and code.max() > 0xFFFF else order


def _nth(values: np.ndarray, n: int) -> float:
    """The n-th greatest value, or 0."""
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) > n else 0.0


def _tops(sums: np.ndarray) -> np.ndarray:
    """The greatest of each 64 sums, which lie evenly apart."""
    return sums.reshape(64, -1).max(axis=0)


def _above(sums: np.ndarray, tops: np.ndarray, least: float) -> np.ndarray:
    """Places of the sums over 0 that are not under ``least``."""
    columns = np.flatnonzero((tops >= least) & (tops > 0))
    some = sums.reshape(64, -1)[:, columns]
    row, column = np.nonzero((some >= least) & (some > 0))
    return row * len(tops) + columns[column]


class Records:
    """A group of records: postings by record and by token; record numbers are in the order of ids.

    ``usual`` has a weight for each word of the vocabulary, with which its shares are kept at
    hand; ``times`` is how many rows of the same id and field there are at most.
    """

    def __init__(self, table: pa.Table, vocabulary: pa.Array, usual: np.ndarray | None = None, times: int = 1):
        ids = pc.unique(table["id"])
        self.ids = ids.take(pc.sort_indices(ids))
        count, words = len(self.ids), len(vocabulary)
        row = pc.index_in(table["id"], self.ids).to_numpy().astype(np.int32)
        lengths, flat = _lists(table["tokens"])
        place, distinct = _coded(flat)
        code = pc.fill_null(pc.index_in(distinct, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)[place]
        tf = _lists(table["tfs"])[1].to_numpy(zero_copy_only=False)
        norm = table["norm"].to_numpy()
        if (row[1:] < row[:-1]).any():
            order = np.argsort(row, kind="stable")
            at = _ranges((np.cumsum(lengths) - lengths)[order], lengths[order])
            row, lengths, norm, code, tf = row[order], lengths[order], norm[order], code[at], tf[at]
        asked = code >= 0
        share = np.repeat(norm, lengths)[asked]
        share += tf[asked]
        self.share = np.divide(tf[asked], share, out=share)
        self.code, owner = code[asked], np.repeat(row, lengths)[asked]
        del code, tf, asked, place, flat
        self.first = np.append(0, np.cumsum(np.bincount(owner, minlength=count)))
        order = _by_code(self.code)
        self.at, share = owner[order], self.share[order]
        del owner, order
        postings = np.bincount(self.code, minlength=words)
        self.start = np.append(0, np.cumsum(postings))
        self.most, some = np.zeros(words), np.flatnonzero(postings)
        if len(some):
            self.most[some] = np.maximum.reduceat(share, self.start[some]) * times
        self.unit, self.value, self.off = np.ones(words), share, 0.0
        if usual is not None:
            # in single precision; parts of a score are off by less than this part of their bound
            self.unit, self.off = usual, 2.0**-22
            share *= np.repeat(usual, postings)
            self.value = share.astype(np.float32)
        self.weight = np.zeros(words)
        self.usual = len(self.code) / max(count, 1)
        self.sums = np.zeros(-(-max(count, 1) // 64) * 64)
        self.last = np.zeros(count, np.int32)
        self.tried = self.settled = 0

    def _scores(self, chosen: np.ndarray) -> np.ndarray:
        """Whole scores of the chosen records for the weights set, added in one order."""
        first, lengths = self.first[chosen], self.first[chosen + 1] - self.first[chosen]
        at = _ranges(first, lengths)
        parts = np.append(self.weight[self.code[at]] * self.share[at], 0.0)
        return np.where(lengths > 0, np.add.reduceat(parts, np.cumsum(lengths) - lengths), 0.0) if len(chosen) else np.zeros(0)

    def _reached(self, chosen: np.ndarray, n: int) -> float:
        """The n-th best whole score of the chosen records."""
        if len(chosen) < n:
            return 0.0
        return _nth(np.append(self._scores(chosen), 0.0), n)

    def _by_bound(self, codes: np.ndarray, weights: np.ndarray):
        """From the greatest bound down: ranges of the words' postings, what weights are to the usual ones, and bounds of all words from each on."""
        bound = weights * self.most[codes]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        codes = codes[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
        factor = weights[order] / self.unit[codes]
        return self.start[codes], self.start[codes + 1], None if (factor == 1).all() else factor, rest

    def _parts(self, first, last, factor, k: int, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Record numbers and parts of the score of the postings of some words."""
        if until == k + 1:
            at, value = self.at[first[k] : last[k]], self.value[first[k] : last[k]]
        else:
            ranges = list(zip(first[k:until].tolist(), last[k:until].tolist()))
            at, value = np.concatenate([self.at[a:b] for a, b in ranges]), np.concatenate([self.value[a:b] for a, b in ranges])
        return at, value if factor is None else value * np.repeat(factor[k:until], last[k:until] - first[k:until])

    def _chosen(self, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen records in order the n best, with all that may tie with them."""
        scores = self._scores(chosen)
        chosen, scores = chosen[scores > 0], scores[scores > 0]
        if len(scores) > n:
            near = scores >= np.partition(scores, len(scores) - n)[len(scores) - n] - SLACK
            chosen, scores = chosen[near], scores[near]
            # of equal scores the n smallest ids stand for all
            order = np.lexsort((chosen, -scores))
            chosen, scores = chosen[order], scores[order]
            new = np.append(True, scores[1:] != scores[:-1])
            place = np.arange(len(scores)) - np.maximum.accumulate(np.where(new, np.arange(len(scores)), 0))
            chosen, scores = chosen[place < n], scores[place < n]
        return chosen, scores

    def every(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of all records with one of the words."""
        first, lengths = self.start[codes], self.start[codes + 1] - self.start[codes]
        if not lengths.sum():
            return np.zeros(0, np.int64), np.zeros(0)
        at = _ranges(first[lengths > 0], lengths[lengths > 0])
        sums = np.bincount(self.at[at], np.repeat(weights / self.unit[codes], lengths) * self.value[at], len(self.ids))
        chosen = np.flatnonzero(sums)
        return chosen, sums[chosen]

    def _few(self, words, n: int, base: np.ndarray | None, slack: float) -> np.ndarray | None:
        """Records that may be among the n best, from the postings of words in few records;
        None where these do not settle it.

        ``base`` has what other words add to each record's score, ``slack`` how exact it is.
        """
        first, last, factor, rest = words
        behind = np.append(0, np.cumsum(last - first))
        # words looked at: all, or those up to half the records
        end = len(first) if base is not None else int(np.searchsorted(behind, len(self.ids) // 2, "right")) - 1
        seen, k, m, floor, sums = np.zeros(0, np.int64), 0, n + 2, 0.0, self.sums
        found = None
        if base is not None:
            tops = _tops(base)
            top = float(tops.max())
            floor = self._reached(_above(base, tops, _nth(tops, m))[: 4 * m], n)
        while k < end or (base is not None and k == end):
            if k < end:
                until = min(end, max(k + 1, int(np.searchsorted(behind, max(len(self.ids) // 32, 8 * behind[k]), "right")) - 1))
                at, value = self._parts(first, last, factor, k, until)
                at = at.astype(np.intp)
                np.add.at(sums, at, value.astype(np.float64))
                # each record once
                seen = np.concatenate((seen, at)) if k else at
                here = np.arange(len(seen), dtype=np.int32)
                self.last[seen] = here
                seen = seen[self.last[seen] == here]
                k = until
            parts = sums[seen] if base is None else sums[seen] + base[seen]
            best = seen[np.argpartition(parts, len(parts) - m)[len(parts) - m :]] if len(parts) > m else seen
            floor = max(floor, self._reached(best, n))
            if k == len(first) or rest[k] < floor - slack:
                near = seen[parts >= floor - rest[k] - slack]
                others = np.zeros(0, np.int64)
                if base is not None and top >= floor - rest[k] - slack:
                    others = _above(base, tops, floor - rest[k] - slack)
                # go on while the next word's postings cost less than scoring these
                if k == end or (len(near) + len(others)) * self.usual * GATHER_COST < last[k] - first[k]:
                    found = np.unique(np.append(near, others)) if len(others) else np.sort(near)
                    break
            if k == end or (base is None and rest[end] > 2 * floor):
                break
        sums[seen] = 0.0
        return found

    def _many(self, words, n: int, base: np.ndarray | None, slack: float) -> np.ndarray:
        """The same from the sums of all records, for words in many."""
        first, last, factor, rest = words
        behind, sums = np.append(0, np.cumsum(last - first)), self.sums
        if base is not None:
            sums[:] = base
        k, m, floor, step = 0, n + 2, 0.0, 0
        while True:
            # the n-th best of the greatest of each 64 is reached for sure
            tops = _tops(sums)
            floor = max(floor, _nth(tops, n) - slack)
            if step == 1 or (k == len(first) and len(tops) <= n):
                floor = max(floor, self._reached(_above(sums, tops, _nth(tops, m))[: 2 * m], n))
            step += 1
            near = np.count_nonzero(sums >= floor - rest[k] - slack)
            # stop once scoring these in full is less work than the words left
            if k == len(first) or near * self.usual * GATHER_COST < behind[-1] - behind[k]:
                break
            # words in steps of about as many postings as there are records
            until = max(k + 1, int(np.searchsorted(behind, behind[k] + len(sums), "right")) - 1)
            at, value = self._parts(first, last, factor, k, until)
            sums += np.bincount(at, value, len(sums))
            k = until
        found = np.flatnonzero((sums > 0) & (sums >= floor - rest[k] - slack))
        sums.fill(0.0)
        return found

    def _settle(self, codes, weights, n: int, base: np.ndarray | None, slack: float, rest: np.ndarray, first: bool):
        """The best records of one request, None where words in few records do not settle it and ``first``.

        ``rest`` tells which words are not in ``base``.
        """
        words = self._by_bound(codes[rest], weights[rest])
        slack += 2 * self.off * float(words[-1][0])
        self.weight[codes] = weights
        if base is None and not len(words[0]):
            found = np.zeros(0, np.int64)
        elif first:
            found = self._few(words, n, None, slack)
        elif base is not None and (words[1] - words[0]).sum() < len(self.ids) / 2:
            found = self._few(words, n, base, slack)
        else:
            found = self._many(words, n, base, slack)
        out = None if found is None else self._chosen(found, n)
        self.weight[codes] = 0.0
        return out

    def best(self, codes: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of records, the n best ones among them."""
        return self.best_of([(codes, weights)], n)[0]

    def best_of(self, requests: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for each of many requests."""
        out, put_off = [], []
        for k, (codes, weights) in enumerate(requests):
            found = None
            if self.tried < TRIED or self.settled * 4 > self.tried:
                found = self._settle(codes, weights, n, None, SLACK, np.ones(len(codes), bool), True)
                self.tried, self.settled = self.tried + 1, self.settled + (found is not None)
            out.append(found)
            if found is None:
                put_off.append(k)
        frequent, matrix = self._matrix([requests[k][0] for k in put_off])
        place = np.full(len(self.unit), -1)
        place[frequent] = np.arange(len(frequent))
        rows = max(1, min(PRODUCT_ROWS, PRODUCT_SIZE // max(1, len(self.ids))))
        for some in (put_off[a : a + rows] for a in range(0, len(put_off), rows)):
            base = None
            if len(frequent):
                wanted = np.zeros((len(some), len(frequent)), np.float32)
                for row, k in enumerate(some):
                    codes, weights = requests[k]
                    at = place[codes]
                    wanted[row, at[at >= 0]] = weights[at >= 0]
                base = wanted @ matrix
            for row, k in enumerate(some):
                codes, weights = requests[k]
                rest = place[codes] < 0
                # single precision: each product and sum is off by a part of 2^-24 at most
                off = (len(frequent) + 4) * 2.0**-24 * float((weights * self.most[codes])[~rest].sum())
                out[k] = self._settle(codes, weights, n, None if base is None else base[row], SLACK + 2 * off, rest, False)
        return out

    def _matrix(self, asked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Words in many records and many of these requests, and their shares in each record."""
        none = np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
        if len(asked) < LEAST_PUT_OFF:
            return none
        work = np.bincount(np.concatenate(asked), minlength=len(self.unit)) * np.diff(self.start)
        frequent = np.flatnonzero(work > PRODUCT_COST * len(asked) * len(self.ids))
        frequent = frequent[np.argsort(-work[frequent], kind="stable")][: PRODUCT_SIZE // max(1, len(self.ids))]
        matrix = np.zeros((len(frequent), len(self.sums)), np.float32)
        for row, c in enumerate(frequent):
            a, b = self.start[c], self.start[c + 1]
            np.add.at(matrix[row], self.at[a:b], (self.value[a:b] / self.unit[c]).astype(np.float32))
        return frequent, matrix


def _score_cell(asked: pa.Scalar, held: pa.Scalar, n: int | None) -> pa.Table:
    """``req_id, id, score`` of a packed group of requests and one of records."""
    asked, held = _opened(asked), _opened(held)
    lengths, flat = _lists(asked["tokens"])
    place, words = _coded(flat)
    weights = _lists(asked["weights"])[1]
    weights = weights.cast(weights.type.value_type) if pa.types.is_dictionary(weights.type) else weights
    weights = weights.to_numpy(zero_copy_only=False)
    usual = np.zeros(len(words))
    usual[place] = weights
    # frequent words first, whose weights are looked up most
    order = np.argsort(usual, kind="stable")
    code = np.empty(len(words), np.int32)
    code[order] = np.arange(len(words))
    codes, usual = code[place], usual[order]
    times = int((held.schema.metadata or {}).get(b"times", b"1"))
    # where all scores are asked for, they are added up from the shares themselves
    records = Records(held, words.take(pa.array(order)), None if n is None else usual, times)
    del held
    ends = np.cumsum(lengths)
    requests = [(codes[a:b], weights[a:b]) for a, b in zip(ends - lengths, ends)]
    found = [records.every(*x) for x in requests] if n is None else records.best_of(requests, n)
    rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    numbers = np.concatenate([x[0] for x in found]).astype(np.int64)
    columns = {
        "req_id": asked["req_id"].combine_chunks().take(pa.array(rows)), "id": records.ids.take(pa.array(numbers)),
        "score": pa.array(np.concatenate([x[1] for x in found]), pa.float64()),
    }
    return pa.table(columns)


def _listed(flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), flat)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """The values as numbers of one list of distinct values."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):  # more than one array can hold
        return pa.concat_arrays(whole.dictionary_encode().unify_dictionaries().chunks)
    return whole.dictionary_encode()


def _request_group(terms: pa.Table) -> pa.Table:
    """Requests with lists of their words and weights, from one row for each."""
    ids = pc.unique(terms["req_id"])
    row = pc.index_in(terms["req_id"], ids).to_numpy().astype(np.int32)
    order = pa.array(_by_code(row))
    lengths = np.bincount(row, minlength=len(ids))
    return pa.table({
        "req_id": ids, "tokens": _listed(_one(terms["token"]).take(order), lengths), "weights": _listed(_one(terms["weight"]).take(order), lengths),
    })


def _record_group(rows: pa.Table) -> pa.Table:
    """Records with numbered words."""
    lengths, _ = _lists(rows["tokens"])
    words = _one(pa.chunked_array([_lists(pa.chunked_array([c]))[1] for c in rows["tokens"].chunks]))
    tfs = _lists(rows["tfs"])[1]
    times = rows.select(["id", "field"]).append_column("one", pa.array(np.ones(len(rows), np.int64))).group_by(["id", "field"]).aggregate([("one", "sum")])
    table = pa.table({"id": rows["id"], "norm": rows["norm"], "tokens": _listed(words, lengths), "tfs": _listed(tfs, lengths)})
    return table.replace_schema_metadata({"times": str(pc.max(times["one_sum"]).as_py())})


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", unify_dictionaries=True)) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _opened(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _numbers(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many partitions a number that is dealt to it, as far as there is one among the first."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    rows = spark.range(32 * parts).groupBy(place.alias("part")).agg(F.min("id").alias("k")).collect()
    found = {x.part: x.k for x in rows}
    return [found.get(part, part) for part in range(parts)]


def _grouped(rows: DataFrame, parts: int, key: str, make, name: str) -> DataFrame:
    """The rows dealt into groups by ``key``, each packed into one row and in a partition of its own."""
    numbers = _numbers(rows.sparkSession, parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            number = numbers[TaskContext.get().partitionId() % len(numbers)]
            data = _packed(make(pa.Table.from_batches(some)))
            yield pa.record_batch({"k": pa.array([number], pa.int32()), name: pa.array([data], pa.binary())})

    # shuffled once more, so that a group is packed once and not for each of its cells
    return rows.repartition(parts, key).mapInArrow(pack, f"k int, {name} binary").repartition(parts, "k").select(name)


def cell_scores(terms: DataFrame, packed: DataFrame, norm: Column, fields: list[str], n: int | None) -> DataFrame:
    """``req_id, id, score`` of records that contain the n best of every request, or of all that share a word.

    ``terms`` (written) has req_id, field, token and weight; ``packed`` one row for each
    record and field with id, tokens, tfs, and what ``norm`` is made of.
    """
    spark = terms.sparkSession
    marks = dict(zip(fields, map(str, range(len(fields)))))  # one letter before a token tells its field
    mark = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])[F.col("field")]
    held = packed.where(F.col("field").isin(*fields))
    n_asked, requests = terms.agg(F.count(F.lit(1)), F.approx_count_distinct("req_id")).first()
    n_held, n_records = held.agg(F.sum(F.size("tokens")), F.count(F.lit(1))).first()
    n_held = n_held or 0
    q, r = groups(n_asked, n_held, spark.sparkContext.defaultParallelism, requests)
    if n is None:
        q, r = smaller(q, r, n_asked, n_held, requests, n_records)
    left = terms.select("req_id", F.concat(mark, "token").alias("token"), "weight")
    marked = F.transform("tokens", lambda t: F.concat(mark, t))
    right = held.select("id", "field", norm.alias("norm"), marked.alias("tokens"), "tfs")
    schema = T.StructType([
        T.StructField("req_id", left.schema["req_id"].dataType), T.StructField("id", right.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column("asked"), batch.column("held")):
                yield from _score_cell(asked, held, n).to_batches(max_chunksize=100_000)

    # each partition of the one side is read for each of the other; nothing is copied for a cell
    asked = _grouped(left, q, "req_id", _request_group, "asked")
    groups_held = _grouped(right, r, "id", _record_group, "held")
    return asked.crossJoin(groups_held.hint("shuffle_replicate_nl")).mapInArrow(score, schema)
