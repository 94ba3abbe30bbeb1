"""Byte-level BPE as a monoid tree reduction.

An element of the monoid is the encoding of a stretch of text.  A text is halved
until stretches are short, halves are encoded on their own, and neighbours are
joined by re-encoding a window around their border that grows until nothing
outside can change:

* pattern matches (pieces): those of the left stretch that end before its last
  characters do not look beyond it, and once the window's matches meet a match
  border of the right stretch, the rest of it is matched as before, because the
  pattern never looks back;
* tokens of a long piece: a token sequence is the encoding of its bytes exactly
  if each two neighbours are the encoding of theirs, so a window may stop as
  soon as the tokens at its edges agree with those outside.

Decoding maps ids to bytes and concatenates them up the same kind of tree.

Null texts are empty and have no tokens.  Equal texts get equal results.  A text
is held by one task, in memory proportional to its length.  An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from biblioweave.llm.common import carried, steps, texts

LEAF_CHARS = 2048
LEAF_BYTES = 3
LEAF_TOKENS = 4096
# Longest contraction of the pattern: how far a match looks beyond its start.
LOOK_AHEAD = 3
MEMO_ENTRIES = 400_000
MEMO_BYTES = 12
MEMO_CHARS = 48
LONG_BYTES = 200
NO_RANK = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ByteBpe:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._odd = regex.compile(r"\s\s").search
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, tuple[str, bytes]] = {}
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self._stretches: dict[bytes, tuple[int, ...]] = {}

    # tokens of a piece

    def _merge(self, data: bytes) -> list[int]:
        """Encoding of a stretch of bytes: the lowest-ranked neighbours first, leftmost on ties."""
        if len(data) > LONG_BYTES:
            return self._merge_long(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same by a heap, for windows that had to grow far."""
        get, size = self.ranks.get, len(data)
        part = [data[i : i + 1] for i in range(size)]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(size - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i] if part[i] is not None else size
            if j >= size or part[i] != left or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < size and (r := get(part[a] + part[after[a]])) is not None:
                    heappush(heap, (r, a, part[a], part[after[a]]))
        return [self.ranks[p] for p in part if p is not None]

    def _pair(self, left: int, right: int) -> tuple[int, ...]:
        """Encoding of the bytes of two neighbouring tokens."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > MEMO_ENTRIES:
                self._pairs.clear()
            known = self._pairs[left, right] = tuple(self._merge(self.bytes_of[left] + self.bytes_of[right]))
        return known

    def _stand(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their own bytes."""
        return self._pair(left, right) == (left, right)

    def _tokens(self, data: bytes) -> tuple[int, ...]:
        """Encoding of the bytes of one piece by halves; short stretches are remembered."""
        known = self._stretches.get(data)
        if known is not None:
            return known
        if len(data) <= LEAF_BYTES:
            out = tuple(self._merge(data))
        else:
            half = len(data) // 2
            out = self._join_tokens(self._tokens(data[:half]), self._tokens(data[half:]))
        if len(data) <= MEMO_BYTES:
            if len(self._stretches) > MEMO_ENTRIES:
                self._stretches.clear()
            self._stretches[data] = out
        return out

    def _join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Re-encode the tokens around the border until those at the window's edges agree with the rest."""
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            if width == 1:
                window = self._pair(left[-1], right[0])
            else:
                window = tuple(self._merge(b"".join(self.bytes_of[t] for t in left[a:] + right[:b])))
            if (a == 0 or self._stand(left[a - 1], window[0])) and (b == len(right) or self._stand(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        known = self._pieces.get(text)
        if known is None:
            if len(self._pieces) > MEMO_ENTRIES:
                self._pieces.clear()
            data = text.encode()
            token = self.ranks.get(data)
            known = array("I", self._tokens(data) if token is None else (token,)).tobytes()
            if len(text) <= MEMO_CHARS:
                self._pieces[text] = known
        return known

    # pieces of a text: an element is a list of (stretch of whole matches, its ids)

    def _scanned(self, text: str) -> tuple[str, bytes]:
        return text, b"".join(map(self.piece, self.find(text)))

    def _leaf(self, text: str) -> list[tuple[str, bytes]]:
        """A short stretch.  One space between two other characters always starts a new match,
        so the stretch may be cut there and its parts remembered."""
        if self._odd(text) or text[:1].isspace() or text[-1:].isspace():
            return [self._scanned(text)]
        head, *rest = text.split(" ")
        memo, out = self._chunks, [self._scanned(head)]
        for chunk in rest:
            entry = memo.get(chunk)
            if entry is None:
                if len(memo) > MEMO_ENTRIES:
                    memo.clear()
                entry = self._scanned(" " + chunk)
                if len(chunk) <= MEMO_CHARS:
                    memo[chunk] = entry
            out.append(entry)
        return out

    def _join(self, left: list, right: list) -> list:
        """Join two elements by matching a growing window around their border again.

        A match is settled once LOOK_AHEAD characters follow its end.
        """
        tail = ""
        while left and len(tail) < LOOK_AHEAD:
            tail = left.pop()[0] + tail
        width = 1
        while True:
            fed = right[:width]
            borders, at = {}, len(tail)
            for n, (stretch, _) in enumerate(fed):
                borders[at] = n
                at += len(stretch)
            window = tail + "".join(stretch for stretch, _ in fed)
            matches, at = self.find(window), 0
            for n, match in enumerate(matches):
                if at in borders and at + LOOK_AHEAD <= len(window):
                    # matched anew up to a border of the right element; from there it stays
                    left.append((window[:at], b"".join(map(self.piece, matches[:n]))))
                    return left + right[borders[at] :]
                at += len(match)
            if width >= len(right):
                left.append((window, b"".join(map(self.piece, matches))))
                return left
            width *= 2

    def _element(self, text: str) -> list:
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)
        half = len(text) // 2
        return self._join(self._element(text[:half]), self._element(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join([ids for _, ids in self._element(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        if len(ids) <= 4 * LEAF_TOKENS:
            values = array("I", ids)
            return b"".join(map(self.bytes_of.__getitem__, values))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, text="text", keep=None) -> DataFrame:
    """``row`` (the columns in ``keep``, or all), ids (binary, little-endian unsigned 32-bit) and the decoded bytes."""
    with open(rank_file, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(read_ranks(data), pattern)
        for batch in steps(batches):
            ids = [bpe.encode(t) for t in texts(batch.column(1))]
            decoded = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["row", "ids", "decoded"]
            )

    packed = carried(docs, text, keep)
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *fields]))
