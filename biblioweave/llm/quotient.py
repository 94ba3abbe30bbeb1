"""Counting quotient filters of packed word-id n-grams, without loss.

An n-gram is packed into one number of ``width`` bits and sent through a permutation
of these numbers, which can be undone.  The upper bits of the permuted number are
its quotient, all others its remainder, so nothing is forgotten and counts are
exact.  A filter keeps, in order of the permuted numbers: one bit for each quotient
(is it occupied?), one bit for each entry (does its run end here?), the remainders
in whole bytes and the counters.  Filters of several shards of a corpus are merged
as sorted runs.

Word ids have ``bits`` bits.  Words at the head of an n-gram that do not fit into
64 bits with the others are kept as further bytes of the remainder.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QBBB"
# Odd factors of the permutation.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ONE_BYTE = 255


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def permute(x: np.ndarray, width: int) -> np.ndarray:
    """A permutation of the numbers of ``width`` bits that spreads them evenly."""
    shift, mask = np.uint64(max(1, width // 2)), _mask(width)
    for factor in _FACTORS:
        x = ((x ^ (x >> shift)) * np.uint64(factor)) & mask
    return x ^ (x >> shift)


def restore(x: np.ndarray, width: int) -> np.ndarray:
    """The number that ``permute`` made ``x`` of."""
    shift, mask = max(1, width // 2), _mask(width)

    def unfold(y):
        out, done = y, shift
        while done < width:
            out, done = y ^ (out >> np.uint64(shift)), done + shift
        return out

    x = unfold(x)
    for factor in reversed(_FACTORS):
        x = unfold((x * np.uint64(pow(factor, -1, 1 << 64))) & mask)
    return x


def layout(n: int, bits: int) -> tuple[int, int]:
    """How many words at the end of an n-gram fit into 64 bits, and the width of these."""
    low = min(n, 64 // bits)
    if (n - low) * bits > 64:
        raise ValueError(f"n-grams of {n} words with ids of {bits} bits do not fit into two numbers of 64 bits")
    return low, low * bits


def pack_ids(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper number of n-grams given by one array for each of their words."""
    low, _ = layout(len(words), bits)
    cut = len(words) - low
    parts = []
    for chosen in (words[cut:], words[:cut]):
        x = np.zeros(len(words[0]), np.uint64)
        for word in chosen:
            x = (x << np.uint64(bits)) | word.astype(np.uint64)
        parts.append(x)
    return parts[0], parts[1]


def unpack_ids(lower: np.ndarray, upper: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Word ids of packed n-grams, one row for each n-gram."""
    low, _ = layout(n, bits)
    out = np.zeros((len(lower), n), np.int64)
    for at in range(n):
        x, back = (lower, n - 1 - at) if at >= n - low else (upper, n - low - 1 - at)
        out[:, at] = (x >> np.uint64(bits * back)) & _mask(bits)
    return out


def counted(lower: np.ndarray, upper: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order with their counts summed; sorted runs are merged as such."""
    if upper.any():
        order = np.lexsort((upper, lower))
        lower, upper = lower[order], upper[order]
    elif counts is None:
        lower, order = np.sort(lower, kind="stable"), None
    else:
        order = np.argsort(lower, kind="stable")
        lower = lower[order]
    first = np.ones(len(lower), bool)
    first[1:] = (lower[1:] != lower[:-1]) | (upper[1:] != upper[:-1])
    starts = np.flatnonzero(first)
    if counts is None:
        sums = np.diff(np.append(starts, len(lower)))
    else:
        sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
    return lower[starts], upper[starts], sums.astype(np.int64)


def _bytes_of(x: np.ndarray, size: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _numbers(data: np.ndarray, size: int, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = data[: n * size].reshape(n, size)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def encode(lower: np.ndarray, upper: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A filter of distinct entries in order, whose lower numbers have ``width`` bits."""
    n = len(lower)
    # about one quotient for each entry, as far as remainders of whole bytes allow
    size = max(0, -(-(width - (n.bit_length() - 1) - 1) // 8))
    quotient = lower >> np.uint64(8 * size) if 8 * size < min(width, 64) else np.zeros(n, np.uint64)
    occupied = np.zeros(1 << max(0, width - 8 * size), bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    more = (int(upper.max()).bit_length() + 7) // 8 if n else 0
    large = counts >= _ONE_BYTE
    return b"".join(
        [
            struct.pack(_HEAD, n, width, size, more),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            _bytes_of(lower, size),
            _bytes_of(upper, more),
            np.minimum(counts, _ONE_BYTE).astype(np.uint8).tobytes(),
            counts[large].astype("<i8").tobytes(),
        ]
    )


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a filter in order: lower and upper numbers, and counts."""
    n, width, size, more = struct.unpack_from(_HEAD, data)
    rest = np.frombuffer(data, np.uint8, offset=struct.calcsize(_HEAD))
    slots = 1 << max(0, width - 8 * size)

    def take(length):
        nonlocal rest
        head, rest = rest[:length], rest[length:]
        return head

    occupied = np.flatnonzero(np.unpackbits(take((slots + 7) // 8), count=slots))
    ends = np.unpackbits(take((n + 7) // 8), count=n)
    run = np.cumsum(ends) - ends
    lower = _numbers(take(n * size), size, n)
    if 8 * size < 64:
        lower = lower | (occupied[run].astype(np.uint64) << np.uint64(8 * size))
    upper = _numbers(take(n * more), more, n)
    counts = take(n).astype(np.int64)
    counts[counts == _ONE_BYTE] = np.frombuffer(rest.tobytes(), "<i8")
    return lower, upper, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of several filters in order, counts of equal ones added."""
    parts = [decode(f) for f in filters]
    return counted(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
