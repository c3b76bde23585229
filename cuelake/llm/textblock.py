"""Vectorised word and n-gram hashing over whole Arrow string columns.

A task sees one Arrow batch at a time.  All texts of the batch are treated as
one byte array: words are found with array operations and every word gets a
64-bit hash from prefix sums, so no Python loop runs over words or characters.
Hashes depend only on the bytes, never on the batch, task or machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD1B54A32D192ED03)

#: Bytes of text handled at once; a longer single text is handled alone.
BLOCK_BYTES = 2 << 20

#: ASCII lower-casing and the word separators 0x20 and 0x09-0x0D, as byte tables.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if not pa.types.is_large_binary(column.type) else column.type)
    column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, in a copy: arithmetic on bytes is many times faster than a table."""
    return raw | (raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    raw, off = string_buffers(column)
    first, rows = 0, len(off) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


class Words:
    """Words of one block of texts.

    ``doc`` is the row of each word, ``start``/``end`` its bytes, ``hash`` its
    64-bit hash, ``first`` the index of each row's first word (one more entry
    than rows).  Rows without words have an empty range.  ``strong``: words are
    told apart by ``span_codes``, as equality asks for; features can do with ``span_hash``.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True, keep: np.ndarray | None = None, strong: bool = False):
        rows, n = len(off) - 1, len(raw)
        text = _LOWER[raw] if lower else raw
        inside = ~_SPACE[text] if keep is None else keep[text]
        edge = np.zeros(n + 1, bool)  # a word never spans two texts
        edge[off] = True
        prev = np.zeros(n, bool)
        prev[1:] = inside[:-1]
        prev[edge[:n]] = False
        self.start = np.flatnonzero(inside & ~prev)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        if strong:
            one, two = span_codes(text, self.start, self.end)
            self.hash = mix64(one + two * _Q)
        else:
            self.hash = span_hash(text, self.start, self.end)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        self.text = text

    def grams(self, n: int, short_whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, hash) of each run of ``n`` words of one text.

        With ``short_whole`` a text of fewer words gives its whole sequence.
        """
        count = np.diff(self.first)
        last = self.first[1:] - n
        at = np.arange(len(self.hash))
        at = at[at <= last[self.doc]] if len(at) else at
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = mix64(value * _Q + self.hash[at + k])
        row = self.doc[at]
        if short_whole:
            small = np.flatnonzero((count > 0) & (count < n))
            whole = np.zeros(len(small), np.uint64)
            for k in range(n - 1):
                has = count[small] > k
                step = mix64(whole * _Q + self.hash[np.minimum(self.first[small] + k, len(self.hash) - 1)]) if len(small) else whole
                whole = np.where(has, step, whole)
            row, at, value = np.concatenate([row, small]), np.concatenate([at, self.first[small]]), np.concatenate([value, mix64(whole ^ count[small].astype(np.uint64))])
            order = np.argsort(row, kind="stable")
            row, at, value = row[order], at[order], value[order]
        return row, at, value


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    if len(cache.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p, q = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        p[0] = q[0] = 1
        cache["p"], cache["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return cache["p"], cache["q"]


def prefix(text: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows."""
    p, _ = _powers(len(text) + 1)
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * p[: len(text)], out=out[1:])
    return out


def span_hash(text: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span ``text[start:end]``: good for features, but long spans can be made to collide."""
    sums = prefix(text) if sums is None else sums
    _, q = _powers(len(text) + 1)
    return mix64((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


#: Bytes up to which a span is hashed by array operations, all spans at once; longer ones go one by one.
_LONG = 512
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_codes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each byte span, to be used where spans of equal hashes count as equal.

    Eight bytes a step, each step with shifts and products between them, so no sum of spans
    cancels as in ``span_hash``; spans of one to eight bytes never collide with others of their length.
    """
    size = end - start
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    steps = np.where(size > _LONG, 0, -(-size // 8))
    order = np.argsort((_LONG // 8 - steps).astype(np.uint8), kind="stable")  # most steps first, sorted by counting
    at, left = start[order], size[order]
    one, two = (left.astype(np.uint64) + k for k in (_P, _Q))
    more = len(order) - np.cumsum(np.bincount(steps, minlength=1))
    for m in more[: len(more) - 1]:
        chunk = eight[at[:m]] & _MASK[np.minimum(left[:m], 8)]
        for lane, k in ((one, _P), (two, _Q)):
            x = (lane[:m] ^ chunk) * k
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            lane[:m] = x ^ (x >> np.uint64(29))
        at[:m] += 8
        left[:m] -= 8
    out = np.empty((2, len(order)), np.uint64)
    out[0, order], out[1, order] = mix64(one), mix64(two)
    for i in np.flatnonzero(size > _LONG):
        out[:, i] = np.frombuffer(hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out[0], out[1]


def distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by both, and the start of each row (rows + 1 entries)."""
    order = np.argsort(value)
    if rows <= 1 << 16:  # the second, stable sort is then by counting
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    return row, value, np.searchsorted(row, np.arange(rows + 1))


def sorted_distinct(value: np.ndarray) -> np.ndarray:
    """The distinct values, sorted: by one sort, which is many times faster here than a hash table."""
    value = np.sort(value)
    return value[np.append(True, value[1:] != value[:-1])[: len(value)]]


def first_of_each(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and a place of each."""
    order = np.argsort(value)
    value = value[order]
    fresh = np.append(True, value[1:] != value[:-1])[: len(value)]
    return value[fresh], order[fresh]


#: Values whose products with all multipliers are made while they are in a core's cache.
_CHUNK = 1 << 15


def minhash(value: np.ndarray, starts: np.ndarray, slots: int, seed: int = 1) -> np.ndarray:
    """uint32 minimum of ``slots`` hash functions over each run of ``value``; empty runs give the largest value."""
    out = np.full((len(starts) - 1, slots), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    mult = (mix64(np.arange(1, slots + 1, dtype=np.uint64) * _P + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    high = (value >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < len(full):
        end = max(first + 1, int(np.searchsorted(starts[full], starts[full[first]] + _CHUNK)))
        rows = full[first:end]
        part, at = high[starts[rows[0]] : starts[rows[-1] + 1]], starts[rows] - starts[rows[0]]
        low = np.empty((slots, len(rows)), np.uint32)
        for k in range(slots):
            np.minimum.reduceat(part * mult[k], at, out=low[k])
        out[rows] = low.T
        first = end
    return out
