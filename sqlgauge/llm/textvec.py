"""Vectorised text helpers: Arrow strings as byte arrays, words, 64-bit span hashes.

All work is done per block of rows whose texts sum to a bounded number of
bytes, so a task's memory follows the block (or its single longest text),
never the partition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_U = np.uint64
_rng = np.random.RandomState(20240607)
_TABLE = (_rng.randint(0, 2**32, 256).astype(_U) << _U(32)) | _rng.randint(0, 2**32, 256).astype(_U)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base ("up") or its inverse ("down"), grown as needed."""
    have = _powers[kind]
    if len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _U(_BASE if kind == "up" else _BASE_INV)
        have = np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(size - 1, base, dtype=_U))])
        _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def place_keys(n: int) -> np.ndarray:
    """Fixed odd 64-bit factors, one per place of an n-gram."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts sum to at most ``limit`` bytes (a longer text alone)."""
    pa.default_memory_pool().release_unused()  # what earlier batches of the worker have left
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums mod 2^64, from which any span's hash follows."""
    pre = np.zeros(len(data) + 1, dtype=_U)
    if len(data):
        np.cumsum(_TABLE[data] * power("up", len(data)), out=pre[1:])
    return pre


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand.

    Other bytes may share a hash (some long texts do for every base): compare them."""
    h = (pre[end] - pre[start]) * power("down", len(pre))[start]
    return mix(h + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


#: Every ASCII byte but letters and digits; other bytes belong to words.
ASCII_GAPS = np.zeros(256, dtype=bool)
ASCII_GAPS[:128] = True
ASCII_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


#: Scripts written without blanks between words; each of their characters is a word.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
             (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF),
             (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
             (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Of each code point: 0 separates, 1 belongs to a word, 2 is a word. Letters, digits, marks
    and characters that Unicode leaves open belong to words."""
    global _kinds
    if _kinds is None:
        said = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" or unicodedata.category(chr(c)) in ("Cn", "Co")
                            for c in range(0x110000)), dtype=bool, count=0x110000)
        kinds = said.astype(np.uint8)
        for lo, hi in _UNSPACED:
            kinds[lo:hi + 1] *= 2
        _kinds = kinds
    return _kinds


def unicode_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` by Unicode class: runs of letters, marks and digits, and single characters
    of scripts without blanks."""
    if not (data >= 0x80).any():
        return words(data, off, ASCII_GAPS)
    cp, at = code_points(data)
    kind = _kind_table()[cp]
    starts = np.zeros(len(cp) + 1, dtype=bool)  # of rows, in code points
    starts[np.searchsorted(at, off)] = True
    # A word goes on between two characters of kind 1 in a row's text.
    apart = np.ones(len(cp) + 1, dtype=bool)
    apart[1:-1] = starts[1:-1] | (kind[1:] != 1) | (kind[:-1] != 1)
    start, end = at[:-1][(kind > 0) & apart[:-1]], at[1:][(kind > 0) & apart[1:]]
    return start, end, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray,
          gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans between ``gaps`` (default: ``[^\\x20\\x09-\\x0D]+``) inside each row:
    (start, end, words before each row)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~gaps[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = solid & cut[:n]
    first[1:] |= solid[1:] & ~solid[:-1]
    last = solid & cut[1:]
    last[:-1] |= solid[:-1] & ~solid[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte offset of each and of the end) of UTF-8 bytes."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    size = (1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)
    at = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    return cp, at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each (s, n)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class SpanBank:
    """Values (arrays of int32) of distinct byte spans, kept between batches of a worker.

    ``lookup`` takes spans of one block and returns, for each, where its values
    lie in ``self.values``. Unknown spans are computed once by ``compute``
    (list of bytes -> list of sequences, or ``by_arrays``: bytes, starts, ends -> all
    values, sizes). Spans are found by hash and compared byte by byte with
    the span that the bank holds under it; those that only share its hash are kept
    apart by their bytes. When the bank holds more than ``limit`` spans it starts
    anew: it is a cache, never a filter.
    """

    def __init__(self, compute, limit: int = 1_000_000, by_arrays: bool = False):
        self.compute, self.limit, self.by_arrays = compute, limit, by_arrays
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=_U)          # sorted hashes,
        self.slot = np.zeros(0, dtype=np.int64)    # and where each one's span is in what follows
        self.near_bits = (2 * self.limit).bit_length()
        self.near = np.zeros(1 << self.near_bits, dtype=np.int32)  # the span last met under a hash's first bits
        self._key = Growing(_U)
        self._start, self._size = Growing(np.int64), Growing(np.int64)
        self._byte_start, self._byte_size = Growing(np.int64), Growing(np.int64)
        self._store = Growing(np.int32)
        self._bytes = Growing(np.uint8)
        self._clashes: dict[bytes, tuple[int, int]] = {}

    @property
    def values(self) -> np.ndarray:
        return self._store.values

    def _append(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Computes spans; where the values of each are, and how many."""
        if self.by_arrays:
            flat, size = self.compute(data, start, end)
        else:
            raw = data.tobytes()
            rows = self.compute([raw[s:e] for s, e in zip(start.tolist(), end.tolist())])
            size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(size.sum()))
        return self._store.add(flat) + np.cumsum(size) - size, size

    def _differing(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions of the spans whose bytes are not those kept at ``at``."""
        size, held = end - start, self._byte_start.values[at]
        wrong = size != self._byte_size.values[at]
        here, there = _words_of(data), self._bytes.words
        rows = np.flatnonzero(~wrong)
        for k in range(0, WORDWISE, 8):  # eight bytes of every span that is so long
            rows = rows[size[rows] > k]
            if len(rows) == 0:
                return np.flatnonzero(wrong)
            other = (here[start[rows] + k] ^ there[held[rows] + k]) & _KEEP[np.minimum(size[rows] - k, 8)]
            wrong[rows[other != 0]] = True
        for r in rows[size[rows] > WORDWISE].tolist():  # few spans are longer
            n = int(size[r])
            wrong[r] |= not np.array_equal(data[start[r]:start[r] + n], self._bytes.values[held[r]:held[r] + n])
        return np.flatnonzero(wrong)

    def _slots(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which span of the bank has each hash; unknown ones are computed."""
        near = (hashes >> _U(64 - self.near_bits)).astype(np.int64)
        slots, rest = self.near[near].astype(np.int64), np.arange(len(hashes))
        if len(self.keys):
            rest = np.flatnonzero(self._key.values[slots] != hashes)
            if len(rest) == 0:
                return slots
        keys, first, inverse = np.unique(hashes[rest], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(self.keys) and len(self.keys) + len(self._clashes) + len(new) > self.limit:
            self._clear()
            return self._slots(data, hashes, start, end)
        found = np.empty(len(keys), dtype=np.int64)
        found[known] = self.slot[at[known]]
        if len(new):
            from_, to = start[rest[first[new]]], end[rest[first[new]]]
            s, n = self._append(data, from_, to)
            size = to - from_
            b = self._bytes.add(data[ranges(from_, size)]) + np.cumsum(size) - size
            self._size.add(n)
            self._byte_start.add(b)
            self._byte_size.add(size)
            self._key.add(keys[new])
            found[new] = self._start.add(s) + np.arange(len(new))
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.slot = np.insert(self.slot, at[new], found[new])
        slots[rest] = found[inverse]
        self.near[near[rest]] = slots[rest]
        return slots

    def lookup(self, data: np.ndarray, pre: np.ndarray, start: np.ndarray,
               end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(start) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self._slots(data, span_hash(pre, start, end), start, end)
        out_start, out_size = self._start.values[at], self._size.values[at]
        wrong = self._differing(data, start, end, at)
        if len(wrong):
            spans = [data[start[k]:end[k]].tobytes() for k in wrong]
            new_spans = list(dict.fromkeys(x for x in spans if x not in self._clashes))
            cut = np.cumsum([0, *map(len, new_spans)])
            joined = np.frombuffer(b"".join(new_spans), dtype=np.uint8)
            if new_spans:
                for span, s, n in zip(new_spans, *(x.tolist() for x in self._append(joined, cut[:-1], cut[1:]))):
                    self._clashes[span] = s, n
            out_start[wrong], out_size[wrong] = np.array([self._clashes[x] for x in spans]).T
        return out_start, out_size


#: Spans are compared eight bytes at a time up to this many.
WORDWISE = 64
#: Of a little-endian word, its first 0..8 bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)


def _words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian words (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


class Growing:
    """An array that is appended to."""

    def __init__(self, kind):
        self._data, self._used = np.zeros(1 << 16, dtype=kind), 0

    @property
    def values(self) -> np.ndarray:
        return self._data[:self._used]

    @property
    def words(self) -> np.ndarray:
        """Of bytes: the little-endian word from each position on."""
        return np.ndarray((self._used + 1,), dtype="<u8", buffer=self._data, strides=(1,))

    def add(self, more: np.ndarray) -> int:
        """Where ``more`` now starts."""
        start, need = self._used, self._used + len(more)
        if need + 8 > len(self._data):
            grown = np.zeros(max(need + 8, len(self._data) * 3 // 2), dtype=self._data.dtype)
            grown[:start] = self.values
            self._data = grown
        self._data[start:need] = more
        self._used = need
        return start


def _digests(spans: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(blake2b(s, digest_size=8).digest(), dtype="<i4") for s in spans]


_hashed = SpanBank(_digests, limit=400_000)


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit BLAKE2 hashes of byte spans (A-Z lower-cased if ``lower``); each distinct span is
    hashed once. Unlike ``span_hash``, no two families of texts collide by their build."""
    if lower:
        data = _LOWER[data]
    at, _ = _hashed.lookup(data, prefix_hash(data), start, end)
    pairs = _hashed.values[np.stack([at, at + 1], axis=1)]
    return np.ascontiguousarray(pairs).view(_U)[:, 0]
