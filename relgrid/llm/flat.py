"""Whole-batch text kernels: many documents as one byte buffer, handled with numpy.

Texts stay UTF-8 bytes. Words are maximal runs of "word" bytes, so classes of ASCII characters can be
tested byte by byte, and every byte of a multi-byte character counts as what that character is.
Hashes are 64-bit polynomial sums over random byte codes, finished by a mixer; two texts with equal
hashes are treated as equal (chance about 2**-64 a pair), and wherever a contract depends on equality
over a whole corpus two independent hashes are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: digits, lower-case letters and everything beyond ASCII
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[48:58] = ALNUM_LOWER[97:123] = ALNUM_LOWER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Poly:
    """Prefix sums of code[byte] * base**i modulo 2**64, from which any span's hash follows in O(1)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = int(rng.integers(1, 2**62)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), CHUNK_BYTES + 1)
            for name, by in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, by, U)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up, self.down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: bytes, or 64-bit hashes of larger units."""
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        v = self.codes[values] if values.dtype == np.uint8 else values
        np.cumsum(v * up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(prefix))
        h = (prefix[stop] - prefix[start]) * down[start]
        return mix(h + (stop - start).astype(U) * U(0x9E3779B97F4A7C15))


BYTES, BYTES2, UNITS = Poly(11), Poly(12), Poly(13)


def as_binary(col: pa.Array) -> pa.Array:
    """Binary array without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    return pc.fill_null(col, b"") if col.null_count else col


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents of about limit bytes."""
    col = as_binary(col)
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n + 1 entries)."""
    b = is_word[buf]
    if not len(b):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    before = np.empty_like(b)
    before[0] = False
    before[1:] = b[:-1]
    firsts = off[:-1]
    before[firsts[firsts < len(b)]] = False
    starts = np.flatnonzero(b & ~before)
    after = np.empty_like(b)
    after[-1] = False
    after[:-1] = b[1:]
    lasts = off[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(b & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """Document number of each item, from the bounds of items by document."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each document (empty documents: 0)."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def gram_hashes(word_hash: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words that stays in one document; the index of its first word."""
    n = len(word_hash)
    at = np.arange(n)
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = at[at + k <= last]
    return UNITS.spans(UNITS.prefix(word_hash), at, at + k), at


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over items: value occurs twice or more in its document; equal to an earlier item of it."""
    key = mix(h + doc.astype(U) * U(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    again[order[1:][same]] = True
    return twice, again


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mask over n items of those inside any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.subtract.at(d, stop, 1)
    return np.cumsum(d[:-1]) > 0
