"""Suffix arrays by induced sorting, many slots at a time with numpy, and permuted common prefixes.

Suffixes are of type S (smaller than the next suffix) or L. Leftmost S suffixes (LMS) are sorted first: their
substrings by inducing from unsorted places, then, if equal substrings repeat, the string of the substrings'
names by the same algorithm, recursively. Two linear passes induce all L and all S suffixes from them.

A pass goes over the slots of the array in order. What a suffix induces always lands further on, so a run of
slots can be taken at once up to the first slot that the run itself would fill; runs are long unless the text
repeats one character, or one name, many times over.
"""

from __future__ import annotations

import numpy as np

from . import flat

U = np.uint64
RUN = 1 << 12


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last character must be the least and unique."""
    step = np.ones(len(t), np.int8)
    step[:-1] = np.sign(np.diff(t))
    at = np.flatnonzero(step)
    return np.repeat(step[at] > 0, np.diff(at, prepend=-1))


def _fill(sa: np.ndarray, edge: np.ndarray, buckets: np.ndarray, places: np.ndarray, forward: bool) -> np.ndarray:
    """Put places, in their order, into the next slots of their buckets (going back: the slots before); the slots."""
    order = buckets.argsort(kind="stable")
    b = buckets[order]
    new = np.empty(len(b), bool)
    new[:1] = True
    np.not_equal(b[1:], b[:-1], out=new[1:])
    first = new.nonzero()[0]
    slots = edge[b]
    if len(first) < len(b):
        rank = np.arange(len(b)) - first[new.cumsum() - 1]
        slots += rank if forward else -rank
    if forward:
        edge[b] = slots + 1  # of several values for one bucket the last holds
    else:
        slots -= 1
        edge[b] = slots
    sa[slots] = places[order]
    return slots


class Inducer:
    def __init__(self, t: np.ndarray, size: int):
        self.t, self.n = t, len(t)
        self.s = types(t)
        counts = np.bincount(t, minlength=size)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.is_lms = np.zeros(self.n, bool)
        self.is_lms[1:] = self.s[1:] & ~self.s[:-1]
        self.lms = np.flatnonzero(self.is_lms).astype(np.int32)

    def run(self, seeds: np.ndarray) -> np.ndarray:
        """The array induced from LMS places in the given order."""
        sa = np.full(self.n, -1, np.int32)
        slots = _fill(sa, self.end.copy(), self.t[seeds[::-1]], seeds[::-1], False)
        sa[0] = self.n - 1
        self._pass(sa, self.start.copy(), forward=True)
        sa[slots] = -1
        sa[0] = self.n - 1
        self._pass(sa, self.end.copy(), forward=False)
        sa[0] = self.n - 1
        return sa

    def _pass(self, sa: np.ndarray, edge: np.ndarray, *, forward: bool) -> None:
        """Induce L suffixes from left to right, or S suffixes from right to left; edge: the next slot of each bucket
        (going back: the slot after it)."""
        t, s, n = self.t, self.s, self.n
        at, width = 0, RUN
        while at < n:
            stop = min(at + width, n)
            run = sa[at:stop] if forward else sa[n - stop : n - at][::-1]
            place = (run > 0).nonzero()[0]
            j = run[place] - 1
            mine = (s[j] != forward).nonzero()[0]
            if len(mine):
                j, place = j[mine], place[mine]
                c = t[j]
                reach = int(edge[c].min()) if forward else n - int(edge[c].max())
                if reach < stop:
                    stop = reach
                    k = place.searchsorted(stop - at)
                    j, c = j[:k], c[:k]
                if len(j):
                    _fill(sa, edge, c, j, forward)
            width = min(max(2 * (stop - at), 64), 1 << 16)
            at = stop


def names_of(x: Inducer, sa: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, in text order, equal ones alike and in their order; how many there are."""
    order = sa[x.is_lms[sa]]
    stop = np.empty(x.n, np.int32)
    stop[x.lms] = np.append(x.lms[1:] + 1, x.n)
    h = flat.UNITS.spans(flat.UNITS.prefix(flat.mix(x.t.astype(U) + U(1))), order, stop[order])
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    name = np.empty(x.n, np.int32)
    name[order] = np.cumsum(new) - 1
    return name[x.lms], int(new.sum())


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Places of the suffixes of t in their order; t ends in its least, unique character, all are below size."""
    x = Inducer(t, size)
    if len(x.lms) < 2:
        return x.run(x.lms)
    names, kinds = names_of(x, x.run(x.lms))
    order = np.argsort(names) if kinds == len(names) else suffix_array(names, kinds)
    return x.run(x.lms[order])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the suffix before it in the array (-1: none), and how many characters they have in common.

    If the characters in front of both are equal too, the common prefix is that of the place before, less one;
    only the others (irreducible ones) are compared, four characters at a time, and their sum is small.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint16), np.zeros(3, np.uint16)]).astype(U)
    four = padded[:-3] | padded[1:-2] << U(16) | padded[2:-1] << U(32) | padded[3:] << U(48)
    alone = np.ones(n, bool)
    i = np.flatnonzero(before > 0)
    i = i[i > 0]
    alone[i] = t[i - 1] != t[before[i] - 1]
    heads = np.flatnonzero(alone)
    common = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(before[heads] >= 0)
    a, b = heads[live], before[heads[live]].astype(np.int64)
    while len(live):
        differ = four[a] ^ four[b]
        rest = np.flatnonzero(differ == 0)
        done = np.flatnonzero(differ)
        d = differ[done]
        common[live[done]] += (d & U(0xFFFF) == 0).astype(np.int64) + (d & U(0xFFFFFFFF) == 0) + (d & U(0xFFFFFFFFFFFF) == 0)
        live = live[rest]
        common[live] += 4
        a, b = a[rest] + 4, b[rest] + 4
        # the last character is unique, so nothing runs over the end
    last = np.cumsum(alone) - 1
    return before, common[last] - (np.arange(n) - heads[last])


def repeated_starts(parts: list[bytes], length: int) -> np.ndarray:
    """Marks every byte of the joined parts at which a `length`-byte string starts that also starts elsewhere.

    Parts are joined by separators; a string that is followed by `length` bytes of its part and has as long a
    common prefix with the suffix before it in the array marks both.
    """
    size = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    n = len(raw) + len(parts)
    t = np.ones(n + 1, np.int16)
    at = np.arange(len(raw)) + np.repeat(np.arange(len(parts)), size)
    t[at] = raw.astype(np.int16) + 2
    t[-1] = 0
    before, common = permuted_prefixes(t, suffix_array(t, 258))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # bytes up to the end of the part
    mark = np.zeros(n + 1, bool)
    i = at[left >= length]
    i = i[common[i] >= length]
    mark[i] = mark[before[i]] = True
    return mark[at]
