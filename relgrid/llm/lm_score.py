"""Scoring texts by a log-bilinear language model trained with noise-contrastive estimation (operator 1).

Tokens are words (runs of characters other than ASCII white space, A-Z lower-cased) and one end token a
document; a null text counts as empty and has the end token alone. Words are known by 64-bit hashes.

Corpus counts come first and cover every training document: partial sums by task, then one aggregation by
word. The HEAD most frequent words (of equally frequent ones at the cut, those of the smallest hashes' rests)
have vectors. The OWN most frequent ones are classes of their own; every other word belongs to a shared class
of words that end alike, and an ending has as many classes as it takes to keep them at about GROUP head words,
so classes, vectors and counts all grow with the corpus' distinct words.

The model is log-bilinear twice. The vectors of the classes of the two words before, each through its own
matrix, add up to a predicted vector, whose products with the classes' output vectors (plus biases) are the
logits of the classes. Inside a shared class the own vectors of the words before are added, and products with
the output vectors of the class's head words, and of one entry for the rest of its words, shift the logits
that counts alone give. Both parts are trained by noise-contrastive estimation: 64 classes drawn by frequency
are shared by the tokens of a batch, and 4 words of each class by the batch's tokens of that class. The words of a rest
share its probability by (c + 1) / (N_rest + V_rest + 1), unseen words together being one more. Matrix products
give exact normalisers, of classes over all pairs of context classes, of words over their whole class, so
token probabilities sum to one.

Each task trains a copy on all its training documents; the copies' average, weighted by tokens, starts the
next round. The last round also trains the vectors of words, of which each is averaged by its uses. Copies are averaged in a tree, so no task holds more than FAN
copies of a block. As samples and order differ by task, scores depend slightly on how the table is split.

What is broadcast has bounded sizes: the HEAD words with counts and vectors, and tables over pairs of classes.
Words beyond HEAD meet their counts in a join; none of them is frequent, so no key is hot. Rows are told apart
by place; repeated rows are scored each, a null doc_id counts as the empty text in crc32, extra columns are
ignored, an empty table gives no rows, and without training documents all probabilities are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .runtime import id_crc, mapped, stored, table

U = np.uint64
HEAD, OWN, ENDINGS, GROUP = 1 << 18, 704, 64, 320
DIM, NOISE, BATCH, ROUNDS, RATE = 24, 64, 1024, 2, 0.15
WORD_NOISE, WORD_RATE = 4, 0.15
POOL = 64  # drawn noise words of a class; each batch takes WORD_NOISE of them in a row
BLOCKS, BLOCK_ROWS, FAN, SCORED = 16, 4096, 64, 192
LONG = 64  # bytes of words hashed eight by eight
NEAR_BITS, NEAR_PARTS = 20, 1 << 18  # of the tables that tell about where to look for keys and for drawn words
PAST = 0.1  # start of the sums of squares of words' steps
END = U(1)
ITEMS = np.arange(4 * BATCH, dtype=np.int32)
LOG10 = float(np.log(10))


#: class of endings by the last byte and, times 256, the one before
ENDING = (flat.mix(np.arange(1 << 16, dtype=U) + U(77)) % U(ENDINGS)).astype(np.int32)
MASKS = np.array([2 ** (8 * i) - 1 for i in range(9)], U)  # of the first bytes of eight


FOLDED = np.where(flat.SPACE, 32, flat.LOWER).astype(np.uint8)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time; low has eight bytes more behind the last word."""
    size = ends - starts
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    h = flat.mix((eight[starts] & MASKS.take(size, mode="clip")) + size.astype(U) * U(0x9E3779B97F4A7C15))
    more, done = (size > 8).nonzero()[0], 8
    while len(more) and done < LONG:
        left = size.take(more) - done
        h[more] = flat.mix(h.take(more) * U(0xD1342543DE82EF95) + (eight[starts.take(more) + done] & MASKS.take(left, mode="clip")))
        more = more.take((left > 8).nonzero()[0])
        done += 8
    if len(more):
        h[more] = flat.BYTES.spans(flat.BYTES.prefix(low), starts.take(more), ends.take(more))
    return h


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending classes of all tokens, and their bounds by document."""
    n = len(off) - 1
    # one space before each document and nine behind the last, so words begin and end where white space does
    low = np.full(len(buf) + n + 9, 32, np.uint8)
    text = np.insert(buf, off[:-1], 32)
    FOLDED.take(text, out=low[: len(text)], mode="clip")
    word = low != 32
    edges = (word[1:] != word[:-1]).nonzero()[0] + 1
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.append(off[:-1] + np.arange(n), len(low)))
    doc = flat.doc_of(bounds)
    key, ending = np.full(len(starts) + n, END, U), np.zeros(len(starts) + n, np.int32)
    at = np.arange(len(starts)) + doc
    key[at] = word_hashes(low, starts, ends)
    last = ends - 1
    ending[at] = ENDING.take(low.take(last).astype(np.int64) | low.take(np.maximum(last - 1, starts)).astype(np.int64) << 8)
    return key, ending, bounds + np.arange(n + 1)


def training_document():
    return id_crc() % 7 != 2


def starts(s: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return new.nonzero()[0]


def sorted_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where in it runs of equal ones begin."""
    order = np.argsort(key)
    return order, starts(key.take(order))


def count_words(docs: DataFrame) -> DataFrame:
    """(key, ending, n) over all documents given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, endings, counts, held = [], [], [], 0
        for batch in batches:
            for _, _, buf, off in flat.chunks(batch.column("text")):
                key, ending, _ = tokens(buf, off)
                order, first = sorted_runs(key)
                at = order.take(first)
                keys.append(key.take(at))
                counts.append(np.diff(first, append=len(key)))
                endings.append(ending.take(at))
                held += len(at)
                if held > 2_000_000:
                    yield _fold(keys, endings, counts)
                    keys, endings, counts, held = [], [], [], 0
        if keys:
            yield _fold(keys, endings, counts)

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    # a task's words differ, so nothing is added up before they are dealt
    return mapped(texts, run, "key long, ending int, n long").repartition("key").groupBy("key", "ending").agg(F.sum("n").alias("n"))


def _fold(keys: list, endings: list, counts: list) -> pa.RecordBatch:
    k, e, n = np.concatenate(keys), np.concatenate(endings), np.concatenate(counts)
    order, first = sorted_runs(k)
    at = order.take(first)
    total = np.add.reduceat(n.take(order), first) if len(n) else n
    return pa.RecordBatch.from_arrays([pa.array(k.take(at).view(np.int64)), pa.array(e.take(at)), pa.array(total.astype(np.int64))], ["key", "ending", "n"])


WHOLE = np.dtype((np.void, 4 * DIM))  # a vector
ROW = np.dtype([("id", "<i4"), ("n", "<f4"), ("v", "<f2", (DIM,))])  # of the words' vectors


@dataclass
class Vocabulary:
    keys: np.ndarray  # the head words, ascending hashes
    counts: np.ndarray
    classes: np.ndarray  # their class: an own one, or a shared one from OWN on
    rows: np.ndarray  # their row among the words of shared classes; -1 for own classes
    total: int
    distinct: int
    splits: np.ndarray  # shared classes of each ending
    edge: np.ndarray  # by shared class, its first row; its last row stands for the rest
    weight: np.ndarray  # by row: count plus one; of the rest, counts plus words plus one
    share: np.ndarray  # of each class, smoothed
    near: np.ndarray | None = None  # by the keys' upper bits, how many head words are below; made where it is used

    @property
    def n_classes(self) -> int:
        return OWN + len(self.edge) - 1

    def shared(self, key: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Shared class that a word falls into, from 0 on."""
        first = np.cumsum(self.splits) - self.splits
        return first[ending] + (key >> U(40)).astype(np.int64) % self.splits[ending]

    def classify(self, key: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each token, its row among the words of shared classes (-1: own class), and its place among the
        head words (-1: none)."""
        at, row, w = np.full(len(key), -1), np.empty(len(key), np.int64), np.empty(len(key), np.int32)
        if len(self.keys):
            if self.near is None:
                self.near = np.searchsorted(self.keys, np.arange(1 << NEAR_BITS).astype(U) << U(64 - NEAR_BITS)).astype(np.int32)
            found = self.near.take((key >> U(64 - NEAR_BITS)).astype(np.int64)).astype(np.int64)
            got = self.keys.take(found, mode="clip")
            low = (got < key).nonzero()[0]
            while len(low):
                found[low] += 1
                low = low[found.take(low) < len(self.keys)]
                got[low] = self.keys.take(found.take(low))
                low = low[got.take(low) < key.take(low)]
            met = got == key
            np.copyto(at, found, where=met)
            self.classes.take(at, out=w, mode="wrap")
            self.rows.take(at, out=row, mode="wrap")
            rare = (~met).nonzero()[0]
        else:
            rare = np.arange(len(key))
        c = self.shared(key.take(rare), ending.take(rare))
        w[rare], row[rare] = OWN + c, self.edge[c + 1] - 1
        return w, row, at


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """About the `limit` most frequent words: a histogram gives the least frequency, of whose words a share is taken by hash."""
    level = F.floor(F.log("n") * 64)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).orderBy(F.desc("level")).collect()  # 64 a power of e
    above = 0
    for r in steps:
        if above + r["v"] > limit:
            part = int((limit - above) / r["v"] * 2**20)
            return counts.where((level > r["level"]) | (level == r["level"]) & (F.pmod("key", F.lit(2**20)) < part))
        above += r["v"]
    return counts


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = frequent(counts, HEAD).toArrow()  # about HEAD rows at most
    key, n, ending = top["key"].to_numpy().view(U), top["n"].to_numpy().astype(np.int64), top["ending"].to_numpy()
    by_size = np.lexsort((key, -n))
    own = np.full(len(key), -1)
    own[by_size[:OWN]] = np.arange(min(OWN, len(key)))
    order = np.argsort(key)
    key, n, ending, own = key[order], n[order], ending[order], own[order]
    splits = np.maximum(-(-np.bincount(ending[own < 0], minlength=ENDINGS) // GROUP), 1)
    v = Vocabulary(key, n, own, own, 0, 0, splits, np.zeros(splits.sum() + 1, np.int64), None, None)
    shared = v.shared(key, ending)
    wide = F.array(*(F.lit(int(x)) for x in splits))
    cls = F.pmod(F.shiftrightunsigned("key", 40), F.element_at(wide, F.col("ending") + 1))
    sums = counts.groupBy("ending", cls.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row for each shared class
    mass, kinds = np.zeros(len(v.edge) - 1, np.int64), np.zeros(len(v.edge) - 1, np.int64)
    first = np.cumsum(splits) - splits
    for r in sums:
        mass[first[r["ending"]] + r["part"]], kinds[first[r["ending"]] + r["part"]] = r["n"], r["v"]
    v.total, v.distinct = int(mass.sum()), int(kinds.sum())
    np.subtract.at(mass, shared[own >= 0], n[own >= 0])
    np.subtract.at(kinds, shared[own >= 0], 1)
    # rows: the head words of each shared class, then its rest
    inside = np.flatnonzero(own < 0)
    size = np.bincount(shared[inside], minlength=len(mass))
    v.edge[1:] = np.cumsum(size + 1)
    inside = inside[np.argsort(shared[inside], kind="stable")]
    c = shared[inside]
    v.rows = np.full(len(key), -1)
    v.rows[inside] = np.arange(len(inside)) + c
    v.classes = np.where(own >= 0, own, OWN + shared).astype(np.int32)
    v.weight = np.zeros(v.edge[-1])
    v.weight[v.rows[inside]] = n[inside] + 1
    v.weight[v.edge[1:] - 1] = mass - np.bincount(c, n[inside], len(mass)) + kinds - size + 1
    whole = np.zeros(v.n_classes)
    whole[own[own >= 0]] = n[own >= 0]
    whole[OWN:] = mass
    v.share = (whole + 1) / (v.total + v.n_classes)
    return v


class LogBilinear:
    """Context vectors of classes (one more for a document's start), two matrices, output vectors and biases of
    classes; for decisions inside classes, context vectors of all words (rows of shared classes, then own classes,
    then a document's start) and output vectors of the words of shared classes."""

    NAMES, ROWS = ("context", "first", "second", "output", "bias"), ("own", "inner")

    def __init__(self, share: np.ndarray, rows: int, seed: int = 3):
        rng, n = np.random.default_rng(seed), len(share)

        def small(count: int) -> np.ndarray:
            out = np.empty((count, DIM), np.float32)
            for i in range(0, count, BLOCK_ROWS):  # no large table in double precision
                out[i : i + BLOCK_ROWS] = rng.standard_normal(out[i : i + BLOCK_ROWS].shape) * 0.1
            return out

        self.vectors = np.concatenate([small(n + 1), small(n)])  # of contexts, then of outputs
        self.context, self.output = self.vectors[: n + 1], self.vectors[n + 1 :]
        self.first, self.second = np.eye(DIM, dtype=np.float32) * 0.5, np.eye(DIM, dtype=np.float32) * 0.5
        self.bias = np.log(share).astype(np.float32)
        self.own, self.inner = small(rows + n + 1), np.zeros((rows, DIM), np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def unpack(self, x: np.ndarray) -> None:
        for k in self.NAMES:
            a = getattr(self, k)
            a[:] = x[: a.size].reshape(a.shape)
            x = x[a.size :]

    def predicted(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Vectors that decide inside classes: a, b the context classes, x, y the rows of the words before."""
        far, near = self.context.take(a, axis=0), self.context.take(b, axis=0)
        far += self.own.take(x, axis=0)
        near += self.own.take(y, axis=0)
        return far @ self.first + near @ self.second

    def normalisers(self) -> np.ndarray:
        """Log of the sum over all classes for every pair (class before the last, last class)."""
        # exp(far + near) are products of two tables' entries, so the sums are a product of matrices
        far, near = (self.context.astype(float) @ x for x in (self.first, self.second))
        near = near @ self.output.T
        near += self.bias
        top = near.max(1)
        near = np.exp(np.subtract(near, top[:, None], out=near), out=near).T
        out = np.empty((len(far), len(far)), np.float32)
        for i in range(0, len(far), SCORED):
            z = far[i : i + SCORED] @ self.output.T
            most = z.max(1)
            out[i : i + SCORED] = np.log(np.exp(z - most[:, None]) @ near) + most[:, None] + top
        return out


def weighted_log_sums(z: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Log of the sum of each row's exponentials times the columns' mass (1 at least), in place."""
    top = z.max(1)
    z -= top[:, None]
    return top + np.log(np.exp(z, out=z) @ mass)


def logistic(x: np.ndarray) -> np.ndarray:
    """In place, in single precision."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += 1
    x *= np.float32(0.5)
    return x


def segment_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at `first`; the even number of columns is added two at a time."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


@lru_cache
def cells(width: int) -> np.ndarray:
    """Places of the entries of the first rows of a table of that width, by row."""
    return (np.arange(8 * BATCH) * width)[:, None] + np.arange(width)


def add_rows(sums: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the row `to` of sums, two of the even number of columns at a time."""
    width = sums.shape[1] // 2
    at = cells(width).take(to, axis=0) if len(sums) <= 8 * BATCH else to[:, None].astype(np.int64) * width + np.arange(width)
    np.add.at(sums.view(np.complex64).reshape(-1), at.ravel(), rows.view(np.complex64).ravel())


def distinct(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers met, an item of each, the index of each item's number, and the other items; place: room for all
    numbers, of any values."""
    item = ITEMS[: len(at)] if len(at) <= len(ITEMS) else np.arange(len(at), dtype=np.int32)
    place[at] = item  # of equal numbers the last stays
    last = place.take(at) == item
    one, more = last.nonzero()[0], (~last).nonzero()[0]
    u = at.take(one)
    place[u] = item[: len(u)]
    return u, one, place.take(at), more


def gathered(at: np.ndarray, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers met, the sums of their rows, and each item's index among them; at may run through the rows twice."""
    u, one, back, more = distinct(at, place)
    again = more
    if len(at) > len(rows):
        one, again = one % len(rows), more % len(rows)
    sums = rows.take(one, axis=0)
    add_rows(sums, back.take(more), rows.take(again, axis=0))
    return u, sums, back


def put_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, for vectors, each copied as a whole."""
    table.view(WHOLE).reshape(-1)[at] = rows.view(WHOLE).reshape(-1)


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; the noise classes of a batch are shared by its tokens, the
    noise words of a class by the batch's tokens of that class."""

    def __init__(self, model: LogBilinear, v: Vocabulary, seed: int):
        self.m, self.v, self.rng = model, v, np.random.default_rng(seed)
        self.edge = np.cumsum(v.share)
        self.log_noise = np.log(NOISE * v.share).astype(np.float32)
        self.past = {k: np.full(getattr(model, k).shape, 1e-4, np.float32) for k in ("vectors", "first", "second", "bias")}
        self.past_rows = {k: np.full(len(getattr(model, k)), PAST, np.float32) for k in model.ROWS}
        self.used = {k: np.zeros(len(getattr(model, k)), np.float32) for k in model.ROWS}
        self.below = np.concatenate([[0], np.cumsum(v.weight)])
        self.pool, self.seen, self.steps = None, 0, 0
        room = {"classes": len(v.share) + 1, "sides": 2 * len(v.share) + 2} | {k: len(getattr(model, k)) for k in model.ROWS}
        self.place = {k: np.zeros(n, np.int32) for k, n in room.items()}
        self.guide = None

    def _step(self, name: str, at: np.ndarray | slice, g: np.ndarray, rate: float) -> None:
        """AdaGrad step for the rows met; the others have no gradient, which changes nothing."""
        past = self.past[name][at] + g * g
        self.past[name][at] = past
        g = g / np.sqrt(past, out=past)
        g *= rate
        getattr(self.m, name)[at] -= g

    def _class_vectors(self, at: np.ndarray, g: np.ndarray) -> None:
        """_step for rows of the table of classes' vectors."""
        past, now = self.past["vectors"], self.m.vectors
        p = past.take(at, axis=0)
        p += g * g
        put_rows(past, at, p)
        np.divide(g, np.sqrt(p, out=p), out=p)
        p *= np.float32(RATE)
        put_rows(now, at, np.subtract(now.take(at, axis=0), p, out=p))

    def _rows(self, name: str, at: np.ndarray, grads: np.ndarray) -> None:
        """AdaGrad steps, one rate a row, for the rows met."""
        u, g, _ = gathered(at, grads, self.place[name])
        past = self.past_rows[name].take(u) + np.einsum("ij,ij->i", g, g) / DIM
        self.past_rows[name][u] = past
        g *= (WORD_RATE / np.sqrt(past))[:, None]
        table = getattr(self.m, name)
        put_rows(table, u, np.subtract(table.take(u, axis=0), g, out=g))

    def _drawn(self, at: np.ndarray) -> np.ndarray:
        """The rows on whose stretch of the summed weights the numbers lie; a table says about where."""
        part = self.below[-1] / NEAR_PARTS
        if self.guide is None:
            self.guide = np.searchsorted(self.below, np.arange(NEAR_PARTS) * part, "right") - 1
        row = self.guide.take((at / part).astype(np.int64), mode="clip")
        row -= self.below.take(row) > at  # rounding
        low = np.arange(len(at))
        while len(low):
            low = low[self.below.take(row.take(low) + 1, mode="clip") <= at.take(low)]
            low = low[row.take(low) < len(self.below) - 2]
            row[low] += 1
        return row

    def _noise_words(self) -> np.ndarray:
        """WORD_NOISE rows of each shared class, by weight."""
        v = self.v
        if self.steps % POOL == 0:
            low = self.below[v.edge[:-1], None]
            at = low + self.rng.random((len(v.edge) - 1, POOL)) * (self.below[v.edge[1:], None] - low)
            self.pool = np.clip(self._drawn(at.ravel()).reshape(at.shape), v.edge[:-1, None], v.edge[1:, None] - 1)
        k = int(self.rng.integers(POOL - WORD_NOISE + 1))
        return self.pool[:, k : k + WORD_NOISE]

    def inside(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray) -> None:
        """Step for the vectors of words: of those predicted inside their classes, and of the words before them."""
        k = (row >= 0).nonzero()[0]
        if not len(k):
            return
        k = k.take(np.argsort(w.take(k).astype(np.int16), kind="stable"))
        m, c, row, x, y = self.m, w.take(k) - OWN, row.take(k), x.take(k), y.take(k)
        q = m.predicted(a.take(k), b.take(k), x, y)
        new = np.ones(len(c), bool)
        np.not_equal(c[1:], c[:-1], out=new[1:])
        first, more = new.nonzero()[0], (~new).nonzero()[0]
        which = np.cumsum(new) - 1
        drawn = self._noise_words()[c.take(first)]
        vec, noise = m.inner.take(row, axis=0), m.inner.take(drawn, axis=0).take(which, axis=0)
        odds = np.float32(np.log(WORD_NOISE))  # frequencies cancel: counts are part of the logit and of the noise
        g_data = logistic(np.einsum("ij,ij->i", q, vec) - odds) - 1
        g_noise = logistic(np.einsum("ikj,ij->ik", noise, q) - odds)
        vec *= g_data[:, None]
        vec += np.einsum("ik,ikj->ij", g_noise, noise)
        pulls = np.einsum("ik,ij->ikj", g_noise, q).reshape(len(q), -1)
        met = pulls.take(first, axis=0)
        add_rows(met, which.take(more), pulls.take(more, axis=0))
        q *= g_data[:, None]
        self._rows("inner", np.concatenate([row, drawn.ravel()]), np.concatenate([q, met.reshape(-1, DIM)]))
        at = np.stack([x, y], axis=1).ravel()
        self._rows("own", at, (vec @ np.concatenate([m.first.T, m.second.T], axis=1)).reshape(-1, DIM))

    def classes(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        """Step for the parameters of classes; a, b, w: the classes of the two words before and of the word."""
        m, n, size = self.m, len(w), len(self.v.share)
        noise = np.minimum(self.edge.searchsorted(self.rng.random(NOISE) * self.edge[-1], "right"), size - 1)
        # matrices are applied to each context class met once, as the first and as the second word before
        met, _, back, _ = distinct(np.concatenate([a, b]), self.place["classes"])
        context, both = m.context.take(met, axis=0), np.concatenate([m.first, m.second], axis=1)
        sides = (context @ both).reshape(-1, DIM)
        far, near = back[:n] * 2, back[n:] * 2 + 1
        pulls = np.empty((n + NOISE, DIM), np.float32)
        q = np.add(sides.take(far, axis=0), sides.take(near, axis=0), out=pulls[:n])
        bias = m.bias - self.log_noise
        qw, qn = m.output.take(w, axis=0), m.output.take(noise, axis=0)
        shift = np.empty(n + NOISE, np.float32)  # of the biases
        g_data = np.divide(logistic(np.einsum("ij,ij->i", q, qw) + bias.take(w)) - 1, n, out=shift[:n])
        qn *= np.float32(0.5)
        t = np.matmul(q, qn.T)
        t += bias.take(noise) * np.float32(0.5)
        np.tanh(t, out=t)
        t += 1  # twice the logistic
        qn /= n
        qw *= g_data[:, None]
        qw += t @ qn
        np.matmul(t.T, q, out=pulls[n:])
        pulls[n:] /= 2 * n
        np.divide(np.ones(n, np.float32) @ t, 2 * n, out=shift[n:])
        q *= g_data[:, None]
        out, of_out, of = gathered(np.concatenate([w, noise]), pulls, self.place["classes"])
        at, g, _ = gathered(np.concatenate([far, near]), qw, self.place["sides"])
        back = np.zeros_like(sides)
        put_rows(back, at, g)
        deep = context.T @ back.reshape(-1, 2 * DIM)
        self._class_vectors(np.concatenate([met, out + len(m.context)]), np.concatenate([back.reshape(-1, 2 * DIM) @ both.T, of_out]))
        self._step("bias", out, np.bincount(of, shift).astype(np.float32), RATE)
        self._step("first", slice(None), deep[:, :DIM], RATE * 0.1)
        self._step("second", slice(None), deep[:, DIM:], RATE * 0.1)

    def learn(self, *of: np.ndarray, words: bool = True) -> None:
        """a, b, w, x, y, row of a chunk's tokens, in batches; words: whether vectors of words learn too."""
        self.seen += len(of[0])
        if words:
            *_, x, y, row = (z[of[5] >= 0] for z in of)
            for name, rows in (("inner", row), ("own", x), ("own", y)):
                np.add.at(self.used[name], rows, np.float32(1))
        for i in range(0, len(of[0]), BATCH):
            batch = [z[i : i + BATCH] for z in of]
            self.classes(*batch[:3])
            if words:
                self.inside(*batch)
            self.steps += 1


def contexts(values: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Values two and one before each token of its document; `start` stands for places before its start."""
    near, far = np.full(len(values), start, values.dtype), np.full(len(values), start, values.dtype)
    near[1:] = values[:-1]
    near[bounds[:-1]] = start  # every document has its end token
    far[1:] = near[:-1]
    far[bounds[:-1]] = start
    return far, near


def placed(v: Vocabulary, buf: np.ndarray, off: np.ndarray, words: bool = True):
    """Keys and bounds of a chunk's tokens, their places among the head words, and (a, b, w, x, y, row) of each, or (a, b, w)."""
    key, ending, bounds = tokens(buf, off)
    w, row, at = v.classify(key, ending)
    rows = int(v.edge[-1])
    if not words:
        return key, bounds, at, (*contexts(w, bounds, v.n_classes), w)
    return key, bounds, at, (*contexts(w, bounds, v.n_classes), w, *contexts(np.where(row >= 0, row, rows + w), bounds, rows + v.n_classes), row)


PARTS = "block int, copy int, weight double, part binary"


def _parts(t: Trainer, copy: int) -> Iterator[pa.RecordBatch]:
    """A copy's parameters: BLOCKS of those of classes, then the vectors of words met, by BLOCK_ROWS rows."""

    def batch(blocks, parts: list) -> pa.RecordBatch:
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([copy] * n, pa.int32()), pa.array([float(t.seen)] * n), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "copy", "weight", "part"])

    yield batch(range(BLOCKS), np.array_split(t.m.pack().astype(np.float32), BLOCKS))
    for k, name in enumerate(t.m.ROWS):
        at = np.flatnonzero(t.used[name])
        if len(at):
            rows = np.empty(len(at), ROW)
            first = k * len(t.used[t.m.ROWS[0]])
            rows["id"], rows["n"], rows["v"] = at + first, t.used[name][at], getattr(t.m, name)[at]
            block = rows["id"] // BLOCK_ROWS
            cuts = np.flatnonzero(np.diff(block)) + 1
            yield batch(block[np.append(0, cuts)] + BLOCKS, np.split(rows, cuts))


def _average(rows: pa.Table) -> pa.Table:
    """One part of all copies of a block: weighted by tokens, or each vector by its uses."""
    weight, parts = rows["weight"].to_numpy(), rows["part"].to_pylist()
    if rows["block"][0].as_py() < BLOCKS:
        total = np.zeros(len(parts[0]) // 4)
        for w, p in zip(weight, parts, strict=True):
            total += np.frombuffer(p, np.float32) * w
        part = (total / weight.sum()).astype(np.float32)
    else:
        got = np.concatenate([np.frombuffer(p, ROW) for p in parts])
        got = got[np.argsort(got["id"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], got["id"][1:] != got["id"][:-1]]))
        part = got[first]
        part["n"] = np.add.reduceat(got["n"], first)
        part["v"] = segment_sums(got["v"].astype(np.float32) * got["n"][:, None], first) / part["n"][:, None]
    return pa.table({"block": rows["block"][:1], "copy": rows["copy"][:1], "weight": pa.array([weight.sum()]), "part": pa.array([part.tobytes()], pa.binary())})


def train(docs: DataFrame, vocab: Vocabulary, *, rounds: int = ROUNDS) -> LogBilinear:
    """Train over all given documents, task by task, averaging after each round."""
    spark = docs.sparkSession
    model = LogBilinear(vocab.share, int(vocab.edge[-1]))
    if not vocab.total:
        return model
    words = spark.sparkContext.broadcast(vocab)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    copies = texts.rdd.getNumPartitions()
    for r in range(rounds):
        last = r == rounds - 1  # the words' vectors need the classes' to be learned
        start = spark.sparkContext.broadcast(model.pack())  # about 65,000 numbers

        def run(batches: Iterator[pa.RecordBatch], r=r, start=start, last=last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            v, copy = words.value, TaskContext.get().partitionId()
            m = LogBilinear(v.share, int(v.edge[-1]) if last else 0)
            m.unpack(start.value)
            t = Trainer(m, v, 1000 * r + copy)
            for batch in batches:
                for _, _, buf, off in flat.chunks(batch.column("text")):
                    *_, all_of = placed(v, buf, off, last)
                    t.learn(*all_of, words=last)
            if t.seen:
                yield from _parts(t, copy)

        got, left = mapped(texts, run, PARTS), copies
        while left > FAN:
            got = got.withColumn("copy", F.floor(F.col("copy") / FAN).cast("int")).groupBy("block", "copy").applyInArrow(_average, PARTS)
            left = -(-left // FAN)
        got = got.groupBy("block").applyInArrow(_average, PARTS).collect()  # the model: bounded by HEAD
        dense = sorted((g for g in got if g["block"] < BLOCKS), key=lambda g: g["block"])
        if len(dense) == BLOCKS:
            model.unpack(np.concatenate([np.frombuffer(g["part"], np.float32) for g in dense]))
        for g in got:
            if g["block"] >= BLOCKS:
                rows = np.frombuffer(g["part"], ROW)
                mine = rows["id"] < len(model.own)
                model.own[rows["id"][mine]] = rows["v"][mine]
                model.inner[rows["id"][~mine] - len(model.own)] = rows["v"][~mine]
        start.destroy()
    return model


@dataclass
class Inside:
    """What decides inside classes, made once a task: by word (rows of shared classes, own classes, a document's
    start) its part of the predicted vector as the second and as the first word before, class and all, and the
    greatest length of the vectors of each shared class."""

    far: np.ndarray
    near: np.ndarray
    longest: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary, m: LogBilinear) -> Inside:
        classes = np.concatenate([np.repeat(np.arange(OWN, v.n_classes), np.diff(v.edge)), np.arange(v.n_classes + 1)])
        far, near = np.empty_like(m.own), np.empty_like(m.own)
        for i in range(0, len(m.own), BLOCK_ROWS):
            both = m.own[i : i + BLOCK_ROWS] + m.context.take(classes[i : i + BLOCK_ROWS], axis=0)
            far[i : i + BLOCK_ROWS], near[i : i + BLOCK_ROWS] = both @ m.first, both @ m.second
        return cls(far, near, longest(v, m))


def longest(v: Vocabulary, m: LogBilinear) -> np.ndarray:
    return np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", m.inner, m.inner), v.edge[:-1]))


def inner_logs(v: Vocabulary, m: LogBilinear, log_weight: np.ndarray, of: tuple, ready: Inside | None = None) -> np.ndarray:
    """Log probabilities of tokens inside their classes (0 in own ones): products with the vectors of the whole class."""
    a, b, w, x, y, row = of
    out = np.zeros(len(w))
    k = (row >= 0).nonzero()[0]
    if not len(k):
        return out
    k = k.take(np.argsort(w.take(k).astype(np.int16), kind="stable"))
    c, row = w.take(k) - OWN, row.take(k)
    if ready:
        q = ready.far.take(x.take(k), axis=0)
        q += ready.near.take(y.take(k), axis=0)
    else:
        q = m.predicted(a.take(k), b.take(k), x.take(k), y.take(k))
    weight = v.weight.astype(np.float32)
    safe = (ready.longest if ready else longest(v, m)) * np.sqrt(np.einsum("ij,ij->i", q, q).max()) < 30  # no product is larger
    total = np.empty(len(k), np.float32)
    cuts = np.append(starts(c), len(c))
    room = np.empty(SCORED * int(np.diff(v.edge).max()), np.float32)
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = c[first]
        low, high = v.edge[at], v.edge[at + 1]
        vectors, mass = m.inner[low:high].T, weight[low:high]
        for i in range(first, last, SCORED):
            end = min(i + SCORED, last)
            z = np.matmul(q[i:end], vectors, out=room[: (end - i) * len(mass)].reshape(end - i, -1))
            total[i:end] = np.log(np.exp(z, out=z) @ mass) if safe[at] else weighted_log_sums(z, mass)
    out[k] = np.einsum("ij,ij->i", q, m.inner.take(row, axis=0)) + log_weight.take(row) - total
    return out


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, n_known, base_score, score (both log10)."""
    spark = docs.sparkSession
    far, near = (model.context @ x @ model.output.T for x in (model.first, model.second))
    shared = spark.sparkContext.broadcast((vocab, model, far, near + model.bias, model.normalisers()))
    base = float(np.log10(vocab.total + vocab.distinct + 1.0))
    names = ["row", "key", "n", "doc_id", "n_tokens", "n_known", "base", "model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, far, near, normal = shared.value
        ready = Inside.of(v, m)
        head_log, rest_log, log_weight = np.log10(v.counts + 1.0), np.log10(v.weight[v.edge[1:] - 1]), np.log(v.weight).astype(np.float32)
        for batch in batches:
            for i, j, buf, off in flat.chunks(batch.column("text")):
                key, bounds, at, of = placed(v, buf, off)
                a, b, w = (x.astype(np.int64) for x in of[:3])
                p = (far.take(a * v.n_classes + w) + near.take(b * v.n_classes + w) - normal.take(a * (v.n_classes + 1) + b)).astype(float)
                p += inner_logs(v, m, log_weight, of, ready)
                p /= LOG10
                known = at >= 0
                own = np.where(known, head_log.take(at), 0.0) if len(head_log) else np.zeros(len(w))
                p -= np.where(known, 0.0, rest_log[np.maximum(w - OWN, 0)])
                row, doc_id = batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i)
                number = row.to_numpy(zero_copy_only=False)
                n = np.diff(bounds)
                # a document's own row joins no word: its key is a hash of its place
                yield pa.RecordBatch.from_arrays([row, pa.array(flat.mix(number.astype(U) ^ U(0xA5A5A5A5A5A5A5A5)).view(np.int64)), pa.array(np.zeros(len(n), np.int64)), doc_id, pa.array(n), pa.array(flat.sums(known, bounds)), pa.array(flat.sums(own, bounds) - n * base), pa.array(flat.sums(p, bounds))], names)
                rare = np.flatnonzero(~known)
                doc = np.searchsorted(bounds, rare, "right") - 1
                order = np.lexsort((key[rare], doc))
                doc, word = doc[order], key[rare][order]
                first = np.flatnonzero(np.concatenate([np.ones(min(len(doc), 1), bool), (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]))
                none = pa.nulls(len(first))
                yield pa.RecordBatch.from_arrays([pa.array(number[doc[first]]), pa.array(word[first].view(np.int64)), pa.array(np.diff(first, append=len(doc))), *(none.cast(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spread = mapped(rows, run, "row long, key long, n long, doc_id long, n_tokens long, n_known long, base double, model double")
    met = spread.join(counts.select("key", F.col("n").alias("c")), "key", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = met.groupBy("row").agg(*(F.max(k).alias(k) for k in ("doc_id", "n_tokens", "n_known", "base", "model")), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(c + F.lit(1.0))).alias("logs"))
    return sums.select("row", "doc_id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), (F.col("base") + F.col("logs")).alias("base_score"), (F.col("model") + F.col("logs")).alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(training_document())
    counts = stored(count_words(learn), "word-counts")
    vocab = vocabulary(counts)
    scored = score(docs, counts, vocab, train(learn, vocab))
    return scored.select("doc_id", (~training_document()).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
