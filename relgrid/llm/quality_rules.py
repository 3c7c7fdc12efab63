"""Quality rules: exact text statistics and a calibrated n-gram logistic regression (operator 3).

Words are maximal runs of characters other than ASCII white space. A null text counts as empty. The
statistics cover whole texts. The model takes relative frequencies of hashed word 1- and 2-grams and of
hashed byte 3-grams; its weights come from a bounded sample of labelled rows, its probabilities are
calibrated on a part of that sample that the weights have not seen, and the verdict compares them with a
fixed threshold, which a probability reaches by being equal to it. Duplicate rows are scored row by row; texts
count whole, whatever their length; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .linear import Sparse, fit_logistic, fit_platt, sigmoid
from .runtime import mapped, table
from .sample import labelled_sample

U = np.uint64
WORD_BITS, CHAR_BITS = 17, 16
WIDTH = (1 << WORD_BITS) * 2 + (1 << CHAR_BITS)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
SAMPLE_ROWS = 4000
THRESHOLD = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


class View:
    """Words, hashes and feature columns of one chunk of documents."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.starts, self.ends, self.bounds = flat.words(buf, off, flat.NOT_SPACE)
        self.prefix = flat.BYTES.prefix(buf)
        self.hash = flat.BYTES.spans(self.prefix, self.starts, self.ends)

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(columns, bounds by document) of each kind of n-gram."""
        one = (self.hash >> U(64 - WORD_BITS)).astype(np.int32)
        h2, at = flat.gram_hashes(self.hash, self.bounds, 2)
        two = (h2 >> U(64 - WORD_BITS)).astype(np.int32) + (1 << WORD_BITS)
        b = self.buf.astype(np.uint32)
        n = max(len(b) - 2, 0)
        code = (b[:n] | (b[1 : n + 1] << np.uint32(8)) | (b[2 : n + 2] << np.uint32(16))) * np.uint32(2654435761)
        three = (code >> np.uint32(32 - CHAR_BITS)).astype(np.int32) + (2 << WORD_BITS)
        size = np.diff(self.off)
        inside = np.ones(n, bool)
        for back in (1, 2):
            edge = self.off[1:-1] - back
            inside[edge[(edge >= 0) & (edge < n)]] = False
        return [(one, self.bounds), (two, np.searchsorted(at, self.bounds)), (three[inside], np.concatenate([[0], np.cumsum(np.maximum(size - 2, 0))]))]


def margins(view: View, m: Model) -> np.ndarray:
    total = np.full(len(view.off) - 1, m.bias)
    for cols, bounds in view.features():
        total += flat.sums(m.weights[cols], bounds) / np.maximum(np.diff(bounds), 1)
    return total


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_c, out_v = [], []
        for _, _, buf, off in flat.chunks(batch.column("text")):
            kinds = View(buf, off).features()
            for d in range(len(off) - 1):
                cols, vals = [], []
                for c, bounds in kinds:
                    u, n = np.unique(c[bounds[d] : bounds[d + 1]], return_counts=True)
                    cols.append(u)
                    vals.append(n / max(n.sum(), 1))
                out_c.append(np.concatenate(cols).astype(np.int32).tobytes())
                out_v.append(np.concatenate(vals).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(out_c, pa.binary()), pa.array(out_v, pa.binary())], ["label", "cols", "vals"])


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `limit` labelled rows; three quarters give weights, the rest the calibration.

    Without both labels in the sample the model keeps everything.
    """
    rows = labelled_sample(docs, labels, "quality", limit).select("label", F.col("text").cast("binary").alias("text"))
    got = mapped(rows, _sparse_rows, "label int, cols binary, vals binary").collect()
    got.sort(key=lambda r: (r["cols"], r["vals"], r["label"]))
    y = np.array([r["label"] for r in got], float)
    if len(set(y.tolist())) < 2 or len(y) < 8:
        return Model(np.zeros(WIDTH), 0.0, 0.0, 3.0)
    x = Sparse.of([(r["cols"], r["vals"]) for r in got])
    part = np.arange(len(y)) % 4 == 3
    w, b = fit_logistic(x.take(~part), y[~part], WIDTH)
    held = x.take(part).times(w) + b
    slope, shift = fit_platt(held, y[part]) if len(set(y[part].tolist())) == 2 else (1.0, 0.0)
    return Model(w.astype(np.float32).astype(float), b, slope, shift)


def statistics(view: View) -> dict[str, np.ndarray]:
    """The exact counts of the rules, one value for each document."""
    buf, off, bounds = view.buf, view.off, view.bounds
    n_words = np.diff(bounds)
    solid = flat.NOT_SPACE[buf] & ((buf & 0xC0) != 0x80)
    # lines that hold a word: from the first word of a line to the line's end
    breaks = np.flatnonzero(buf == 10)
    doc = flat.doc_of(bounds)
    line = np.searchsorted(breaks, view.starts)
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    of = doc[first]
    begin = np.where(line[first] > 0, breaks[np.maximum(line[first] - 1, 0)] + 1, 0) if len(breaks) else np.zeros(first.sum(), np.int64)
    begin = np.maximum(begin, off[of])
    end = np.where(line[first] < len(breaks), np.append(breaks, len(buf))[line[first]], len(buf))
    end = np.minimum(end, off[of + 1])
    _, again = flat.repeated(of, flat.BYTES.spans(view.prefix, begin, end))
    grams, at = flat.gram_hashes(view.hash, bounds, WINDOW)
    twice, _ = flat.repeated(doc[at], grams)
    inside = flat.covered(len(view.hash), at[twice], at[twice] + WINDOW)
    return {
        "n_words": n_words,
        "word_chars": flat.sums(solid, off),
        "n_symbols": flat.sums(SYMBOLS[buf], off),
        "n_dup_lines": np.bincount(of[again], minlength=len(n_words)) if len(of) else np.zeros(len(n_words), np.int64),
        "n_repeat_words": flat.sums(inside, bounds),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality_probability double"


def apply_rules(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: counts, the rules' verdict and the model's calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, buf, off in flat.chunks(batch.column("text")):
                view = View(buf, off)
                s = statistics(view)
                failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
                p = sigmoid(m.slope * margins(view, m) + m.shift)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", *COUNTS, "base_failed", "kept", "quality_probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return mapped(rows, run, SCHEMA)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
