"""Toxicity grades by cumulative-link ordinal regression (operator 8).

Terms are words (runs of digits, letters and everything beyond ASCII, A-Z lower-cased), their first 6 and 8
bytes as stems, and pairs of neighbouring words, hashed. A bounded sample of labelled rows selects the terms that lean clearly to either
label, by a z-score of their log-odds over documents; this keeps the features few and sparse, and lets one
word in a very long text count. Labels say toxic or not; the severity of a toxic document is graded 1 to 3
by the terciles of its toxic evidence, the summed log-odds of its selected terms. One weight vector is
shared by all grades and the thresholds are ordered. Output: P(grade >= 1) as `score`, the expected grade,
the most likely grade, and `toxic`, score >= 0.5. Null and empty texts have no terms and are not toxic
(unless the sample holds no clean row). Evidence equal to a tercile belongs to the grade above it; of equally
distinctive terms at the MAX_TERMS-th place those of lower hashes stay. An empty table gives no rows. Rows are
scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .linear import Sparse, fit_ordinal, sigmoid
from .runtime import mapped, table
from .sample import labelled_sample

U = np.uint64
STEMS = (6, 8)
BITS, GRADES, SAMPLE_ROWS, MIN_Z, MAX_TERMS = 20, 4, 6000, 3.0, 4096


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of every word and pair of words."""
    low = flat.LOWER[buf]
    starts, ends, bounds = flat.words(low, off, flat.ALNUM_LOWER)
    h = flat.BYTES.spans(flat.BYTES.prefix(low), starts, ends)
    two, at = flat.gram_hashes(h, bounds, 2)
    doc = flat.doc_of(bounds)
    prefix = flat.BYTES.prefix(low)
    owner, found = [doc, doc[at]], [h, two]
    for n in STEMS:
        long = ends - starts > n
        owner.append(doc[long])
        found.append(flat.mix(flat.BYTES.spans(prefix, starts[long], starts[long] + n) + U(n)))
    return np.concatenate(owner), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    column: np.ndarray  # term -> selected feature, or -1
    weights: np.ndarray
    thresholds: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_ROWS, where=None) -> Model:

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, buf, off in flat.chunks(batch.column("text")):
                doc, term = terms(buf, off)
                u, n = np.unique(doc << BITS | term, return_counts=True)
                edge = np.searchsorted(u >> BITS, np.arange(len(off)))
                out += [((u[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes(), np.log1p(n[a:b]).astype(np.float32).tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["label", "cols", "vals"])

    sample = labelled_sample(docs, labels, "toxic", limit, where).select("label", F.col("text").cast("binary").alias("text"))
    got = mapped(sample, rows, "label int, cols binary, vals binary").collect()
    got.sort(key=lambda r: (r["cols"], r["vals"], r["label"]))
    column = np.full(1 << BITS, -1, np.int32)
    y = np.array([r["label"] > 0 for r in got], bool)
    if y.all() or not y.any():
        return Model(column, np.zeros(1), np.array([-8.0, -7.0, -6.0]) if len(y) and y.all() else np.array([8.0, 9.0, 10.0]))
    x = Sparse.of([(r["cols"], r["vals"]) for r in got])
    del got
    width = 1 << BITS
    bad = np.bincount(x.col[y[x.row]], minlength=width).astype(float)
    good = np.bincount(x.col[~y[x.row]], minlength=width).astype(float)
    a, b, n_bad, n_good = bad + 0.5, good + 0.5, y.sum() + 1, (~y).sum() + 1
    odds = np.log(a / (n_bad - a)) - np.log(b / (n_good - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    chosen = np.flatnonzero((np.abs(z) >= MIN_Z) & (bad + good >= 3))
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")][:MAX_TERMS]
    column[chosen] = np.arange(len(chosen))
    mine = column[x.col] >= 0
    small = Sparse(x.row[mine], column[x.col[mine]].astype(np.int64), x.val[mine], x.n)
    evidence = np.bincount(small.row, np.maximum(odds[chosen], 0)[small.col] * small.val, small.n)
    cuts = np.quantile(evidence[y], [1 / 3, 2 / 3])
    grade = np.where(y, 1 + np.searchsorted(cuts, evidence, "right"), 0)
    w, theta = fit_ordinal(small, grade, max(len(chosen), 1), GRADES)
    return Model(column, w, theta)


SCHEMA = "doc_id long, score double, expected_severity double, grade int, toxic boolean"


def grade(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS term numbers and at most MAX_TERMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, off in flat.chunks(batch.column("text")):
                doc, term = terms(buf, off)
                col = m.column[term]
                hit = col >= 0
                u, n = np.unique(doc[hit] * len(m.weights) + col[hit], return_counts=True)
                total = np.bincount(u // len(m.weights), np.log1p(n) * m.weights[u % len(m.weights)], b - a)
                above = 1 - sigmoid(m.thresholds[None, :] - total[:, None])
                p = -np.diff(np.concatenate([np.ones((b - a, 1)), above, np.zeros((b - a, 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)], ["doc_id", "score", "expected_severity", "grade", "toxic"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, SCHEMA)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))
