"""Quality classifier by nearest-neighbour voting in a latent space (operator 9).

Terms are hashed words, byte 3-grams and the words' shapes (how a word is cased, which marks it ends in,
whether it repeats the word before), all from the text alone. A bounded sample of labelled rows gives term
weights (inverse document frequency) and a truncated singular value decomposition; its documents' latent
vectors and labels are what is broadcast, whatever the size of the input. Every document is projected and
compared with all labelled vectors by blocked matrix products; the `k` nearest vote with their similarity
to the power `sharpness` (of equally near ones at the k-th place, those that partial sorting leaves). A text without terms gets the sample's share of label 1, as does every text when
nothing is labelled. Null texts count as empty; rows are scored one by one, repeated ones alike; extra
columns, lang and source among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .runtime import give_back, hidden, id_crc, mapped, table
from .sample import labelled_sample

U = np.uint64
WORD_DIM, CHAR_DIM, SHAPE_DIM = 2048, 4096, 256
DIM = WORD_DIM + CHAR_DIM + SHAPE_DIM
LATENT, SAMPLE_ROWS, NEIGHBOURS, SHARPNESS = 64, 4096, 15, 4
BLOCK_ROWS = 256


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents by terms, each of the three kinds scaled to length one after a square root."""
    n = len(off) - 1
    starts, ends, bounds = flat.words(buf, off, flat.NOT_SPACE)
    h = flat.BYTES.spans(flat.BYTES.prefix(flat.LOWER[buf]), starts, ends)
    doc = flat.doc_of(bounds)
    word = (h >> U(32)).astype(np.int64) % WORD_DIM
    b = buf.astype(np.uint32)
    m = max(len(b) - 2, 0)
    code = (b[:m] | (b[1 : m + 1] << np.uint32(8)) | (b[2 : m + 2] << np.uint32(16))) * np.uint32(2654435761)
    char_doc = np.repeat(np.arange(n), np.diff(off))
    inside = char_doc[:m] == char_doc[2 : m + 2]  # no trigram crosses the end of a document
    char, char_doc = (code >> np.uint32(20)).astype(np.int64)[inside], char_doc[:m][inside]
    upper = (buf >= 65) & (buf <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    many = np.minimum(ups[ends] - ups[starts], 2)
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    mark = np.zeros(256, np.int64)
    mark[list(b".,;:!?#*$%&|<>")] = np.arange(1, 15)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    shape = again * 128 + many * 32 + mark[last] * 2 + (ends - starts > 1)
    out = np.empty((n, DIM), np.float32)
    at = 0
    for owner, term, size in ((doc, word, WORD_DIM), (char_doc, char, CHAR_DIM), (doc, shape, SHAPE_DIM)):
        x = np.sqrt(np.bincount(owner * size + term, minlength=n * size).reshape(n, size).astype(np.float32))
        out[:, at : at + size] = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        at += size
    return out


@dataclass
class Model:
    weights: np.ndarray  # DIM x LATENT: term weights times right singular vectors
    vectors: np.ndarray  # sample x LATENT, of length one
    labels: np.ndarray
    share: float


def project(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)


class Weighted:
    """The sample's rows in half precision times the terms' weights, multiplied block by block."""

    def __init__(self, rows: np.ndarray, idf: np.ndarray):
        self.rows, self.idf, self.shape = rows, idf, rows.shape

    def _blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.rows), BLOCK_ROWS):
            yield self.rows[at : at + BLOCK_ROWS].astype(np.float32) * self.idf

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([b @ q for b in self._blocks()])

    def transposed(self, q: np.ndarray) -> np.ndarray:
        return sum(b.T @ q[i * BLOCK_ROWS : (i + 1) * BLOCK_ROWS] for i, b in enumerate(self._blocks()))


def truncated_svd(x: Weighted, k: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (columns) by subspace iteration."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(k + 8, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ q)
        q, _ = np.linalg.qr(x.transposed(q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :k]


def fit(docs: DataFrame, labels: DataFrame, *, where=None, limit: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `limit` labelled rows of label column quality; `where` restricts them by doc_id."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in flat.chunks(batch.column("text"), 1 << 18):
                x = counts(buf, off).astype(np.float16)
                cols = [np.flatnonzero(r).astype(np.uint16) for r in x]
                out = [c.tobytes() for c in cols], [r[c].tobytes() for r, c in zip(x, cols, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), *(pa.array(o, pa.binary()) for o in out)], ["label", "cols", "vals"])

    # only terms that occur travel: a tenth of the dense rows
    sample = labelled_sample(docs, labels, "quality", limit, where).select("label", F.col("text").cast("binary").alias("text"))
    got = mapped(sample, sparse, "label int, cols binary, vals binary").toArrow()  # at most `limit` rows of DIM terms
    got = got.sort_by([("cols", "ascending"), ("vals", "ascending"), ("label", "ascending")])
    y = got["label"].to_numpy().astype(np.float32)
    if not len(y):
        return Model(np.zeros((DIM, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 0.5)
    rows, df = np.zeros((len(y), DIM), np.float16), np.zeros(DIM, np.int64)
    for i, (cols, vals) in enumerate(zip(got["cols"], got["vals"], strict=True)):
        c = np.frombuffer(cols.as_buffer(), np.uint16)
        rows[i, c] = np.frombuffer(vals.as_buffer(), np.float16)
        df[c] += 1
    del got
    x = Weighted(rows, np.where(df > 0, np.log((1 + len(y)) / (1 + df)) + 1, 0).astype(np.float32))
    v, idf = truncated_svd(x, LATENT), x.idf
    weights = idf[:, None] * v
    z = x @ v
    z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)
    del x, rows
    give_back()
    return Model(weights.astype(np.float32), z.astype(np.float32), y, float(y.mean()))


def vote(z: np.ndarray, m: Model, k: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Share of label 1 among the k most similar labelled vectors, weighted by similarity."""
    out = np.empty(len(z))
    k = min(k, len(m.vectors))
    for at in range(0, len(z), BLOCK_ROWS):
        sim = z[at : at + BLOCK_ROWS] @ m.vectors.T
        best = np.argpartition(sim, sim.shape[1] - k, axis=1)[:, -k:] if k < sim.shape[1] else np.broadcast_to(np.arange(k), sim.shape)
        w = np.maximum(np.take_along_axis(sim, best, 1), 0).astype(np.float64) ** sharpness
        total = w.sum(1)
        out[at : at + BLOCK_ROWS] = np.where(total > 1e-12, (w * m.labels[best]).sum(1) / np.maximum(total, 1e-12), m.share)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score under `name`, one row for each input row."""
    shared, source = docs.sparkSession.sparkContext.broadcast(model), hidden(docs, "__text")  # DIM x LATENT and sample x LATENT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, off in flat.chunks(batch.column(source)):
                p = [vote(project(counts(buf[off[i] : off[j]], off[i : j + 1] - off[i]), m.weights), m) for i, j in ((i, min(i + BLOCK_ROWS, b - a)) for i in range(0, b - a, BLOCK_ROWS))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), pa.array(np.concatenate(p))], [*keep, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    return mapped(docs.select(*keep, F.col("text").cast("binary").alias(source)), run, schema)


def trained_on():
    """Rows whose labels may be learned from."""
    return id_crc() % 4 != 2


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels, where=trained_on()))
    return scored.select("doc_id", (~trained_on()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Documents whose score reaches the threshold, with all their columns."""
    model, name = fit(docs, labels, where=trained_on()), hidden(docs, "__score")
    return score(docs, model, keep=tuple(docs.columns), name=name).where(F.col(name) >= threshold).select(*docs.columns)
