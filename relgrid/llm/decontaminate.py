"""Benchmark decontamination by winnowing (operator 7).

Words are runs of digits, letters a-z and everything beyond ASCII, after lower-casing A-Z. A benchmark
item's windows are its runs of 13 words; an item of fewer words, but not none, is one window. Documents
and items keep the minimum 7-gram hash of each 7 consecutive 7-grams, so any shared run of 13 words shares
a kept fingerprint at the same place in both; hits on fingerprints are extended word by word to the whole
shared run, and runs of 13 words or more mark the document's words. Items shorter than 13 words are found
by the hash of their whole text at every place of a document. Null texts, and texts without words, have
no words and no hits. Repeated rows are judged row by row; extra columns are ignored. Items of one item_id count
as one; those with a null item_id mark words like others and count as one item without a name, which the digest
of names leaves out. Of empty tables nothing is found.

The benchmark's index is broadcast in blocks of at most `block_words` words (a fixed size); a benchmark
beyond one block takes one pass over the documents for each block, and the passes are added up by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .runtime import hidden, mapped, ship, steady, table

U = np.uint64
WINDOW, GRAM, WINNOW = 13, 7, 7  # GRAM + WINNOW - 1 == WINDOW: every shared window holds a kept fingerprint
BLOCK_WORDS = 1_000_000


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = flat.LOWER[buf]
    starts, ends, bounds = flat.words(low, off, flat.ALNUM_LOWER)
    return flat.BYTES.spans(flat.BYTES.prefix(low), starts, ends), bounds


def winnow(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint): the leftmost least GRAM-gram hash of each window of WINNOW grams inside a document."""
    g, at = flat.gram_hashes(h, bounds, GRAM)
    if len(g) < WINNOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low, best = g[: len(g) - WINNOW + 1].copy(), np.zeros(len(g) - WINNOW + 1, np.int64)
    for j in range(1, WINNOW):
        x = g[j : len(g) - WINNOW + 1 + j]
        less = x < low
        low[less], best[less] = x[less], j
    first = np.arange(len(low))
    best = best + first
    whole = at[first + WINNOW - 1] - at[first] == WINNOW - 1  # places are consecutive only inside a document
    keep = np.unique(best[whole])
    return at[keep], g[keep]


class Index:
    """Words, fingerprints and short items of one block of the benchmark."""

    def __init__(self, ids: list[str], texts: list[bytes]):
        buf, off = (b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)) if texts else (b"", np.zeros(1, np.int64))
        self.ids = ids
        self.hash, self.bounds = word_hashes(np.frombuffer(buf, np.uint8), off)
        self.item = flat.doc_of(self.bounds)
        place, fp = winnow(self.hash, self.bounds)
        order = np.argsort(fp, kind="stable")
        self.fp, self.place = fp[order], place[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.diff(self.bounds)
        for n in np.unique(size[(size > 0) & (size < WINDOW)]):
            items = np.flatnonzero(size == n)
            at = self.bounds[items]
            h = flat.UNITS.spans(flat.UNITS.prefix(self.hash), at, at + n)
            order = np.argsort(h, kind="stable")
            self.short[int(n)] = h[order], items[order]

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, item) of the shared runs in a chunk of documents."""
        starts, stops, items = [], [], []
        place, fp = winnow(h, bounds)
        mine, theirs = _matches(fp, self.fp)
        if len(mine):
            p, q = place[mine], self.place[theirs]
            owner, item = np.searchsorted(bounds, p, "right") - 1, self.item[q]
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for side, low, other in ((left, -1, -1), (right, 1, 1)):
                going = np.arange(len(p))
                step = 0 if low > 0 else 1
                while len(going):
                    a, b = p[going] + low * step, q[going] + other * step
                    ok = (a >= bounds[owner[going]]) & (a < bounds[owner[going] + 1]) & (b >= self.bounds[item[going]]) & (b < self.bounds[item[going] + 1])
                    a, b, going = a[ok], b[ok], going[ok]
                    same = h[a] == self.hash[b]
                    going = going[same]
                    side[going] += 1
                    step += 1
            long = left + right >= WINDOW
            starts.append((p - left)[long])
            stops.append((p + right)[long])
            items.append(item[long])
        for n, (hashes, of) in self.short.items():
            g, at = flat.gram_hashes(h, bounds, n)
            mine, theirs = _matches(g, hashes)
            starts.append(at[mine])
            stops.append(at[mine] + n)
            items.append(of[theirs])
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *x]) for x in (starts, stops, items))


def _matches(a: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values; the second array is sorted."""
    lo, hi = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    n = hi - lo
    mine = np.repeat(np.arange(len(a)), n)
    first = np.cumsum(n) - n
    return mine, np.arange(len(mine)) - np.repeat(first, n) + np.repeat(lo, n)


SCHEMA = "row long, doc_id long, n_words long, hits binary, item_ids array<string>"


def _blocks(bench: DataFrame, block_words: int) -> Iterator[Index]:
    """Blocks of whole items; rows arrive one partition at a time, so the driver holds one block."""
    ids, texts, size = [], [], 0
    for r in bench.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(bytes(r["t"]))
        size += len(texts[-1]) // 2 + 1
        if size >= block_words:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    yield Index(ids, texts)


def find_contamination(docs: DataFrame, bench: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_hit, item_ids (distinct, sorted as strings, a null last)."""
    spark = docs.sparkSession
    ship(spark)
    rows = steady(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    passes = []
    for index in _blocks(bench, block_words):
        shared = spark.sparkContext.broadcast(index)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b, buf, off in flat.chunks(batch.column("text")):
                    h, bounds = word_hashes(buf, off)
                    start, stop, item = index.hits(h, bounds)
                    mask = flat.covered(len(h), start, stop)
                    owner = np.searchsorted(bounds, start, "right") - 1
                    pairs = np.unique(owner * len(index.ids) + item) if len(item) else owner
                    names: list[list[str]] = [[] for _ in range(b - a)]
                    for x in pairs.tolist():
                        names[x // len(index.ids)].append(index.ids[x % len(index.ids)])
                    hit = flat.sums(mask, bounds)
                    bits = [np.packbits(mask[bounds[d] : bounds[d + 1]]).tobytes() if hit[d] else b"" for d in range(b - a)]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "hits", "item_ids"])

        passes.append(mapped(rows, run, SCHEMA))
    if len(passes) == 1:
        found = passes[0]
        return found.select("row", "doc_id", "n_words", _ones("hits").alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))
    both = passes[0]
    for more in passes[1:]:
        both = both.unionByName(more)
    return both.groupBy("row").applyInArrow(_merge, "row long, doc_id long, n_words long, n_hit long, item_ids array<string>")


def _ones(col: str):
    """Number of set bits of a binary column."""
    h = F.hex(col)
    count = F.lit(0)
    for bits, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        count = count + F.length(F.regexp_replace(h, f"[^{digits}]", "")) * bits
    return count.cast("long")


def _merge(part: pa.Table) -> pa.Table:
    masks = [np.frombuffer(x, np.uint8) for x in part["hits"].to_pylist() if x]
    n_hit = int(np.unpackbits(np.bitwise_or.reduce(masks)).sum()) if masks else 0
    names = sorted({x for xs in part["item_ids"].to_pylist() for x in xs}, key=lambda x: (x is None, x))
    return pa.table({"row": part["row"][:1], "doc_id": part["doc_id"][:1], "n_words": part["n_words"][:1], "n_hit": pa.array([n_hit], pa.int64()), "item_ids": pa.array([names], pa.list_(pa.string()))})


def contaminated():
    """The contamination rule, over the columns of find_contamination."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, bench: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    A benchmark of one block is judged where the documents are read; beyond it the rows found are taken out by a join.
    """
    ship(docs.sparkSession)
    blocks = _blocks(bench, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        docs, name = steady(docs), hidden(docs, "__row")
        bad = find_contamination(docs, bench, block_words=block_words).where(contaminated()).select(F.col("row").alias(name))
        return docs.withColumn(name, F.monotonically_increasing_id()).join(bad, name, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, buf, off in flat.chunks(batch.column("text")):
                h, bounds = word_hashes(buf, off)
                start, stop, _ = shared.value.hits(h, bounds)
                n = flat.sums(flat.covered(len(h), start, stop), bounds)
                keep.append(~((n > 0) & (20 * n >= np.diff(bounds))))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return mapped(docs, run, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS bw FROM benchmark),
starts AS (SELECT item_id, bw, least(len(bw), {WINDOW}) AS m, unnest(range(1, len(bw) - least(len(bw), {WINDOW}) + 2)) AS i FROM b WHERE len(bw) > 0),
win AS (SELECT DISTINCT item_id, m, list_slice(bw, i, i + m - 1) AS g FROM starts),
places AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m),
hit AS (SELECT doc_id, p.m, i, item_id FROM places p JOIN win ON win.m = p.m AND win.g = list_slice(ws, i, i + p.m - 1)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


def brute_force(docs: list[tuple], bench: list[tuple]) -> dict:
    """Plain Python reading of the contract, for tests: {doc_id: (n_words, n_hit, items, contaminated)}."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for item, text in bench:
        w = split(text)
        size = min(len(w), WINDOW)
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item if item is None else str(item))
    sizes, out = {len(k) for k in windows}, {}
    for doc, text in docs:
        w, hit, items = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        names = ",".join(sorted(x for x in items if x is not None))
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out
