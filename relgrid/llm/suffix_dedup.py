"""Removal of repeated long byte strings with suffix arrays (operator 4).

Every byte covered by a string of LENGTH bytes that also starts at another place, in the same document or
another, is removed. Matches never cross documents and are judged on the input.

One suffix array of a corpus cannot be built, so places are dealt to shards by content: of each window of
LENGTH bytes the least GRAM-byte hash is its anchor, and equal windows have equal anchors at equal places.
An anchor's context is what the windows with this anchor cover, so every window of the corpus lies in one
context. Contexts are first counted by two independent 64-bit hashes:

- a context that occurs twice is repeated as a whole, however many copies there are, and needs no array;
- an anchor with several different contexts sends one copy of each to its shard, where an array over them
  (induced sorting, then permuted common prefixes) finds the windows they share;
- anchors seen once have nothing to share.

So only the surroundings of differences between copies are sorted, and a passage that a third of all
documents repeats costs counts alone. An anchor with more than HOT different contexts would fill a task: its
windows are dealt again by where in them the anchor stands, in runs of 64 places, then 8, then 1. All windows
of such a run share the bytes around the anchor that the run's first and last window have in common, and
these are the key of the next round, which counts and sorts what is still together. So no group holds more than
HOT contexts, which bounds a task's memory, as do shards of about SHARD_BYTES.

Texts cross the network once, those with hits a second time. Null and empty texts give rows of zeros, and the
digest of nothing; repeated rows are told apart by their place and all removed where they repeat; a document
must fit a task's memory some forty times over; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .runtime import forget, mapped, ship, steady, stored, table
from .suffix_array import repeated_starts

U = np.uint64
LENGTH, GRAM = 400, 32
SHARD_BYTES = 1 << 19
HOT = 2048
WIDE = U(0x9E3779B97F4A7C15)


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its least, leftmost one, by the upper 32 bits."""
    key = (g >> U(32) << U(32)) | np.arange(len(g)).astype(U)
    rows = -(-len(key) // width)
    grid = np.full(rows * width, U(2**64 - 1))
    grid[: len(key)] = key
    grid = grid.reshape(rows, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return (np.minimum(onward[:n], upto[width - 1 : width - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)


def _context(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes a..b and of where in them the anchor stands."""
    ctx = flat.BYTES.spans(one, a, b) + before.astype(U) * WIDE
    return flat.mix(ctx), flat.BYTES2.spans(two, a, b) ^ flat.mix(before.astype(U) + U(5))


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Document, place, bytes before and after, anchor hash and two context hashes, of each anchor."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    if not (size >= length).any():
        return none, none, none, none, none, none, none
    one, two = flat.BYTES.prefix(buf), flat.BYTES2.prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    best = least_places(flat.BYTES.spans(one, at, at + gram), length - gram + 1)
    doc_end = np.repeat(off[1:], size)
    begin = np.flatnonzero(np.arange(len(best)) + length <= doc_end[: len(best)])
    flag = np.zeros(len(buf), bool)
    flag[best[begin]] = True
    p = np.flatnonzero(flag)
    doc = np.searchsorted(off, p, "right") - 1
    # windows of one anchor follow each other, for least places never go back
    mine = best[begin]
    a, b = begin[np.searchsorted(mine, p, "left")], begin[np.searchsorted(mine, p, "right") - 1] + length
    return doc, p - off[doc], p - a, b - p, flat.BYTES2.spans(two, p, p + gram), *_context(one, two, a, b, p - a)


ANCHOR_ROWS = "row long, anchor long, ctx long, ctx2 long, place long"
KEY = ["anchor", "ctx", "ctx2"]


def _packed(row: np.ndarray, p: np.ndarray, before: np.ndarray, after: np.ndarray, hashes) -> pa.RecordBatch:
    """place packs the anchor's place, bytes before and bytes from it on."""
    return pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(h.view(np.int64)) for h in hashes), pa.array(p << 24 | before << 12 | after)], ["row", *KEY, "place"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy(zero_copy_only=False)
            for i, _, buf, off in flat.chunks(batch.column("text")):
                doc, p, before, after, *hashes = anchors(buf, off, length, gram)
                yield _packed(row[i + doc], p, before, after, hashes)

    return mapped(_texts(docs).select("row", "text"), run, ANCHOR_ROWS)


def refined(contexts: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """contexts (row, text, wanted: list of at (a, b) and p) -> anchor rows of runs of `width` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column("row").to_numpy(zero_copy_only=False), batch.column("wanted")
            for i, j, buf, off in flat.chunks(batch.column("text")):
                some = lists.slice(i, j - i)
                item, n = some.flatten(), np.diff(some.offsets.to_numpy())
                doc = np.repeat(np.arange(j - i), n)
                p, at = item.field("p").to_numpy(), item.field("at")
                # in how many places of the window the anchor stands, least and most
                least, most = p - (at.field("b").to_numpy() - length), p - at.field("a").to_numpy()
                runs = most // width - least // width + 1
                pick = np.repeat(np.arange(len(p)), runs)
                k = np.arange(len(pick)) - np.repeat(np.cumsum(runs) - runs, runs) + (least // width)[pick]
                lo, hi = np.maximum(least[pick], k * width), np.minimum(most[pick], k * width + width - 1)
                place, base = p[pick], off[doc[pick]]
                q = place + base
                one, two = flat.BYTES.prefix(buf), flat.BYTES2.prefix(buf)
                common = flat.BYTES2.spans(two, q - k * width, q - np.minimum(k * width + width - 1, length - gram) + length)
                key = flat.mix(common + k.astype(U) * WIDE + U(width))
                yield _packed(rows[i + doc[pick]], place, hi, length - lo, (key, *_context(one, two, q - hi, q - lo + length, hi)))

    return mapped(contexts.select("row", "text", "wanted"), run, ANCHOR_ROWS)


SPAN = "row long, a int, b int"


def shared_spans(contexts: DataFrame, length: int) -> DataFrame:
    """contexts (anchor, row, a, bytes) -> (row, a, b): what another context of the anchor repeats, as spans of the row's text."""
    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            mark = repeated_starts([h[3] for h in held], length)
            edges = np.concatenate([[0], np.cumsum([len(h[3]) for h in held])])
            s = np.flatnonzero(mark)
            part = np.searchsorted(edges, s, "right") - 1
            first = np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), (np.diff(s) > length) | (np.diff(part) > 0)]))
            last = np.append(first[1:], len(s)) - 1 if len(first) else first
            of = part[first]
            row, a = np.array([h[1] for h in held], np.int64)[of], np.array([h[2] for h in held], np.int64)[of] - edges[of]
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array((s[first] + a).astype(np.int32)), pa.array((s[last] + a + length).astype(np.int32))], ["row", "a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in ("anchor", "row", "a", "bytes")), strict=True):
                if size >= SHARD_BYTES and r[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield done()

    return mapped(ordered, run, SPAN)


def _hits(found: DataFrame) -> DataFrame:
    """Of the stored anchor rows those of anchors that occur twice, with a, b, p, n (times the context occurs), kinds
    (contexts of the anchor) and first; the rest is deleted."""
    groups = stored(found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("row").alias("first")), "contexts")
    more = groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    known = stored(groups.join(more.drop("all"), "anchor"), "repeated")
    place, before, after = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095), F.col("place").bitwiseAND(4095)
    hits = stored(found.join(known, KEY).select("row", *KEY, "n", "kinds", "first", place.alias("p"), (place - before).cast("int").alias("a"), (place + after).cast("int").alias("b")), "hits")
    forget(found, groups, known)
    return hits


def _wanted(hits: DataFrame) -> DataFrame:
    """(row, wanted): by document, one copy of each context of the anchors that have several."""
    one = hits.where("kinds > 1 and row = first").groupBy(*KEY, "row", "kinds").agg(F.min(F.struct("a", "b", "p")).alias("m"))
    item = F.struct("anchor", "kinds", F.struct("m.a", "m.b").alias("at"), F.col("m.p").alias("p"))
    return one.groupBy("row").agg(F.collect_list(item).alias("wanted"))  # within one document


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not 0 < gram <= length < 2048:
        raise ValueError("lengths are packed into 12 bits: 0 < gram <= length < 2048")
    spark = docs.sparkSession
    ship(spark)
    docs = steady(docs)
    hits = _hits(stored(_anchor_rows(docs, length, gram), "anchors"))
    marks = hits.select("row").distinct().join(_wanted(hits), "row", "left").withColumn("touched", F.lit(True))
    split = _texts(docs).join(marks, "row", "left")
    split = stored(split.select("row", "doc_id", F.length("text").cast("long").alias("n_bytes"), F.when(F.col("touched"), F.col("text")).alias("text"), F.when(F.col("touched").isNull(), F.sha2("text", 256)).alias("whole_sha256"), "wanted"), "split")
    wanted, spans = split.where("wanted is not null").select("row", "text", "wanted"), []
    widths = [w for w in (512, 64, 8, 1) if 4 * w < length - gram + 1]
    while True:
        spans.append(hits.where("n > 1").select("row", "a", "b"))
        pieces = wanted.select("row", "text", F.explode(F.filter("wanted", lambda w: w.kinds <= hot)).alias("w"))
        pieces = pieces.select("w.anchor", "row", F.col("w.at.a").alias("a"), F.expr("substring(text, w.at.a + 1, w.at.b - w.at.a)").alias("bytes"))
        spans.append(stored(shared_spans(pieces, length), "shared"))
        crowded = wanted.withColumn("wanted", F.filter("wanted", lambda w: w.kinds > hot)).where("size(wanted) > 0")
        if not widths or hits.where(F.col("kinds") > hot).isEmpty():
            break
        hits = _hits(stored(refined(crowded, length, gram, widths.pop(0)), "anchors"))
        wanted = split.select("row", "text").join(_wanted(hits), "row")
    every = spans[0]
    for x in spans[1:]:
        every = every.union(x)
    by_doc = every.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # within one document
    left = split.where("text is not null").select("row", "doc_id", "n_bytes", "text").join(by_doc, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digest = [], [], []
            for text, spans in zip(flat.as_binary(batch.column("text")), batch.column("spans"), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                if not spans.is_valid:
                    gone = np.zeros(len(raw), bool)
                else:
                    ab = spans.values
                    gone = flat.covered(len(raw), ab.field("a").to_numpy(), ab.field("b").to_numpy())
                removed.append(int(gone.sum()))
                runs.append(int((gone[1:] & ~gone[:-1]).sum() + (len(gone) and gone[0])))
                digest.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = mapped(left, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = split.where("text is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("whole_sha256").alias("kept_sha256"))
    return out.union(rest)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: equality of windows is equality of 64-bit hashes here as well
ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, hash(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
cuts AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS cut FROM hit),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS z FROM (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cuts) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, z + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1e15::BIGINT) - 1 AS z FROM runs UNION ALL SELECT doc_id, 1, min(a) - 1 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[a:z]), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id) WHERE a <= z AND a <= octet_length(b) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS s FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(x, '')) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def brute_force(docs: list[tuple], length: int = LENGTH) -> dict:
    """Contract by a table of all windows, for tests: {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    raw = {d: (t or "").encode() if not isinstance(t, bytes) else t for d, t in docs}
    seen: dict[int, int] = {}
    hashes = {}
    for d, t in raw.items():
        hashes[d] = [hash(t[i : i + length]) for i in range(len(t) - length + 1)]
        for h in hashes[d]:
            seen[h] = seen.get(h, 0) + 1
    out = {}
    for d, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i, h in enumerate(hashes[d]):
            if seen[h] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) and gone[0]))
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out
