"""Near-duplicate documents by fast similarity sketching, banding and exact verification (operator 2).

A document's set holds its distinct shingles of `width` words (words: runs of characters other than ASCII
white space, A-Z lower-cased); a document of fewer words has its whole sequence as its one shingle, and a
document without words, or a null text, has an empty set and links with nothing.

Sketch: in round i < t each element is thrown into one of t bins with value i + hash; round i >= t throws
every element into bin i - t. A document stops once all bins are full, which the second half guarantees,
so every coordinate is filled, long documents need one round, and estimates concentrate as for sampling
without replacement. Bands of `rows` coordinates give candidates; their number follows from the wanted
chance `miss` of overlooking a link exactly at the threshold. Every link is confirmed on the full sets.

Skew: equal sets are collapsed first (a partial aggregation), so a group of copies is one node. The members
of a bucket are compared with its least member only; those that this leaves in another component are
compared with the centre's whole family, block by block inside tasks that give links alone. So a large
group of near copies costs a star, plus blocks for what the star does not reach. Comparisons with a popular
centre are dealt over salts in proportion to their number.

Rows are told apart by their place, so repeated rows and repeated or null ids do no harm: the id of a
component is the least non-null doc_id in it. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .components import components
from .runtime import hidden, mapped, ship, steady, stored, table

U = np.uint64
ROWS, MISS = 5, 1e-7
PER_SALT = BLOCK = 256
WIDTH = 1 << 16  # elements of a centre that a block of members is multiplied over at a time
FILTER_BITS, FILTER_ROWS = 1 << 26, 1 << 22


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each document, and their bounds."""
    low = flat.LOWER[buf]
    starts, ends, bounds = flat.words(low, off, flat.NOT_SPACE)
    h = flat.BYTES.spans(flat.BYTES.prefix(low), starts, ends)
    g, at = flat.gram_hashes(h, bounds, width)
    doc = np.searchsorted(bounds, at, "right") - 1
    n = np.diff(bounds)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        prefix = flat.UNITS.prefix(h)
        g = np.concatenate([g, flat.UNITS.spans(prefix, bounds[few], bounds[few + 1])])
        doc = np.concatenate([doc, few])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(off)))


def sketch(h: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """t coordinates for each document; a document without elements gets the largest value everywhere."""
    n = len(bounds) - 1
    full = U(2**64 - 1)
    s = np.full(n * t, full, U)
    doc = flat.doc_of(bounds)
    live_doc, live = doc, h
    open_docs = np.diff(bounds) > 0
    for i in range(2 * t):
        if not len(live):
            break
        x = flat.mix(live ^ flat.mix(np.full(1, i + 1, U) * U(0x9E3779B97F4A7C15)))
        value = U(i << 48) | (x >> U(16))
        place = live_doc * t + (((x & U(0xFFFFFFFF)) * U(t)) >> U(32)).astype(np.int64) if i < t else live_doc * t + (i - t)
        np.minimum.at(s, place, value)
        if i >= t - 1 or i < 8 or i % 4 == 0:
            done = (s.reshape(n, t) != full).all(1)
            if (done & open_docs).any():
                open_docs &= ~done
                keep = open_docs[live_doc]
                live_doc, live = live_doc[keep], live[keep]
    return s.reshape(n, t)


def band_hashes(s: np.ndarray, rows: int) -> np.ndarray:
    n, t = s.shape
    odd = flat.mix(np.arange(1, t + 1).astype(U)) | U(1)
    mixed = flat.mix(s ^ odd) * odd
    b = mixed.reshape(n, t // rows, rows).sum(2, dtype=U)
    return flat.mix(b + np.arange(t // rows).astype(U) * U(0x9E3779B97F4A7C15))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame, width: int, n_bands: int, rows: int = ROWS) -> DataFrame:
    """(row, doc_id, n_shingles, sig_a, sig_b, bands): sig_* identify the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in flat.chunks(batch.column("text")):
                h, bounds = shingles(buf, off, width)
                bands = band_hashes(sketch(h, bounds, n_bands * rows), rows).view(np.int64)
                sig = [flat.sums(flat.mix(h ^ U(k)).view(np.int64), bounds) for k in (0x51ED270B, 0xA24BAED4)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * n_bands), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(sig[0]), pa.array(sig[1]), lists], ["row", "doc_id", "n_shingles", "sig_a", "sig_b", "bands"])

    return mapped(_texts(docs), run, "row long, doc_id long, n_shingles long, sig_a long, sig_b long, bands array<long>")


def shingle_sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(row, set) of the given rows, and by chance of some others: ascending 64-bit shingle hashes, as bytes.

    Up to FILTER_ROWS rows are found where texts are read, by a filter of 16 bits a row and FILTER_BITS at most, so
    no text is shuffled, and about one other in sixteen comes along; more rows are met by a join.
    """
    n = rows.count()
    size = min(max(1 << (16 * n).bit_length(), 64), FILTER_BITS)
    slot = F.pmod(F.xxhash64("row"), F.lit(size))
    texts = _texts(docs)
    if n > FILTER_ROWS:
        texts, bits = texts.join(rows, "row", "left_semi"), np.full(size // 64, -1)
    else:
        masks = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()  # size / 64 rows at most
        bits = np.zeros(size // 64, np.int64)
        bits[masks["word"].to_numpy()] = masks["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((shared.value[slot >> 6] >> (slot & 63)) & 1 == 1))
            for a, b, buf, off in flat.chunks(batch.column("text")):
                h, bounds = shingles(buf, off, width)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((bounds * 8).astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), raw.cast(pa.binary())], ["row", "set"])

    return mapped(texts.select("row", slot.alias("slot"), "text"), run, "row long, set binary")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, both, all, bits, extra): sizes of intersection and union, and u's set told by v's:
    which of v's elements it holds, and those it has besides."""
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    dealt = pairs.join(salts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    left = dealt.join(sets.select(F.col("row").alias("u"), F.col("set").alias("set_u")), "u")
    right = salts.join(sets.select(F.col("row").alias("v"), F.col("set").alias("set_v")), "v").select("v", "set_v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, whole, bits, extra = [], [], [], []
            for x, y in zip(*(flat.as_binary(batch.column(k)) for k in ("set_u", "set_v")), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), U) for z in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = y[at] == x
                held = np.zeros(len(y), bool)
                held[at[shared]] = True
                both.append(int(shared.sum()))
                whole.append(len(x) + len(y) - both[-1])
                bits.append(np.packbits(held).tobytes())
                extra.append(x[~shared].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(both, pa.int64()), pa.array(whole, pa.int64()), pa.array(bits, pa.binary()), pa.array(extra, pa.binary())], ["u", "v", "both", "all", "bits", "extra"])

    return mapped(left.join(right, ["v", "salt"]).select("u", "v", "set_u", "set_v"), run, "u long, v long, both long, all long, bits binary, extra binary")


def missing_links(star: DataFrame, percent: int) -> DataFrame:
    """Links inside families beyond those to their centres.

    star: (u, v, both, all, bits, extra, u_of, v_of), a row for each member u of the family of centre v, with its
    set told by the centre's and the components that both are in so far. Members outside their centre's
    component (probes) are compared with all members of other components; blocks of probes meet blocks of
    members in one task each, and a task gives one link for a probe and a component at most, so no pairs are
    listed. As near copies hardly differ from their centre, what is sent is a small part of the sets.
    """
    sizes = star.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("member_blocks"), F.ceil(F.count_if(F.col("u_of") != F.col("v_of")) / BLOCK).cast("int").alias("probe_blocks")).where("probe_blocks > 0")
    full = star.join(sizes, "v").withColumn("apart", F.col("u_of") != F.col("v_of"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    cols = ["v", "i", "j", "probe", "u", F.col("u_of").alias("of"), "apart", "both", "bits", "extra"]
    probes = full.where("apart").withColumn("i", own("probe_blocks")).withColumn("j", upto("member_blocks")).withColumn("probe", F.lit(True)).select(*cols)
    members = full.withColumn("j", own("member_blocks")).withColumn("i", upto("probe_blocks")).withColumn("probe", F.lit(False)).select(*cols)

    def run(group: pa.Table) -> pa.Table:
        probe = group["probe"].to_numpy(zero_copy_only=False)
        u, of, apart, both = (group[k].to_numpy(zero_copy_only=False) for k in ("u", "of", "apart", "both"))
        extra = [np.frombuffer(x.as_buffer(), U) for x in flat.as_binary(group["extra"])]
        size = both + np.array([len(x) for x in extra])
        xs, ys = np.flatnonzero(probe), np.flatnonzero(~probe)
        packed = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in flat.as_binary(group["bits"])])
        inside = np.zeros((len(xs), len(ys)), np.int64)
        for at in range(0, packed.shape[1], WIDTH // 8):
            held = np.unpackbits(packed[:, at : at + WIDTH // 8], axis=1).astype(np.float32)
            inside += np.rint(held[xs] @ held[ys].T).astype(np.int64)  # counts below 2**24 are exact
        values = np.concatenate([np.zeros(0, U), *(extra[y] for y in ys)])
        owner = np.repeat(np.arange(len(ys)), [len(extra[y]) for y in ys])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        found = []
        for k, x in enumerate(xs):
            lo, hi = np.searchsorted(values, extra[x], "left"), np.searchsorted(values, extra[x], "right")
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            common = inside[k] + np.bincount(owner[at], minlength=len(ys))
            ok = (100 * common >= percent * (size[ys] + size[x] - common)) & (of[ys] != of[x]) & (~apart[ys] | (u[ys] > u[x]))
            hit = np.flatnonzero(ok)
            _, first = np.unique(of[ys[hit]], return_index=True)
            found += [(int(u[x]), int(u[ys[h]])) for h in hit[first]]
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    # dealt by block, for blocks of one centre would otherwise stay where its rows have met; by a given number, for
    # their work follows rows and not bytes
    parts = int(star.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probes.unionByName(members).repartition(parts, "v", "i", "j").groupBy("v", "i", "j").applyInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row for each input row: row, doc_id, n_shingles, component (a row of its group), component_id (least
    doc_id of its group).

    Rows are known by their place and read twice, so what is not a plain scan is stored first.
    """
    ship(docs.sparkSession)
    docs = steady(docs)
    known = stored(sketches(docs, width, bands_for(percent / 100, rows, miss), rows), "sketches")
    classes = known.where("n_shingles > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"))
    classes = stored(classes, "classes")
    nodes = known.join(classes.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), F.explode("bands").alias("bucket"))
    crowd = nodes.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = nodes.join(crowd, "bucket").where("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct()
    star = stored(star, "candidates")
    need = star.select(F.col("u").alias("row")).union(star.select(F.col("v").alias("row"))).distinct()
    sets = stored(shingle_sets(docs, need, width), "shingle-sets")
    measured = stored(similarities(star, sets), "similarities")
    links = measured.where(f"100 * both >= {percent} * all").select("u", "v")
    joined = components(links)

    # members that the star left outside their centre's component meet the rest of their family
    of = lambda name: joined.select(F.col("node").alias(name), F.col("component").alias(f"{name}_of"))
    placed = measured.join(of("u"), "u", "left").join(of("v"), "v", "left")
    placed = placed.select("u", "v", "both", "bits", "extra", F.coalesce("u_of", "u").alias("u_of"), F.coalesce("v_of", "v").alias("v_of"))
    more = stored(missing_links(placed, percent), "links")
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    reps = classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig_a", "sig_b", "n_shingles", "least_id", F.coalesce("component", "rep").alias("component"))
    least = reps.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = reps.join(least, "component").select("sig_a", "sig_b", "n_shingles", "component", "component_id")
    full = known.select("row", "doc_id", "n_shingles", "sig_a", "sig_b")
    linked = full.join(named, ["sig_a", "sig_b", "n_shingles"], "left")
    return linked.select("row", "doc_id", "n_shingles", F.coalesce("component", "row").alias("component"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, least(len(ws), 3) AS m, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + m - 1) AS g FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, y FROM reach JOIN link ON x = r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near duplicates, that of least id, and of equal ids the first row; null ids come last."""
    docs, name = steady(docs), hidden(docs, "__row")
    found = near_duplicates(docs, **options).select("row", "component", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("order"))
    kept = found.groupBy("component").agg(F.min("order").alias("order")).select(F.col("order.row").alias(name))
    return docs.withColumn(name, F.monotonically_increasing_id()).join(kept, name, "left_semi").select(*docs.columns)


def brute_force(docs: list[tuple], width: int, percent: int) -> dict:
    """All-pairs reading of the contract for tests: {doc_id: (n_shingles, component_id)}."""
    import re

    sets = {}
    for doc, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    index: dict = {}
    for d in ids:
        near = {}
        for s in sets[d]:
            for other in index.get(s, ()):
                near[other] = near.get(other, 0) + 1
            index.setdefault(s, []).append(d)
        for other, both in near.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[other]) - both):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}
