"""Mixing sources to target weights (operator 6).

Shares of tokens by source are raised to an exponent and normalised. The exponent is the least in [0, 1]
whose mixture has at most the target entropy (a part of the logarithm of the number of sources) and
repeats no source more often than `max_repeats` times; it is bisected, four levels in each aggregation over
the table of sources, so nothing is collected but a handful of sums. If even the natural shares exceed the
target they are used as they are.

The weights are realised as a block permutation: each source's documents fall into BLOCKS blocks by a
hash, and the blocks are permuted by another. A source with budget b and t tokens is taken whole
floor(b / t) times; of the rest, blocks are taken in permuted order while they fit, and the documents of
the first block that does not fit, in the order of their hashes, while they fit. No source exceeds its
budget, and it misses it by less than one document. Only block totals and one block a source are put in
order, so a source of any size is dealt over all tasks.

A null source is a source of its own; documents without words take no budget, and a source without words
is not taken. Repeated rows are chosen one by one: hashes cover a row's place, so docs should be a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat
from .runtime import mapped, steady, stored, table

BLOCKS, SEED = 4096, 20240
TARGET_ENTROPY, MAX_REPEATS = 0.98, 4.0
BROADCAST_ROWS = 250_000


def measured(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, n_tokens): tokens are words between ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(flat.words(buf, off, flat.NOT_SPACE)[2]) for _, _, buf, off in flat.chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["row", "doc_id", "source", "n_tokens"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    return mapped(rows, run, "row long, doc_id long, source string, n_tokens long")


def _keyed(df: DataFrame) -> DataFrame:
    """Adds the source's key (null and empty differ), a document's hash and its block."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))
    h = F.xxhash64(F.lit(SEED), "doc_id", "row")
    return df.withColumn("key", key).withColumn("h", h).withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "h"), F.lit(BLOCKS)).cast("int"))


def exponent(totals: DataFrame, budget: float, target_entropy: float, max_repeats: float, rounds: int = 8) -> float:
    """The least exponent that meets both limits; totals holds `tokens` (positive) by source."""
    all_tokens, n = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(all_tokens))
    target = target_entropy * float(np.log(n))
    lo, hi, slots = 0.0, 1.0, 15
    for k in range(rounds):
        tried = np.linspace(lo, hi, slots + 2)[0 if k == 0 else 1 : -1]
        sums = []
        for i, a in enumerate(tried):
            sums += [F.sum(F.pow(p, F.lit(float(a)))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(float(a))) * F.log(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(float(a) - 1))).alias(f"m{i}")]
        r = totals.agg(*sums).first()
        fits = [float(np.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"]) <= target and budget / all_tokens * r[f"m{i}"] / r[f"z{i}"] <= max_repeats for i, a in enumerate(tried)]
        first = next((i for i, ok in enumerate(fits) if ok), len(tried))
        if k == 0 and first == 0:
            return 0.0
        lo, hi = (float(tried[first - 1]) if first else lo), (float(tried[first]) if first < len(tried) else hi)
    return hi


def decide(docs: DataFrame, *, budget: float | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(measured documents, decisions by source and block): whole repeats, and what of a further one is taken."""
    known = _keyed(stored(measured(docs), "measured"))
    blocks = stored(known.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = stored(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sources")
    positive = totals.where("tokens > 0")
    all_tokens = positive.agg(F.sum("tokens")).first()[0] or 0
    budget = float(all_tokens) if budget is None else float(budget)
    a = exponent(positive, budget, target_entropy, max_repeats)
    p = F.pow(F.col("tokens") / F.lit(float(all_tokens or 1)), F.lit(a))
    z = positive.agg(F.sum(p)).first()[0] or 1.0
    wanted = F.col("weight") * F.lit(budget)
    plan = totals.withColumn("weight", F.when(F.col("tokens") > 0, p / F.lit(z)).otherwise(0.0))
    plan = plan.withColumn("repeats", F.when(F.col("tokens") > 0, F.floor(wanted / F.col("tokens") + 1e-9)).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(wanted - F.col("repeats") * F.col("tokens"), F.lit(0.0))).drop("tokens")
    order = F.xxhash64(F.lit(SEED + 2), "key", "block")
    line = Window.partitionBy("key").orderBy(order, "block")  # BLOCKS rows a source at most
    placed = blocks.join(plan, "key").withColumn("place", F.row_number().over(line)).withColumn("upto", F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.min(F.when(F.col("upto") > F.col("rest"), F.col("place"))).over(Window.partitionBy("key"))
    placed = stored(placed.withColumn("edge", edge), "placed")
    cut_blocks = placed.where("place = edge and rest > 0").select("key", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))
    inside = Window.partitionBy("key").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)  # one block of each source
    cuts = known.join(cut_blocks, ["key", "block"]).withColumn("sum", F.sum("n_tokens").over(inside)).where("sum <= left")
    cuts = cuts.groupBy("key").agg(F.max(F.struct("h", "row")).alias("cut"))
    decisions = placed.join(cuts, "key", "left").select("key", "block", "weight", "repeats", "place", F.when(F.col("edge").isNull() | (F.col("place") < F.col("edge")), "all").when(F.col("place") == F.col("edge"), "some").otherwise("none").alias("further"), "cut")
    decisions = stored(decisions.withColumn("further", F.when(F.col("weight") > 0, F.col("further")).otherwise("none")), "decisions")
    if decisions.count() <= BROADCAST_ROWS:
        decisions = F.broadcast(decisions)
    return known, decisions


def _copies():
    whole = F.col("further") == "all"
    part = (F.col("further") == "some") & F.coalesce(F.struct("h", "row") <= F.col("cut"), F.lit(False))
    return (F.col("repeats") + F.when(whole | part, 1).otherwise(0)).cast("long")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row for each input row: its source's weight, its block's place in the permutation, and its copies."""
    known, decisions = decide(docs, **options)
    return known.join(decisions, ["key", "block"]).select("doc_id", "source", "n_tokens", "weight", "block", F.col("place").alias("block_place"), _copies().alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mixture takes it."""
    docs = steady(docs)
    _, decisions = decide(docs, **options)
    # the document travels as one column, so its columns' names cannot clash with ours
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("row"))
    chosen = _keyed(whole).join(decisions, ["key", "block"]).withColumn("copies", _copies()).where("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
