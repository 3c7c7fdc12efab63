"""Secrets in texts, with DataFrame functions only (operator 5).

Base kinds, leftmost and not overlapping within a kind, positions in code points, ends exclusive:

- assign: a password-like name, optional quotes and spaces around : or =, and a value of 6 characters or more
- access: AKIA and capitals or digits, 20 characters or more together
- hex: 24 or more of 0-9 a-f

The method adds spans of kind markov: runs of 16 or more characters of [A-Za-z0-9+/_=-] that touch no base
span and that a first-order Markov model of random strings explains better than one of ordinary
identifiers, by a log-likelihood ratio of at least MIN_RATIO and MIN_RATE for each character. Both models
are learned from a bounded sample of documents, labelled by rules: values that the base rules find are random
strings, other runs whose digits, if any, are a short number at the end are identifiers. Transitions are smoothed towards single
characters, and those of random strings mixed evenly with uniform ones, so that secrets over other alphabets
than the labelled ones are known as well.

Matches of a pattern and the gaps between them (a split by the same pattern) give positions. A null text
counts as empty and has no spans; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

# fixed values: the rules' patterns, in the order of the kinds
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run matches whole or, being too short, not at all
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"^[^0-9]+[0-9]{0,4}$"  # digits, if any, are a short number at the end
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCS, SMOOTHING, MIN_RATIO, MIN_RATE = 16_384, 33.0, 12.0, 0.6
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def placed(text: Column, pattern: str, kind: int) -> Column:
    """All matches of the pattern with their positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["value"])
        span = F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds __text (nulls empty) and __base, the base spans in order."""
    out = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        out = out.withColumn(f"__{KINDS[k]}", placed(F.col("__text"), pattern, k))
    assign = F.filter("__assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    access = F.filter("__access", lambda s: s["end"] - s["start"] >= 20)
    out = out.withColumn("__assign", assign).withColumn("__access", access)
    return out.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex"))).drop("__assign", "__access", "__hex")


def candidates(scanned: DataFrame) -> DataFrame:
    """Adds __runs, the long runs that touch no base span."""
    runs = placed(F.col("__text"), RUN, 3)
    base = F.col("__base")
    free = F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return scanned.withColumn("__runs", F.when(F.col("__text").rlike(RUN), free).otherwise(F.array().cast(SPAN)))


def _codes(value: Column) -> Column:
    """Places in ALPHABET, from 1; 0 for anything else."""
    return F.transform(F.split(value, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _pairs(value: Column) -> Column:
    codes = _codes(value)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * (len(ALPHABET) + 1) + b)


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Log-likelihood ratios by transition, rounded, learned from at most sample_docs documents."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = candidates(base_spans(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")))  # ids: sample_docs at most
    strings = F.concat(
        F.transform("__base", lambda s: F.struct(F.lit(1).alias("random"), F.coalesce(F.nullif(F.regexp_extract(s["value"], ASSIGN, 1), F.lit("")), s["value"]).alias("value"))),
        F.transform(F.filter("__runs", lambda s: s["value"].rlike(IDENTIFIER)), lambda s: F.struct(F.lit(0).alias("random"), s["value"].alias("value"))),
    )
    counts = some.select(F.explode(strings).alias("s")).select("s.random", F.explode(_pairs(F.col("s.value"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    size = len(ALPHABET) + 1
    n = np.zeros((2, size, size))
    for r in counts.collect():  # at most 2 * size**2 rows
        n[r["random"]].flat[r["pair"]] = r["n"]
    single = (n.sum(1) + 1) / (n.sum((1, 2)) + size)[:, None]
    p = (n + SMOOTHING * single[:, None, :]) / (n.sum(2, keepdims=True) + SMOOTHING)
    p[1] = (p[1] + 1 / size) / 2
    return np.round(np.log(p[1] / p[0]), 3)


def scan(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Adds `spans`, array of (start, end, kind number, value) by start and kind, and `base_spans`.

    Columns of these names are replaced, and names of ours (__text, __base, __runs, __more and the kinds) are taken.
    A text of any length is one row; its spans are gathered one after the other, so time grows with the square of
    the spans in a single text.
    """
    table_of = F.split(F.lit(",".join(f"{x:g}" for x in ratios.ravel())), ",").cast("array<double>")  # folded to one literal
    found = candidates(base_spans(docs))

    def likely(r: Column) -> Column:
        ratio = F.aggregate(_pairs(r["value"]), F.lit(0.0), lambda acc, p: acc + F.element_at(table_of, (p + 1).cast("int")))
        return ratio >= F.greatest(F.lit(MIN_RATIO), F.lit(MIN_RATE) * (r["end"] - r["start"] - 1))

    found = found.withColumn("__more", F.filter("__runs", likely))
    return found.withColumn("base_spans", F.col("__base")).withColumn("spans", F.array_sort(F.concat("__base", "__more"))).drop("__text", "__base", "__runs", "__more")


def _joined(spans: str) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(_in_order(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(spans: str) -> Column:
    """By start, then by kind as listed."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
