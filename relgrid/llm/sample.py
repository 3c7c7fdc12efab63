"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where=None) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled rows, chosen by a hash of the id.

    Rows with a null id or label are left out, of several labels of one id the largest holds, and of several
    texts of one id that of the least hash. The sample is the only thing bounded here: it feeds a classifier's
    fit and nothing else.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text")
    # at most `limit` ids of 8 bytes: a bound that does not grow with the input
    found = texts.join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    return one.select("doc_id", F.col("t.text").alias("text"), "label")
