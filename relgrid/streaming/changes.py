"""The change log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relgrid.sources.store import CHANGES, DELETE, KEY


def stream_changes(spark: SparkSession, path: str, *, object_type: str = "", after: str = "") -> DataFrame:
    """New files of a change log as they come; resumes from the query's own checkpoint."""
    rows = spark.readStream.schema(CHANGES).parquet(path)
    rows = rows.where(F.col("object_type") == object_type) if object_type else rows
    return rows.where(F.col("ulid") > after) if after else rows


def net_changes(batch: DataFrame) -> DataFrame:
    """The last change of each key in a batch."""
    last = F.max_by(F.struct("operation", "condition_name", "condition_context", "ulid", "inserted_at"), "ulid").alias("last")
    return batch.groupBy(*KEY).agg(last).select(*KEY, "last.*")


def applied(tuples: DataFrame, batch: DataFrame) -> DataFrame:
    """Tuples after a batch of changes."""
    net = net_changes(batch)
    kept = tuples.join(net.select(*KEY), KEY, "left_anti")
    return kept.unionByName(net.where(f"operation <> {DELETE}").drop("operation"), allowMissingColumns=True)


def invalidated(batch: DataFrame) -> DataFrame:
    """What a batch makes stale: object#relation, and the subject with the object's type."""
    return batch.select("object_type", "object_id", "relation", "subject_type", "subject_id", "subject_relation").distinct()


def follow(changes: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], *, once: bool = True) -> StreamingQuery:
    """Run `each` on the net changes of every batch."""
    out = changes.writeStream.foreachBatch(lambda df, n: each(net_changes(df), n)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
