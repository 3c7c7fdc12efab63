"""Decisions and searches in terms of subjects, resources and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgrid.operators.check import check, list_objects
from relgrid.operators.list_users import list_users
from relgrid.plans.model import Model


def merged_context(subject: str = "subject_properties", resource: str = "resource_properties", action: str = "action_properties", request: str = "context"):
    """Properties (MAP<STRING,STRING>) as one JSON context: names get a prefix, the request's own values win."""
    part = lambda c, p: F.transform_keys(F.coalesce(F.col(c), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.concat(F.lit(p), k))
    all_ = F.concat(*(F.map_entries(part(c, p)) for c, p in ((subject, "subject_"), (resource, "resource_"), (action, "action_"), (request, ""))))
    # a later entry wins: keep the last of each key
    keys = F.array_distinct(F.transform(all_, lambda e: e["key"]))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(all_, lambda e: e["key"] == k), -1)["value"])))


def evaluate(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """One decision for each request (action: the relation).

    With properties of subjects, resources or actions (maps), these join the request's own context map.
    """
    parts = ["subject_properties", "resource_properties", "action_properties"]
    if set(parts) & set(requests.columns):
        none = F.lit(None).cast("map<string,string>")
        for c in [*parts, "context"]:
            requests = requests.withColumn(c, F.col(c) if c in requests.columns else none)
        requests = requests.withColumn("context", merged_context()).drop(*parts)
    return check(model, tuples, requests.withColumnRenamed("action", "relation"), contextual).withColumnRenamed("allowed", "decision")


def evaluations(model: Model, tuples: DataFrame, items: DataFrame, semantic: str = "execute_all", contextual: DataFrame | None = None) -> DataFrame:
    """items (batch, item, ...request): all decisions, or those up to the first deny or permit of each batch.

    An error counts as a deny.
    """
    asked = items.withColumn("qid", F.concat_ws(":", F.col("batch").cast("string"), F.col("item").cast("string")))
    out = evaluate(model, tuples, asked, contextual)
    if semantic == "execute_all":
        return out
    stop = {"deny_on_first_deny": ~F.col("decision"), "permit_on_first_permit": F.col("decision")}[semantic]
    before = Window.partitionBy("batch").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("stopped", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))).where("stopped = 0").drop("stopped")


def subject_search(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """requests (qid, object_type, object_id, relation, filter_type) -> (qid, user); usersets are left out."""
    asked = requests.withColumn("filter_relation", F.lit(""))
    return list_users(model, tuples, asked, contextual).where(~F.col("user").contains("#"))


def resource_search(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    return list_objects(model, tuples, requests, contextual)


def action_search(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """requests (qid, object_type, object_id, subject_*) -> (qid, actions): every relation that holds, sorted by name."""
    types = F.create_map(*(x for t, rs in model.types.items() for x in (F.lit(t), F.array(*map(F.lit, sorted(rs))).cast("array<string>"))))
    asked = requests.withColumn("relation", F.explode(types[F.col("object_type")])).withColumn("ask", F.col("qid").cast("string")).withColumn("qid", F.concat_ws(":", "ask", "relation"))
    if contextual is not None:
        contextual = contextual.withColumnRenamed("qid", "ask").join(asked.select("ask", "qid"), "ask").drop("ask")
    held = check(model, tuples, asked, contextual).where("allowed").groupBy("ask").agg(F.array_sort(F.collect_list("relation")).alias("actions"))
    return requests.select(F.col("qid").cast("string").alias("ask")).join(held, "ask", "left").select(F.col("ask").alias("qid"), F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))
