"""Expand: one level of the expression behind a relation, with its direct users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrid.functions.identifiers import join_object, join_user
from relgrid.operators.evaluate import direct_filter, few, with_contextual
from relgrid.plans.model import Computed, Difference, Intersection, Model, This, Union, children


def _nodes(e, path: str = ""):
    yield path or "/", e
    for i, c in enumerate(children(e)):
        yield from _nodes(c, f"{path}/{i}")


def expand(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """requests (qid, object_type, object_id, relation) -> one row a tree node: qid, path, kind, users.

    kind: union, intersection, difference, direct, computed, or tuple_to_userset. users: sorted distinct users of
    a direct leaf (conditions are not evaluated), or the usersets a computed or tuple-to-userset leaf leads to.
    """
    rows, out = with_contextual(tuples, contextual), None
    pairs = few(requests.select("object_type", "relation"))
    none = F.array().cast("array<string>")
    for t, r in sorted((p[0], p[1]) for p in pairs):
        rel = model.need(t, r)
        mine = requests.where((F.col("object_type") == t) & (F.col("relation") == r)).select("qid", "object_id")
        for path, e in _nodes(rel.rewrite):
            if isinstance(e, This):
                found = rows.where(direct_filter(model, t, r)).join(mine, "object_id").where("ctx is null or ctx = cast(qid as string)")
                leaf = found.groupBy("qid").agg(F.array_sort(F.collect_set(join_user())).alias("users"))
                node = mine.select("qid").join(leaf, "qid", "left").select("qid", F.lit("direct").alias("kind"), F.coalesce("users", none).alias("users"))
            elif isinstance(e, Computed):
                node = mine.select("qid", F.lit("computed").alias("kind"), F.array(F.concat(join_object(F.lit(t), "object_id"), F.lit(f"#{e.relation}"))).alias("users"))
            elif isinstance(e, (Union, Intersection, Difference)):
                node = mine.select("qid", F.lit(type(e).__name__.lower()).alias("kind"), none.alias("users"))
            else:
                kinds = sorted({x.type for x in model.types[t][e.tupleset].restrictions if model.relation(x.type, e.relation)})
                found = rows.where(direct_filter(model, t, e.tupleset) & F.col("subject_type").isin(*kinds)).join(mine, "object_id").where("ctx is null or ctx = cast(qid as string)")
                leaf = found.groupBy("qid").agg(F.array_sort(F.collect_set(F.concat(join_object("subject_type", "subject_id"), F.lit(f"#{e.relation}")))).alias("users"))
                node = mine.select("qid").join(leaf, "qid", "left").select("qid", F.lit("tuple_to_userset").alias("kind"), F.coalesce("users", none).alias("users"))
            node = node.select("qid", F.lit(path).alias("path"), "kind", "users")
            out = node if out is None else out.unionByName(node)
    return out if out is not None else requests.select("qid", F.lit("").alias("path"), F.lit("").alias("kind"), none.alias("users")).limit(0)
