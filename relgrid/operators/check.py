"""Check, BatchCheck and ListObjects over tables of requests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgrid.functions.identifiers import join_object
from relgrid.operators.evaluate import VALUE, Evaluator, few, with_contextual
from relgrid.plans.model import Model, ModelError


def _by_subject(requests: DataFrame, contextual: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Requests with `__sid`, which names their subject and context; seeds and contexts, one row for each of those.

    Contextual tuples belong to single requests, which then are evaluated one by one.
    """
    requests = requests.withColumn("subject_relation", F.coalesce("subject_relation", F.lit("")))
    parts = ["subject_type", "subject_id", "subject_relation", *(["context"] if "context" in requests.columns else [])]
    requests = requests.withColumn("__sid", F.to_json(F.struct(*parts)) if contextual is None else F.col("qid").cast("string"))
    seeds = requests.select(F.col("__sid").alias("qid"), *parts).distinct()
    return requests, seeds, seeds.select("qid", "context").distinct() if "context" in parts else None


def _targets(requests: DataFrame) -> list[tuple[str, str]]:
    """The (type, relation) pairs asked for, of which a model has few."""
    return sorted((r[0], r[1]) for r in few(requests.select("object_type", "relation")))


def check(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None, *, max_depth: int | None = None) -> DataFrame:
    """requests (qid, object_type, object_id, relation, subject_type, subject_id, subject_relation[, context]) plus
    allowed and failed; failed: undecided because a condition could not be evaluated.

    Subjects with equal contexts are evaluated once, and only for the objects that are asked for: the work follows
    the requests and the tuples of their objects. Unknown types and relations raise ModelError.
    """
    rows, out = with_contextual(tuples, contextual), None
    columns = requests.columns
    requests, _, _ = _by_subject(requests, contextual)
    for t, r in _targets(requests):
        model.need(t, r)
        mine, seeds, contexts = _by_subject(requests.where((F.col("object_type") == t) & (F.col("relation") == r)), contextual)
        e = Evaluator(model, rows, seeds, contexts, max_depth=max_depth)
        e.demand((t, r), mine.select(F.col("__sid").alias("qid"), "object_id"))
        answer = _marked(mine, e.value(t, r, False), "__sure")
        if e.conditional((t, r)):
            answer = _marked(answer, e.value(t, r, True), "__maybe")
        else:
            answer = answer.withColumn("__maybe", F.col("__sure"))
        answer = answer.select(*columns, F.col("__sure").alias("allowed"), (~F.col("__sure") & F.col("__maybe")).alias("failed"))
        out = answer if out is None else out.unionByName(answer)
    if out is None:
        out = requests.select(*columns, F.lit(False).alias("allowed"), F.lit(False).alias("failed"))
    return out


def _marked(requests: DataFrame, value: DataFrame | None, name: str) -> DataFrame:
    if value is None:
        return requests.withColumn(name, F.lit(False))
    found = value.select(F.col("qid").alias("__sid"), "object_id", F.lit(True).alias(name))
    return requests.join(found, ["__sid", "object_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def batch_check(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None, *, max_checks: int | None = None) -> DataFrame:
    """check() with correlation_id as the request's name: ids must be given and unique."""
    bad = requests.groupBy("correlation_id").count().where("correlation_id is null or correlation_id = '' or count > 1")
    if not bad.isEmpty():
        raise ModelError("correlation ids must be given and unique")
    if max_checks is not None and requests.limit(max_checks + 1).count() > max_checks:
        raise ModelError(f"more than {max_checks} checks")
    return check(model, tuples, requests.withColumn("qid", F.col("correlation_id")), contextual)


def list_objects(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None, *, max_results: int | None = None, max_depth: int | None = None) -> DataFrame:
    """requests (qid, object_type, relation, subject_*[, context]) -> (qid, object); max_results limits each request,
    to its first objects by name. Subjects with equal contexts are evaluated once."""
    rows, out = with_contextual(tuples, contextual), None
    for t, r in _targets(requests):
        model.need(t, r)
        mine, seeds, contexts = _by_subject(requests.where((F.col("object_type") == t) & (F.col("relation") == r)), contextual)
        v = Evaluator(model, rows, seeds, contexts, max_depth=max_depth).value(t, r)
        if v is not None:
            found = v.withColumnRenamed("qid", "__sid").join(mine.select("__sid", "qid"), "__sid").select("qid", join_object(F.lit(t), "object_id").alias("object"))
            out = found if out is None else out.union(found)
    if out is None:
        out = requests.select("qid", F.lit("").alias("object")).limit(0)
    return first_of_each(out, "object", max_results)


def undecided_objects(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> DataFrame:
    """(qid, object): objects that list_objects leaves out because a condition could not be evaluated."""
    rows, out = with_contextual(tuples, contextual), None
    for t, r in _targets(requests):
        mine, seeds, contexts = _by_subject(requests.where((F.col("object_type") == t) & (F.col("relation") == r)), contextual)
        e = Evaluator(model, rows, seeds, contexts)
        if not e.conditional((t, r)):
            continue
        may, must = e.value(t, r, True), e.value(t, r)
        if may is not None:
            open_ = may if must is None else may.join(must, list(VALUE), "left_anti")
            found = open_.withColumnRenamed("qid", "__sid").join(mine.select("__sid", "qid"), "__sid").select("qid", join_object(F.lit(t), "object_id").alias("object"))
            out = found if out is None else out.union(found)
    return out if out is not None else requests.select("qid", F.lit("").alias("object")).limit(0)


def first_of_each(found: DataFrame, column: str, limit: int | None) -> DataFrame:
    """At most `limit` rows of each request, in order of the column."""
    if limit is None:
        return found
    place = F.row_number().over(Window.partitionBy("qid").orderBy(column))
    return found.withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")


def stream_objects(model: Model, tuples: DataFrame, requests: DataFrame, contextual: DataFrame | None = None) -> Iterator[tuple]:
    """list_objects one result at a time, partition by partition, without a limit."""
    for row in list_objects(model, tuples, requests, contextual).toLocalIterator(prefetchPartitions=True):
        yield row["qid"], row["object"]
