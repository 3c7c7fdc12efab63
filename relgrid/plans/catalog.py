"""Registered queries over the fixture tuples, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrid.functions import identifiers as ids
from relgrid.functions.cel import condition_column
from relgrid.operators.check import batch_check, check, list_objects
from relgrid.operators.evaluate import valid_tuples
from relgrid.operators.expand import expand
from relgrid.operators.list_users import list_users
from relgrid.operators.search import action_search, evaluations, resource_search, subject_search
from relgrid.plans.model import Condition, parse_model, validate
from relgrid.sources import store
from relgrid.sources.fixtures import MODEL, TUPLES_SQL, changelog, tuples
from relgrid.sources.storage import shared_dir
from relgrid.streaming.changes import follow, net_changes, stream_changes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def model():
    return validate(parse_model(MODEL))


# requests ----------------------------------------------------------------------------------------------------------

def _subjects(spark: SparkSession, sf_dir: str, object_type: str, relation: str) -> DataFrame:
    """A request of each user that owns a customer."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 150).cast("string").alias("uid")).distinct()
    return users.select(F.concat(F.lit("u"), "uid").alias("qid"), F.lit(object_type).alias("object_type"), F.lit(relation).alias("relation"), F.lit("user").alias("subject_type"), F.col("uid").alias("subject_id"), F.lit("").alias("subject_relation"))


_OWNERS = "asked(qid, uid) AS (SELECT DISTINCT 'u' || CAST(c_custkey % 150 AS VARCHAR), CAST(c_custkey % 150 AS VARCHAR) FROM customer)"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


#: values of the fixture's relations as (qid, object_id), for `asked`
VALUES_SQL = """
team_member(qid, object_id) AS (
  SELECT qid, object_id FROM tuples JOIN asked ON subject_id = uid WHERE object_type = 'team' AND subject_type = 'user'
  UNION SELECT m.qid, t.object_id FROM team_member m JOIN tuples t ON t.subject_id = m.object_id WHERE t.object_type = 'team' AND t.subject_type = 'team'
), nation_viewer AS (
  SELECT qid, object_id FROM tuples JOIN asked ON subject_id IN (uid, '*') WHERE object_type = 'nation' AND relation = 'analyst'
  UNION SELECT a.qid, n.object_id FROM tuples n JOIN tuples r ON n.subject_id = r.object_id AND r.object_type = 'region' JOIN asked a ON r.subject_id = a.uid WHERE n.object_type = 'nation' AND n.relation = 'region'
), customer_viewer AS (
  (SELECT qid, object_id FROM tuples JOIN asked ON subject_id = uid WHERE object_type = 'customer' AND relation = 'owner'
   UNION SELECT v.qid, c.object_id FROM tuples c JOIN nation_viewer v ON c.subject_id = v.object_id WHERE c.object_type = 'customer' AND c.relation = 'nation')
  EXCEPT SELECT qid, object_id FROM tuples JOIN asked ON subject_id = uid WHERE object_type = 'customer' AND relation = 'blocked'
), order_approver AS (
  SELECT qid, object_id FROM tuples JOIN asked ON subject_id = uid WHERE object_type = 'order' AND relation = 'approver' AND subject_type = 'user'
  UNION SELECT m.qid, t.object_id FROM tuples t JOIN team_member m ON t.subject_id = m.object_id WHERE t.object_type = 'order' AND t.relation = 'approver' AND t.subject_type = 'team'
), order_seen AS (
  SELECT v.qid, o.object_id FROM tuples o JOIN customer_viewer v ON o.subject_id = v.object_id WHERE o.object_type = 'order' AND o.relation = 'customer'
), order_viewer AS (SELECT * FROM order_approver UNION SELECT * FROM order_seen)
, order_can_release AS (SELECT * FROM order_approver INTERSECT SELECT * FROM order_seen)"""


def _listed(relation: str, of: str) -> str:
    return _with(TUPLES_SQL, _OWNERS, VALUES_SQL) + f"SELECT qid, '{of}:' || object_id AS object FROM {relation}"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that user 3 may view."""
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "order", "viewer").where("subject_id = '3'"))


# identifiers -------------------------------------------------------------------------------------------------------

_TEXTS = ["user:anne", "group:eng#member", "user:*", "*", "anne", "group:eng#", "a:b:c", "a b:c", "doc:1#x#y", ":x", "x:", "group:*#member", ""]


@_query(_with(TUPLES_SQL) + "SELECT text, CASE WHEN instr(text, ':') > 0 THEN split_part(text, ':', 1) ELSE '' END AS object_type, CASE WHEN instr(text, ':') > 0 THEN substr(text, instr(text, ':') + 1) ELSE text END AS object_id, CASE WHEN instr(text, '#') > 0 THEN regexp_extract(text, '#([^#]*)$', 1) ELSE '' END AS relation FROM (SELECT DISTINCT subject_type || ':' || subject_id || CASE WHEN subject_relation <> '' THEN '#' || subject_relation ELSE '' END AS text FROM tuples UNION ALL VALUES " + ", ".join(f"('{t}')" for t in _TEXTS) + ") t(text)")
def identifier_split(spark, sf_dir):
    """Every user of the tuples, and forms that none of them has."""
    users = tuples(spark, sf_dir).select(ids.join_user().alias("text")).distinct()
    df = users.union(spark.createDataFrame([(t,) for t in _TEXTS], "text string"))
    return df.select("text", ids.object_type("text").alias("object_type"), ids.object_id("text").alias("object_id"), ids.userset_relation("text").alias("relation"))


@_query("SELECT object_type, subject_type, CASE WHEN subject_relation <> '' OR subject_id = '*' THEN 'userset' ELSE 'user' END AS kind, count(*) AS n FROM (" + _with(TUPLES_SQL) + "SELECT * FROM tuples) GROUP BY ALL")
def identifier_classify(spark, sf_dir):
    rows = tuples(spark, sf_dir).select("object_type", "subject_type", ids.user_kind(ids.join_user()).alias("kind"))
    return rows.groupBy("object_type", "subject_type", "kind").agg(F.count("*").alias("n"))


# the store ---------------------------------------------------------------------------------------------------------


@_query(_with(TUPLES_SQL) + "SELECT object_id, subject_id FROM tuples WHERE object_type = 'order' AND relation = 'approver' AND subject_type = 'user'")
def tuple_read_filter(spark, sf_dir):
    return store.read(tuples(spark, sf_dir), object_type="order", relation="approver", subject_type="user").select("object_id", "subject_id")


@_query(_with(TUPLES_SQL, _OWNERS) + "SELECT object_id, subject_id FROM tuples WHERE object_type = 'customer' AND relation = 'owner' AND subject_id IN (SELECT uid FROM asked)")
def tuple_reverse_read(spark, sf_dir):
    return store.read_starting_with_users(tuples(spark, sf_dir), "customer", "owner", _subjects(spark, sf_dir, "customer", "owner")).select("object_id", "subject_id")


@_query(_with(TUPLES_SQL) + "SELECT object_id, subject_type || ':' || subject_id || '#' || subject_relation AS userset FROM tuples WHERE object_type = 'order' AND relation = 'approver' AND subject_type = 'team'")
def userset_tuples(spark, sf_dir):
    rows = store.read_usersets(tuples(spark, sf_dir), "order", "approver", [("team", "member", False)])
    return rows.select("object_id", ids.join_user().alias("userset"))


@_query(_with(TUPLES_SQL) + "SELECT object_id, subject_id FROM tuples JOIN customer ON object_id = CAST(c_custkey AS VARCHAR) AND subject_id = CAST((c_custkey * 13) % 150 AS VARCHAR) WHERE object_type = 'customer' AND relation = 'owner'")
def user_tuple_lookup(spark, sf_dir):
    """Exact keys, one for each customer; most are not there."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wanted = customer.select(F.lit("customer").alias("object_type"), F.col("c_custkey").cast("string").alias("object_id"), F.lit("owner").alias("relation"), F.lit("user").alias("subject_type"), ((F.col("c_custkey") * 13) % 150).cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))
    return store.read_user_tuples(tuples(spark, sf_dir), wanted).select("object_id", "subject_id")


@_query("SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS ulid, CAST(event_id AS VARCHAR) AS object_id FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 51")
def tuple_page(spark, sf_dir):
    rows = changelog(spark, sf_dir).where(F.col("ulid") >= "100".zfill(26))
    return rows.orderBy("ulid").limit(51).select("ulid", "object_id")


@_query(_with(TUPLES_SQL) + "SELECT object_type, relation, count(*) AS n FROM tuples WHERE NOT (object_type = 'nation' AND subject_id = '*') AND NOT (subject_type = 'team' AND object_type = 'order') AND condition_name = '' GROUP BY ALL")
def valid_tuple_filter(spark, sf_dir):
    narrower = MODEL.replace("analyst: [user, user:*]", "analyst: [user]").replace("approver: [user, team#member]", "approver: [user]").replace("reader: [user with min_value]", "reader: [user]")
    m = validate(parse_model(narrower))
    return valid_tuples(m, tuples(spark, sf_dir)).groupBy("object_type", "relation").agg(F.count("*").alias("n"))


@_query("SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS ulid, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS operation FROM events WHERE event_id > 500")
def changelog_after_cursor(spark, sf_dir):
    return store.changes_after(changelog(spark, sf_dir), object_type="resource", after="500".zfill(26)).select("ulid", "operation")


@_query("SELECT operation, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS operation FROM events WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM events) - 86400000) GROUP BY ALL")
def changelog_horizon(spark, sf_dir):
    log = changelog(spark, sf_dir)
    newest = log.agg(F.max("inserted_at")).first()[0]
    return store.changes_after(log, horizon_ms=86_400_000, now=F.lit(newest)).groupBy("operation").agg(F.count("*").alias("n"))


@_query(_with(TUPLES_SQL, "old AS (SELECT * FROM tuples WHERE object_type = 'customer' AND relation = 'owner')") + "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o.object_id IS NULL THEN 'insert' ELSE 'duplicate' END AS outcome FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST((c_custkey + c_custkey % 2) % 150 AS VARCHAR) AS uid FROM customer) w LEFT JOIN old o ON o.object_id = w.id AND o.subject_id = w.uid UNION ALL SELECT CASE WHEN o.object_id IS NULL THEN 'missing' ELSE 'delete' END FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST((c_custkey + 1 - c_custkey % 2) % 150 AS VARCHAR) AS uid FROM customer) d LEFT JOIN old o ON o.object_id = d.id AND o.subject_id = d.uid) GROUP BY ALL")
def write_plan_classify(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    row = lambda shift: customer.select(F.lit("customer").alias("object_type"), F.col("c_custkey").cast("string").alias("object_id"), F.lit("owner").alias("relation"), F.lit("user").alias("subject_type"), ((F.col("c_custkey") + shift) % 150).cast("string").alias("subject_id"), F.lit("").alias("subject_relation"), F.lit("").alias("condition_name"), F.lit("").alias("condition_context"))
    old = store.read(tuples(spark, sf_dir), object_type="customer", relation="owner")
    return store.classify(old, row(F.col("c_custkey") % 2), row(1 - F.col("c_custkey") % 2)).groupBy("outcome").agg(F.count("*").alias("n"))


# list objects ------------------------------------------------------------------------------------------------------


@_query(_with(TUPLES_SQL, _OWNERS) + "SELECT qid, 'customer:' || object_id AS object FROM tuples JOIN asked ON subject_id = uid WHERE object_type = 'customer' AND relation = 'owner'")
def list_objects_direct(spark, sf_dir):
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "customer", "owner"))


@_query(_with(TUPLES_SQL, _OWNERS) + "SELECT DISTINCT qid, 'nation:' || object_id AS object FROM tuples JOIN asked ON subject_id IN (uid, '*') WHERE object_type = 'nation' AND relation = 'analyst'")
def list_objects_wildcard(spark, sf_dir):
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "nation", "analyst"))


@_query(_listed("nation_viewer", "nation"))
def list_objects_nation_viewer(spark, sf_dir):
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "nation", "viewer"))


@_query(_listed("customer_viewer", "customer"))
def list_objects_customer_viewer(spark, sf_dir):
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "customer", "viewer"))


@_query(_listed("order_viewer", "order"))
def list_objects_order_viewer(spark, sf_dir):
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "order", "viewer"))


@_query(_listed("order_can_release", "order"))
def list_objects_order_can_release(spark, sf_dir):
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "order", "can_release"))


@_query(_with(TUPLES_SQL, _OWNERS, VALUES_SQL) + "SELECT qid, object FROM (SELECT qid, 'customer:' || object_id AS object, row_number() OVER (PARTITION BY qid ORDER BY 'customer:' || object_id) AS place FROM customer_viewer) WHERE place <= 10")
def list_objects_limited(spark, sf_dir):
    """The first ten objects of each request."""
    return list_objects(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "customer", "viewer"), max_results=10)


@_query(_listed("order_viewer", "order"))
def resource_search_orders(spark, sf_dir):
    return resource_search(model(), tuples(spark, sf_dir), _subjects(spark, sf_dir, "order", "viewer"))


_ALL_USERS = "asked AS (SELECT DISTINCT 'u' || user_id AS qid, CAST(user_id AS VARCHAR) AS uid FROM events)"


@_query(_with(TUPLES_SQL, _ALL_USERS, VALUES_SQL) + "SELECT object_id AS team, substr(qid, 2) AS user_id FROM team_member")
def team_closure(spark, sf_dir):
    """Every user's teams through nested and cyclic membership, all users in one batch."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    asked = users.select(F.concat(F.lit("u"), "user_id").alias("qid"), F.lit("team").alias("object_type"), F.lit("member").alias("relation"), F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))
    found = list_objects(model(), tuples(spark, sf_dir), asked)
    return found.select(ids.object_id("object").alias("team"), F.expr("substr(qid, 2)").alias("user_id"))


# check -------------------------------------------------------------------------------------------------------------


def _order_requests(spark, sf_dir, relation: str) -> DataFrame:
    """One request for each order, by a user that follows from its number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").cast("string").alias("qid"), F.lit("order").alias("object_type"), F.col("o_orderkey").cast("string").alias("object_id"), F.lit(relation).alias("relation"), F.lit("user").alias("subject_type"), ((F.col("o_orderkey") * 13) % 150).cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))


_ORDER_USERS = "asked(qid, uid) AS (SELECT DISTINCT CAST((o_orderkey * 13) % 150 AS VARCHAR), CAST((o_orderkey * 13) % 150 AS VARCHAR) FROM orders)"


def _checked(value: str) -> str:
    return _with(TUPLES_SQL, _ORDER_USERS, VALUES_SQL) + f"SELECT CAST(o_orderkey AS VARCHAR) AS qid, v.object_id IS NOT NULL AS allowed FROM orders LEFT JOIN (SELECT DISTINCT qid, object_id FROM {value}) v ON v.object_id = CAST(o_orderkey AS VARCHAR) AND v.qid = CAST((o_orderkey * 13) % 150 AS VARCHAR)"


@_query(_checked("order_viewer"))
def check_batch(spark, sf_dir):
    return check(model(), tuples(spark, sf_dir), _order_requests(spark, sf_dir, "viewer")).select("qid", "allowed")


@_query("SELECT allowed, count(*) AS n FROM (" + _checked("order_can_release") + ") GROUP BY ALL")
def check_batch_dedupe(spark, sf_dir):
    asked = _order_requests(spark, sf_dir, "can_release")
    both = asked.unionByName(asked.withColumn("qid", F.concat(F.lit("again"), "qid")))
    got = check(model(), tuples(spark, sf_dir), both).select("qid", "allowed")
    return got.where(~F.col("qid").startswith("again")).groupBy("allowed").agg(F.count("*").alias("n"))


_TEAMS_SQL = "nested(top, below) AS (SELECT CAST(i AS VARCHAR), CAST(i AS VARCHAR) FROM range(31) t(i) UNION SELECT n.top, t.subject_id FROM nested n JOIN tuples t ON t.object_type = 'team' AND t.subject_type = 'team' AND t.object_id = n.below)"


@_query(_with(TUPLES_SQL, _TEAMS_SQL) + "SELECT CAST(i AS VARCHAR) AS qid, n.top IS NOT NULL AS allowed FROM range(961) t(i) LEFT JOIN nested n ON n.top = CAST(i // 31 AS VARCHAR) AND n.below = CAST(i % 31 AS VARCHAR)")
def check_usersets(spark, sf_dir):
    """Whether one team's members are members of another: of itself always, of others by nesting, all pairs."""
    a, b = F.floor(F.col("id") / 31).cast("string"), (F.col("id") % 31).cast("string")
    asked = spark.range(961).select(F.col("id").cast("string").alias("qid"), F.lit("team").alias("object_type"), a.alias("object_id"), F.lit("member").alias("relation"), F.lit("team").alias("subject_type"), b.alias("subject_id"), F.lit("member").alias("subject_relation"))
    return check(model(), tuples(spark, sf_dir), asked).select("qid", "allowed")


@_query(_checked("order_can_release"))
def batch_check_orders(spark, sf_dir):
    asked = _order_requests(spark, sf_dir, "can_release").withColumnRenamed("qid", "correlation_id")
    return batch_check(model(), tuples(spark, sf_dir), asked).select(F.col("correlation_id").alias("qid"), "allowed")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS qid, c_custkey % 3 = 0 AS allowed FROM customer")
def check_contextual(spark, sf_dir):
    """A user unknown to the store owns every third customer by tuples of its own requests alone."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("object_id"), (F.col("c_custkey") % 3 == 0).alias("own"))
    asked = customer.select(F.col("object_id").alias("qid"), F.lit("customer").alias("object_type"), "object_id", F.lit("owner").alias("relation"), F.lit("user").alias("subject_type"), F.lit("guest").alias("subject_id"), F.lit("").alias("subject_relation"))
    bring = asked.join(customer.where("own").select("object_id"), "object_id", "left_semi")
    return check(model(), tuples(spark, sf_dir), asked, bring).select("qid", "allowed")


@_query(_with(TUPLES_SQL, _ALL_USERS, VALUES_SQL) + "SELECT a.qid, m.qid IS NOT NULL AS allowed FROM asked a LEFT JOIN team_member m ON m.qid = a.qid AND m.object_id = '30'")
def check_recursive(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    asked = users.select(F.concat(F.lit("u"), "user_id").alias("qid"), F.lit("team").alias("object_type"), F.lit("30").alias("object_id"), F.lit("member").alias("relation"), F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))
    return check(model(), tuples(spark, sf_dir), asked).select("qid", "allowed")


# conditions --------------------------------------------------------------------------------------------------------


def _resource_requests(spark, sf_dir, context) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").cast("string").alias("qid"), F.lit("resource").alias("object_type"), F.col("event_id").cast("string").alias("object_id"), F.lit("reader").alias("relation"), F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"), context.alias("context"))


@_query("SELECT CAST(event_id AS VARCHAR) AS qid, value >= event_id % 200 AS allowed, false AS failed FROM events")
def condition_filter(spark, sf_dir):
    context = F.to_json(F.struct((F.col("event_id") % 200).alias("threshold")))
    return check(model(), tuples(spark, sf_dir), _resource_requests(spark, sf_dir, context)).select("qid", "allowed", "failed")


@_query("SELECT CAST(event_id AS VARCHAR) AS qid, event_id % 2 = 0 AS allowed, event_id % 2 = 1 AS failed FROM events")
def condition_missing_param(spark, sf_dir):
    context = F.when(F.col("event_id") % 2 == 0, F.lit('{"threshold": -1}')).otherwise(F.lit("{}"))
    return check(model(), tuples(spark, sf_dir), _resource_requests(spark, sf_dir, context)).select("qid", "allowed", "failed")


@_query("SELECT CAST(event_id AS VARCHAR) AS id, (10 * 256 * 65536 + (event_id % 256) * 65536 + (event_id * 7 % 256) * 256 + 1) BETWEEN 10 * 16777216 + 64 * 65536 AND 10 * 16777216 + 127 * 65536 + 65535 AS inside FROM events")
def in_cidr_v4(spark, sf_dir):
    c = Condition("net", (("ip", "ipaddress"),), 'ip.in_cidr("10.64.0.0/10")')
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    address = F.concat_ws(".", F.lit("10"), (F.col("event_id") % 256).cast("string"), (F.col("event_id") * 7 % 256).cast("string"), F.lit("1"))
    return events.select(F.col("event_id").cast("string").alias("id"), condition_column(c, F.lit("{}"), F.to_json(F.struct(address.alias("ip")))).alias("inside"))


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_id % 65536 >= 32768 AS inside FROM events")
def in_cidr_v6(spark, sf_dir):
    c = Condition("net", (("ip", "ipaddress"),), 'ip.in_cidr("2001:db8:8000::/33")')
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    address = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("event_id") % 65536)), F.lit("::1"))
    return events.select(F.col("event_id").cast("string").alias("id"), condition_column(c, F.lit("{}"), F.to_json(F.struct(address.alias("ip")))).alias("inside"))


@_query("SELECT CAST(event_id AS VARCHAR) AS id, event_id % 5 > 2 OR event_id % 7 > 2 AS some, event_id % 3 = 1 AS own FROM events")
def condition_lists_and_maps(spark, sf_dir):
    some = Condition("some", (("l", "list<int>"),), "l.exists(x, x > 2)")
    own = Condition("own", (("m", "map<int>"),), "m.k == 1 && m.size() == 1")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    context = F.to_json(F.struct(F.array(n % 5, n % 7).alias("l"), F.create_map(F.lit("k"), n % 3).alias("m")))
    return events.select(n.cast("string").alias("id"), condition_column(some, F.lit("{}"), context).alias("some"), condition_column(own, F.lit("{}"), context).alias("own"))


# writes and changes ------------------------------------------------------------------------------------------------


@_query(_with(TUPLES_SQL) + "SELECT relation, t.object_id, t.subject_id FROM tuples t JOIN customer c ON t.object_id = CAST(c.c_custkey AS VARCHAR) WHERE object_type = 'customer' AND (relation = 'owner' AND c_acctbal >= 0 OR relation = 'blocked')")
def store_writes(spark, sf_dir):
    """Owners are written, those of customers in debt deleted and blocked instead, and all is compacted in between."""
    s = store.Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    rows = store.read(tuples(spark, sf_dir), object_type="customer")
    debt = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("object_id"))
    owners = rows.where("relation = 'owner'")
    s.write(model(), owners)
    s.compact()
    s.write(model(), rows.where("relation = 'blocked'"), owners.join(debt, "object_id", "left_semi"))
    return s.tuples().select("relation", "object_id", "subject_id")


@_query("SELECT object_id, CAST(last AS BIGINT) AS last FROM (SELECT CAST(event_id % 500 AS VARCHAR) AS object_id, max(event_id) AS last, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1) WHERE kind <> 'error'")
def stream_of_changes(spark, sf_dir):
    """What a stream over the change log leaves, the last change of each object winning."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    log = changelog(spark, sf_dir).withColumn("object_id", (F.col("object_id").cast("bigint") % 500).cast("string")).withColumn("subject_id", F.lit("all"))
    log.withColumns({"condition_name": F.lit(""), "condition_context": F.lit("")}).repartition(4).write.parquet(f"{folder}/log")
    follow(stream_changes(spark, f"{folder}/log"), f"{folder}/at", lambda df, n: df.write.mode("append").parquet(f"{folder}/net")).awaitTermination()
    return net_changes(spark.read.parquet(f"{folder}/net")).where("operation = 0").select("object_id", F.col("ulid").cast("bigint").alias("last"))


# list users, expand, searches --------------------------------------------------------------------------------------


def _objects(spark, object_type: str, relation: str, keys, kind: str = "user") -> DataFrame:
    return keys.select(F.col("id").cast("string").alias("qid"), F.lit(object_type).alias("object_type"), F.col("id").cast("string").alias("object_id"), F.lit(relation).alias("relation"), F.lit(kind).alias("filter_type"), F.lit("").alias("filter_relation"))


@_query(_with(TUPLES_SQL, _ALL_USERS, VALUES_SQL) + "SELECT object_id AS qid, 'user:' || substr(qid, 2) AS \"user\" FROM team_member")
def list_users_team(spark, sf_dir):
    return list_users(model(), tuples(spark, sf_dir), _objects(spark, "team", "member", spark.range(31)))


_NATION_USERS = """nation_users AS (
  SELECT object_id, subject_id FROM tuples WHERE object_type = 'nation' AND relation = 'analyst'
  UNION SELECT n.object_id, r.subject_id FROM tuples n JOIN tuples r ON n.subject_id = r.object_id AND r.object_type = 'region' WHERE n.object_type = 'nation' AND n.relation = 'region')"""


@_query(_with(TUPLES_SQL, _NATION_USERS) + "SELECT object_id AS qid, 'user:' || subject_id AS \"user\" FROM nation_users")
def list_users_nation_wildcard(spark, sf_dir):
    return list_users(model(), tuples(spark, sf_dir), _objects(spark, "nation", "viewer", spark.range(25)))


_CUSTOMER_USERS = """customer_users AS (
  (SELECT object_id, subject_id FROM tuples WHERE object_type = 'customer' AND relation = 'owner'
   UNION SELECT c.object_id, n.subject_id FROM tuples c JOIN nation_users n ON c.subject_id = n.object_id WHERE c.object_type = 'customer' AND c.relation = 'nation')
  EXCEPT SELECT object_id, subject_id FROM tuples WHERE object_type = 'customer' AND relation = 'blocked')"""


@_query(_with(TUPLES_SQL, _NATION_USERS, _CUSTOMER_USERS) + "SELECT object_id AS qid, 'user:' || subject_id AS \"user\" FROM customer_users")
def list_users_exclusion(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return list_users(model(), tuples(spark, sf_dir), _objects(spark, "customer", "viewer", keys))


_ANYONE = "asked AS (SELECT DISTINCT 'u' || subject_id AS qid, subject_id AS uid FROM tuples WHERE subject_type = 'user' AND subject_id <> '*' AND object_type <> 'resource')"


@_query(_with(TUPLES_SQL, _ANYONE, VALUES_SQL) + "SELECT object_id AS qid, 'user:' || substr(qid, 2) AS \"user\" FROM order_can_release")
def list_users_intersection(spark, sf_dir):
    """Approvers that may also view the order's customer, by name or by a wildcard that does not exclude them."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return list_users(model(), tuples(spark, sf_dir), _objects(spark, "order", "can_release", keys))


@_query(_with(TUPLES_SQL, _ANYONE, VALUES_SQL, _TEAMS_SQL) + "SELECT object_id AS qid, 'user:' || substr(qid, 2) AS \"user\" FROM order_approver UNION SELECT t.object_id, 'team:' || n.below || '#member' FROM tuples t JOIN nested n ON n.top = t.subject_id WHERE t.object_type = 'order' AND t.relation = 'approver' AND t.subject_type = 'team'")
def list_users_filters(spark, sf_dir):
    """Two filters a request: users, and teams as usersets."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    users = _objects(spark, "order", "approver", keys)
    teams = users.withColumn("filter_type", F.lit("team")).withColumn("filter_relation", F.lit("member"))
    return list_users(model(), tuples(spark, sf_dir), users.unionByName(teams))


@_query(_with(TUPLES_SQL, _NATION_USERS, _CUSTOMER_USERS) + "SELECT object_id AS qid, 'user:' || subject_id AS \"user\" FROM customer_users")
def subject_search_customers(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return subject_search(model(), tuples(spark, sf_dir), _objects(spark, "customer", "viewer", keys))


@_query(_with(TUPLES_SQL) + "SELECT object_id AS qid, string_agg('user:' || subject_id, ',' ORDER BY 'user:' || subject_id) AS users FROM tuples WHERE object_type = 'nation' AND relation = 'analyst' GROUP BY object_id")
def expand_direct(spark, sf_dir):
    asked = _objects(spark, "nation", "analyst", spark.range(25)).select("qid", "object_type", "object_id", "relation")
    return expand(model(), tuples(spark, sf_dir), asked).select("qid", F.array_join("users", ",").alias("users"))


@_query(_with(TUPLES_SQL) + "SELECT object_id AS qid, p AS path, k AS kind, CASE k WHEN 'union' THEN '' WHEN 'computed' THEN 'nation:' || object_id || '#analyst' ELSE 'region:' || subject_id || '#manager' END AS users FROM tuples, (VALUES ('/', 'union'), ('/0', 'computed'), ('/1', 'tuple_to_userset')) t(p, k) WHERE object_type = 'nation' AND relation = 'region'")
def expand_ttu(spark, sf_dir):
    asked = _objects(spark, "nation", "viewer", spark.range(25)).select("qid", "object_type", "object_id", "relation")
    return expand(model(), tuples(spark, sf_dir), asked).select("qid", "path", "kind", F.array_join("users", ",").alias("users"))


_ACTIONS = "asked AS (SELECT DISTINCT CAST((c_custkey * 7) % 150 AS VARCHAR) AS qid, CAST((c_custkey * 7) % 150 AS VARCHAR) AS uid FROM customer), mine AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST((c_custkey * 7) % 150 AS VARCHAR) AS uid FROM customer)"


def _held(relation: str) -> str:
    return f"CASE WHEN EXISTS (SELECT 1 FROM tuples t WHERE t.object_type = 'customer' AND t.relation = '{relation}' AND t.subject_id = m.uid AND t.object_id = m.id) THEN '{relation}' END"


@_query(_with(TUPLES_SQL, _ACTIONS, VALUES_SQL) + f"SELECT id AS qid, concat_ws(',', {_held('blocked')}, {_held('owner')}, CASE WHEN EXISTS (SELECT 1 FROM customer_viewer v WHERE v.object_id = m.id AND v.qid = m.uid) THEN 'viewer' END) AS actions FROM mine m")
def action_search_customers(spark, sf_dir):
    """What each customer's possibly blocked user may do."""
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("qid"), F.lit("customer").alias("object_type"), F.col("c_custkey").cast("string").alias("object_id"), F.lit("user").alias("subject_type"), ((F.col("c_custkey") * 7) % 150).cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))
    return action_search(model(), tuples(spark, sf_dir), asked).select("qid", F.array_join("actions", ",").alias("actions"))


@_query("SELECT batch, item, decision FROM (SELECT *, coalesce(max(CASE WHEN decision THEN 0 ELSE 1 END) OVER (PARTITION BY batch ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM (SELECT CAST(qid AS BIGINT) % 50 AS batch, CAST(qid AS BIGINT) AS item, allowed AS decision FROM (" + _checked("order_viewer") + "))) WHERE stopped = 0")
def evaluations_first_deny(spark, sf_dir):
    items = _order_requests(spark, sf_dir, "viewer").withColumn("item", F.col("qid").cast("bigint")).withColumn("batch", F.col("item") % 50).drop("qid").withColumnRenamed("relation", "action")
    return evaluations(model(), tuples(spark, sf_dir), items, "deny_on_first_deny").select("batch", "item", "decision")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
