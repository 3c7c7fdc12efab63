"""Relationship tuples derived from business tables, and a model over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = """
model
  schema 1.1
type user
type team
  relations
    define member: [user, team#member]
type region
  relations
    define manager: [user]
type nation
  relations
    define region: [region]
    define analyst: [user, user:*]
    define viewer: analyst or manager from region
type customer
  relations
    define nation: [nation]
    define owner: [user]
    define blocked: [user]
    define viewer: (owner or viewer from nation) but not blocked
type order
  relations
    define customer: [customer]
    define approver: [user, team#member]
    define viewer: approver or viewer from customer
    define can_release: approver and viewer from customer
type resource
  relations
    define reader: [user with min_value]
condition min_value(threshold: double, value: double) {
  value >= threshold
}
"""

TEAMS = 31


def _rows(df: DataFrame, object_type: str, object_id, relation: str, subject_type: str, subject_id, subject_relation: str = "", condition: str = "", context=None) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(F.lit(object_type).alias("object_type"), text(object_id).alias("object_id"), F.lit(relation).alias("relation"), F.lit(subject_type).alias("subject_type"), text(subject_id).alias("subject_id"), F.lit(subject_relation).alias("subject_relation"), F.lit(condition).alias("condition_name"), (context if context is not None else F.lit("")).alias("condition_context"))


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, orders, events = (read(n) for n in ("region", "nation", "customer", "orders", "events"))
    ids = spark.range(TEAMS)
    parts = [
        _rows(nation, "nation", "n_nationkey", "region", "region", "n_regionkey"),
        _rows(region, "region", "r_regionkey", "manager", "user", F.col("r_regionkey") * 10),
        _rows(nation.where("n_nationkey % 5 <> 0"), "nation", "n_nationkey", "analyst", "user", "n_nationkey"),
        _rows(nation.where("n_nationkey % 5 = 0"), "nation", "n_nationkey", "analyst", "user", F.lit("*")),
        _rows(customer, "customer", "c_custkey", "nation", "nation", "c_nationkey"),
        _rows(customer, "customer", "c_custkey", "owner", "user", F.col("c_custkey") % 150),
        _rows(customer.where("c_acctbal < 0"), "customer", "c_custkey", "blocked", "user", (F.col("c_custkey") * 7) % 150),
        _rows(orders, "order", "o_orderkey", "customer", "customer", "o_custkey"),
        _rows(orders.where("o_orderpriority = '1-URGENT'"), "order", "o_orderkey", "approver", "team", F.col("o_orderkey") % TEAMS, "member"),
        _rows(orders.where("o_orderpriority = '2-HIGH'"), "order", "o_orderkey", "approver", "user", F.col("o_orderkey") % 150),
        _rows(events.select((F.col("user_id") % TEAMS).alias("team"), "user_id").distinct(), "team", "team", "member", "user", "user_id"),
        _rows(ids.select("id", F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("child")).where(f"child < {TEAMS}"), "team", "id", "member", "team", "child", "member"),
        _rows(spark.range(1), "team", F.lit(TEAMS - 1), "member", "team", F.lit(0), "member"),
        _rows(events, "resource", "event_id", "reader", "user", "user_id", "", "min_value", F.to_json(F.struct("value"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change for each event: ulid, inserted_at, operation (0 write, 1 delete) and the resource tuple."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.lpad(F.col("event_id").cast("string"), 26, "0").alias("ulid"), F.col("ts").alias("inserted_at"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("operation"), F.lit("resource").alias("object_type"), F.col("event_id").cast("string").alias("object_id"), F.lit("reader").alias("relation"), F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), F.lit("").alias("subject_relation"))


#: the same tuples in SQL, as a common table expression for oracle queries
TUPLES_SQL = f"""tuples AS (
  SELECT 'nation' AS object_type, CAST(n_nationkey AS VARCHAR) AS object_id, 'region' AS relation, 'region' AS subject_type, CAST(n_regionkey AS VARCHAR) AS subject_id, '' AS subject_relation, '' AS condition_name FROM nation
  UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'manager', 'user', CAST(r_regionkey * 10 AS VARCHAR), '', '' FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'analyst', 'user', CASE WHEN n_nationkey % 5 = 0 THEN '*' ELSE CAST(n_nationkey AS VARCHAR) END, '', '' FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', 'nation', CAST(c_nationkey AS VARCHAR), '', '' FROM customer
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'owner', 'user', CAST(c_custkey % 150 AS VARCHAR), '', '' FROM customer
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'blocked', 'user', CAST((c_custkey * 7) % 150 AS VARCHAR), '', '' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'customer', 'customer', CAST(o_custkey AS VARCHAR), '', '' FROM orders
  UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'approver', 'team', CAST(o_orderkey % {TEAMS} AS VARCHAR), 'member', '' FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'approver', 'user', CAST(o_orderkey % 150 AS VARCHAR), '', '' FROM orders WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT DISTINCT 'team', CAST(user_id % {TEAMS} AS VARCHAR), 'member', 'user', CAST(user_id AS VARCHAR), '', '' FROM events
  UNION ALL SELECT 'team', CAST(i AS VARCHAR), 'member', 'team', CAST(2 * i + k AS VARCHAR), 'member', '' FROM range({TEAMS}) t(i), range(1, 3) u(k) WHERE 2 * i + k < {TEAMS}
  UNION ALL SELECT 'team', '{TEAMS - 1}', 'member', 'team', '0', 'member', ''
  UNION ALL SELECT 'resource', CAST(event_id AS VARCHAR), 'reader', 'user', CAST(user_id AS VARCHAR), '', 'min_value' FROM events
)"""
