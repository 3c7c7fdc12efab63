"""Stores of relationship tuples: scans, pages, writes, changes, models and assertions.

A store is a folder of Parquet tables (any path Spark can reach): tuples, changes, models and assertions, plus a
table of stores. Tuples are partitioned by object type and relation, so scans of one relation read its files
alone. A write only appends to the change log: tuples are the last snapshot with the changes since then laid
over it, and compact() writes a new snapshot. A single writer is assumed; readers see a write whole or not at all.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgrid.functions.cel import stored_context_fits
from relgrid.functions.identifiers import is_object, is_relation, is_self_defining, is_user, join_object, join_user
from relgrid.operators.evaluate import few, valid_tuples
from relgrid.plans.model import Model, ModelError, parse_model, validate

KEY = ["object_type", "object_id", "relation", "subject_type", "subject_id", "subject_relation"]
SCHEMA = "object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string, condition_name string, condition_context string, ulid string, inserted_at timestamp"
CHANGES = SCHEMA + ", operation int"
CHANGES_COLUMNS = [x.split()[0] for x in CHANGES.split(", ")]
WRITE, DELETE = 0, 1
MAX_PAGE, MAX_CONTEXT_BYTES, MAX_TUPLES = 100, 32 * 1024, 100
MAX_OBJECT, MAX_RELATION, MAX_USER = 256, 50, 512
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_LAST: dict[str, int] = {}  # by store, the time of the last write: later ones never share it


def ulid(ms: int | None = None, random: int | None = None) -> str:
    """26 characters that sort by time."""
    x = ((int(time.time() * 1000) if ms is None else ms) << 80) | (uuid.uuid4().int >> 48 if random is None else random)
    return "".join(_BASE32[(x >> (5 * k)) & 31] for k in range(25, -1, -1))


def _ulids(ms: int) -> Column:
    """Ids of one write's rows: its time, 30 random bits, and the row's place."""
    k = F.monotonically_increasing_id()
    digits = [F.lit(_BASE32).substr(F.shiftright(k, 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(9, -1, -1)]
    return F.concat(F.lit(ulid(ms)[:16]), *digits)


# scans -------------------------------------------------------------------------------------------------------------


def read(tuples: DataFrame, *, object_type: str = "", object_id: str = "", relation: str = "", subject_type: str = "", subject_id: str = "", subject_relation: str | None = None, conditions: list[str] | None = None) -> DataFrame:
    """Tuples that match every given part; empty parts match anything, a type without id any id of it."""
    out = tuples
    for c, v in (("object_type", object_type), ("object_id", object_id), ("relation", relation), ("subject_type", subject_type), ("subject_id", subject_id)):
        if v:
            out = out.where(F.col(c) == v)
    if subject_relation is not None:
        out = out.where(F.col("subject_relation") == subject_relation)
    if conditions:
        out = out.where(F.coalesce("condition_name", F.lit("")).isin(*conditions))
    return out


def read_user_tuples(tuples: DataFrame, requests: DataFrame) -> DataFrame:
    """The tuple of each request with exactly its key, if there is one."""
    return requests.join(tuples, KEY)


def read_usersets(tuples: DataFrame, object_type: str, relation: str, restrictions: list[tuple[str, str, bool]] = (), conditions: list[str] | None = None) -> DataFrame:
    """Tuples whose user is a userset or wildcard; restrictions: allowed (type, relation, wildcard)."""
    out = read(tuples, object_type=object_type, relation=relation, conditions=conditions).where("subject_relation <> '' or subject_id = '*'")
    if restrictions:
        ok = F.lit(False)
        for t, r, wildcard in restrictions:
            ok = ok | ((F.col("subject_type") == t) & ((F.col("subject_id") == "*") if wildcard else (F.col("subject_relation") == r)))
        out = out.where(ok)
    return out


def read_starting_with_users(tuples: DataFrame, object_type: str, relation: str, users: DataFrame, object_ids: DataFrame | None = None, conditions: list[str] | None = None) -> DataFrame:
    """Reverse scan: tuples of a relation that start at any of the users (subject_*); object_ids None: any, empty: none."""
    out = read(tuples, object_type=object_type, relation=relation, conditions=conditions)
    out = out.join(users.select(*KEY[3:]).distinct(), KEY[3:], "left_semi")
    return out.join(object_ids.select("object_id").distinct(), "object_id", "left_semi") if object_ids is not None else out


def page(rows: DataFrame, size: int = 50, cursor: str = "") -> tuple[list, str]:
    """Rows from cursor on, by ulid, and the cursor of the next page (empty: none)."""
    got = rows.where(F.col("ulid") >= cursor).orderBy("ulid").limit(size + 1).collect()
    return got[:size], got[size]["ulid"] if len(got) > size else ""


def changes_after(changes: DataFrame, *, object_type: str = "", after: str = "", horizon_ms: int = 0, now: Column | None = None, descending: bool = False) -> DataFrame:
    """Changes beyond a cursor, not younger than the horizon."""
    out = changes.where(F.col("object_type") == object_type) if object_type else changes
    if after:
        out = out.where(F.col("ulid") < after if descending else F.col("ulid") > after)
    if horizon_ms:
        now = F.current_timestamp() if now is None else now
        out = out.where(F.unix_millis(F.col("inserted_at").cast("timestamp")) <= F.unix_millis(now.cast("timestamp")) - horizon_ms)
    return out


def encode_cursor(ulid_: str, object_type: str) -> str:
    return f"{ulid_}|{object_type}"


def decode_cursor(token: str) -> tuple[str, str]:
    ulid_, bar, object_type = token.partition("|")
    if not bar:
        raise ModelError("invalid continuation token", 2007)
    return ulid_, object_type


# writes ------------------------------------------------------------------------------------------------------------


def classify(existing: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """What each row of a request does: key columns, condition, `operation` and `outcome`.

    outcome: insert, duplicate (same tuple is there), conflict (there with another condition), delete, missing.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    old = existing.select(*KEY, text("condition_name").alias("old_name"), text("condition_context").alias("old_context"), F.lit(True).alias("there"))
    w = writes.select(*KEY, text("condition_name").alias("condition_name"), text("condition_context").alias("condition_context")).join(old, KEY, "left")
    same = (F.col("condition_name") == F.col("old_name")) & (F.col("condition_context") == F.col("old_context"))
    w = w.withColumn("operation", F.lit(WRITE)).withColumn("outcome", F.when(F.col("there").isNull(), "insert").when(same, "duplicate").otherwise("conflict"))
    d = deletes.select(*KEY).join(old.select(*KEY, "there"), KEY, "left")
    d = d.withColumn("condition_name", F.lit("")).withColumn("condition_context", F.lit("")).withColumn("operation", F.lit(DELETE)).withColumn("outcome", F.when(F.col("there").isNull(), "missing").otherwise("delete"))
    cols = [*KEY, "condition_name", "condition_context", "operation", "outcome"]
    return w.select(*cols).union(d.select(*cols))


def duplicates(writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Keys that a request names more than once."""
    return writes.select(*KEY).union(deletes.select(*KEY)).groupBy(*KEY).count().where("count > 1")


def ungrammatical(rows: DataFrame) -> DataFrame:
    """Rows whose object, relation or user is not well formed or too long."""
    object_, user = join_object("object_type", "object_id"), join_user(relation=F.coalesce("subject_relation", F.lit("")))
    ok = is_object(object_) & is_relation("relation") & is_user(user) & (F.octet_length(object_) <= MAX_OBJECT) & (F.octet_length("relation") <= MAX_RELATION) & (F.octet_length(user) <= MAX_USER)
    return rows.where(~F.coalesce(ok, F.lit(False))).select(*KEY)


@dataclass
class Store:
    """One store in a folder."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def tuples(self) -> DataFrame:
        """The last snapshot, and the last change since then of each key that has any."""
        current = self._read("current", "snapshot string, ulid string").orderBy(F.desc("ulid")).limit(1).collect()
        since = current[0]["ulid"] if current else ""
        base = self._read(f"tuples/{current[0]['snapshot']}", SCHEMA) if current else self.spark.createDataFrame([], SCHEMA)
        fresh = self.changes().where(F.col("ulid") > since)
        rest = [c for c in CHANGES_COLUMNS if c not in KEY]
        last = fresh.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ulid").alias("last")).select(*KEY, "last.*")
        kept = base.join(last.select(*KEY), KEY, "left_anti").select(*CHANGES_COLUMNS[:-1])
        return kept.union(last.where(f"operation = {WRITE}").select(*CHANGES_COLUMNS[:-1]))

    def read_tuples(self, *, size: int = 50, token: str = "", **key: str) -> tuple[list, str]:
        """A page of the tuples that match a key (as for read()), by ulid, and the token of the next page (empty: none).

        A key needs an object type, and an object id or a user with it; without a key all tuples are read.
        """
        if any(key.values()) and not (key.get("object_type") and (key.get("object_id") or key.get("subject_id"))):
            raise ModelError("a key needs an object type, and an object id or a user", 2000)
        if not 1 <= size <= MAX_PAGE:
            raise ModelError(f"pages have 1 to {MAX_PAGE} tuples", 2000)
        if token and (len(token) != 26 or set(token) - set(_BASE32)):
            raise ModelError("invalid continuation token", 2007)
        return page(read(self.tuples(), **key), size, token)

    def compact(self) -> None:
        """Write all tuples as a new snapshot, so that reads no longer lay changes over the old one."""
        newest = self.changes().agg(F.max("ulid")).first()[0]
        if newest:
            snapshot = uuid.uuid4().hex
            self.tuples().write.partitionBy("object_type", "relation").parquet(f"{self.path}/tuples/{snapshot}")
            self.spark.createDataFrame([(snapshot, newest)], "snapshot string, ulid string").write.mode("append").parquet(f"{self.path}/current")

    def changes(self) -> DataFrame:
        return self._read("changes", CHANGES)

    def write(self, model: Model, writes: DataFrame | None = None, deletes: DataFrame | None = None, *, on_duplicate: str = "error", on_missing: str = "error", max_tuples: int | None = None) -> None:
        """Apply deletes, then writes, as one step; raises ModelError and changes nothing if any row is not acceptable.

        Identifiers follow the grammar and its lengths, stored contexts name parameters of their condition with
        values of their types, and tuples fit the model. Only the relations that the rows name are read.
        """
        empty = self.spark.createDataFrame([], SCHEMA)
        writes = empty if writes is None else writes
        deletes = empty if deletes is None else deletes
        n = writes.count() + deletes.count()
        if not n or (max_tuples is not None and n > max_tuples):
            raise ModelError("no tuples given" if not n else f"more than {max_tuples} tuples")
        if not duplicates(writes, deletes).isEmpty():
            raise ModelError("a tuple is named twice", 2004)
        if not ungrammatical(writes).union(ungrammatical(deletes)).isEmpty():
            raise ModelError("an object, relation or user is not well formed", 2000)
        full = writes.select(*KEY, F.coalesce("condition_name", F.lit("")).alias("condition_name"), F.coalesce("condition_context", F.lit("")).alias("condition_context"))
        bad = full.join(valid_tuples(model, full).select(*KEY), KEY, "left_anti")
        implied = full.where(is_self_defining(join_object("object_type", "object_id"), "relation", join_user()))
        large = full.where(F.octet_length("condition_context") > MAX_CONTEXT_BYTES)
        alien = full.where(~self._contexts_fit(model, full))
        if not (bad.isEmpty() and implied.isEmpty() and large.isEmpty() and alien.isEmpty()):
            raise ModelError("a tuple does not fit the model", 2000)
        pairs = few(full.select("object_type", "relation").union(deletes.select("object_type", "relation")))
        named = F.lit(False)
        for t, r in sorted(map(tuple, pairs)):
            named = named | ((F.col("object_type") == t) & (F.col("relation") == r))
        tuples = self.tuples().where(named)
        plan = classify(tuples, full, deletes)
        errors = ["conflict"] + (["duplicate"] if on_duplicate == "error" else []) + (["missing"] if on_missing == "error" else [])
        if found := plan.where(F.col("outcome").isin(*errors)).select("outcome").limit(1).collect():
            raise ModelError(f"cannot write: {found[0][0]}", 2017)
        ms = _LAST[self.path] = max(int(time.time() * 1000), _LAST.get(self.path, 0) + 1)
        done = plan.where(F.col("outcome").isin("insert", "delete")).withColumn("ulid", _ulids(ms)).withColumn("inserted_at", F.to_timestamp(F.timestamp_millis(F.lit(ms))))
        done.select(*CHANGES_COLUMNS).write.mode("append").parquet(f"{self.path}/changes")

    @staticmethod
    def _contexts_fit(model: Model, rows: DataFrame) -> Column:
        plain = F.col("condition_context") == ""
        fits = F.when(plain, True)
        for (name,) in sorted(map(tuple, few(rows.where(~plain).select("condition_name")))):
            if name in model.conditions:
                fits = fits.when(F.col("condition_name") == name, stored_context_fits(model.conditions[name])(F.col("condition_context")))
        return F.coalesce(fits, F.lit(False))

    def read_changes(self, *, object_type: str = "", token: str = "", size: int = 50, horizon_ms: int = 0, start_ms: int | None = None) -> tuple[list, str]:
        """A page of changes and its token; an empty page gives the token it was asked with."""
        after = ""
        if token:
            after, kind = decode_cursor(token)
            if kind != object_type:
                raise ModelError("the token belongs to another type", 2003)
        elif start_ms is not None:
            after = ulid(start_ms, 0)
        got = changes_after(self.changes(), object_type=object_type, after=after, horizon_ms=horizon_ms).orderBy("ulid").limit(min(size, MAX_PAGE)).collect()
        return got, encode_cursor(got[-1]["ulid"], object_type) if got else token

    def write_model(self, text: str) -> str:
        validate(parse_model(text))
        id_ = ulid()
        self.spark.createDataFrame([(id_, text)], "id string, text string").write.mode("append").parquet(f"{self.path}/models")
        return id_

    def models(self) -> DataFrame:
        """Newest first."""
        return self._read("models", "id string, text string").orderBy(F.desc("id"))

    def model(self, id_: str | None = None) -> Model:
        found = (self.models().where(F.col("id") == id_) if id_ else self.models().limit(1)).collect()
        if not found:
            raise ModelError("no such model", 2001 if id_ else 2020)
        return parse_model(found[0]["text"])

    def write_assertions(self, model_id: str, assertions: DataFrame) -> None:
        """Replace a model's assertions: rows of a check request and `expectation`; relations must be the model's."""
        model = self.model(model_id)
        for t, r in sorted(map(tuple, few(assertions.select("object_type", "relation")))):
            model.need(t, r)
        if not ungrammatical(assertions).isEmpty():
            raise ModelError("an object, relation or user is not well formed", 2000)
        assertions.write.mode("overwrite").parquet(f"{self.path}/assertions/{model_id}")

    def assertions(self, model_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/assertions/{model_id}")

    def run_assertions(self, model_id: str) -> DataFrame:
        """Each assertion with the answer and whether it is as expected."""
        from relgrid.operators.check import check

        got = check(self.model(model_id), self.tuples(), self.assertions(model_id).withColumn("qid", F.monotonically_increasing_id()))
        return got.withColumn("passed", F.col("allowed") == F.col("expectation"))


@dataclass
class Stores:
    """All stores under one folder; deleted ones stay on disk but are not listed."""

    spark: SparkSession
    path: str
    SCHEMA = "id string, name string, created_at timestamp, deleted_at timestamp"

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("append").parquet(f"{self.path}/_stores")

    def _current(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/_stores")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy("id").agg(F.max("name").alias("name"), F.min("created_at").alias("created_at"), F.max("deleted_at").alias("deleted_at")).where("deleted_at is null").drop("deleted_at")

    def create(self, name: str) -> str:
        from datetime import datetime, timezone

        id_ = ulid()
        self._append((id_, name, datetime.now(timezone.utc), None))
        return id_

    def delete(self, id_: str) -> None:
        from datetime import datetime, timezone

        self._append((id_, None, None, datetime.now(timezone.utc)))

    def get(self, id_: str) -> Store:
        if self._current().where(F.col("id") == id_).isEmpty():
            raise ModelError("no such store", 5002)
        return Store(self.spark, f"{self.path}/{id_}")

    def list(self, *, name: str = "", ids: list[str] | None = None, size: int = 50, cursor: str = "") -> tuple[list, str]:
        rows = self._current()
        rows = rows.where(F.col("name") == name) if name else rows
        rows = rows.where(F.col("id").isin(*ids)) if ids else rows
        got = rows.where(F.col("id") >= cursor).orderBy("id").limit(size + 1).collect()
        return got[:size], got[size]["id"] if len(got) > size else ""
