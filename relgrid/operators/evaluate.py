"""Batch evaluation of relations: which objects do the subjects of many requests reach?

The value of a relation is a table (qid, object_id). A request's subject seeds it: as itself, as its type's
wildcard, and, being a userset, as a member of that very relation. Direct tuples are joined on the subject,
userset and tuple-to-userset expressions on the value of the relation they lead to; or, and, but not are
union, semi join and anti join. Relations are evaluated in the order of their dependencies; recursive groups
by a semi-naive loop that only joins what the last round has found.

Where the objects are given too, demand() first goes from them towards the subjects and notes the pairs (qid,
object) that each relation can be asked for; values are then joined from these pairs, so their size follows
what was asked and not all that subjects can reach. Groups that recur through usersets alone are still
evaluated from the subjects, whose closure upwards is the smaller one.

Conditions are three-valued. Every relation can be evaluated as what must hold (errors are false) or may hold
(errors are true); a request that may but need not hold has met an error.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrid.functions.cel import condition_column
from relgrid.plans.model import Computed, Difference, Intersection, Model, ModelError, This, Union, Via, children, dependencies, strata, tuplesets, walk
from relgrid.sources.storage import cut

VALUE = ("qid", "object_id")
TUPLE = ("object_type", "object_id", "relation", "subject_type", "subject_id", "subject_relation", "condition_name", "condition_context")


def with_defaults(tuples: DataFrame) -> DataFrame:
    """Tuple columns without nulls where empty is meant, and `ctx`, the request a contextual tuple belongs to."""
    have = set(tuples.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
    ctx = F.col("ctx") if "ctx" in have else F.lit(None).cast("string").alias("ctx")
    return tuples.select("object_type", "object_id", "relation", "subject_type", "subject_id", text("subject_relation"), text("condition_name"), text("condition_context"), ctx)


def with_contextual(tuples: DataFrame, contextual: DataFrame | None) -> DataFrame:
    """Stored tuples and those that single requests (column qid) bring along."""
    stored = with_defaults(tuples)
    if contextual is None:
        return stored
    return stored.unionByName(with_defaults(contextual.withColumn("ctx", F.col("qid").cast("string"))))


def direct_filter(m: Model, t: str, r: str) -> Column:
    """Which tuples of t#r the model admits. A condition counts by the subject's type, not by its kind; having none must
    be admitted for the kind."""
    allowed = F.lit(False)
    for x in m.types[t][r].restrictions:
        same = [y for y in m.types[t][r].restrictions if y.type == x.type]
        bare = any(not y.condition and (y.relation == x.relation if y.relation else y.wildcard == x.wildcard) for y in same)
        names = sorted({y.condition for y in same if y.condition} | ({""} if bare else set()))
        kind = (F.col("subject_relation") == x.relation) if x.relation else (F.col("subject_relation") == "")
        star = (F.col("subject_id") == "*") if x.wildcard else (F.col("subject_id") != "*")
        allowed = allowed | ((F.col("subject_type") == x.type) & kind & star & F.col("condition_name").isin(*names))
    return (F.col("object_type") == t) & (F.col("relation") == r) & allowed


def valid_tuples(m: Model, tuples: DataFrame) -> DataFrame:
    """Tuples that the model admits; tuples of older models stay stored but are not seen."""
    ok = F.lit(False)
    for t, relations in m.types.items():
        for r, rel in relations.items():
            if rel.restrictions:
                ok = ok | direct_filter(m, t, r)
    return tuples.where(ok)


def conditions_hold(m: Model, rows: DataFrame, names: set[str], contexts: DataFrame | None, may: bool) -> DataFrame:
    """Rows (with qid) whose condition holds, or may hold."""
    names = {n for n in names if n}
    if not names:
        return rows
    rows, ok = _condition(m, rows, names, contexts)
    return rows.where(F.coalesce(ok, F.lit(may))).drop("__context")


def undecided_rows(m: Model, rows: DataFrame, names: set[str], contexts: DataFrame | None) -> DataFrame:
    """Rows (with qid) whose condition cannot be evaluated."""
    names = {n for n in names if n}
    if not names:
        return rows.limit(0)
    rows, ok = _condition(m, rows, names, contexts)
    return rows.where(ok.isNull()).drop("__context")


def _condition(m: Model, rows: DataFrame, names: set[str], contexts: DataFrame | None) -> tuple[DataFrame, Column]:
    if contexts is not None:
        rows = rows.join(contexts.select("qid", F.col("context").alias("__context")), "qid", "left")
    else:
        rows = rows.withColumn("__context", F.lit(None).cast("string"))
    ok = F.when(F.col("condition_name") == "", F.lit(True))
    for n in sorted(names):
        ok = ok.when(F.col("condition_name") == n, condition_column(m.conditions[n], F.col("condition_context"), F.col("__context")))
    return rows, ok


MAX_RELATIONS = 10_000


def few(rows: DataFrame) -> list:
    """Distinct rows of a table that has as few as a model has relations; more raise ModelError."""
    got = rows.distinct().limit(MAX_RELATIONS + 1).collect()
    if len(got) > MAX_RELATIONS:
        raise ModelError(f"more than {MAX_RELATIONS} different {', '.join(rows.columns)} in the requests")
    return got


class Evaluator:
    """Values of relations for one batch of subjects: seeds (qid, subject_type, subject_id, subject_relation)."""

    def __init__(self, model: Model, tuples: DataFrame, seeds: DataFrame, contexts: DataFrame | None = None, *, max_depth: int | None = None):
        self.m, self.t, self.max_depth = model, tuples, max_depth
        self.contexts = contexts
        own = seeds.select("qid", "subject_type", "subject_id", F.coalesce("subject_relation", F.lit("")).alias("subject_relation"))
        star = own.where("subject_relation = '' and subject_id <> '*'").withColumn("subject_id", F.lit("*"))
        self.seeds = own.union(star.select(own.columns)).distinct()
        kinds = few(own.select("subject_type", "subject_relation"))  # kinds of subjects, of which a model has few
        self.kinds = {(k[0], k[1]) for k in kinds}
        self.memo: dict = {}
        self.reach: dict = {}
        self.need: dict = {}  # node -> pairs (qid, object_id) asked for; nodes without pairs are evaluated in full

    def conditional(self, node) -> bool:
        """Whether conditions have a say in the relation, so that what may hold can differ from what must."""
        if node not in self.reach:
            self.reach[node] = any(x.condition for g in strata(self.m, node) for t, r in g for n in {r, *tuplesets(self.m, t, r)} for x in self.m.types[t][n].restrictions)
        return self.reach[node]

    # which relations can lead to the subjects at all
    def _reached(self, node) -> bool:
        for group in strata(self.m, node):
            for t, r in group:
                if (t, r) in self.kinds or any((x.type, x.relation) in self.kinds for x in self.m.types[t][r].restrictions):
                    return True
        return False

    # from objects towards subjects
    def demand(self, root, wanted: DataFrame) -> None:
        """Restrict values to what the wanted pairs (qid, object_id) of root depend on."""
        asked: dict = {root: [wanted.select(*VALUE).distinct()]}
        full: set = set()
        for group in reversed(strata(self.m, root)):
            group = [n for n in group if n in asked or n in full]
            if not group:
                continue
            whole = self._group_of(group[0], root)
            inside = [(n, c) for n in whole for c in dependencies(self.m, *n) if c in whole]
            if full & set(whole) or inside and not any(self._recurs_by_tupleset(n, set(whole)) for n in whole):
                full |= {*whole, *(c for n in whole for c in dependencies(self.m, *n))}
                continue
            if inside:
                self._close(whole, asked)
            else:
                n = group[0]
                self.need[n] = self._pairs(asked[n], bool(dependencies(self.m, *n)))
            for n in whole:
                if n in self.need:
                    for child, pairs in self._asked_by(n, self.need[n]):
                        if child not in whole:
                            asked.setdefault(child, []).append(pairs)
        for n in full:
            self.need.pop(n, None)

    def _group_of(self, node, root) -> list:
        return next(g for g in strata(self.m, root) if node in g)

    def _recurs_by_tupleset(self, node, group: set) -> bool:
        t, r = node
        return any(isinstance(e, Via) and any((x.type, e.relation) in group for x in self.m.types[t][e.tupleset].restrictions) or isinstance(e, Computed) and (t, e.relation) in group for e in walk(self.m.types[t][r].rewrite))

    @staticmethod
    def _pairs(parts: list, keep: bool) -> DataFrame:
        if len(parts) == 1:
            return cut(parts[0]) if keep else parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return cut(out.distinct()) if keep else out.distinct()

    def _close(self, group: list, asked: dict) -> None:
        """Demand inside a recursive group: rounds until no new pair comes up."""
        new = {n: self._pairs(asked[n], True) for n in group if n in asked}
        self.need.update(new)
        rounds = 0
        while new:
            rounds += 1
            fresh: dict = {}
            for n, pairs in new.items():
                for child, more in self._asked_by(n, pairs):
                    if child in group:
                        fresh.setdefault(child, []).append(more)
            new = {}
            for n, parts in fresh.items():
                pairs = self._pairs(parts, False)
                if n in self.need:
                    pairs = pairs.join(self.need[n], list(VALUE), "left_anti")
                pairs = cut(pairs)
                if not pairs.isEmpty():
                    new[n] = pairs
                    self.need[n] = compacted(self.need[n].union(pairs), rounds) if n in self.need else pairs

    def _asked_by(self, node, pairs: DataFrame):
        """(child, pairs) that pairs of node can ask of others."""
        t, r = node
        rel = self.m.types[t][r]
        for e in walk(rel.rewrite):
            if isinstance(e, Computed):
                yield (t, e.relation), pairs
            elif isinstance(e, This):
                for child in sorted({(x.type, x.relation) for x in rel.restrictions if x.relation}):
                    yield child, self._to(self._usersets(t, r, child), pairs)
            elif isinstance(e, Via):
                for kind in sorted({x.type for x in self.m.types[t][e.tupleset].restrictions}):
                    if self.m.relation(kind, e.relation):
                        yield (kind, e.relation), self._to(self._parents(t, e.tupleset, kind), pairs)

    def _to(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        return self._of_request(rows.join(pairs, "object_id")).select("qid", F.col("subject_id").alias("object_id")).distinct()

    def value(self, t: str, r: str, may: bool = False) -> DataFrame | None:
        """(qid, object_id) of t#r, or None if no data could give any; after demand(), right for the pairs asked for."""
        may = may and self.conditional((t, r))
        if (t, r, may) in self.memo:
            return self.memo[t, r, may]
        if not self._reached((t, r)):
            return None
        groups = strata(self.m, (t, r))
        uses = Counter(d for g in groups for n in g for d in dependencies(self.m, *n))
        for group in groups:
            if any((*n, may) in self.memo for n in group):
                continue
            if may and not self.conditional(group[0]):
                self.value(*group[0])
                self.memo.update({(*n, True): self.memo.get((*n, False)) for n in group})
                continue
            recursive = len(group) > 1 or group[0] in dependencies(self.m, *group[0])
            if recursive:
                self._fixpoint(group, may)
            else:
                n = group[0]
                v = self._with_reflexive(n, self._full(n, self.m.types[n[0]][n[1]].rewrite, {}, may))
                v = v.distinct() if v is not None else None
                self.memo[*n, may] = cut(v) if v is not None and uses[n] > 1 else v
        return self.memo[t, r, may]

    def _with_reflexive(self, node, v: DataFrame | None) -> DataFrame | None:
        t, r = node
        if (t, r) not in self.kinds:
            return v
        own = self.seeds.where((F.col("subject_type") == t) & (F.col("subject_relation") == r)).select("qid", F.col("subject_id").alias("object_id"))
        if node in self.need:
            own = own.join(self.need[node], list(VALUE), "left_semi")
        return own if v is None else v.union(own)

    def _child(self, node, env: dict, may: bool) -> DataFrame | None:
        if node in env:
            return env[node]
        return self.value(*node, may)

    # one relation's direct tuples
    def _scan(self, t: str, r: str) -> DataFrame:
        return self.t.where(direct_filter(self.m, t, r))

    def _usersets(self, t: str, r: str, child) -> DataFrame:
        return self._scan(t, r).where((F.col("subject_type") == child[0]) & (F.col("subject_relation") == child[1]))

    def _parents(self, t: str, tupleset: str, kind: str) -> DataFrame:
        return self._scan(t, tupleset).where((F.col("subject_type") == kind) & (F.col("subject_relation") == "") & (F.col("subject_id") != "*"))

    def _of_request(self, rows: DataFrame) -> DataFrame:
        return rows.where("ctx is null or ctx = cast(qid as string)")

    def _reaching(self, node, rows: DataFrame, child: DataFrame) -> DataFrame:
        """Tuples of node that lead to objects in the child's value."""
        found = child.select("qid", F.col("object_id").alias("subject_id"))
        if node in self.need:
            return rows.join(self.need[node], "object_id").join(found, ["qid", "subject_id"])
        return rows.join(found, "subject_id")

    def _this(self, node, env: dict, may: bool, only: set | None = None) -> DataFrame | None:
        t, r = node
        rel, found = self.m.types[t][r], []
        plain = {x.type for x in rel.restrictions if not x.relation} & {k for k, _ in self.kinds}
        if only is None and any(k in plain and s == "" for k, s in self.kinds):
            subjects, key = self.seeds.where("subject_relation = ''").drop("subject_relation"), ["subject_type", "subject_id"]
            if node in self.need:
                subjects, key = self.need[node].join(subjects, "qid"), ["object_id", *key]
            found.append(self._scan(t, r).where(F.col("subject_relation") == "").join(subjects, key))
        for child in sorted({(x.type, x.relation) for x in rel.restrictions if x.relation}):
            if only is not None and child not in only:
                continue
            v = self._child(child, env, may)
            if v is not None:
                found.append(self._reaching(node, self._usersets(t, r, child), v))
        return self._held(found, {x.condition for x in rel.restrictions}, may)

    def _via(self, node, e: Via, env: dict, may: bool, only: set | None = None) -> DataFrame | None:
        t, _ = node
        rel, found = self.m.types[t][e.tupleset], []
        for kind in sorted({x.type for x in rel.restrictions}):
            child = (kind, e.relation)
            if self.m.relation(*child) is None or (only is not None and child not in only):
                continue
            v = self._child(child, env, may)
            if v is not None:
                found.append(self._reaching(node, self._parents(t, e.tupleset, kind), v))
        return self._held(found, {x.condition for x in rel.restrictions}, may)

    def _held(self, found: list, names: set[str], may: bool) -> DataFrame | None:
        """(qid, object_id) of the tuples found whose conditions hold."""
        out = None
        for f in found:
            f = f.select("qid", "object_id", "condition_name", "condition_context", "ctx")
            out = f if out is None else out.union(f)
        return None if out is None else conditions_hold(self.m, self._of_request(out), names, self.contexts, may).select(*VALUE)

    def _full(self, node, e, env: dict, may: bool) -> DataFrame | None:
        """Value of an expression; env gives what is known of relations still being computed."""
        if isinstance(e, This):
            return self._this(node, env, may)
        if isinstance(e, Computed):
            return self._child((node[0], e.relation), env, may)
        if isinstance(e, Via):
            return self._via(node, e, env, may)
        if isinstance(e, Difference):
            base, minus = self._full(node, e.base, env, may), self._full(node, e.subtract, env, not may)
            return base if base is None or minus is None else base.join(minus, list(VALUE), "left_anti")
        return _combined(e, [self._full(node, p, env, may) for p in e.parts])

    # recursion
    def _touches(self, node, e, group: set) -> bool:
        t = node[0]
        for x in walk(e):
            if isinstance(x, This) and any((y.type, y.relation) in group for y in self.m.types[t][node[1]].restrictions):
                return True
            if isinstance(x, Computed) and (t, x.relation) in group:
                return True
            if isinstance(x, Via) and any((y.type, x.relation) in group for y in self.m.types[t][x.tupleset].restrictions):
                return True
        return False

    def _step(self, node, e, new: dict, acc: dict, may: bool) -> DataFrame | None:
        """What the newest rows add to an expression that depends on its own group."""
        group = set(acc)
        if isinstance(e, This):
            return self._this(node, new, may, group)
        if isinstance(e, Computed):
            return new.get((node[0], e.relation))
        if isinstance(e, Via):
            return self._via(node, e, new, may, group)
        if isinstance(e, Difference):
            if self._touches(node, e.subtract, group):
                raise ModelError(f"'{node[0]}#{node[1]}' excludes what depends on itself")
            base, minus = self._step(node, e.base, new, acc, may), self._full(node, e.subtract, {}, not may)
            return base if base is None or minus is None else base.join(minus, list(VALUE), "left_anti")
        recursive = [p for p in e.parts if self._touches(node, p, group)]
        if isinstance(e, Union):
            return _combined(e, [x for x in (self._step(node, p, new, acc, may) for p in recursive)])
        out = []
        for p in recursive:
            x = self._step(node, p, new, acc, may)
            for q in e.parts:
                if q is not p and x is not None:
                    other = self._full(node, q, acc, may)
                    x = None if other is None else x.join(other, list(VALUE), "left_semi")
            out.append(x)
        return _combined(Union(()), out)

    def _fixpoint(self, group: list, may: bool) -> None:
        nothing = {n: None for n in group}
        acc: dict = {}
        for n in group:
            v = self._with_reflexive(n, self._full(n, self.m.types[n[0]][n[1]].rewrite, nothing, may))
            acc[n] = cut(v.distinct()) if v is not None else None
        new = dict(acc)
        depth = 0
        while any(v is not None for v in new.values()):
            depth += 1
            if self.max_depth is not None and depth > self.max_depth:
                raise ModelError("the resolution is too deep", 2002)
            found = {}
            for n in group:
                e = self.m.types[n[0]][n[1]].rewrite
                x = self._step(n, e, new, acc, may) if self._touches(n, e, set(group)) else None
                if x is not None:
                    x = x.distinct()
                    x = cut(x.join(acc[n], list(VALUE), "left_anti") if acc[n] is not None else x)
                    x = None if x.isEmpty() else x
                found[n] = x
            for n, x in found.items():
                if x is not None:
                    acc[n] = x if acc[n] is None else compacted(acc[n].union(x), depth)
            new = found
        for n in group:
            self.memo[*n, may] = acc[n]


COMPACT_ROUNDS = 16


def compacted(rows: DataFrame, rounds: int) -> DataFrame:
    """Every COMPACT_ROUNDS rounds the union of all rounds is written as one, so plans stay small."""
    return cut(rows) if rounds % COMPACT_ROUNDS == 0 else rows


def _combined(e, parts: list) -> DataFrame | None:
    if isinstance(e, Intersection):
        if any(p is None for p in parts):
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, list(VALUE), "left_semi")
        return out
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.union(p)
    return out


__all__ = ["Evaluator", "children", "conditions_hold", "direct_filter", "valid_tuples", "with_contextual", "with_defaults"]
