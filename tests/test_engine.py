import random

import pytest

from relgrid.operators.check import batch_check, check, list_objects
from relgrid.operators.list_users import list_users
from relgrid.plans.model import Computed, Difference, Intersection, ModelError, This, Union, parse_model, validate

TUPLE = "object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string, condition_name string, condition_context string"
REQUEST = "qid string, object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string, context string"

MODEL = """
model
  schema 1.1
type user
type group
  relations
    define member: [user, user:*, group#member]
type folder
  relations
    define parent: [folder]
    define owner: [user, group#member]
    define banned: [user, user:*]
    define viewer: (owner or viewer from parent) but not banned
type doc
  relations
    define folder: [folder]
    define editor: [user, group#member, user:*, user with late]
    define both: editor and viewer from folder
    define either: editor or viewer from folder
    define not_owner: editor but not owner from folder
condition late(hour: int, least: int) {
  hour >= least
}
"""


def row(text: str, condition: str = "", context: str = ""):
    """type:id#relation@user as tuple columns."""
    object_, _, rest = text.partition("#")
    relation, _, user = rest.partition("@")
    user, _, subject_relation = user.partition("#")
    return (*object_.split(":", 1), relation, *user.split(":", 1), subject_relation, condition, context)


def brute(m, tuples, object_type, object_id, relation, subject, contexts=None):
    """Least-fixpoint reading of a model over ground atoms, without conditions."""
    objects = {(t[0], t[1]) for t in tuples} | {(t[3], t[4]) for t in tuples} | {(object_type, object_id), (subject[0], subject[1])}
    true: set = set()

    def ok(kind, oid, rel, e):
        if isinstance(e, This):
            for t in tuples:
                if t[:3] != (kind, oid, rel):
                    continue
                allowed = [x for x in m.types[kind][rel].restrictions if x.type == t[3] and x.relation == t[5] and x.wildcard == (t[4] == "*") and x.condition == t[6]]
                if not allowed:
                    continue
                if t[5]:
                    if t[3:6] == subject or (t[3], t[4], t[5]) in true:
                        return True
                elif t[3] == subject[0] and not subject[2] and t[4] in (subject[1], "*"):
                    return True
            return False
        if isinstance(e, Computed):
            return (kind, oid, e.relation) in true
        if isinstance(e, Union):
            return any(ok(kind, oid, rel, p) for p in e.parts)
        if isinstance(e, Intersection):
            return all(ok(kind, oid, rel, p) for p in e.parts)
        if isinstance(e, Difference):
            return ok(kind, oid, rel, e.base) and not ok(kind, oid, rel, e.subtract)
        return any(t[:3] == (kind, oid, e.tupleset) and not t[5] and (t[3], t[4], e.relation) in true for t in tuples)

    order = ["member", "parent", "folder", "owner", "banned", "viewer", "editor", "both", "either", "not_owner"]
    for rel in order:  # the model's strata
        while True:
            new = {(k, i, rel) for k, i in objects if rel in m.types.get(k, {}) and (k, i, rel) not in true and ((k, i, rel) == subject or ok(k, i, rel, m.types[k][rel].rewrite))}
            if not new:
                break
            true |= new
    return (object_type, object_id, relation) in true


def random_tuples(seed: int):
    r = random.Random(seed)
    u, g, f, d = (lambda p: (lambda: f"{p}{r.randrange(4)}"))("u"), (lambda: f"g{r.randrange(4)}"), (lambda: f"f{r.randrange(5)}"), (lambda: f"d{r.randrange(5)}")
    out = set()
    for _ in range(26):
        out.add(
            row(
                r.choice(
                    [
                        f"group:{g()}#member@user:{u()}", f"group:{g()}#member@group:{g()}#member", f"folder:{f()}#parent@folder:{f()}", f"folder:{f()}#owner@user:{u()}", f"folder:{f()}#owner@group:{g()}#member",
                        f"folder:{f()}#banned@user:{u()}", f"doc:{d()}#folder@folder:{f()}", f"doc:{d()}#editor@user:{u()}", f"doc:{d()}#editor@group:{g()}#member", f"doc:{d()}#editor@user:*", f"group:{g()}#member@user:*",
                    ]
                )
            )
        )
    return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    """Check, ListObjects and ListUsers agree with each other and with plain evaluation."""
    m, tuples = validate(parse_model(MODEL)), random_tuples(seed)
    df = spark.createDataFrame(tuples, TUPLE)
    asked, want = [], {}
    subjects = [("user", f"u{i}", "") for i in range(3)] + [("group", "g1", "member")]
    for kind, rel, ids in (("folder", "viewer", "f"), ("doc", "both", "d"), ("doc", "not_owner", "d")):
        for i in range(5):
            for s in subjects:
                q = f"{kind}|{ids}{i}|{rel}|{s[1]}"
                asked.append((q, kind, f"{ids}{i}", rel, *s, "{}"))
                want[q] = brute(m, tuples, kind, f"{ids}{i}", rel, s)
    requests = spark.createDataFrame(asked, REQUEST)
    got = {r.qid: r.allowed for r in check(m, df, requests).collect()}
    assert got == want
    listed = list_objects(m, df, requests.selectExpr("concat_ws('|', relation, subject_id) as qid", "object_type", "relation", "subject_type", "subject_id", "subject_relation").distinct())
    expect = {(f"{rel}|{s}", f"{kind}:{i}") for q, ok in want.items() if ok for kind, i, rel, s in [q.split("|")]}
    assert {(r.qid, r.object) for r in listed.collect()} == expect
    keys = requests.selectExpr("concat_ws('|', relation, object_id) as qid", "object_type", "object_id", "relation", "'user' as filter_type", "'' as filter_relation").distinct()
    users = {}
    for r in list_users(m, df, keys).collect():
        users.setdefault(r.qid, set()).add(r.user)
    for q, ok in want.items():
        _, i, rel, s = q.split("|")
        if s.startswith("u"):
            found = users.get(f"{rel}|{i}", set())
            # named, or covered by the wildcard without being excluded; the wildcard itself says nothing of excluded users
            assert (f"user:{s}" in found) <= ok and (ok <= (f"user:{s}" in found or "user:*" in found)), (q, found)


def ask(*texts, context="{}"):
    return [(t, *row(t)[:6], context) for t in texts]


def test_cases(spark):
    m = validate(parse_model(MODEL))
    tuples = [
        row("group:a#member@group:b#member"), row("group:b#member@group:a#member"), row("group:b#member@user:x"), row("doc:1#editor@group:a#member"), row("doc:2#editor@user:x", "late", '{"least": 9}'),
        row("doc:3#editor@ghost:x"), row("doc:4#editor@user:y", "unknown"), row("doc:5#editor@user:*"),
    ]
    df = spark.createDataFrame(tuples, TUPLE)
    asked = [
        *ask("group:a#member@user:x", "group:a#member@group:a#member", "doc:1#editor@user:x", "doc:1#editor@group:b#member", "doc:3#editor@ghost:x", "doc:4#editor@user:y", "doc:5#editor@user:new", "doc:5#editor@group:a#member", "doc:5#editor@user:*"),
        ("early", *row("doc:2#editor@user:x")[:6], '{"hour": 8}'), ("late", *row("doc:2#editor@user:x")[:6], '{"hour": 10}'), ("none", *row("doc:2#editor@user:x")[:6], "{}"),
    ]
    got = {r.qid: (r.allowed, r.failed) for r in check(m, df, spark.createDataFrame(asked, REQUEST)).collect()}
    assert [got[q][0] for q in list(got) if q == "group:a#member@user:x"] == [True]
    want = {"group:a#member@group:a#member": True, "doc:1#editor@user:x": True, "doc:1#editor@group:b#member": True, "doc:3#editor@ghost:x": False, "doc:4#editor@user:y": False, "doc:5#editor@user:new": True, "doc:5#editor@group:a#member": False, "doc:5#editor@user:*": True}
    assert {k: got[k][0] for k in want} == want
    assert got["early"] == (False, False) and got["late"] == (True, False) and got["none"] == (False, True)


def test_batch_check_ids(spark):
    m = validate(parse_model(MODEL))
    df = spark.createDataFrame([row("group:a#member@user:x")], TUPLE)
    one = spark.createDataFrame([(*row("group:a#member@user:x")[:6], "c1"), (*row("group:a#member@user:y")[:6], "c2")], "object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string, correlation_id string")
    assert {r.correlation_id: r.allowed for r in batch_check(m, df, one).collect()} == {"c1": True, "c2": False}
    with pytest.raises(ModelError):
        batch_check(m, df, one.union(one))
    with pytest.raises(ModelError):
        batch_check(m, df, one, max_checks=1)
    with pytest.raises(ModelError):
        check(m, df, spark.createDataFrame(ask("group:a#nothing@user:x"), REQUEST))


def test_more_relations_than_the_limit_raise(spark, monkeypatch):
    from relgrid.operators import evaluate
    from relgrid.operators.check import _targets

    monkeypatch.setattr(evaluate, "MAX_RELATIONS", 3)
    asked = spark.range(5).selectExpr("'doc' as object_type", "concat('r', least(id, 3)) as relation")
    with pytest.raises(evaluate.ModelError):
        _targets(asked)
    assert len(_targets(asked.where("relation <> 'r3'"))) == 3


def test_check_work_follows_the_requests(spark):
    """Values hold the pairs asked for, not all that their subjects reach, through recursion as well."""
    from relgrid.operators.evaluate import Evaluator, with_contextual

    m = validate(parse_model(MODEL))
    tuples = [row("folder:top#owner@user:x"), *(row(f"folder:f{i}#parent@folder:{'top' if i < 3 else f'f{i - 3}'}") for i in range(60)), *(row(f"doc:{i}#folder@folder:f{i % 60}") for i in range(300))]
    df = with_contextual(spark.createDataFrame(tuples, TUPLE), None)
    wanted = spark.createDataFrame([("q", "7"), ("q", "59"), ("q", "none")], "qid string, object_id string")
    seeds = spark.createDataFrame([("q", "user", "x", "")], "qid string, subject_type string, subject_id string, subject_relation string")
    e = Evaluator(m, df, seeds)
    e.demand(("doc", "either"), wanted)
    assert {r.object_id for r in e.value("doc", "either").collect()} == {"7", "59"}
    assert e.need["folder", "viewer"].count() == 24  # f7, f4, f1, top, and f59 up to f2
    assert e.value("folder", "viewer").count() == 24
    assert {(r.qid, r.object) for r in list_objects(m, df.drop("ctx"), spark.createDataFrame(ask("doc:1#either@user:x"), REQUEST)).collect()} >= {("doc:1#either@user:x", "doc:299")}


def test_limits_streams_and_undecided_objects(spark):
    from relgrid.operators.check import stream_objects, undecided_objects

    m = validate(parse_model(MODEL))
    df = spark.createDataFrame([*(row(f"doc:{i}#editor@user:x") for i in range(5)), row("doc:9#editor@user:y"), row("doc:8#editor@user:y", "late", '{"least": 9}')], TUPLE)
    asked = spark.createDataFrame([("a", *row("doc:1#editor@user:x")[:6], "{}"), ("b", *row("doc:1#editor@user:x")[:6], "{}"), ("c", *row("doc:1#editor@user:y")[:6], "{}")], REQUEST)
    some = {}
    for r in list_objects(m, df, asked, max_results=2).collect():
        some.setdefault(r.qid, set()).add(r.object)
    assert some == {"a": {"doc:0", "doc:1"}, "b": {"doc:0", "doc:1"}, "c": {"doc:9"}}
    assert len(list(stream_objects(m, df, asked))) == 11
    assert [tuple(r) for r in undecided_objects(m, df, asked).collect()] == [("c", "doc:8")]


def test_evaluations_merge_properties_into_the_context(spark):
    from relgrid.operators.search import evaluate

    m = validate(parse_model(MODEL))
    df = spark.createDataFrame([row("doc:2#editor@user:x", "late", '{"subject_least": 1}')], TUPLE)
    m.conditions["late"] = type(m.conditions["late"])("late", (("subject_hour", "int"), ("least", "int")), "subject_hour >= least")
    asked = spark.createDataFrame([(str(h), "doc", "2", "editor", "user", "x", "", {"hour": str(h)}, {"least": "9"}) for h in (8, 10)], "qid string, object_type string, object_id string, action string, subject_type string, subject_id string, subject_relation string, subject_properties map<string,string>, context map<string,string>")
    assert {r.qid: r.decision for r in evaluate(m, df, asked).collect()} == {"8": False, "10": True}
