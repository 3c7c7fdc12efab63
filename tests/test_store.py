import pytest

from relgrid.plans.model import ModelError, parse_model, validate
from relgrid.sources import store
from relgrid.streaming.changes import applied, follow, stream_changes

from .test_engine import MODEL, TUPLE, row


def rows(spark, *texts):
    return spark.createDataFrame([row(t) for t in texts], TUPLE)


def keys(df):
    return {(r.object_id, r.relation, r.subject_id) for r in df.collect()}


def test_writes_changes_and_stream(spark, tmp_path):
    m = validate(parse_model(MODEL))
    s = store.Store(spark, str(tmp_path / "s"))
    s.write(m, rows(spark, "group:a#member@user:x", "group:a#member@user:y"))
    s.write(m, rows(spark, "group:b#member@user:x"), rows(spark, "group:a#member@user:y"))
    assert keys(s.tuples()) == {("a", "member", "x"), ("b", "member", "x")}
    with pytest.raises(ModelError):
        s.write(m, rows(spark, "group:b#member@user:x"))
    s.write(m, rows(spark, "group:b#member@user:x", "group:c#member@user:z"), on_duplicate="ignore")
    for bad in ("doc:1#editor@folder:f", "group:a#member@group:a#member"):
        with pytest.raises(ModelError):
            s.write(m, rows(spark, bad))
    with pytest.raises(ModelError):
        s.write(m, rows(spark, "group:d#member@user:x"), rows(spark, "group:d#member@user:x"))
    with pytest.raises(ModelError):
        s.write(m, None, rows(spark, "group:d#member@user:none"))
    got, token = s.read_changes(object_type="group", size=3)
    more, token2 = s.read_changes(object_type="group", token=token)
    assert [r.operation for r in got].count(1) + [r.operation for r in more].count(1) == 1 and len(got) + len(more) == 5
    assert s.read_changes(object_type="group", token=token2) == ([], token2)
    with pytest.raises(ModelError):
        s.read_changes(object_type="doc", token=token)
    seen = []
    follow(stream_changes(spark, f"{s.path}/changes", object_type="group"), str(tmp_path / "cp"), lambda df, n: seen.append(keys(applied(s.tuples().limit(0), df)))).awaitTermination()
    assert set().union(*seen) == {("a", "member", "x"), ("b", "member", "x"), ("c", "member", "z")}


def test_scans_and_pages(spark):
    df = rows(spark, "doc:1#editor@user:x", "doc:2#editor@user:*", "doc:3#editor@group:a#member", "folder:1#owner@user:x")
    assert store.read(df, object_type="doc", subject_type="user").count() == 2
    assert keys(store.read_usersets(df, "doc", "editor", [("user", "", True)])) == {("2", "editor", "*")}
    x = spark.createDataFrame([("user", "x", "")], "subject_type string, subject_id string, subject_relation string")
    assert keys(store.read_starting_with_users(df, "doc", "editor", x)) == {("1", "editor", "x")}
    none = spark.createDataFrame([], "object_id string")
    assert store.read_starting_with_users(df, "doc", "editor", x, none).count() == 0
    log = spark.createDataFrame([(f"{i:026d}",) for i in range(5)], "ulid string")
    first, cursor = store.page(log, 3)
    assert [r.ulid[-1] for r in first] == ["0", "1", "2"] and cursor == f"{3:026d}" and store.page(log, 3, cursor)[1] == ""
    assert store.decode_cursor(store.encode_cursor("01A", "doc|x")) == ("01A", "doc|x")
    assert store.ulid(1, 0) < store.ulid(2, 0) and len(store.ulid()) == 26


def test_models_assertions_and_stores(spark, tmp_path):
    all_ = store.Stores(spark, str(tmp_path / "all"))
    a, b = all_.create("first"), all_.create("second")
    assert [r["name"] for r in all_.list()[0]] == ["first", "second"] and all_.list(size=1)[1] == b
    s = all_.get(a)
    all_.delete(b)
    assert [r["id"] for r in all_.list()[0]] == [a]
    with pytest.raises(ModelError):
        all_.get(b)
    id_ = s.write_model(MODEL)
    assert s.model().types.keys() == s.model(id_).types.keys() and s.models().count() == 1
    s.write(s.model(), rows(spark, "group:a#member@user:x"))
    s.write_assertions(id_, rows(spark, "group:a#member@user:x", "group:a#member@user:y").selectExpr("*", "subject_id = 'x' as expectation").drop("condition_name", "condition_context"))
    assert [r.passed for r in s.run_assertions(id_).collect()] == [True, True]


def test_writes_are_checked_and_laid_over_snapshots(spark, tmp_path):
    m = validate(parse_model(MODEL))
    s = store.Store(spark, str(tmp_path / "s"))
    with_context = lambda text, context: spark.createDataFrame([row(text, "late", context)], TUPLE)
    for bad in ("group:#member@user:x", "group:a b#member@user:x", "group:a#member@user:x#y#z", f"group:{'a' * 300}#member@user:x", "group:a#member@user:a:b"):
        with pytest.raises(ModelError):
            s.write(m, rows(spark, bad))
    for bad in ('{"other": 1}', '{"least": "soon"}', "[1]", "no json"):
        with pytest.raises(ModelError):
            s.write(m, with_context("doc:1#editor@user:x", bad))
    s.write(m, with_context("doc:1#editor@user:x", '{"least": 9}'))
    s.write(m, rows(spark, *(f"group:a#member@user:{i}" for i in range(40))))
    s.compact()
    s.write(m, rows(spark, "group:b#member@user:x"), rows(spark, "group:a#member@user:0"))
    s.write(m, rows(spark, "group:a#member@user:0"))
    s.write(m, None, rows(spark, "group:a#member@user:1"))
    want = {("1", "editor", "x"), ("b", "member", "x"), *(("a", "member", str(i)) for i in range(40) if i != 1)}
    assert keys(s.tuples()) == want and s.tuples().count() == len(want)
    s.compact()
    assert keys(s.tuples()) == want
    ulids = [r.ulid for r in s.changes().collect()]
    assert len(set(ulids)) == len(ulids) == 45 and all(len(u) == 26 and set(u) <= set(store._BASE32) for u in ulids)


def test_unknown_functions_are_rejected_with_the_model():
    with pytest.raises(ModelError):
        validate(parse_model(MODEL.replace("hour >= least", "soon(hour) >= least")))


def test_pages_of_tuples_and_checked_assertions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    id_ = s.write_model(MODEL)
    s.write(s.model(), rows(spark, *(f"group:a#member@user:{i}" for i in range(5)), "group:b#member@user:0"))
    first, token = s.read_tuples(size=4)
    rest, end = s.read_tuples(size=4, token=token)
    assert len(first) == 4 and len(rest) == 2 and end == "" and not {r.ulid for r in first} & {r.ulid for r in rest}
    assert {r.object_id for r in s.read_tuples(object_type="group", subject_type="user", subject_id="0")[0]} == {"a", "b"}
    for wrong in ({"object_type": "group"}, {"relation": "member"}, {"size": 0}, {"token": "no"}):
        with pytest.raises(ModelError):
            s.read_tuples(**wrong)
    bad = rows(spark, "group:a#nothing@user:x").selectExpr("*", "true as expectation").drop("condition_name", "condition_context")
    with pytest.raises(ModelError):
        s.write_assertions(id_, bad)
