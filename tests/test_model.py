import pytest

from relgrid.plans.model import Computed, Difference, Intersection, ModelError, This, Union, Via, dependencies, parse_model, reaches, strata, validate
from relgrid.sources.fixtures import MODEL

HEAD = "model\n  schema 1.1\ntype user\n"


def relations(body: str):
    return parse_model(HEAD + body).types


def test_definitions():
    t = relations(
        """type doc
  relations
    define parent: [doc]   # where it lies
    define owner: [user, user:*, doc#viewer, user with c]
    define viewer: (owner or viewer from parent) but not blocked
    define blocked: [user] and owner
condition c(a: int, b: list<string>) {
  a > 1 && "x" in b
}
"""
    )["doc"]
    assert isinstance(t["parent"].rewrite, This)
    assert [(r.type, r.relation, r.wildcard, r.condition) for r in t["owner"].restrictions] == [("user", "", False, ""), ("user", "", True, ""), ("doc", "viewer", False, ""), ("user", "", False, "c")]
    v = t["viewer"].rewrite
    assert isinstance(v, Difference) and v.base == Union((Computed("owner"), Via("viewer", "parent"))) and v.subtract == Computed("blocked")
    assert t["blocked"].rewrite == Intersection((This(), Computed("owner")))


def test_conditions_keep_their_parameters():
    m = parse_model(HEAD + "condition c(a: int, b: map<string>) {\n  a > 1 && {\"k\": 1} == b\n}\ntype doc\n  relations\n    define r: [user with c]\n")
    assert m.conditions["c"].parameters == (("a", "int"), ("b", "map<string>"))
    assert m.types["doc"]["r"].restrictions[0].condition == "c"


@pytest.mark.parametrize(
    "body",
    [
        "type doc\n  relations\n    define a: [user] or b and c\n",
        "type doc\n  relations\n    define a: [ghost]\n",
        "type doc\n  relations\n    define a: b\n    define b: a\n",
        "type doc\n  relations\n    define a: b\n",
        "type doc\n  relations\n    define a: [doc#a]\n",
        "type doc\n  relations\n    define p: [user:*]\n    define a: x from p\n",
        "type doc\n  relations\n    define p: [doc]\n    define a: x from p\n",
        "type doc\n  relations\n    define a: [user with nope]\n",
        "type self\n",
        "type user\n",
        "type doc\n  relations\n    define a: [user\n",
    ],
)
def test_rejected(body):
    with pytest.raises(ModelError):
        validate(parse_model(HEAD + body))


def test_schema_version():
    with pytest.raises(ModelError):
        validate(parse_model("model\n  schema 1.0\ntype user\n"))


def test_strata_and_reachability():
    m = validate(parse_model(MODEL))
    order = [n for g in strata(m, ("order", "viewer")) for n in g]
    assert order.index(("nation", "viewer")) < order.index(("customer", "viewer")) < order.index(("order", "viewer"))
    assert dependencies(m, "team", "member") == {("team", "member")}
    assert reaches(m, ("order", "viewer"), "user") and reaches(m, ("order", "viewer"), "team", "member") and not reaches(m, ("customer", "owner"), "team", "member")
