"""Replays YAML files of cases: models, tuples, and the answers expected of check, list objects and list users.

CASES_DIR names a folder with such files; without it there is nothing to replay. CASES_LOG names a file that gets a
line for each case as it ends, CASES_PART (as 0/4) takes a part of them.
"""

import glob
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from relgrid.operators.check import check, list_objects, undecided_objects
from relgrid.operators.list_users import list_users, undecided_requests
from relgrid.plans.model import ModelError, parse_model

FOLDER = os.environ.get("CASES_DIR", "")
TUPLE = "object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string, condition_name string, condition_context string"
UNDECIDED = 2000


def cases():
    import yaml

    for path in sorted(glob.glob(os.path.join(FOLDER, "*.yaml"))):
        with open(path) as f:
            yield from yaml.safe_load(f)["tests"]


def split(user: str) -> tuple[str, str, str]:
    whole, _, relation = user.partition("#")
    kind, _, id_ = whole.partition(":")
    return kind, id_, relation


def tuple_row(t: dict) -> tuple:
    c = t.get("condition") or {}
    return (*t["object"].split(":", 1), t["relation"], *split(t["user"]), c.get("name") or "", json.dumps(c["context"]) if c.get("context") else "")


def answers(run):
    """The function's answer, or the code of the error it raises."""
    try:
        return run()
    except ModelError as e:
        return e.code


class Stage:
    def __init__(self, spark, model: str, tuples: list):
        self.spark, self.m = spark, parse_model(model)
        self.tuples = spark.createDataFrame([tuple_row(t) for t in tuples], TUPLE)

    def _requests(self, rows: list, columns: str, contexts: list):
        """Requests without contextual tuples together, others one by one."""
        schema = f"qid string, {columns}, context string"
        plain = [i for i, c in enumerate(contexts) if not c]
        for some in ([plain] if plain else []) + [[i] for i, c in enumerate(contexts) if c]:
            more = [(str(i), *tuple_row(t)) for i in some for t in contexts[i] or ()]
            yield some, self.spark.createDataFrame([(str(i), *rows[i]) for i in some], schema), self.spark.createDataFrame(more, f"qid string, {TUPLE}") if more else None

    def run(self, assertions: list, rows: list, columns: str, ask) -> list:
        """(assertion, answer) pairs; requests of unknown types or relations would fail their whole batch and go alone."""
        alone = [i for i, a in enumerate(assertions) if a.get("errorCode") not in (None, UNDECIDED)]
        out = []
        for group in [[i for i in range(len(assertions)) if i not in alone], *([i] for i in alone)]:
            if not group:
                continue
            mine = [assertions[i] for i in group]
            for some, requests, contextual in self._requests([rows[i] for i in group], columns, [a.get("contextualTuples") for a in mine]):
                got = answers(lambda r=requests, c=contextual: ask(r, c))
                out += [(mine[i], got if isinstance(got, int) else got.get(str(i))) for i in some]
        return out

    def check(self, assertions: list) -> list:
        def ask(requests, contextual):
            return {r.qid: UNDECIDED if r.failed else r.allowed for r in check(self.m, self.tuples, requests, contextual).collect()}

        rows = [(*a["tuple"]["object"].split(":", 1), a["tuple"]["relation"], *split(a["tuple"]["user"]), json.dumps(a.get("context") or {})) for a in assertions]
        got = self.run(assertions, rows, "object_type string, object_id string, relation string, subject_type string, subject_id string, subject_relation string", ask)
        return [("check", a, x) for a, x in got if x != (a.get("errorCode") or a.get("expectation", False))]

    def list_objects(self, assertions: list) -> list:
        def ask(requests, contextual):
            found = {r.qid: set() for r in requests.collect()}
            for r in list_objects(self.m, self.tuples, requests, contextual).collect():
                found[r.qid].add(r.object)
            return found | {r.qid: UNDECIDED for r in undecided_objects(self.m, self.tuples, requests, contextual).collect()}

        rows = [(a["request"]["type"], a["request"]["relation"], *split(a["request"]["user"]), json.dumps(a.get("context") or {})) for a in assertions]
        got = self.run(assertions, rows, "object_type string, relation string, subject_type string, subject_id string, subject_relation string", ask)
        return [("list_objects", a, x) for a, x in got if x != (a.get("errorCode") or set(a.get("expectation") or ()))]

    def list_users(self, assertions: list) -> list:
        def ask(requests, contextual):
            found = {r.qid: set() for r in requests.collect()}
            for r in list_users(self.m, self.tuples, requests, contextual).collect():
                found[r.qid].add(r.user)
            return found | {r.qid: UNDECIDED for r in undecided_requests(self.m, self.tuples, requests, contextual).collect()}

        rows = []
        for a in assertions:
            kind, _, relation = a["request"]["filters"][0].partition("#")
            rows.append((*a["request"]["object"].split(":", 1), a["request"]["relation"], kind, relation, json.dumps(a.get("context") or {})))
        got = self.run(assertions, rows, "object_type string, object_id string, relation string, filter_type string, filter_relation string", ask)
        return [("list_users", a, x) for a, x in got if x != (a.get("errorCode") or set(a.get("expectation") or ()))]


def replay(spark, case: dict) -> list:
    """(case, stage, operation, assertion, answer) where the answer is not the one expected."""
    tuples, wrong = [], []
    for n, stage in enumerate(case["stages"]):
        tuples = tuples + (stage.get("tuples") or [])
        try:
            s = Stage(spark, stage["model"], tuples)
            found = []
            for name, key in (("check", "checkAssertions"), ("list_objects", "listObjectsAssertions"), ("list_users", "listUsersAssertions")):
                if stage.get(key):
                    found += getattr(s, name)(stage[key])
        except Exception as e:
            found = [("error", str(e)[:300], None)]
        wrong += [(case["name"], n, *f) for f in found]
    if log := os.environ.get("CASES_LOG"):
        with open(log, "a") as f:
            f.write(json.dumps([case["name"], [[str(x) for x in w] for w in wrong]]) + "\n")
    return wrong


#: what differs on purpose: an answer's place and why it differs
DIFFERENCES: dict[str, str] = {}


@pytest.mark.skipif(not FOLDER, reason="CASES_DIR is not set")
def test_cases(spark):
    part, of = map(int, os.environ.get("CASES_PART", "0/1").split("/"))
    with ThreadPoolExecutor(int(os.environ.get("CASES_THREADS", "6"))) as pool:
        wrong = [w for found in pool.map(lambda c: replay(spark, c), list(cases())[part::of]) for w in found]
    report = [f"{w[0]}, stage {w[1]}, {w[2]}: {json.dumps(w[3], default=str)} gave {w[4]!r}" for w in wrong if w[0] not in DIFFERENCES]
    assert not report, "\n".join(report)
