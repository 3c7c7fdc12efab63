"""Typed models: types, relations as set expressions, conditions; parsing, validation and analysis on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ModelError(ValueError):
    """A model or a request that the model does not allow; code tells the kind."""

    def __init__(self, message: str, code: int = 2000):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Restriction:
    """One entry of a direct relation's list: type, type:* or type#relation, maybe with a condition."""

    type: str
    relation: str = ""
    wildcard: bool = False
    condition: str = ""


@dataclass(frozen=True)
class This:
    pass


@dataclass(frozen=True)
class Computed:
    relation: str


@dataclass(frozen=True)
class Via:
    """`relation` from `tupleset`."""

    relation: str
    tupleset: str


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Intersection:
    parts: tuple


@dataclass(frozen=True)
class Difference:
    base: object
    subtract: object


@dataclass
class Relation:
    rewrite: object
    restrictions: tuple[Restriction, ...] = ()


@dataclass(frozen=True)
class Condition:
    name: str
    parameters: tuple[tuple[str, str], ...]
    expression: str


@dataclass
class Model:
    schema: str
    types: dict[str, dict[str, Relation]]
    conditions: dict[str, Condition] = field(default_factory=dict)
    text: str = ""

    def relation(self, type_: str, relation: str) -> Relation | None:
        return self.types.get(type_, {}).get(relation)

    def need(self, type_: str, relation: str) -> Relation:
        if type_ not in self.types:
            raise ModelError(f"type '{type_}' not found", 2021)
        if relation not in self.types[type_]:
            raise ModelError(f"relation '{type_}#{relation}' not found", 2022)
        return self.types[type_][relation]


def children(e) -> tuple:
    if isinstance(e, (Union, Intersection)):
        return e.parts
    return (e.base, e.subtract) if isinstance(e, Difference) else ()


def walk(e):
    """Pre-order visit of an expression."""
    yield e
    for c in children(e):
        yield from walk(c)


# parsing -----------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(\[|\]|\(|\)|,|but\s+not\b|or\b|and\b|from\b|with\b|[\w.-]+(?:#[\w.-]+|:\*)?)")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ModelError(f"cannot read relation definition at: {text[at:]!r}")
        out.append(re.sub(r"\s+", " ", m[1]))
        at = m.end()
    return out


class _Definition:
    """Recursive descent over one `define`; operators may not be mixed without parentheses."""

    def __init__(self, text: str):
        self.tokens, self.at, self.restrictions = _tokens(text), 0, ()

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or (wanted and t != wanted):
            raise ModelError(f"expected {wanted or 'more'} but found {t or 'the end'}")
        self.at += 1
        return t

    def whole(self):
        e = self.expression()
        if self.peek():
            raise ModelError(f"unexpected {self.peek()!r}")
        return e

    def expression(self):
        parts, op = [self.operand()], ""
        while self.peek() in ("or", "and", "but not"):
            t = self.take()
            if op and (t != op or t == "but not"):
                raise ModelError("mixed operators need parentheses")
            op = t
            parts.append(self.operand())
        if op == "but not":
            return Difference(*parts)
        return {"or": Union, "and": Intersection}[op](tuple(parts)) if op else parts[0]

    def operand(self):
        t = self.take()
        if t == "(":
            e = self.expression()
            self.take(")")
            return e
        if t == "[":
            found = []
            while self.peek() != "]":
                name = self.take()
                condition = ""
                if self.peek() == "with":
                    self.take()
                    condition = self.take()
                if name.endswith(":*"):
                    found.append(Restriction(name[:-2], wildcard=True, condition=condition))
                else:
                    kind, _, relation = name.partition("#")
                    found.append(Restriction(kind, relation, condition=condition))
                if self.peek() == ",":
                    self.take()
            self.take("]")
            self.restrictions += tuple(found)
            return This()
        if self.peek() == "from":
            self.take()
            return Via(t, self.take())
        return Computed(t)


def parse_model(text: str) -> Model:
    """Read the modelling language: model/schema, types with `define name: expression`, and conditions."""
    schema, types, conditions = "1.1", {}, {}
    current: dict[str, Relation] | None = None
    body = re.sub(r"(?m)(^|\s)#[^\n]*", r"\1", text)

    def condition(m: re.Match) -> str:
        parameters = tuple(tuple(x.strip() for x in p.split(":", 1)) for p in _split_commas(m[2]))
        if m[1] in conditions:
            raise ModelError(f"condition '{m[1]}' is defined twice")
        conditions[m[1]] = Condition(m[1], parameters, m[3].strip())
        return ""

    body = re.sub(r"(?ms)^\s*condition\s+(\w+)\s*\(([^)]*)\)\s*\{(.*?)\}[ \t]*$", condition, body)
    lines = [x.strip() for x in body.split("\n")]
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if not line or line in ("model", "relations") or line.startswith("module "):
            continue
        word, _, rest = line.partition(" ")
        if word == "schema":
            schema = rest.strip()
        elif word in ("type", "extend"):
            name = rest.replace("type ", "", 1).strip() if word == "extend" else rest.strip()
            if word == "type" and name in types:
                raise ModelError(f"type '{name}' is defined twice")
            current = types.setdefault(name, {})
        elif word == "define" and current is not None:
            name, _, definition = rest.partition(":")
            while k < len(lines) and lines[k] and not re.match(r"(define|type|relations|condition|extend)\b", lines[k]):
                definition += " " + lines[k]
                k += 1
            d = _Definition(definition)
            if name.strip() in current:
                raise ModelError(f"relation '{name.strip()}' is defined twice")
            current[name.strip()] = Relation(d.whole(), d.restrictions)
        else:
            raise ModelError(f"cannot read line {line!r}")
    return Model(schema, types, conditions, text)


def _split_commas(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return out + [part] if part.strip() else out


# validation --------------------------------------------------------------------------------------------------------

MAX_TYPES, MAX_BYTES = 100, 256 * 1024


def validate(m: Model) -> Model:
    """Raise ModelError unless every rule holds; the model itself otherwise."""
    if m.schema not in ("1.1", "1.2"):
        raise ModelError(f"unsupported schema version {m.schema}")
    if len(m.types) > MAX_TYPES or len(m.text.encode()) > MAX_BYTES:
        raise ModelError("the model is too large")
    from relgrid.functions.cel import check_condition

    for c in m.conditions.values():
        check_condition(c)
    for t, relations in m.types.items():
        for name in (t, *relations):
            if not name or name in ("self", "this"):
                raise ModelError(f"'{name}' is a reserved or empty name")
        for r, relation in relations.items():
            _validate_relation(m, t, r, relation)
    for t, relations in m.types.items():
        for r in relations:
            if _only_computed_cycle(m, t, r):
                raise ModelError(f"'{t}#{r}' is defined by itself alone")
            if not _has_entry(m, t, r):
                raise ModelError(f"'{t}#{r}' has no entry point: no tuple could ever make it true")
    return m


def _validate_relation(m: Model, t: str, r: str, relation: Relation) -> None:
    direct = any(isinstance(e, This) for e in walk(relation.rewrite))
    if direct != bool(relation.restrictions):
        raise ModelError(f"'{t}#{r}' must list types exactly if it is directly assignable")
    for x in relation.restrictions:
        if x.type not in m.types or (x.relation and x.relation not in m.types[x.type]):
            raise ModelError(f"'{t}#{r}' lists '{x.type}{'#' * bool(x.relation)}{x.relation}', which is not defined")
        if x.condition and x.condition not in m.conditions:
            raise ModelError(f"'{t}#{r}' uses condition '{x.condition}', which is not defined")
    for e in walk(relation.rewrite):
        if isinstance(e, Computed) and e.relation not in m.types[t]:
            raise ModelError(f"'{t}#{r}' uses '{e.relation}', which is not defined on '{t}'")
        if isinstance(e, Via):
            tupleset = m.relation(t, e.tupleset)
            if tupleset is None or not isinstance(tupleset.rewrite, This):
                raise ModelError(f"'{e.tupleset}' must be a direct relation of '{t}'")
            if any(x.relation or x.wildcard for x in tupleset.restrictions):
                raise ModelError(f"'{t}#{e.tupleset}' may list plain types only, as a tupleset")
            if not any(m.relation(x.type, e.relation) for x in tupleset.restrictions):
                raise ModelError(f"'{e.relation}' is not defined on any type of '{t}#{e.tupleset}'")


def _only_computed_cycle(m: Model, t: str, r: str) -> bool:
    seen, todo = set(), [r]
    while todo:
        e = m.types[t][todo.pop()].rewrite
        # only what an answer cannot avoid: an alias, or every branch of an operator
        for c in [x for x in walk(e) if isinstance(x, Computed)] if not any(isinstance(x, (This, Via)) for x in walk(e)) else []:
            if c.relation == r:
                return True
            if c.relation not in seen:
                seen.add(c.relation)
                todo.append(c.relation)
    return False


def _has_entry(m: Model, t: str, r: str) -> bool:
    """Least fixpoint: can any chain of tuples end in a subject?"""
    good: set[tuple[str, str]] = set()

    def ok(kind: str, rel: Relation, e) -> bool:
        if isinstance(e, This):
            return any(not x.relation or (x.type, x.relation) in good for x in rel.restrictions)
        if isinstance(e, Computed):
            return (kind, e.relation) in good
        if isinstance(e, Via):
            return any((x.type, e.relation) in good for x in m.types[kind][e.tupleset].restrictions)
        if isinstance(e, Union):
            return any(ok(kind, rel, p) for p in e.parts)
        return all(ok(kind, rel, p) for p in children(e))

    while True:
        new = {(k, n) for k, rs in m.types.items() for n, rel in rs.items() if (k, n) not in good and ok(k, rel, rel.rewrite)}
        if not new:
            return (t, r) in good
        good |= new


# analysis ----------------------------------------------------------------------------------------------------------


def dependencies(m: Model, t: str, r: str) -> set[tuple[str, str]]:
    """Relations whose values the value of t#r is computed from."""
    rel, out = m.types[t][r], set()
    for e in walk(rel.rewrite):
        if isinstance(e, This):
            out |= {(x.type, x.relation) for x in rel.restrictions if x.relation}
        elif isinstance(e, Computed):
            out.add((t, e.relation))
        elif isinstance(e, Via):
            out |= {(x.type, e.relation) for x in m.types[t][e.tupleset].restrictions if m.relation(x.type, e.relation)}
    return {d for d in out if m.relation(*d)}


def strata(m: Model, root: tuple[str, str]) -> list[list[tuple[str, str]]]:
    """Strongly connected groups of relations that root needs, dependencies first (Tarjan's algorithm)."""
    index: dict = {}
    low: dict = {}
    stack: list = []
    out: list = []

    def visit(v) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(dependencies(m, *v)):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            group = []
            while True:
                w = stack.pop()
                group.append(w)
                if w == v:
                    break
            out.append(sorted(group))

    visit(root)
    return out


def reaches(m: Model, root: tuple[str, str], subject_type: str, subject_relation: str = "") -> bool:
    """Whether any path of the model leads from root to such subjects; if not, no data can."""
    if (subject_type, subject_relation) == root:
        return True
    for group in strata(m, root):
        for t, r in group:
            if (t, r) == (subject_type, subject_relation):
                return True
            if any(x.type == subject_type and x.relation == subject_relation for x in m.types[t][r].restrictions):
                return True
    return False


def tuplesets(m: Model, t: str, r: str) -> set[str]:
    return {e.tupleset for e in walk(m.types[t][r].rewrite) if isinstance(e, Via)}
