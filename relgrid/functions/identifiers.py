"""Column functions over identifiers: type:id objects, and users as objects, usersets or typed wildcards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: control characters and blanks are never allowed
_FORBIDDEN = r"[\p{Cntrl}\s]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def object_type(c) -> Column:
    """Before the first colon; empty without one."""
    c = _col(c)
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)).otherwise("")


def object_id(c) -> Column:
    """After the first colon; the whole without one."""
    c = _col(c)
    return c.substr(F.instr(c, ":") + 1, F.length(c))


def userset_object(c) -> Column:
    """Before the last #, or the whole if nothing follows it."""
    c = _col(c)
    return F.when(userset_relation(c) != "", F.regexp_replace(c, "#[^#]*$", "")).otherwise(F.regexp_replace(c, "#$", ""))


def userset_relation(c) -> Column:
    """After the last #; empty without one or if nothing follows."""
    c = _col(c)
    return F.when(F.instr(c, "#") > 0, F.substring_index(c, "#", -1)).otherwise("")


def is_object(c) -> Column:
    return _col(c).rlike(r"^[^:#\p{Cntrl}\s]+:[^:#\p{Cntrl}\s]+$")


def is_wildcard(c) -> Column:
    """* or type:*"""
    return _col(c).rlike(r"^(?:[^:#\p{Cntrl}\s]+:)?\*$")


def is_userset(c) -> Column:
    """type:id#relation, where the id is not *."""
    return _col(c).rlike(r"^[^:#\p{Cntrl}\s]+:(?!\*)[^:#\p{Cntrl}\s]+#[^:#*\p{Cntrl}\s]+$")


def is_relation(c) -> Column:
    return _col(c).rlike(r"^[^:#@\p{Cntrl}\s]+$")


def is_user(c) -> Column:
    """Objects, usersets, wildcards and bare ids."""
    c = _col(c)
    bare = c.rlike(r"^[^:#\p{Cntrl}\s]+$")
    return is_object(c) | is_userset(c) | is_wildcard(c) | bare


def user_kind(c) -> Column:
    """What the store files the user under: wildcards count as usersets."""
    c = _col(c)
    return F.when(is_wildcard(c) | (userset_relation(c) != ""), "userset").otherwise("user")


def split_user(c) -> list[Column]:
    """subject_type, subject_id, subject_relation of a user."""
    whole = userset_object(c)
    return [object_type(whole).alias("subject_type"), object_id(whole).alias("subject_id"), userset_relation(c).alias("subject_relation")]


def join_object(type_, id_) -> Column:
    return F.concat(_col(type_), F.lit(":"), _col(id_))


def join_user(type_="subject_type", id_="subject_id", relation="subject_relation") -> Column:
    relation = _col(relation)
    return F.concat(join_object(type_, id_), F.when(relation != "", F.concat(F.lit("#"), relation)).otherwise(""))


def tuple_text(object_, relation, user) -> Column:
    """object#relation@user"""
    return F.concat(_col(object_), F.lit("#"), _col(relation), F.lit("@"), _col(user))


def is_self_defining(object_, relation, user) -> Column:
    """o#r@o#r, which holds without any data."""
    return F.concat(_col(object_), F.lit("#"), _col(relation)) == _col(user)
