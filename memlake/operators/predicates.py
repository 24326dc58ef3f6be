"""Conditions as columns with two truth values.

Every leaf is true or false, also where a field is absent or of another type,
so NOT, != and NOT IN are true of absent fields.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import ast as A
from ..plans.lexer import QueryError
from ..schema import BOOLEAN, COLUMNS, COMMON, NUMERIC, OMITTED, TYPES

# Relation categories, each standing for its names with and without the mg: prefix.
CATEGORIES = {
    "observation": "perceives state_at",
    "knowledge": "knows infers learned owned_by",
    "interaction": "said did handed_off_to",
    "consensus": "agrees_with",
    "workflow": "requires_steps",
    "lifecycle": "intends depends_on",
    "permission": "permits revokes prohibits",
    "preference": "requires prefers avoids dislikes",
    "agency": "delegates_to has_capability assigned_to capable_of",
}


def category_relations(name: str) -> list[str]:
    words = CATEGORIES.get(name.lower())
    if words is None:
        raise QueryError("CAL-E018", f"unknown relation category {name}")
    return [x for w in words.split() for x in (w, f"mg:{w}")]


def namespace_scope(value: str, column: Column | None = None) -> Column:
    """Exact, or for a trailing * the base and what follows it after the separator written."""
    ns = F.col("ns") if column is None else column
    if "*" not in value:
        return F.coalesce(ns == value, F.lit(False))
    base, sep = value[:-2], value[-2:-1]
    if not value.endswith("*") or "*" in value[:-1] or not base or sep.isalnum():
        raise QueryError("VAL-E001", f"{value} is no namespace pattern")
    return F.coalesce((ns == base) | ns.startswith(base + sep), F.lit(False))


def field(name: str, grain_type: str | None = None) -> Column:
    """The column of a field, from attrs if it has none of its own."""
    low = {"namespace": "ns", "type": "grain_type", "query": "text"}.get(name.lower(), name)
    if low == "score":
        return F.lit(1.0)
    if low in COLUMNS:
        return F.col(low)
    c = F.col("attrs")[low]
    return F.coalesce(c, F.lit(OMITTED[low])) if low in OMITTED else c


def check_field(name: str, grain_type: str | None) -> None:
    """CAL-E060 for a field that the type can not carry."""
    known = name in COMMON or ":" in name or name in COLUMNS
    if grain_type is not None and not known and name not in TYPES[grain_type].fields and name != "tool_name":
        extra = {"tool": {"value", "k"}, "fact": {"price", "status"}}.get(grain_type, set())
        if name not in extra:
            raise QueryError("CAL-E060", f"{grain_type} has no field {name}")


def _number(name: str) -> Column:
    return field(name).try_cast("double")


def equals(name: str, value: object) -> Column:
    if isinstance(value, A.Param):
        raise QueryError("CAL-E008", f"${value.name} is not bound")
    if isinstance(value, list):
        return F.lit(False)
    if name in ("ns", "namespace") and isinstance(value, str):
        return namespace_scope(value)
    c = field(name)
    if isinstance(value, bool):
        same = c.cast("string") == ("true" if value else "false") if name in BOOLEAN or name not in COLUMNS else F.lit(False)
    elif isinstance(value, float):
        same = F.abs(_number(name) - value) < 2.220446049250313e-16 if name in NUMERIC or name not in COLUMNS else F.lit(False)
    elif name in NUMERIC or name in BOOLEAN:
        same = F.lit(False)
    else:
        same = c == (value.removeprefix("sha256:") if name == "hash" else value)
    return F.coalesce(same, F.lit(False))


def compile_condition(cond, grain_type: str | None = None, bound: dict[str, object] | None = None) -> Column:
    """bound: values of $names."""
    bound = bound or {}
    again = lambda c: compile_condition(c, grain_type, bound)
    if isinstance(cond, A.Both):
        return again(cond.left) & again(cond.right)
    if isinstance(cond, A.Either):
        return again(cond.left) | again(cond.right)
    if isinstance(cond, A.Not):
        return ~again(cond.inner)
    check_field(cond.field, grain_type)
    if isinstance(cond, A.Compare):
        value = bound.get(cond.value.name, cond.value) if isinstance(cond.value, A.Param) else cond.value
        if cond.field == "tags":
            return F.coalesce(F.array_contains("tags", value), F.lit(False)) == (cond.op == "=")
        if cond.op in ("=", "!="):
            same = equals(cond.field, value)
            return same if cond.op == "=" else ~same
        if not isinstance(value, float):
            return F.lit(False)
        n = _number(cond.field) if cond.field in NUMERIC or cond.field not in COLUMNS else F.lit(None).cast("double")
        if cond.field == "confidence":
            n = F.coalesce(n, F.lit(0.0))
        test = {"<": n < value, "<=": n <= value, ">": n > value, ">=": n >= value}[cond.op]
        return F.coalesce(test, F.lit(False))
    if isinstance(cond, A.Within):
        values = bound.get(cond.values.name) if isinstance(cond.values, A.Param) else cond.values
        if values is None:
            raise QueryError("CAL-E008", f"${cond.values.name} is not bound")
        if cond.field == "tags":
            every = F.lit(True)
            for v in values:
                has = F.coalesce(F.array_contains("tags", v), F.lit(False))
                every = every & (~has if cond.negated else has)
            return every
        if all(isinstance(v, str) for v in values) and cond.field not in ("ns", "namespace", "hash") and cond.field not in NUMERIC | BOOLEAN and values:
            inside = F.coalesce(field(cond.field).isin(values), F.lit(False))
        else:
            inside = F.lit(False)
            for v in values:
                inside = inside | equals(cond.field, v)
        return ~inside if cond.negated else inside
    if isinstance(cond, A.IsNull):
        return field(cond.field).isNotNull() if cond.negated else field(cond.field).isNull()
    if isinstance(cond, A.Matches):
        c = field(cond.field).cast("string")
        return F.coalesce(c.contains(cond.text) if cond.how == "contains" else c.startswith(cond.text), F.lit(False))
    if isinstance(cond, A.IsCategory):
        if cond.field == "relation":
            return F.coalesce(F.col("relation").isin(category_relations(cond.category)), F.lit(False))
        return F.coalesce(F.lower(field(cond.field)) == cond.category.lower(), F.lit(False))
    raise TypeError(cond)


def semi_join_parts(cond) -> tuple[list[tuple[A.Within, bool]], object]:
    """Top-level IN $name conditions, which become joins, and the rest."""
    if isinstance(cond, A.Both):
        a, x = semi_join_parts(cond.left)
        b, y = semi_join_parts(cond.right)
        return a + b, y if x is None else x if y is None else A.Both(x, y)
    if isinstance(cond, A.Within) and isinstance(cond.values, A.Param):
        return [cond], None
    return [], cond


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def moment(text: str, now_ms: int, end: bool = False) -> int:
    """Epoch milliseconds of a date, a time, epoch milliseconds, "now", "yesterday" or "3 days ago"."""
    low = text.strip().lower()
    if re.fullmatch(r"\d{10,}", low):
        return int(low)
    if low in ("now", "today"):
        return now_ms
    if low == "yesterday":
        return now_ms - 86_400_000
    m = re.fullmatch(r"(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago", low)
    if m:
        return now_ms - int(m[1]) * _UNITS[m[2]] * 1000
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise QueryError("CAL-E019", f"{text!r} is no time") from e
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    if end and re.fullmatch(r"\d{4}-\d\d-\d\d", text.strip()):
        at += timedelta(days=1, milliseconds=-1)
    return int(at.timestamp() * 1000)


def subject_did(df: DataFrame, subject: str) -> DataFrame:
    """Grains of a subject under its plain name or as a DID."""
    return df.filter(F.col("subject").isin(subject, f"did:{subject}"))
