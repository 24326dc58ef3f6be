"""Conditions and checks on JSON text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def at(payload: Column, path: str) -> Column:
    """The value at a dotted path or an RFC 6901 pointer, null if there is none."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.lstrip("/").split("/" if path.startswith("/") else ".")]
    return F.get_json_object(payload, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts))


def edge_condition(text: str, payload: Column) -> Column:
    """A DAG edge's condition: path == literal, path != literal, path exists, path or !path; always true or false."""
    text = text.strip()
    m = re.fullmatch(r"(\S+)\s+exists", text)
    if m:
        return at(payload, m[1]).isNotNull()
    m = re.fullmatch(r"(\S+)\s*(==|!=)\s*(.+)", text)
    if m:
        literal = m[3].strip()
        value = F.lit(literal[1:-1] if literal.startswith('"') else literal)
        same = at(payload, m[1]) == value
        return F.coalesce(same, F.lit(False)) if m[2] == "==" else ~F.coalesce(same, F.lit(False))
    negated = text.startswith("!")
    value = at(payload, text.lstrip("!").strip())
    true = F.coalesce(~value.isin("false", "0", "", "null", "[]", "{}"), F.lit(False))
    return ~true if negated else true


def fits_schema(payload: Column, schema: dict) -> Column:
    """Whether a JSON object fits a subset of JSON Schema: required, and properties' type, enum, minimum, maximum and pattern."""
    out = F.coalesce(F.get_json_object(payload, "$").isNotNull(), F.lit(False))
    for name in schema.get("required", []):
        out = out & at(payload, name).isNotNull()
    for name, rule in schema.get("properties", {}).items():
        value = at(payload, name)
        ok = F.lit(True)
        kind = rule.get("type")
        if kind == "integer":
            ok = ok & F.coalesce(value.rlike(r"^-?\d+$"), F.lit(False))
        elif kind == "number":
            ok = ok & value.try_cast("double").isNotNull()
        elif kind == "boolean":
            ok = ok & value.isin("true", "false")
        elif kind == "array":
            ok = ok & value.startswith("[")
        elif kind == "object":
            ok = ok & value.startswith("{")
        if "enum" in rule:
            ok = ok & value.isin([str(x).lower() if isinstance(x, bool) else str(x) for x in rule["enum"]])
        if "minimum" in rule:
            ok = ok & F.coalesce(value.try_cast("double") >= rule["minimum"], F.lit(False))
        if "maximum" in rule:
            ok = ok & F.coalesce(value.try_cast("double") <= rule["maximum"], F.lit(False))
        if "pattern" in rule:
            ok = ok & value.rlike(rule["pattern"])
        out = out & (value.isNull() | F.coalesce(ok, F.lit(False)))
    return out
