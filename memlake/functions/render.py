"""Output formats and templates.

Line formats are columns, so a result of any size can be rendered and written;
templates, yaml and toon render a bounded result on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

MAX_EACH, MAX_TEMPLATE = 200, 4096
CLIP = {"summary": 40, "headlines": 80, "full": None}


def _body() -> Column:
    triple = F.when(F.col("subject").isNotNull() & F.col("relation").isNotNull(), F.concat_ws(" ", "subject", F.replace("relation", F.lit("_"), F.lit(" ")), "object"))
    return F.coalesce(triple, F.col("content"), F.lit(""))


def clipped(c: Column, level: str) -> Column:
    n = CLIP[level]
    return c if n is None else F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def _date() -> Column:
    return F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd")


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def line(fmt: str, level: str = "full") -> Column:
    body = clipped(_body(), level)
    if fmt == "sml":
        conf = F.when(F.col("confidence").isNotNull() & (F.col("confidence") < 1), F.concat(F.lit(' confidence="'), F.col("confidence").cast("string"), F.lit('"')))
        role = F.when(F.col("role").isNotNull(), F.concat(F.lit(' role="'), "role", F.lit('"')))
        date = F.when(F.col("grain_type") == "fact", F.concat(F.lit(' date="'), _date(), F.lit('"')))
        return F.concat(F.lit("  <"), "grain_type", F.coalesce(conf, F.lit("")), F.coalesce(role, F.lit("")), F.coalesce(date, F.lit("")), F.lit(">"), _xml(body), F.lit("</"), "grain_type", F.lit(">"))
    if fmt == "markdown":
        fact = F.concat(F.lit("- **"), "subject", F.lit("** "), F.concat_ws(" ", F.replace("relation", F.lit("_"), F.lit(" ")), "object"))
        event = F.concat(F.lit("- **"), F.coalesce("role", F.col("grain_type")), F.lit("**: "), clipped(F.coalesce("content", F.lit("")), level))
        conf = F.when(F.col("confidence") < 1, F.col("confidence").cast("string"))
        tail = F.concat(F.lit(" *("), F.concat_ws(", ", conf, F.when(F.col("subject").isNotNull(), _date()), F.when(F.col("superseded_by").isNotNull(), F.lit("superseded"))), F.lit(")*"))
        return F.when(F.col("subject").isNotNull() & F.col("relation").isNotNull(), F.concat(fact, tail)).otherwise(event)
    if fmt == "triples":
        return F.concat_ws("\t", F.coalesce("subject", F.lit("_")), F.coalesce("relation", F.lit("_")), F.coalesce("object", F.lit("_")))
    if fmt == "csv":
        quote = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        return F.concat_ws(",", *[F.coalesce(quote(F.col(c).cast("string")), F.lit("")) for c in ("hash", "grain_type", "subject", "relation", "object", "confidence")])
    if fmt == "table":
        return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("grain_type", "subject", "relation", "object", "confidence", "created_at")]), F.lit(" |"))
    if fmt == "json":
        return F.to_json(F.struct("hash", "grain_type", "ns", "subject", "relation", "object", "content", "confidence", "created_at"))
    return body  # text


HEADS = {"sml": "<grains>", "csv": "hash,type,subject,relation,object,confidence", "table": "| type | subject | relation | object | confidence | created_at |\n|---|---|---|---|---|---|"}
FEET = {"sml": "</grains>"}


def lines(df: DataFrame, fmt: str, level: str = "full") -> DataFrame:
    """(_rank, line)."""
    return df.select("_rank", line(fmt, level).alias("line"))


def block(df: DataFrame, fmt: str, level: str = "full") -> DataFrame:
    """One row: the whole text of a bounded result."""
    parts = F.array_sort(F.collect_list(F.struct("_rank", "line")))
    body = lines(df, fmt, level).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("b"))
    return body.select(F.concat_ws("\n", F.lit(HEADS.get(fmt)), F.when(F.col("b") != "", F.col("b")), F.lit(FEET.get(fmt))).alias("text"))


def toon(rows: Iterable[dict], fields: list[str]) -> str:
    rows = list(rows)
    return "\n".join([f"grains[{len(rows)}]{{{','.join(fields)}}}:", *["  " + ",".join(_scalar(r.get(f)) for f in fields) for r in rows]])


def yaml(rows: Iterable[dict]) -> str:
    out = []
    for r in rows:
        for i, (k, v) in enumerate((k, v) for k, v in r.items() if v is not None):
            out.append(("- " if not i else "  ") + f"{k}: {_scalar(v)}")
    return "\n".join(out)


def _scalar(v: object) -> str:
    if v is None:
        return "null"
    text = f"{v:g}" if isinstance(v, float) else str(v)
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if re.search(r'[,:"\n#]', text) else text


_FILTERS = {
    "uppercase": lambda v: str(v).upper(),
    "lowercase": lambda v: str(v).lower(),
    "percent": lambda v: f"{int(float(v) * 100)}%",
    "json": lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"',
    "humanize": lambda v: str(v).split(":", 1)[-1].replace("_", " "),
}


def _apply(v: object, spec: str) -> object:
    name, _, arg = spec.strip().partition("(")
    arg = arg.rstrip(")").strip().strip("\"'")
    if name == "truncate":
        text, n = str(v or ""), int(arg)
        return text if len(text) <= n else text[:n] + "..."
    if name == "default":
        return v if v not in (None, "", 0, False) else arg
    if name == "join":
        return arg.join(map(str, v or []))
    if name == "date":
        return datetime.fromtimestamp(float(v or 0), timezone.utc).strftime(arg)
    if v is None:
        return ""
    return _FILTERS[name](v)


def template(source: str, scope: dict) -> str:
    """{{field | filter}}, {{#if field}} ... {{else}} ... {{/if}} and {{#each field}} ... {{/each}}."""
    if len(source.encode()) > MAX_TEMPLATE:
        raise ValueError("CAL-E040: a template has 4096 bytes at most")
    parts = re.split(r"(\{\{.*?\}\})", source)

    def value(expr: str) -> object:
        name, *filters = expr.split("|")
        v: object = scope_stack[-1]
        for p in name.strip().split("."):
            v = v.get(p, v if p == "this" else None) if isinstance(v, dict) else None
        for f in filters:
            v = _apply(v, f)
        return v

    def run(i: int, live: bool, depth: int) -> tuple[str, int, str]:
        if depth > 5:
            raise ValueError("CAL-E117: conditions nest 5 deep at most")
        out = []
        while i < len(parts):
            p = parts[i]
            i += 1
            if not p.startswith("{{"):
                out.append(p if live else "")
                continue
            tag = p[2:-2].strip()
            if tag in ("/if", "/each", "else"):
                return "".join(out), i, tag
            if tag.startswith("#if "):
                on = live and bool(value(tag[4:]))
                yes, i, end = run(i, on, depth + 1)
                no = ""
                if end == "else":
                    no, i, _ = run(i, live and not on, depth + 1)
                out.append(yes if on else no)
            elif tag.startswith("#each "):
                items, start = list(value(tag[6:]) or [])[:MAX_EACH] if live else [], i
                _, i, _ = run(start, False, depth + 1)
                for item in items:
                    scope_stack.append(item if isinstance(item, dict) else {"this": item})
                    out.append(run(start, True, depth + 1)[0])
                    scope_stack.pop()
            elif live:
                v = value(tag)
                out.append("" if v is None else f"{v:g}" if isinstance(v, float) else str(v))
        return "".join(out), i, ""

    scope_stack: list = [scope]
    return run(0, True, 0)[0]
