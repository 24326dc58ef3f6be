"""Personal data in texts: patterns as column expressions, checksums as integer arithmetic on them.

Every category is found by a pattern; those with a checksum (card numbers,
IBAN, national ids) keep only matches whose checksum holds, computed with
built-in functions too.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Patterns by category.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url_userinfo": r"[a-z][a-z0-9+.-]*://[^\s/@:]+:[^\s/@]+@[^\s/]+",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "date": r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "credit_card": r"\b\d(?:[ -]?\d){12,18}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "sg_nric": r"\b[STFG]\d{7}[A-Z]\b",
    "ae_eid": r"\b784-?\d{4}-?\d{7}-?\d\b",
    "mrn": r"\bMRN[:# ]*\d{5,10}\b",
    "phone": r"(?<![\w.])\+?\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?\b",
    "secret": r"\b(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,}\b",
    "pin": r"(?i)\bpin\b\W{0,3}\d{4,6}\b",
    "password": r"(?i)\b(?:password|passwd|pwd)\b\s*[:=]\s*\S+",
    "otp": r"(?i)\b(?:otp|one-time code)\b\W{0,3}\d{4,8}\b",
    "account": r"(?i)\baccount\b\W{0,3}(?:no\W{0,2})?\d{6,12}\b",
}
# One of these stands in every text, lower-cased, that a category's pattern matches: a cheap test before the pattern.
NEEDS = {
    "email": ["@"], "url_userinfo": ["://"], "ipv6": [":"], "mac": [":", "-"], "mrn": ["mrn"], "ae_eid": ["784"], "secret": ["sk", "pk", "ghp", "akia"],
    "pin": ["pin"], "password": ["password", "passwd", "pwd"], "otp": ["otp", "one-time code"], "account": ["account"],
}
# Actions from the least severe to the most.
ACTIONS = ["allow", "pseudonym", "generalize", "mask", "redact"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int") + 1)))
    return (F.length(digits) > 0) & (F.aggregate(d, F.lit(0), lambda s, x: s + x) % 10 == 0)


def iban_ok(c: Column) -> Column:
    """Whether an IBAN's number is 1 modulo 97."""
    moved = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55))
    return F.aggregate(codes, F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def matches(text: Column, category: str) -> Column:
    """All matches of a category in a text that pass its checksum."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[category]), F.lit(0))
    if category == "credit_card":
        return F.filter(found, lambda x: luhn(F.regexp_replace(x, "[ -]", "")))
    if category == "ae_eid":
        return F.filter(found, lambda x: luhn(F.regexp_replace(x, "-", "")))
    if category == "iban":
        return F.filter(found, iban_ok)
    return found


def scan(df: DataFrame, key: str, text: str = "text", categories: list[str] | None = None) -> DataFrame:
    """(key, category, value, n): distinct findings of each key, in one pass over the texts; only findings are shuffled."""
    def labelled(category: str) -> Column:
        values = matches(F.col("_text"), category)
        if category in NEEDS:
            worth = F.lit(False)
            for needed in NEEDS[category]:
                worth = worth | F.contains("_low", F.lit(needed))
            values = F.when(worth, values).otherwise(F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), v.alias("value")))

    found = [labelled(c) for c in categories or PATTERNS]
    texts = df.select(key, F.col(text).alias("_text"), F.lower(text).alias("_low")).filter("_text is not null")
    one = texts.select(key, F.explode(F.concat(*found)).alias("f"))
    return one.groupBy(key, "f.category", "f.value").agg(F.count("*").alias("n"))


def known_identities(df: DataFrame, key: str, names: DataFrame, text: str = "text") -> DataFrame:
    """(key, name) where a listed single-word name stands in the text, by an equi-join on words."""
    words = df.select(key, F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("word"))
    return words.join(names.select(F.lower("name").alias("word"), "name").distinct(), "word").select(key, "name")


def severity(action: str) -> int:
    kind, _, bucket = action.partition(":")
    if kind not in ACTIONS or bucket not in ("", "month", "year", "decade") or bucket and kind != "generalize":
        raise ValueError(f"{action} is no action")
    return ACTIONS.index(kind)


@dataclass(frozen=True)
class Policy:
    """What to do with each category (generalize may name its bucket, as in generalize:year); others are left."""

    actions: dict[str, str]

    def __post_init__(self):
        for action in self.actions.values():
            severity(action)


def _luhn(value: str) -> bool:
    digits = [int(x) for x in value if x.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


CHECKS = {"credit_card": _luhn, "ae_eid": _luhn, "iban": lambda v: int("".join(str(int(x, 36)) for x in v[4:] + v[:4])) % 97 == 1}


def spans(text: str, policy: Policy) -> list[tuple[int, int, str]]:
    """(start, end, category) of what is treated: checked findings of which none overlap.

    Of overlapping ones the severest action's stays, then the longer, the
    earlier, and the category that comes first by name.
    """
    found = []
    for category, action in policy.actions.items():
        if action == "allow":
            continue
        ok = CHECKS.get(category, lambda v: True)
        found += [(-severity(action), m.start() - m.end(), m.start(), category, m.end()) for m in re.finditer(PATTERNS[category], text, re.ASCII) if ok(m[0])]
    taken: list[tuple[int, int, str]] = []
    for _, _, start, category, end in sorted(found):
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, category))
    return sorted(taken)


def masked(value: str) -> str:
    """The first of each run of letters and digits stays."""
    return re.sub(r"(?<=[^\W_])[^\W_]", "*", value)


def generalized(value: str, category: str, bucket: str) -> str:
    """A date as its month or year, a whole number as its decade; what does not parse is replaced."""
    iso, local = re.match(r"(\d{4})-(\d\d)", value), re.fullmatch(r"\d+[/.](\d+)[/.](\d{4})", value)
    if bucket == "decade":
        return f"{int(value) // 10}0s" if re.fullmatch(r"\d{1,4}", value.strip()) else f"[GENERALIZED:{category.upper()}]"
    if not iso and not local:
        return f"[GENERALIZED:{category.upper()}]"
    year, month = iso.groups() if iso else (local[2], local[1].zfill(2))
    return year if bucket == "year" else f"{year}-{month}"


def anonymize(text: Column, policy: Policy, salt: str = "") -> Column:
    """The text with each finding treated in its place; Arrow batches, as what overlaps is decided by order."""
    def treat(category: str, value: str) -> str:
        action = policy.actions[category]
        if action == "redact":
            return f"[REDACTED:{category.upper()}]"
        if action == "mask":
            return masked(value)
        if action == "pseudonym":
            return f"[{category.upper()}_{hashlib.sha256((salt + value).encode()).hexdigest()[:8]}]"
        return generalized(value, category, action.partition(":")[2] or "month")

    def one(t: str | None) -> str:
        t, out, at = t or "", [], 0
        for start, end, category in spans(t, policy):
            out += [t[at:start], treat(category, t[start:end])]
            at = end
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return run(text)


def pseudonym(value: Column, label: str, salt: str) -> Column:
    """A token that is the same for the same value and salt everywhere."""
    return F.concat(F.lit(f"[{label}_"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 8), F.lit("]"))


def generalize_date(ms: Column, to: str) -> Column:
    d = F.timestamp_millis(ms)
    return {"month": F.date_format(d, "yyyy-MM"), "year": F.date_format(d, "yyyy"), "decade": F.concat((F.floor(F.year(d) / 10) * 10).cast("string"), F.lit("s"))}[to]
