"""Identity selection, retention and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens
from .ranking import query_tokens


def refers_to(c: Column, identity: str) -> Column:
    """The identity itself, or it with a key after a separator: pat and pat#visit, never patricia."""
    return F.coalesce(c.rlike("^" + re.escape(identity) + r"($|[^\p{L}\p{N}])"), F.lit(False))


def report_subject(grains: DataFrame, identity: str, text_mentions: bool = False) -> DataFrame:
    hit = F.lit(False)
    for c in ("subject", "object", "session_id", "run_id"):
        hit = hit | refers_to(F.col(c), identity)
    if text_mentions:
        words = F.array(*[F.lit(w) for w in query_tokens(identity)])
        hit = hit | (F.size(F.array_except(words, tokens(F.col("text")))) == 0)
    return grains.filter(hit)


def forget_subject(grains: DataFrame, identity: str, text_mentions: bool = False) -> DataFrame:
    return grains.join(report_subject(grains, identity, text_mentions).select("hash"), "hash", "left_anti")


def purge(grains: DataFrame, before_ms: int, ns: str, grain_type: str | None = None, limit: int = 1000, floor_ms: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """What a purge takes: the oldest of one namespace; no younger than a retention floor allows, nothing on hold."""
    cutoff = before_ms if floor_ms is None else min(before_ms, floor_ms)
    out = grains.filter((F.col("ns") == ns) & (F.col("created_at") < cutoff))
    if grain_type is not None:
        out = out.filter(F.col("grain_type") == grain_type)
    if held is not None:
        out = out.join(held.select("hash"), "hash", "left_anti")
    return out.orderBy("created_at", "seq").limit(limit)


def corpus_export(grains: DataFrame, roles: tuple[str, ...] = ("system", "user", "assistant")) -> DataFrame:
    """(session_id, messages, lineage): chat lines as JSON with the hashes they came from."""
    e = grains.filter((F.col("grain_type") == "event") & F.col("role").isin(*roles) & F.col("session_id").isNotNull())
    turns = F.array_sort(F.collect_list(F.struct("seq", "role", "content", "hash")))
    by = e.groupBy("session_id").agg(turns.alias("t"))
    messages = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return by.select("session_id", messages.alias("messages"), F.transform("t", lambda x: x["hash"]).alias("lineage"))


def exports_touching(exports: DataFrame, hashes: DataFrame) -> DataFrame:
    one = exports.select("session_id", F.explode("lineage").alias("hash"))
    return one.join(hashes.select("hash"), "hash", "left_semi").select("session_id").distinct()


def permitted(grains: DataFrame, grants: DataFrame, principal: str, verb: str = "read") -> DataFrame:
    """Rows of namespaces that the principal may use; "*" is all of them."""
    mine = grants.filter((F.col("principal") == principal) & (F.col("verb") == verb) & ~F.col("revoked"))
    all_ = mine.filter("ns = '*'").limit(1).select(F.lit(True).alias("_all"))
    own = mine.select("ns").distinct()
    exact = grains.join(own, "ns", "left_semi")
    rest = grains.join(own, "ns", "left_anti").join(F.broadcast(all_)).drop("_all")
    return exact.unionByName(rest)


def rehydrate(rows: DataFrame, mapping: DataFrame, key: str, text: str = "text") -> DataFrame:
    """rows with each token in its text replaced by the mapping's value, by a join on the tokens that are there."""
    found = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[[A-Z_]+_[0-9a-f]{8}\]"), F.lit(0)))).alias("token"))
    pairs = found.join(mapping.select("token", "value"), "token").groupBy(key).agg(F.collect_list(F.struct("token", "value")).alias("_p"))
    out = rows.join(pairs, key, "left")
    return out.withColumn(text, F.aggregate(F.coalesce("_p", F.array().cast("array<struct<token:string,value:string>>")), F.col(text), lambda t, p: F.replace(t, p["token"], p["value"]))).drop("_p")


def policy_sweep(grains: DataFrame, policies: DataFrame, now_ms: int) -> DataFrame:
    """Grains past their namespace's max_age_ms, not under hold: what a retention sweep takes."""
    rules = policies.filter(~F.coalesce("hold", F.lit(False))).select("ns", "max_age_ms")
    return grains.join(rules, "ns").filter((F.col("max_age_ms") > 0) & (F.col("created_at") > 0) & (F.col("created_at") < now_ms - F.col("max_age_ms"))).drop("max_age_ms")
