"""Scans of a grains table: filters and top-k, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .predicates import namespace_scope


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("superseded_by").isNull())


def recent(df: DataFrame, limit: int, ns: str | list[str] | None = None, grain_type: str | None = None, order: str = "seq", include_superseded: bool = True) -> DataFrame:
    """Newest by seq, or by created_at either way with seq as tie-break."""
    if ns is not None:
        scope = F.lit(False)
        for one in [ns] if isinstance(ns, str) else ns:
            scope = scope | namespace_scope(one)
        df = df.filter(scope)
    if grain_type is not None:
        df = df.filter(F.col("grain_type") == grain_type)
    if not include_superseded:
        df = live(df)
    keys = {"seq": [F.desc("seq")], "created_desc": [F.desc("created_at"), F.desc("seq")], "created_asc": [F.asc("created_at"), F.asc("seq")]}[order]
    return df.orderBy(*keys).limit(limit)


def probe(df: DataFrame, subject: str | None = None, relation: str | None = None, object_: str | None = None, limit: int | None = None) -> DataFrame:
    """Live facts by subject, relation or object, newest first."""
    for c, v in (("subject", subject), ("relation", relation), ("object", object_)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    df = live(df)
    return df if limit is None else df.orderBy(F.desc("seq")).limit(limit)


def subjects_with_relation(df: DataFrame, relation: str) -> DataFrame:
    return live(df).filter(F.col("relation") == relation).select("subject").distinct()


def by_hash(df: DataFrame, *hashes: str) -> DataFrame:
    return df.filter(F.col("hash").isin([h.removeprefix("sha256:") for h in hashes]))


def thread_tail(df: DataFrame, session_id: str, n: int) -> DataFrame:
    """The last n of a session, oldest first."""
    return df.filter(F.col("session_id") == session_id).orderBy(F.desc("seq")).limit(n).orderBy("seq")


def run_grains(df: DataFrame, run_id: str, after_seq: int, limit: int) -> DataFrame:
    """A page of a run's grains by seq, after the cursor."""
    return df.filter((F.col("run_id") == run_id) & (F.col("seq") > after_seq)).orderBy("seq").limit(limit)


def changes_since(log: DataFrame, after: int, limit: int) -> DataFrame:
    return log.filter(F.col("op_seq") > after).orderBy("op_seq").limit(limit)


def namespaces(df: DataFrame, prefix: str | None = None) -> DataFrame:
    df = df if prefix is None else df.filter(namespace_scope(prefix))
    return df.groupBy("ns").agg(F.count("*").alias("n"))


def mounted(mounts: dict[str, DataFrame], ns: str) -> tuple[DataFrame, str]:
    """The table that alias.inner belongs to, and inner."""
    alias, _, inner = ns.partition(".")
    if alias not in mounts:
        raise KeyError(alias)
    return mounts[alias], inner
