"""Versions: the operation log, liveness, heads, forks, history and as-of reads.

An operation log has (op_seq, hlc, op, hash), op 1 add, 2 supersede, 3 forget.
Liveness is derived: a grain is live unless a later one supersedes it or it was
forgotten.  Heads of a key are its tips; which tip is the provisional head is
either the last one inserted (local logs) or the largest (created_at, hash)
(imported logs, where it does not depend on the order of arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..shared import cut

ADD, SUPERSEDE, FORGET = 1, 2, 3
KEY = ("ns", "subject", "relation")
CHAIN = 512


def replay(grains: DataFrame, log: DataFrame, until_hlc: int | None = None) -> DataFrame:
    """The grains that the log's operations up to a point in time (inclusive) leave, with superseded_by as of then."""
    if until_hlc is not None:
        log = log.filter(F.col("hlc") <= until_hlc)
    last = log.groupBy("hash").agg(F.max_by("op", "op_seq").alias("_op"))
    there = grains.join(last.filter(F.col("_op") != FORGET).select("hash"), "hash", "left_semi")
    by = there.filter(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("hash")).agg(F.min("hash").alias("_by"))
    return there.drop("superseded_by").join(by, "hash", "left").withColumnRenamed("_by", "superseded_by")


def tips(grains: DataFrame) -> DataFrame:
    """Live grains with a key: all that nothing supersedes."""
    keyed = grains.filter(F.col("subject").isNotNull() & F.col("relation").isNotNull())
    gone = grains.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("hash")).distinct()
    return keyed.join(gone, "hash", "left_anti")


def heads(grains: DataFrame, subject: str | None = None, relation: str | None = None) -> DataFrame:
    t = grains.filter(F.col("superseded_by").isNull() & F.col("subject").isNotNull() & F.col("relation").isNotNull())
    if subject is not None:
        t = t.filter((F.col("subject") == subject) & (F.col("relation") == relation))
    return t


def latest(grains: DataFrame, mode: str = "imported") -> DataFrame:
    """One head for each key: an aggregate with partial results, no sort of a key's versions."""
    order = F.col("seq") if mode == "local" else F.struct("created_at", "hash")
    best = heads(grains).groupBy(*KEY).agg(F.max_by(F.struct("hash", "object", "created_at", "seq"), order).alias("h"))
    return best.select(*KEY, "h.*")


def open_forks(grains: DataFrame) -> DataFrame:
    """Keys with more than one head, with all of them, and the elected one."""
    by = heads(grains).groupBy(*KEY).agg(F.count("*").alias("n_heads"), F.array_sort(F.collect_list("hash")).alias("heads"), F.max_by("hash", F.struct("created_at", "hash")).alias("provisional"))
    return by.filter("n_heads > 1")


def contested(grains: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows that are heads of a fork, with contested_by: the other heads of their key."""
    forks = open_forks(grains).select(*KEY, F.col("heads").alias("_heads"))
    rows = grains if rows is None else rows
    hit = rows.join(forks, list(KEY)).filter(F.array_contains("_heads", F.col("hash")))
    return hit.withColumn("contested_by", F.array_except("_heads", F.array("hash"))).drop("_heads")


def merge_heads(grains: DataFrame, subject: str, relation: str) -> DataFrame:
    """Parents of a merge: every tip of the key; a fork has two at least."""
    t = heads(grains, subject, relation)
    return t.groupBy(*KEY).agg(F.array_sort(F.collect_list("hash")).alias("merge_parents")).filter(F.size("merge_parents") >= 2)


def history(grains: DataFrame, starts: DataFrame, most: int = CHAIN) -> DataFrame:
    """Chains newest to oldest along supersedes from each start hash: (start, depth, hash), a join per step.

    Keys whose versions form one chain, all but forks, need no walk: see ordered_history.
    """
    link = grains.select("hash", "supersedes")
    front = starts.select(F.col("hash").alias("start"), F.lit(0).alias("depth"), "hash")
    out = front
    for depth in range(1, most):
        front = front.join(link, "hash").filter(F.col("supersedes").isNotNull()).select("start", F.lit(depth).alias("depth"), F.col("supersedes").alias("hash"))
        front = front.join(grains.select("hash"), "hash", "left_semi").select("start", "depth", "hash")
        if depth % 16 == 0:
            front, _ = cut(front)  # keep a long chain's plan short
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def ordered_history(grains: DataFrame) -> DataFrame:
    """Version numbers of linear chains, 1 the newest, by one window over the key."""
    w = W.partitionBy(*KEY).orderBy(F.desc("created_at"), F.desc("seq"))
    return grains.filter("subject is not null and relation is not null").withColumn("version", F.row_number().over(w))


def as_of_world(grains: DataFrame, at_ms: int) -> DataFrame:
    """For each key what was true at a time: the newest with valid_from <= t < valid_to."""
    open_from = F.coalesce("valid_from", "created_at") <= at_ms
    open_to = F.col("valid_to").isNull() | (F.col("valid_to") > at_ms)
    best = grains.filter(open_from & open_to & F.col("subject").isNotNull()).groupBy(*KEY).agg(F.max_by(F.struct("hash", "object"), "seq").alias("h"))
    return best.select(*KEY, "h.*")


def as_of_knowledge(grains: DataFrame, at_ms: int) -> DataFrame:
    """For each key what was known at a time: the newest version recorded by then."""
    known = grains.filter((F.col("created_at") <= at_ms) & F.col("subject").isNotNull())
    best = known.groupBy(*KEY).agg(F.max_by(F.struct("hash", "object"), F.struct("created_at", "seq")).alias("h"))
    return best.select(*KEY, "h.*")


def as_of_join(points: DataFrame, grains: DataFrame, on: list[str], at: str = "at_ms") -> DataFrame:
    """For each point the last version created at or before it.

    Points and versions are interleaved by time within their key and the last
    version is carried forward: one shuffle and one sort, whatever the number
    of versions, instead of a range join.
    """
    v = grains.select(*on, F.col("created_at").alias("_t"), F.col("seq").alias("_s"), F.struct("object", "hash", "created_at").alias("_v"))
    p = points.select(*[F.col(c) for c in points.columns], F.col(at).alias("_t"), F.lit((1 << 62)).alias("_s"), F.lit(True).alias("_point"))
    both = p.unionByName(v, allowMissingColumns=True)
    w = W.partitionBy(*on).orderBy("_t", "_s").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_point")
    return out.select(*points.columns, F.col("_last.object").alias("object"), F.col("_last.created_at").alias("version_at"))


def diff(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """(field, change, old, new) between two one-row tables: added, removed, then changed."""
    pairs = lambda df: df.select(F.explode(F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda k, v: v.isNotNull())).alias("field", "value"))
    old, new = pairs(a).withColumnRenamed("value", "old"), pairs(b).withColumnRenamed("value", "new")
    both = old.join(new, "field", "full")
    change = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).when(F.col("old") != F.col("new"), F.lit("changed"))
    return both.withColumn("change", change).filter("change is not null").select("field", "change", "old", "new")


def supersession_pairs(grains: DataFrame, among: Column | None = None) -> DataFrame:
    """(oldest, newest) object of each key that has changed; among orders versions of one created_at, by default seq."""
    place = F.struct("created_at", F.col("seq") if among is None else among)
    by = grains.filter("subject is not null and relation is not null").groupBy(*KEY).agg(
        F.min_by("object", F.struct(place, "seq")).alias("oldest"), F.max_by("object", F.struct(place, -F.col("seq"))).alias("newest"), F.count("*").alias("n_versions"))
    return by.filter("n_versions > 1")


def conflict_resolution(rows: DataFrame) -> DataFrame:
    """The newest of each (subject, relation), later hash on ties; rows without a key stay."""
    w = W.partitionBy("subject", "relation").orderBy(F.desc("created_at"), F.desc("hash"))
    keyed = F.col("subject").isNotNull() & F.col("relation").isNotNull()
    return rows.withColumn("_n", F.row_number().over(w)).filter(~keyed | (F.col("_n") == 1)).drop("_n")


def verify(grains: DataFrame, recompute) -> DataFrame:
    """Counts of grains whose content address is right and wrong."""
    return grains.agg(F.count("*").alias("n"), F.count_if(F.col("hash") == recompute).alias("ok"), F.count_if(~F.col("hash").eqNullSafe(recompute)).alias("mismatched"))
