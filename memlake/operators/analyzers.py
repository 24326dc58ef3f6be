"""Batch rules over the agent's own history: each a group-by with thresholds.

Every rule returns (target_ref, action, severity, evidence_n) and figures of
its own; recommendations() gives the common shape with its dedup key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..shared import cut, drop
from ..functions.text import normalize_ident, normalize_signature, tokens

DAY = 86_400_000
SLOTS = 1 << 16
PART_SETS, PART_PAIRS = 8_000, 500_000
# Relations that hold one object at a time.
FUNCTIONAL = ["deploy_target", "lives_in", "reports_to", "status", "tier", "owner", "region", "assigned_to", "primary_email", "current_plan"]


def tool_failure(calls: DataFrame, now_ms: int, days: int = 30, least: int = 3, rate: float = 0.4, many: int = 50) -> DataFrame:
    """calls: ns, tool_name, is_error, content, created_at.  Clusters of one tool's equal failures."""
    calls = calls.filter(F.col("created_at") >= now_ms - days * DAY)
    totals = calls.groupBy("tool_name").agg(F.count("*").alias("total"))
    bad = calls.filter("is_error").withColumn("signature", normalize_signature(F.coalesce("content", F.lit("")))).filter("signature <> ''")
    by_ns = bad.groupBy("tool_name", "signature", "ns").agg(F.count("*").alias("_c"))
    clusters = by_ns.groupBy("tool_name", "signature").agg(F.sum("_c").alias("failures"), F.min(F.struct(-F.col("_c"), F.col("ns"))).alias("_m"))
    out = clusters.join(totals, "tool_name").withColumn("rate", F.col("failures") / F.col("total"))
    out = out.filter((F.col("failures") >= least) & ((F.col("rate") >= rate) | (F.col("failures") >= many)))
    severity = F.when((F.col("rate") >= 0.7) & (F.col("failures") >= 5), "high").when(F.col("rate") >= 0.5, "medium").otherwise("low")
    return out.select("tool_name", "signature", "failures", "total", "rate", F.col("_m.ns").alias("ns"), severity.alias("severity"))


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Live facts that are equal when trimmed and lower-cased; the earliest stays."""
    live = facts.filter(F.col("superseded_by").isNull() & F.col("object").isNotNull())
    keys = {"s": normalize_ident(F.col("subject")), "r": normalize_ident(F.col("relation")), "o": normalize_ident(F.col("object"))}
    by = live.withColumns(keys).groupBy("ns", "s", "r", "o").agg(F.count("*").alias("n"), F.min_by("hash", F.struct("created_at", "hash")).alias("canonical"))
    return by.filter("n >= 2")


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(set, n, p): the tokens, rarest first, of which sets that reach the threshold share one; as 32 bits each."""
    counts = rows.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(SLOTS)).alias("s")).agg(F.count("*").alias("n")).collect()  # SLOTS rows at most
    often = np.zeros(SLOTS, dtype=np.int64)
    for r in counts:
        often[r["s"]] = r["n"].bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            t, n = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths(), dtype=np.int64)
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((t, often[t % SLOTS], own))
            most = np.where(n > 0, n - np.ceil(threshold * n).astype(np.int64) + 1, 0)
            first = np.arange(len(t)) - (np.cumsum(n) - n)[own] < most[own]
            p = (t[order][first] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"set": batch.column("set"), "n": pa.array(n.astype(np.int32)), "p": pa.ListArray.from_arrays(pa.array(ends), pa.array(p))})

    return rows.filter(F.size("tokens") > 0).select("set", "tokens").mapInArrow(run, "set binary, n int, p array<int>").groupBy("set").agg(F.first("n").alias("n"), F.first("p").alias("p"))


def _reach(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the pairs of a task those whose sets, all of them there too, reach the threshold."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pairs.select(["ns", "x", "y"])
        number = {x: i for i, x in enumerate(sets["set"].to_pylist())}
        lists = sets["tokens"].combine_chunks()
        n = np.asarray(lists.value_lengths(), dtype=np.int64)
        begins = np.cumsum(n) - n
        names, token = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        x, y = (np.array([number[v] for v in pairs[c].to_pylist()], dtype=np.int64) for c in "xy")
        good, mark = np.zeros(len(x), dtype=bool), np.zeros(len(names), dtype=np.int64)
        order = np.argsort(x, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
            one = int(x[mine[0]])
            mark[token[begins[one] : begins[one] + n[one]]] = 1
            for i in range(0, len(mine), 2000):
                some = mine[i : i + 2000]
                long = n[y[some]]
                at = np.cumsum(long) - long
                both = np.add.reduceat(mark[token[np.repeat(begins[y[some]] - at, long) + np.arange(int(long.sum()))]], at)
                good[some] = both >= threshold * (n[one] + long - both)
            mark[token[begins[one] : begins[one] + n[one]]] = 0
        return pairs.select(["ns", "x", "y"]).filter(pa.array(good))

    return run


def near_sets(observations: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(ns, id, set) of every text, id being its time and hash, and (ns, x, y): pairs of different sets whose Jaccard is threshold or more.

    A set is named by the 128-bit digest of its ns and tokens; tokens are
    compared by 64-bit hashes.  Candidates share one of their rarest tokens
    (prefix filter, rare by the counts of SLOTS groups of tokens), so only texts
    that can reach the threshold meet, once, at the first that they share.  To
    be verified, sets are dealt into parts, and each to the pairs of parts that
    hold its own: a set's tokens go to as many tasks as there are parts, not
    with each pair.
    """
    at = "created_at" if "created_at" in observations.columns else "seq"
    texts = observations.filter(F.col("text").isNotNull() & F.col("ns").isNotNull()).select("ns", F.struct(F.col(at).alias("at"), "hash").alias("id"), F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("words"))
    digest = F.unhex(F.md5(F.concat_ws("\n", F.col("ns"), F.concat_ws(" ", "words")).cast("binary")))
    spark = observations.sparkSession
    whole, p1 = cut(texts.select("ns", "id", digest.alias("set"), F.transform("words", lambda w: F.xxhash64(w)).alias("tokens")))
    rows, _ = cut(whole.select("ns", "id", "set"))
    prefix, p2 = cut(_prefixes(whole, threshold).join(rows.groupBy("set").agg(F.first("ns").alias("ns")), "set"))
    one = prefix.select("ns", F.posexplode("p").alias("i", "t"), F.col("set").alias("x"), "n", "p").select("ns", "t", "x", "n", F.slice("p", 1, F.col("i")).alias("p"))
    two = one.withColumnsRenamed({"x": "y", "n": "n2", "p": "p2"})
    some = one.join(two, ["ns", "t"]).filter((F.col("x") < F.col("y")) & (F.least("n", "n2") >= threshold * F.greatest("n", "n2")) & ~F.arrays_overlap("p", "p2"))
    some, p3 = cut(some.select("ns", "x", "y").distinct())
    there = some.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    full, p4 = cut(whole.join(there, "set").groupBy("set").agg(F.first("tokens").alias("tokens")))
    drop(spark, p1, p2)
    parts = max(4, math.ceil(math.sqrt(full.count() / PART_SETS)), math.ceil(math.sqrt(2 * some.count() / PART_PAIRS)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    task = lambda a, b: F.least(a, b) * parts + F.greatest(a, b)
    dealt = full.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(task(part("set"), F.col("j")).alias("task"), "set", "tokens")
    asked = some.select(task(part("x"), part("y")).alias("task"), "ns", "x", "y")
    close, _ = cut(dealt.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(_reach(threshold), "ns string, x binary, y binary"))
    drop(spark, p3, p4)
    return rows, close


def near_pairs(observations: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(ns, a, b): pairs of texts whose token sets have a Jaccard of threshold or more, a the earlier.

    Equal sets meet as one, the earliest row of each, whose pairs are given to
    all; texts without a token are equal sets too.
    """
    rows, close = near_sets(observations, threshold)
    # a row against the earliest of its own set, and each row of one set against the earliest of the other
    lead = rows.groupBy("set").agg(F.min("id").alias("lead"))
    same = rows.join(lead, "set").filter("lead < id").select("ns", F.col("lead").alias("a"), F.col("id").alias("b"))
    across = close.unionByName(close.select("ns", F.col("y").alias("x"), F.col("x").alias("y")))
    across = across.join(lead.withColumnRenamed("set", "x"), "x").join(rows.select("id", F.col("set").alias("y")), "y").filter("lead < id").select("ns", F.col("lead").alias("a"), F.col("id").alias("b"))
    return same.unionByName(across)


def near_duplicates(observations: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(ns, seed, member): greedy clusters in the order of created_at and hash.

    A text that is no earlier seed's member is a seed; a member belongs to its
    earliest seed.  Only the earliest row of equal sets can be a seed, so
    near_pairs() holds all that matters.  A round settles the members of known
    seeds and the texts that have no unsettled earlier neighbour.
    """
    spark = observations.sparkSession
    pairs, _ = cut(near_pairs(observations, threshold))
    left, path = cut(pairs.select("ns", F.explode(F.array("a", "b")).alias("id")).distinct())
    edges, read = pairs, [path]
    seeds = None
    while not left.isEmpty():
        waiting = edges.select("ns", F.col("b").alias("id")).distinct()
        fresh, _ = cut(left.join(waiting, ["ns", "id"], "left_anti"))
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
        of = pairs.join(fresh.withColumnRenamed("id", "a"), ["ns", "a"], "left_semi").select("ns", F.col("b").alias("id")).distinct()
        (left, now), before = cut(left.join(fresh, ["ns", "id"], "left_anti").join(of, ["ns", "id"], "left_anti")), read
        (edges, then) = cut(edges.join(left.withColumnRenamed("id", "a"), ["ns", "a"], "left_semi").join(left.withColumnRenamed("id", "b"), ["ns", "b"], "left_semi"))
        drop(spark, *before)
        read = [now, then]
    drop(spark, *read)
    members = pairs if seeds is None else pairs.join(seeds.withColumnRenamed("id", "a"), ["ns", "a"], "left_semi")
    return members.groupBy("ns", "b").agg(F.min("a").alias("a")).select("ns", F.col("a.hash").alias("seed"), F.col("b.hash").alias("member"))


def contradictions(facts: DataFrame, relations: list[str] = FUNCTIONAL) -> DataFrame:
    """Functional relations with two distinct live objects or more; the latest resolves."""
    live = facts.filter(F.col("superseded_by").isNull() & F.col("relation").isin(relations))
    by = live.groupBy("ns", "subject", "relation").agg(F.countDistinct(normalize_ident(F.col("object"))).alias("n_objects"), F.max_by("object", F.struct("created_at", "hash")).alias("resolved"))
    return by.filter("n_objects >= 2")


def forks(open_forks: DataFrame) -> DataFrame:
    return open_forks.select("ns", "subject", "relation", "n_heads", F.element_at("heads", 1).alias("primary"))


def staleness(grains: DataFrame, now_ms: int, grace_ms: int = 0) -> DataFrame:
    past = now_ms - grace_ms
    old = grains.filter(F.col("grain_type").isin("fact", "observation") & (F.col("valid_to") < past))
    return old.select("hash", "seq", "valid_to", F.when(now_ms - F.col("valid_to") > 90 * DAY, "medium").otherwise("low").alias("severity"))


def skill_stall(skills: DataFrame, practice: int = 5, proficiency: float = 0.4) -> DataFrame:
    return skills.filter((F.col("practice_count") >= practice) & (F.col("proficiency") <= proficiency))


def goal_stagnation(goals: DataFrame, now_ms: int, days: int = 30, progress: float = 0.1) -> DataFrame:
    return goals.filter((F.col("goal_state") == "active") & (F.coalesce("progress", F.lit(0.0)) <= progress) & (F.col("created_at") <= now_ms - days * DAY))


def cold_grains(facts: DataFrame, access: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Old facts that were never recalled."""
    warm = access.filter("recall_count > 0").select("hash")
    return facts.filter(F.col("created_at") <= now_ms - days * DAY).join(warm, "hash", "left_anti")


def coverage_gap(queries: DataFrame, least: int = 3, ratio: float = 0.8) -> DataFrame:
    return queries.withColumn("ratio", F.col("empty_count") / F.col("run_count")).filter((F.col("run_count") >= least) & (F.col("ratio") >= ratio))


def budget_pressure(samples: DataFrame, least: int = 20, ratio: float = 0.5) -> DataFrame:
    out = samples.agg(F.count("*").alias("sample_count"), F.count_if("overflow").alias("overflow_count"))
    out = out.withColumn("ratio", F.col("overflow_count") / F.col("sample_count"))
    return out.filter((F.col("sample_count") >= least) & (F.col("ratio") >= ratio))


def outcome_review(measures: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Applied changes that made their metric worse; direction is up or down."""
    worse = F.when(F.col("direction") == "up", F.col("current") < F.col("baseline") - eps).otherwise(F.col("current") > F.col("baseline") + eps)
    return measures.filter(worse)


def retention_sweep(grains: DataFrame, now_ms: int, max_age_ms: int, reserved: list[str] | None = None, most: int = 500) -> DataFrame:
    """Each namespace's oldest expired grains."""
    old = grains.filter((F.col("created_at") > 0) & (F.col("created_at") < now_ms - max_age_ms) & ~F.col("ns").isin(reserved or ["agent:authz"]))
    w = W.partitionBy("ns").orderBy("created_at", "seq")
    return old.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def run_outcome(runs: DataFrame, least: int = 3, ratio: float = 0.5, usd: float = 5.0) -> DataFrame:
    """runs: plan, outcome, detail, spent_usd_micros, created_at, seq."""
    failed = ~F.col("outcome").isin("completed", "canceled")
    by = runs.groupBy("plan").agg(F.count("*").alias("runs"), F.count_if(failed).alias("failed"), (F.sum("spent_usd_micros") / 1e6).alias("usd"), F.max_by("detail", F.struct("created_at", "seq")).alias("last_detail"))
    by = by.withColumn("ratio", F.col("failed") / F.col("runs"))
    return by.filter(((F.col("runs") >= least) & (F.col("ratio") >= ratio)) | (F.col("usd") >= usd))


def adapter_intake(candidates: DataFrame, promoted: DataFrame) -> DataFrame:
    """The newest live candidate of each subject that has not been promoted."""
    live = candidates.filter(F.col("superseded_by").isNull()).join(promoted.select("hash"), "hash", "left_anti")
    w = W.partitionBy("subject").orderBy(F.desc("created_at"), F.desc("seq"))
    return live.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def measure_metric(events: DataFrame, applied_ms: int) -> DataFrame:
    """How often each signature came before and after a change."""
    return events.groupBy("signature").agg(F.count_if(F.col("created_at") < applied_ms).alias("before"), F.count_if(F.col("created_at") >= applied_ms).alias("after"))


def eval_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))


def recommendations(found: DataFrame, family: str, action: str, target, severity, summary) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.lit(family), target, F.lit(action)), 256)
    out = found.select(target.alias("target_ref"), F.lit(family).alias("analyzer"), F.lit(action).alias("action"), severity.alias("severity"), summary.alias("summary"), key.alias("dedup_key"))
    return out.dropDuplicates(["dedup_key"])


def governance_status(recs: DataFrame, audit: DataFrame) -> DataFrame:
    """Each recommendation's state: that of its last audit event, else pending."""
    last = audit.groupBy("dedup_key").agg(F.max_by("action", F.struct("at", "seq")).alias("status"))
    return recs.join(last, "dedup_key", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def external(grains: DataFrame, command: list[str], now_ms: int, watermark_ms: int = 0, most: int = 2000, timeout: float = 60.0) -> DataFrame:
    """Findings (target, summary, severity, evidence, confidence) of a command that reads grains as JSON and answers in JSON.

    The command gets the newest live grains, as many as most, on its standard
    input.  One that can not be run, fails, is late or answers no JSON finds
    nothing; findings without a target or summary are dropped.
    """
    import json
    import subprocess

    spark, shape = grains.sparkSession, "target string, summary string, severity string, evidence array<string>, confidence double"
    rows = grains.filter("superseded_by is null").orderBy(F.desc("created_at"), F.desc("seq")).limit(most).collect()
    own = ("hash", "grain_type", "ns", "created_at")
    told = [{"hash": r["hash"], "grain_type": r["grain_type"], "namespace": r["ns"], "created_at_ms": r["created_at"], "fields": {k: v for k, v in r.asDict().items() if v is not None and k not in own}} for r in rows]
    question = json.dumps({"loop_analyzer": 1, "op": "analyze", "now_ms": now_ms, "watermark_ms": watermark_ms, "grains": told}, default=str)
    try:
        done = subprocess.run(command, input=question, capture_output=True, text=True, timeout=timeout, check=True)
        found = json.loads(done.stdout)["findings"]
        good = [(f["target"], f["summary"], f.get("severity", "low"), f.get("evidence", []), float(f.get("confidence", 0.0))) for f in found if f.get("target") and f.get("summary")]
    except (OSError, subprocess.SubprocessError, ValueError, KeyError, TypeError, AttributeError):
        good = []
    return spark.createDataFrame(good, shape)
