"""Graph and provenance walks by frontier joins, one level a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

FAN_OUT = 64


def edges(grains: DataFrame, relations: list[str], direction: str = "out") -> DataFrame:
    """(a, b, relation, seq) of live facts, turned round for "in"."""
    f = grains.filter(F.col("superseded_by").isNull() & F.col("relation").isin(relations) & F.col("object").isNotNull())
    out = f.select(F.col("subject").alias("a"), F.col("object").alias("b"), "relation", "seq")
    back = f.select(F.col("object").alias("a"), F.col("subject").alias("b"), "relation", "seq")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def related(grains: DataFrame, start: str, relations: list[str], direction: str = "out", depth: int = 1, limit: int = 256, fan_out: int | None = FAN_OUT) -> DataFrame:
    """(term, depth) of what is reached from start in up to depth steps, nearest first, start left out."""
    e = edges(grains, relations, direction)
    spark = grains.sparkSession
    seen = spark.createDataFrame([(start, 0)], "term string, depth int")
    front = seen
    for d in range(1, depth + 1):
        step = e.join(front.select(F.col("term").alias("a")), "a")
        if fan_out is not None:
            w = W.partitionBy("a", "relation").orderBy("b", "seq")
            step = step.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= fan_out)
        front = step.select(F.col("b").alias("term")).distinct().join(seen.select("term"), "term", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen.filter("depth > 0").orderBy("depth", "term").limit(limit)


def path(grains: DataFrame, start: str, goal: str, relations: list[str], most: int = 6) -> DataFrame:
    """(depth, path) of a shortest path, the first by its terms; no row if there is none."""
    e = edges(grains, relations).select("a", "b").distinct()
    front = grains.sparkSession.createDataFrame([(start, [start])], "term string, path array<string>")
    seen = front.select("term")
    out = front.filter(F.col("term") == goal)
    for _ in range(most):
        step = e.join(front, F.col("a") == F.col("term")).select(F.col("b").alias("term"), F.concat("path", F.array("b")).alias("path"))
        step = step.groupBy("term").agg(F.min("path").alias("path"))
        front = step.join(seen, "term", "left_anti")
        seen = seen.unionByName(front.select("term"))
        out = out.unionByName(front.filter(F.col("term") == goal))
    found = out.select((F.size("path") - 1).alias("depth"), "path")
    return found.orderBy("depth", "path").limit(1)


def derived_from(grains: DataFrame, hash_: str) -> DataFrame:
    return grains.filter(F.col("derived_from") == hash_).orderBy(F.desc("seq"))


def run_trace(grains: DataFrame, run_id: str, limit: int = 1024) -> DataFrame:
    """A run's grains (recorded), and what was derived from them outside it (produced)."""
    own = grains.filter(F.col("run_id") == run_id)
    recorded = own.withColumn("part", F.lit("recorded")).orderBy(F.desc("seq")).limit(limit)
    parents = own.select(F.col("hash").alias("_parent")).distinct()
    made = grains.join(parents, F.col("derived_from") == F.col("_parent"), "left_semi").filter(~F.col("run_id").eqNullSafe(F.lit(run_id)))
    return recorded.unionByName(made.withColumn("part", F.lit("produced")))


def runs_touching(grains: DataFrame, hash_: str, depth: int = 8) -> DataFrame:
    """(run_id, distance) of runs that recorded the grain, its ancestors or its descendants."""
    link = grains.filter(F.col("derived_from").isNotNull()).select(F.col("hash").alias("a"), F.col("derived_from").alias("b"))
    both = link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = grains.filter(F.col("hash") == hash_).select("hash", F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        front = both.join(front.select(F.col("hash").alias("a")), "a").select(F.col("b").alias("hash")).distinct().join(seen.select("hash"), "hash", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    hit = grains.select("hash", "run_id").filter("run_id is not null").join(seen, "hash")
    return hit.groupBy("run_id").agg(F.min("distance").alias("distance"))


def step_actions(links: DataFrame, workflow: str, prefix: str = "mg:step_action:") -> DataFrame:
    """(hash, node) from (hash, seq, related_to array<struct<relation_type, hash>>): the grains that stand for a workflow's steps."""
    one = links.select("hash", "seq", F.explode("related_to").alias("l"))
    hit = one.filter((F.col("l.hash") == workflow) & F.col("l.relation_type").startswith(prefix))
    return hit.select("hash", "seq", F.substring("l.relation_type", len(prefix) + 1, 1 << 20).alias("node"))


def topological_levels(nodes: DataFrame, arcs: DataFrame, most: int = 64) -> DataFrame:
    """(node, level) of a DAG: the longest way from a source; nodes on or behind a cycle have level null."""
    left, done, level = nodes.select("node"), None, 0
    while level < most:
        blocked = arcs.join(left, arcs["a"] == left["node"], "left_semi").select(F.col("b").alias("node")).distinct()
        ready = left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = left.join(ready.select("node"), "node", "left_anti")
        level += 1
    stuck = left.withColumn("level", F.lit(None).cast("int"))
    return stuck if done is None else done.unionByName(stuck)


def node_state(arcs: DataFrame) -> DataFrame:
    """From (b, resolved, fired): a node is ready when all its arcs in are resolved and one fired, dead when none did."""
    by = arcs.groupBy(F.col("b").alias("node")).agg(F.bool_and("resolved").alias("all_resolved"), F.bool_or("fired").alias("any_fired"))
    state = F.when(F.col("all_resolved") & F.col("any_fired"), F.lit("ready")).when(F.col("all_resolved"), F.lit("dead")).otherwise(F.lit("waiting"))
    return by.select("node", state.alias("state"))
