"""Context from ranked hits: which form it takes, and its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

# Phrases that ask about time, and that ask for the newest state only.
TEMPORAL = [
    "order of", "in what order", "sequence of", "from earliest", "from latest", "from first", "from last", "how many days", "how long between", "time between",
    "which came first", "which came last", "which was earlier", "which was later", "before or after", "earlier or later", "when did", "what date", "what time", "chronolog",
]
RECENCY = ["currently", "right now", "most recently", "at this point", "latest", "what is", "what's"]


def asks(question: str, phrases: list[str]) -> bool:
    return any(p in question.lower() for p in phrases)


def mode(question: str, n_hits: int, temporal: bool = False, sessions: int = 1) -> str:
    """timeline, census (hits of several sessions) or single."""
    if n_hits >= 2 and (temporal or asks(question, TEMPORAL)):
        return "timeline"
    return "census" if sessions > 1 else "single"


def knowledge_updates(hits: DataFrame, question: str = "") -> DataFrame:
    """(subject, relation, old, new) for hits superseded by another hit; old is left out where the newest state is asked for."""
    new = hits.select(F.col("hash").alias("superseded_by"), F.col("object").alias("new"))
    pairs = hits.filter("superseded_by is not null").join(new, "superseded_by").select("subject", "relation", F.col("object").alias("old"), "new")
    return pairs.withColumn("old", F.lit(None).cast("string")) if asks(question, RECENCY) else pairs


def sections(hits: DataFrame, per_type: dict[str, int], default: int = 10) -> DataFrame:
    """Hits by type, the best of each by score, with a section number in the order of the types' best scores."""
    most = F.coalesce(F.element_at(F.create_map(*[x for k, v in per_type.items() for x in (F.lit(k), F.lit(v))]), F.col("grain_type")), F.lit(default)) if per_type else F.lit(default)
    w = W.partitionBy("grain_type").orderBy(F.desc("score"), F.desc("seq"))
    out = hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    best = out.groupBy("grain_type").agg(F.max("score").alias("_best"))
    order = best.withColumn("section", F.row_number().over(W.orderBy(F.desc("_best"), "grain_type"))).drop("_best")
    return out.join(F.broadcast(order), "grain_type")  # one row for each of the 13 types at most


def census(hits: DataFrame) -> DataFrame:
    """Hits and their time span by session."""
    return hits.groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
