"""Ranked retrieval: BM25, nearest vectors, fusion, and what reorders results.

Each leg is a top-k over scores computed in one pass; postings are an exploded
token table that can be written once and partitioned by token.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.text import jaccard, tokens, word_bigrams

K1, B = 1.2, 0.75
RRF = 60
POOL = 64
NEAR_DUPLICATE = 0.85

# For each English word the words that may stand for it in query expansion.
SYNONYMS = {
    "cell": "mobile phone", "cellphone": "mobile phone",
    "mobile": "cell phone",
    "phone": "cell mobile telephone",
    "email": "mail", "e-mail": "mail",
    "buy": "purchase", "bought": "purchase", "purchased": "purchase",
    "purchase": "buy",
    "car": "vehicle", "automobile": "vehicle",
    "vehicle": "car",
    "doctor": "doctor physician", "physician": "doctor physician",
    "kid": "child children", "kids": "child children", "child": "child children",
    "spouse": "wife husband partner",
    "job": "work employer",
    "home": "residence address", "house": "residence address",
    "birthday": "birthdate born",
    "big": "large",
    "small": "little",
}
SUFFIXES = ("ing", "ed", "es", "s")


def query_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t and len(t) <= 64]


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(seq, token, tf, dl) of a table with seq and text."""
    toks = docs.select("seq", tokens(F.col(text)).alias("_t"))
    one = toks.select("seq", F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    return one.groupBy("seq", "token", "dl").agg(F.count("*").alias("tf"))


def _times(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda t: t == F.lit(word)))


def bm25(docs: DataFrame, query: str, k: int, scope: Column | None = None, live: Column | None = None, text: str = "text") -> DataFrame:
    """(seq, score) of the k best.

    N and the mean length are of the whole table, document frequencies of the
    scope; superseded rows count in both and are left out of the answer.
    A query word given twice counts twice.
    """
    words = query_tokens(query)
    if not words:
        return docs.select("seq", F.lit(0.0).alias("score")).limit(0)
    weight = {w: words.count(w) for w in words}
    base = docs.select("seq", tokens(F.col(text)).alias("_t"), (F.lit(True) if scope is None else scope).alias("_in"), (F.lit(True) if live is None else live).alias("_live"))
    base = base.withColumn("_dl", F.size("_t"))
    for i, w in enumerate(weight):
        base = base.withColumn(f"_f{i}", _times("_t", w))
    # corpus statistics: one row of a few numbers for each query word
    stats = base.agg(F.count_if(F.col("_dl") > 0).alias("_n"), (F.sum("_dl") / F.count_if(F.col("_dl") > 0)).alias("_avg"), *[F.count_if((F.col(f"_f{i}") > 0) & F.col("_in")).alias(f"_df{i}") for i in range(len(weight))])
    any_word = F.lit(False)
    for i in range(len(weight)):
        any_word = any_word | (F.col(f"_f{i}") > 0)
    hits = base.filter(any_word & F.col("_in") & F.col("_live")).drop("_t").join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, times in enumerate(weight.values()):
        tf, df = F.col(f"_f{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + times * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return hits.select("seq", score.alias("score")).orderBy(F.desc("score"), F.desc("seq")).limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, similarity) of the k nearest by cosine: exact, one pass, top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sized = vectors.filter(F.size(vector) == len(query))
    return sized.select(id_, cosine(v, q).alias("similarity")).orderBy(F.desc("similarity"), F.asc(id_)).limit(k)


def rrf(legs: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of (seq, score) legs, ranks from 0, ties by seq from the top."""
    w = W.orderBy(F.desc("score"), F.desc("seq"))
    ranked = None
    for leg in legs:
        part = leg.select("seq", (1.0 / (RRF + F.row_number().over(w) - 1)).alias("part"))  # a leg is a top-k
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("seq").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), F.desc("seq")).limit(k)


def expand_query(text: str, most: int = 4) -> list[str]:
    """Variants with one synonym each, then one with all words stemmed; never the query itself, none twice, most at most."""
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() for x in text.split()) if w]
    variants = [[*words[:i], other, *words[i + 1 :]] for i, w in enumerate(words) for other in SYNONYMS.get(w, "").split()]
    variants.append([next((w[: -len(x)] for x in SUFFIXES if w.endswith(x) and len(w) > len(x) + 2), w) for w in words])
    distinct = dict.fromkeys(" ".join(v) for v in variants)
    distinct.pop(" ".join(words), None)
    return list(distinct)[:most]


def recency_weight(ranked: DataFrame, w: float, now_ms: int, total: int) -> DataFrame:
    """(1 - w)(1 - place / n) + w / (1 + age in hours); states do not age."""
    if not w > 0:
        return ranked
    w = min(w, 1.0)
    age = F.greatest((F.lit(now_ms) - F.col("created_at")) / 3_600_000.0, F.lit(0.0))
    fresh = F.when(F.col("grain_type") == "state", F.lit(1.0)).otherwise(1 / (1 + age))
    return ranked.withColumn("score", (1 - w) * (1 - F.col("_rank") / F.lit(float(total))) + w * fresh)


def mmr(pool: DataFrame, k: int, lam: float, id_: str = "vec_id", vector: str = "embedding", relevance: str = "similarity") -> DataFrame:
    """Maximal marginal relevance over a pool of 64 rows or so, in one task by design: the choice is sequential."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values([relevance, id_], ascending=[False, True]).reset_index(drop=True)
        x = np.array([np.asarray(v, dtype=float) for v in rows[vector]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim, rel, left, chosen = x @ x.T, rows[relevance].to_numpy(float), list(range(len(rows))), []
        while left and len(chosen) < k:
            gain = [lam * rel[i] - (1 - lam) * (max(sim[i][j] for j in chosen) if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(gain))))
        out = rows.loc[chosen, [id_, relevance]].copy()
        out["place"] = range(1, len(chosen) + 1)
        return out

    kind = dict(pool.dtypes)[id_]
    return pool.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda p: pick(p), f"{id_} {kind}, {relevance} double, place int")


def diversified(pool: DataFrame, vectors: DataFrame, like: list[float], k: int, lam: float) -> DataFrame:
    """A pool with _rank by maximal marginal relevance to a vector; rows without a vector follow in their own order."""
    q = F.array(*[F.lit(float(x)) for x in like])
    own = vectors.filter(F.size("embedding") == len(like)).join(pool.select("seq"), "seq", "left_semi")
    own = own.select("seq", "embedding", cosine(F.transform("embedding", lambda x: x.cast("double")), q).alias("similarity"))
    chosen = mmr(own, k, lam, "seq").select("seq", "place")
    out = pool.join(chosen, "seq", "left")
    order = W.orderBy(F.col("place").asc_nulls_last(), "_rank")
    return out.withColumn("_rank", F.row_number().over(order).cast("long")).drop("place")


def dedup_by(rows: DataFrame, name: str) -> DataFrame:
    """The first row of each value in rank order; rows without one stay."""
    w = W.partitionBy(name).orderBy("_rank")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col(name).isNull() | (F.col("_n") == 1)).drop("_n")


def near_duplicates(rows: DataFrame, text: str = "text", threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Greedy: a row goes if an earlier kept one has a word-bigram Jaccard of threshold or more; for an assembled pool."""

    def keep(p: pd.DataFrame) -> pd.DataFrame:
        p, kept, sets = p.sort_values("_rank"), [], []
        for i, pairs in zip(p.index, p["_pairs"], strict=True):
            s = set(pairs)
            if all(len(s & o) < threshold * max(1, len(s | o)) for o in sets):
                kept.append(i)
                sets.append(s)
        return p.loc[kept].drop(columns=["_pairs"])

    pool = rows.withColumn("_pairs", word_bigrams(F.col(text)))
    return pool.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda p: keep(p).drop(columns=["_one"], errors="ignore"), rows.schema)


def multi_hop(grains: DataFrame, hits: DataFrame, hops: int, fan_out: int = 8, most_seeds: int = 8) -> DataFrame:
    """Hashes of facts reached from the hits' subjects and objects, with the hop: one join a hop, fan_out newest each."""
    facts = grains.filter(F.col("superseded_by").isNull() & F.col("subject").isNotNull() & F.col("object").isNotNull())
    ends = lambda df: df.select(F.explode(F.array("subject", "object")).alias("entity")).filter("entity is not null").distinct()
    front, out = ends(hits.orderBy("_rank").limit(most_seeds)), None
    for hop in range(1, hops + 1):
        forward = facts.join(front, F.col("subject") == F.col("entity"))
        back = facts.join(front, F.col("object") == F.col("entity"))
        w = W.partitionBy("entity", "_dir").orderBy(F.desc("seq"))
        both = forward.withColumn("_dir", F.lit(0)).unionByName(back.withColumn("_dir", F.lit(1))).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= fan_out)
        step = both.select("hash", "seq", "subject", "object", F.lit(hop).alias("hop"))
        out = step if out is None else out.unionByName(step)
        front = ends(step)
    fresh = out.join(hits.select("hash"), "hash", "left_anti")
    return fresh.groupBy("hash", "seq").agg(F.min("hop").alias("hop"))


def rerank(pool: DataFrame, query: str, scorer, text: str = "text") -> DataFrame:
    """A pool reordered by a pluggable scorer of (query, texts), called on Arrow batches; without one the order stays."""
    if scorer is None:
        return pool

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.fillna("").tolist()), dtype="float64")

    scored = pool.withColumn("score", run(F.col(text)))
    return scored.withColumn("_rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc("seq"))).cast("long"))


__all__ = ["bm25", "cosine", "dedup_by", "diversified", "expand_query", "jaccard", "mmr", "multi_hop", "near_duplicates", "nearest", "postings", "recency_weight", "rerank", "rrf"]
