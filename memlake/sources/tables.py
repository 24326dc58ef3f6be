"""The driver's tables as grains.

Facts come from customers, nations and suppliers, versioned facts from orders
(each order of a customer supersedes the one before), events from
conversations, and tool calls from the event stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from ..functions.text import projection
from ..schema import COLUMNS

EPOCH = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its times without a zone are UTC, whatever the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp") for c in plain})


def content_hash(*parts: Column) -> Column:
    """Content address: sha-256 of the parts joined by "|", nulls left out."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def canonical(df: DataFrame) -> DataFrame:
    """All columns of a grains table in order; the hash is computed if it is not there."""
    have = set(df.columns)
    out = df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    text = projection(F.col("subject"), F.col("relation"), F.col("object"), F.col("content"))
    out = out.withColumn("text", F.coalesce("text", text))
    if "hash" not in have:
        out = out.withColumn("hash", content_hash(*[F.col(c) for c in ("grain_type", "ns", "subject", "relation", "object", "content", "created_at", "seq")]))
    return out.select(*COLUMNS)


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return canonical(c.select(
        F.col("c_custkey").alias("seq"), F.concat(F.lit("crm."), F.lower("c_mktsegment")).alias("ns"), F.lit("fact").alias("grain_type"),
        (F.lit(EPOCH) + F.col("c_custkey") * 1000).alias("created_at"), _id("customer:", "c_custkey").alias("subject"), F.lit("in_nation").alias("relation"),
        _id("nation:", "c_nationkey").alias("object"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"),
    ))


def geo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(
        (F.lit(10_000_000) + F.col("n_nationkey")).alias("seq"), F.lit("geo").alias("ns"), (F.lit(EPOCH) + F.col("n_nationkey")).alias("created_at"),
        _id("nation:", "n_nationkey").alias("subject"), F.lit("in_region").alias("relation"), _id("region:", "n_regionkey").alias("object"))
    s = table(spark, sf_dir, "supplier").select(
        (F.lit(20_000_000) + F.col("s_suppkey")).alias("seq"), F.lit("geo.supply").alias("ns"), (F.lit(EPOCH) + F.col("s_suppkey")).alias("created_at"),
        _id("supplier:", "s_suppkey").alias("subject"), F.lit("in_nation").alias("relation"), _id("nation:", "s_nationkey").alias("object"))
    return canonical(n.unionByName(s).withColumns({"grain_type": F.lit("fact"), "confidence": F.lit(1.0)}))


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a version of its customer's latest_order; the chain is by date, then key."""
    o = table(spark, sf_dir, "orders")
    v = canonical(o.select(
        (F.lit(100_000_000) + F.col("o_orderkey")).alias("seq"), F.lit("orders").alias("ns"), F.lit("fact").alias("grain_type"),
        F.unix_millis("o_orderdate").alias("created_at"), _id("customer:", "o_custkey").alias("subject"), F.lit("latest_order").alias("relation"),
        _id("order:", "o_orderkey").alias("object"), F.lit(1.0).alias("confidence"), F.unix_millis("o_orderdate").alias("valid_from"),
        F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus")).alias("attrs"),
    ))
    w = W.partitionBy("subject").orderBy("created_at", "seq")
    return v.withColumns({"supersedes": F.lag("hash").over(w), "superseded_by": F.lead("hash").over(w), "valid_to": F.lead("created_at").over(w)}).withColumn("derived_from", F.col("supersedes"))


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return canonical(c.select(
        (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("chat").alias("ns"), F.lit("event").alias("grain_type"),
        (F.lit(EPOCH) + F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("created_at"), F.col("text").alias("content"),
        F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("run:"), (F.col("conv_id") % 50).cast("string")).alias("run_id"), "role",
    ))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return canonical(e.select(
        (F.lit(2_000_000_000) + F.col("event_id")).alias("seq"), F.concat(F.lit("tools."), F.col("event_type")).alias("ns"), F.lit("tool").alias("grain_type"),
        F.unix_millis("ts").alias("created_at"), _id("user:", "user_id").alias("session_id"), _id("run:", "user_id").alias("run_id"),
        F.create_map(F.lit("tool_name"), F.col("event_type"), F.lit("is_error"), (F.col("event_type") == "error").cast("string"),
                     F.lit("value"), F.col("value").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("attrs"),
    ))


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = customer_facts(spark, sf_dir)
    for part in (geo_facts, order_versions, chat_events, tool_calls):
        out = out.unionByName(part(spark, sf_dir))
    return out


#: The same views in SQL; a query's SQL starts with them.
SQL = """
customer_facts AS (
  SELECT c_custkey AS seq, 'crm.' || lower(c_mktsegment) AS ns, 'fact' AS grain_type, 1700000000000 + c_custkey * 1000 AS created_at,
         'customer:' || c_custkey AS subject, 'in_nation' AS relation, 'nation:' || c_nationkey AS object, CAST(NULL AS VARCHAR) AS content,
         (c_custkey % 10) / 10.0::double AS confidence, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS role
  FROM customer
), geo_facts AS (
  SELECT 10000000 + n_nationkey AS seq, 'geo' AS ns, 'fact' AS grain_type, 1700000000000 + n_nationkey AS created_at, 'nation:' || n_nationkey AS subject,
         'in_region' AS relation, 'region:' || n_regionkey AS object, CAST(NULL AS VARCHAR) AS content, 1.0::double AS confidence,
         CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS role FROM nation
  UNION ALL
  SELECT 20000000 + s_suppkey, 'geo.supply', 'fact', 1700000000000 + s_suppkey, 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey,
         CAST(NULL AS VARCHAR), 1.0::double, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM supplier
), order_facts AS (
  SELECT 100000000 + o_orderkey AS seq, 'orders' AS ns, 'fact' AS grain_type, (epoch_us(o_orderdate) // 1000) AS created_at, 'customer:' || o_custkey AS subject,
         'latest_order' AS relation, 'order:' || o_orderkey AS object, CAST(NULL AS VARCHAR) AS content, 1.0::double AS confidence,
         CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS role, o_totalprice AS price FROM orders
), chat_events AS (
  SELECT 1000000000 + conv_id * 1000 + turn AS seq, 'chat' AS ns, 'event' AS grain_type, 1700000000000 + conv_id * 60000 + turn * 1000 AS created_at,
         CAST(NULL AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS VARCHAR) AS object, text AS content, CAST(NULL AS DOUBLE) AS confidence,
         CAST(conv_id AS VARCHAR) AS session_id, 'run:' || (conv_id % 50) AS run_id, role FROM conversations
), tool_calls AS (
  SELECT 2000000000 + event_id AS seq, 'tools.' || event_type AS ns, 'tool' AS grain_type, (epoch_us(ts) // 1000) AS created_at,
         CAST(NULL AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS VARCHAR) AS object, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS DOUBLE) AS confidence,
         'user:' || user_id AS session_id, 'run:' || user_id AS run_id, CAST(NULL AS VARCHAR) AS role, event_type AS tool_name, event_type = 'error' AS is_error, value,
         json_extract_string(props, '$.k') AS k FROM events
), order_versions AS (
  SELECT *, lead(seq) OVER (PARTITION BY subject ORDER BY created_at, seq) AS next_seq, lag(seq) OVER (PARTITION BY subject ORDER BY created_at, seq) AS prev_seq,
         lead(created_at) OVER (PARTITION BY subject ORDER BY created_at, seq) AS valid_to FROM order_facts
), grains AS (
  SELECT seq, ns, grain_type, created_at, subject, relation, object, content, confidence, session_id, run_id, role, true AS live FROM customer_facts
  UNION ALL SELECT seq, ns, grain_type, created_at, subject, relation, object, content, confidence, session_id, run_id, role, true FROM geo_facts
  UNION ALL SELECT seq, ns, grain_type, created_at, subject, relation, object, content, confidence, session_id, run_id, role, next_seq IS NULL FROM order_versions
  UNION ALL SELECT seq, ns, grain_type, created_at, subject, relation, object, content, confidence, session_id, run_id, role, true FROM chat_events
  UNION ALL SELECT seq, ns, grain_type, created_at, subject, relation, object, content, confidence, session_id, run_id, role, true FROM tool_calls
)
"""
