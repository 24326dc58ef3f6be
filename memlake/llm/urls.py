"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is a host and a path prefix; it fits its host and all subdomains if the
url's path starts with the rule's, and the longest fitting rule wins: the
longest host, then the longest path.  The list's canonical keys, host then path,
are hashed into a Bloom filter of 256-bit blocks, four 64-bit words
each, of which one key touches one block only.  Every url is looked up with the
few keys that could list it: its host's suffixes of the label counts that the
list has, with its path's prefixes of the lengths that the list has.  Keys that
pass the filter go on to an equi-join with the list, which removes the
filter's false positives; urls without such a key, nearly all of them, never
reach a shuffle.

All of it is built-in expressions and joins.  The filter is embedded in the
plan only up to MAX_BLOCKS blocks (a longer list makes it pass more, which the
join removes again), whatever the length of the list.

Defined cases: a null url, or one without "://", has an empty host and path and
no rule; a url without a rule is allowed; equal rows stay as many as they are;
extra columns are ignored; empty tables give empty results; a rule given twice
counts once, and of contrary verdicts for one rule, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORDS = 4
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 14
SEEDS = (11, 23, 37, 53)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first "://" with A-Z lower-cased, and the path."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _bits(key: Column) -> list[tuple[int, Column]]:
    """For each word of the block: its number and the bit that the key sets there."""
    return [(w, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64)).cast("int")) for w, seed in enumerate(SEEDS[:WORDS])]


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


class Bloom:
    """The filter as a list of 64-bit words, WORDS to a block."""

    def __init__(self, rules: DataFrame, max_blocks: int = MAX_BLOCKS):
        n = rules.count()
        self.blocks = max(1, min(max_blocks, -(-n // KEYS_PER_BLOCK)))
        keys = rules.select(canonical(F.col("rule_host"), F.col("rule_path")).alias("key"))
        words = [F.bit_or(_one(bit)).alias(f"w{w}") for w, bit in _bits(F.col("key"))]
        rows = keys.groupBy(_block(F.col("key"), self.blocks).alias("b")).agg(*words).collect()  # max_blocks rows at most
        flat = [0] * (self.blocks * WORDS)
        for r in rows:
            flat[r["b"] * WORDS : (r["b"] + 1) * WORDS] = [r[f"w{w}"] for w in range(WORDS)]
        self.words = F.split(F.lit(",".join(map(str, flat))), ",").cast("array<bigint>")

    def may_hold(self, key: Column) -> Column:
        block = _block(key, self.blocks) * WORDS
        test = F.lit(True)
        for w, bit in _bits(key):
            mask = _one(bit)
            test = test & (F.get(self.words, block + w).bitwiseAND(mask) == mask)
        return test


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """From (host, path with its leading "/", verdict)."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def apply_rules(pages: DataFrame, rules: DataFrame, *keep: str, url: str = "url", default: str = "allow") -> DataFrame:
    """keep, host, path, rule (host and path of the winning rule, or null) and verdict of every row of pages."""
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # "block" > "allow"
    bloom = Bloom(rules)
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()  # a few small numbers
    host, path = host_and_path(F.col(url))
    at = pages.select(*keep, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    hosts = [F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in sorted(shape["labels"])]
    tails = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]
    keys = F.array_compact(F.array(*[F.concat(h, t) for h in hosts for t in tails])) if hosts else F.array().cast("array<string>")
    keys = F.filter(F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")), bloom.may_hold)
    at = at.withColumn("_keys", keys)
    none = F.lit(None).cast("string")
    clear = at.filter(F.size("_keys") == 0).select(*keep, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    # equal rows become one with a count, so a hot url is summed where it lies
    hits = at.filter(F.size("_keys") > 0).groupBy(*keep, "host", "path", "_keys").agg(F.count("*").alias("_n"))
    listed = rules.select(canonical(F.col("rule_host"), F.col("rule_path")).alias("_key"), "rule_host", "rule_path", "rule_verdict")
    found = hits.withColumn("_key", F.explode("_keys")).join(listed, "_key", "left")
    best = F.max(F.when(F.col("rule_host").isNotNull(), F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"))).alias("_best")
    found = found.groupBy(*keep, "host", "path", "_n").agg(best)
    found = found.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    found = found.select(*keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))
    return clear.unionByName(found)
