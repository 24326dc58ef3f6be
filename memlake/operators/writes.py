"""Writes as new rows: nothing is changed in place, what is gone is an anti-join away."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize_ident
from ..schema import ADDABLE, TYPES
from ..sources.tables import canonical
from .versions import FORGET, KEY, SUPERSEDE, latest


def add(grains: DataFrame, new: DataFrame) -> DataFrame:
    """grains and the new rows whose content is not there yet; equal new rows once."""
    fresh = new.dropDuplicates(["hash"]).join(grains.select("hash"), "hash", "left_anti")
    return grains.unionByName(fresh.select(*grains.columns))


def add_if_novel(grains: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose key's head has another object."""
    head = latest(grains).select(*KEY, F.col("object").alias("_head"))
    return new.join(head, list(KEY), "left").filter(~F.col("object").eqNullSafe(F.col("_head"))).drop("_head")


def supersede(grains: DataFrame, old_hash: str, new: DataFrame) -> DataFrame:
    """new, one row, in place of old; an old row already superseded is a conflict and stays as it is."""
    new = new.withColumns({"supersedes": F.lit(old_hash), "derived_from": F.lit(old_hash)})
    by = new.select(F.col("hash").alias("_by"))
    can = grains.filter((F.col("hash") == old_hash) & F.col("superseded_by").isNull()).select(F.col("hash").alias("_old"))
    done = grains.join(F.broadcast(can.join(by)), F.col("hash") == F.col("_old"), "left")
    done = done.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by", "_old")
    return done.unionByName(new.join(F.broadcast(can)).drop("_old").select(*grains.columns))


def merge(grains: DataFrame, parents: DataFrame, new: DataFrame) -> DataFrame:
    """new closes a fork: every parent (merge_parents) is superseded by it."""
    gone = parents.select(F.explode("merge_parents").alias("_p")).join(new.select(F.col("hash").alias("_by")))
    done = grains.join(gone, F.col("hash") == F.col("_p"), "left")
    return done.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_p", "_by").unionByName(new.select(*grains.columns))


def forget(grains: DataFrame, hashes: DataFrame) -> DataFrame:
    return grains.join(hashes.select("hash"), "hash", "left_anti")


def log_of(grains: DataFrame) -> DataFrame:
    """The operation log that the grains came by: (op_seq, hlc, op, hash)."""
    return grains.select(F.col("seq").alias("op_seq"), F.col("created_at").alias("hlc"), F.when(F.col("supersedes").isNotNull(), SUPERSEDE).otherwise(1).alias("op"), "hash")


def validate(grain_type: str, fields: dict) -> None:
    from ..plans.lexer import QueryError

    if grain_type not in ADDABLE and grain_type != "event":
        raise QueryError("CAL-E021", f"{grain_type} can not be added")
    missing = [f for f in TYPES[grain_type].required if f not in fields]
    if missing:
        raise QueryError("CAL-E022", f"{grain_type} needs {', '.join(missing)}")
    if "*" in str(fields.get("namespace", "")):
        raise QueryError("VAL-E001", "* is reserved in namespace names")


def row(spark, grain_type: str, fields: dict, ns: str, seq: int, now_ms: int) -> DataFrame:
    """One new grain; fields without a column of their own go to attrs."""
    from ..schema import COLUMNS

    known = {"namespace": "ns"}
    values = {"ns": ns, "grain_type": grain_type, "seq": seq, "created_at": now_ms}
    attrs = {}
    for f, v in fields.items():
        name = known.get(f, f)
        if name in COLUMNS:
            values[name] = v
        else:
            attrs[f] = str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)
    if "description" in fields and "content" not in values:
        values["content"] = fields["description"]
    cols = {c: F.lit(v).cast(COLUMNS[c]) for c, v in values.items()}
    if attrs:
        cols["attrs"] = F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv])
    return canonical(spark.range(1).select(*[c.alias(k) for k, c in cols.items()]))


def bundle(grains: DataFrame, log: DataFrame, after: int) -> DataFrame:
    """The log after a cursor with its grains; what was forgotten comes without."""
    return log.filter(F.col("op_seq") > after).join(grains, "hash", "left")


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result: parquet, json, orc or csv (of flat columns)."""
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def blob_garbage(blobs: DataFrame, grains: DataFrame) -> DataFrame:
    """Blobs that no grain's content_refs name."""
    used = grains.select(F.explode("content_refs").alias("hash")).distinct()
    return blobs.join(used, "hash", "left_anti")


__all__ = ["FORGET", "add", "add_if_novel", "blob_garbage", "bundle", "export", "forget", "log_of", "merge", "normalize_ident", "row", "supersede", "validate"]
