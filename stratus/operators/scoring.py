"""Batch scoring helpers: nested batches, per-row status, dedup, canary, shadow, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket

MSG_BATCH = "Request body must contain a list of instances"
MSG_EMPTY = "No instances"


def explode_batch(df: DataFrame, doc: str, instance_schema: str, batch_id: str) -> DataFrame:
    """``{"instances": [...]}`` (or a bare list) -> one row per instance with its position.
    A document that is neither, or has no instances, is one row with a null position and
    its error."""
    fields = ",".join(f"{n}:{t}" for n, t in (f.strip().split() for f in instance_schema.split(",")))
    inst = f"struct<{fields}>"
    parsed = F.coalesce(
        F.from_json(F.col(doc), f"struct<instances:array<{inst}>>").getField("instances"),
        F.from_json(F.col(doc), f"array<{inst}>"),
    )
    error = F.when(parsed.isNull(), F.lit(MSG_BATCH)).when(F.size(parsed) == 0, F.lit(MSG_EMPTY))
    return df.select(batch_id, error.alias("error"), F.posexplode_outer(parsed).alias("index", "inst")).select(batch_id, "index", "inst.*", "error")


def canary_variant(request_id: Column, percent: float) -> Column:
    """``probe`` for requests whose hash, as a share of its whole range of 2**32, is below
    the clamped percentage."""
    pct = max(0.0, min(100.0, float(percent)))
    share = md5_bucket(request_id, 1 << 32) * (100.0 / (1 << 32))
    return F.when(share < F.lit(pct), F.lit("probe")).otherwise(F.lit("anchor"))


def score_distinct(df: DataFrame, key: str, scorer) -> DataFrame:
    """Score each distinct payload once, then join the score back to every request.

    ``scorer`` maps a DataFrame of distinct keys to (key, score)."""
    distinct = df.select(key).distinct()
    scored = scorer(distinct)
    return df.join(scored, key)


def audit_projection(df: DataFrame) -> DataFrame:
    """Audit event rows with defaults: status 'success', endpoint 'unknown', flag 0/1,
    ``created_at`` as epoch seconds."""
    return df.select(
        F.col("request_id").cast("string").alias("request_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_at"),
        F.coalesce(F.col("endpoint"), F.lit("unknown")).alias("endpoint"),
        F.col("model_version"),
        F.col("variant"),
        F.col("prediction"),
        F.col("predicted_latency_ms"),
        F.coalesce(F.col("cache_hit").cast("int"), F.lit(0)).alias("cache_hit"),
        F.col("latency_ms"),
        F.coalesce(F.col("status"), F.lit("success")).alias("status"),
        F.to_date(F.col("ts")).alias("event_date"),
    )
