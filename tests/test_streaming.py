"""Streaming twins equal the batch replays over the same events."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stratus.operators import requests_log as rl
from stratus.sources import adapters
from stratus.sources.tables import Tables
from stratus.streaming import requests_stream as rs


def run_to_completion(df, checkpoint: str, mode: str = "append") -> list:
    """Drive a streaming query over all available input (``availableNow``) and
    return the rows it emitted, collected micro-batch by micro-batch."""
    rows: list = []

    def sink(batch, _epoch) -> None:
        rows.extend(batch.collect())  # test/dev helper: output of a bounded input

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return rows


def _split_by_day(spark, scratch):
    """Events written as one file per day, so micro-batches arrive in time order."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = f"{scratch}/events"
    days = [r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days):
        ev.where(F.to_date("ts") == F.lit(d)).coalesce(1).write.parquet(f"{src}/part={i:03d}")
    return src


def test_rate_limit_and_cache_stream_equal_batch(spark, scratch):
    src = _split_by_day(spark, scratch)
    files = f"{src}/*"
    req = rs.requests_stream(rs.read_events_stream(spark, files, max_files_per_trigger=1))
    got = run_to_completion(rs.rate_limit_stream(req, 2, "1 day", "1 day"), f"{scratch}/ck1")
    stream = {r["request_id"]: r["admitted"] for r in got}

    r = adapters.requests(Tables(spark, SF_SMALL))
    r = r.withColumn("client_key", rl.client_key(F.col("xff"), F.col("endpoint"))).select("request_id", "ts", "client_key")
    batch = {row["request_id"]: row["admitted"] for row in rl.rate_limit(r, "client_key", "ts", "request_id", 2, "1 day").collect()}
    assert stream == batch
    assert sum(not v for v in batch.values()) > 0

    req2 = rs.requests_stream(rs.read_events_stream(spark, files, max_files_per_trigger=1))
    got2 = run_to_completion(rs.cache_replay_stream(req2, "6 hours", "6 hours"), f"{scratch}/ck2")
    stream2 = {r["request_id"]: r["cache_hit"] for r in got2}
    r2 = adapters.requests(Tables(spark, SF_SMALL)).select("request_id", "ts", "payload_key")
    batch2 = {row["request_id"]: row["cache_hit"] for row in rl.cache_replay(r2, "payload_key", "ts", "request_id", "6 hours").collect()}
    assert stream2 == batch2


def test_rate_limit_stream_for_other_limits(spark, scratch):
    src = _split_by_day(spark, scratch)
    r = adapters.requests(Tables(spark, SF_SMALL))
    r = r.withColumn("client_key", rl.client_key(F.col("xff"), F.col("endpoint"))).select("request_id", "ts", "client_key")
    for limit in (0, 1):
        req = rs.requests_stream(rs.read_events_stream(spark, f"{src}/*", max_files_per_trigger=8))
        got = run_to_completion(rs.rate_limit_stream(req, limit, "1 day", "1 day"), f"{scratch}/ck{limit}")
        batch = {row["request_id"]: row["admitted"] for row in rl.rate_limit(r, "client_key", "ts", "request_id", limit, "1 day").collect()}
        assert {x["request_id"]: x["admitted"] for x in got} == batch


def test_windowed_counts_stream_equal_batch(spark, scratch):
    src = _split_by_day(spark, scratch)
    req = rs.requests_stream(rs.read_events_stream(spark, f"{src}/*", max_files_per_trigger=3))
    got = run_to_completion(rs.windowed_counts_stream(req, "1 hour", ["endpoint"], "0 seconds"), f"{scratch}/ck")
    s = pd.DataFrame([r.asDict() for r in got]).sort_values(["window_start", "endpoint"]).reset_index(drop=True)
    b = rl.window_counts(adapters.requests(Tables(spark, SF_SMALL)), "ts", "1 hour", ["endpoint"]).drop("rate_per_s")
    b = b.toPandas().sort_values(["window_start", "endpoint"]).reset_index(drop=True)
    # append mode holds back windows still open at the final watermark
    merged = b.merge(s, on=["window_start", "window_end", "endpoint"], how="left", suffixes=("", "_s"))
    emitted = merged.dropna(subset=["n_s"])
    assert (emitted["n"] == emitted["n_s"]).all()
    assert len(emitted) >= len(b) - 5 * 2


def test_error_ratio_stream_equal_batch(spark, scratch):
    src = _split_by_day(spark, scratch)
    req = rs.requests_stream(rs.read_events_stream(spark, f"{src}/*", max_files_per_trigger=2))
    got = run_to_completion(rs.error_ratio_stream(req, "6 hours", "1 hour", "0 seconds", 0.25), f"{scratch}/ck")
    s = {(r["window_start"], r["window_end"]): (r["n"], r["n_bad"], r["above"]) for r in got}
    r = adapters.requests(Tables(spark, SF_SMALL))
    b = rl.ratio_series(r, "ts", F.col("status") >= 500, "6 hours", "1 hour", 0.25).collect()
    bd = {(x["window_start"], x["window_end"]): (x["n"], x["n_bad"], x["above"]) for x in b}
    assert s and all(bd[k] == v for k, v in s.items())
    assert len(s) >= len(bd) - 6  # windows still open at the final watermark are held back


def test_audit_stream_sink_is_replay_safe(spark, scratch):
    src = _split_by_day(spark, scratch)
    req = rs.requests_stream(rs.read_events_stream(spark, f"{src}/*", max_files_per_trigger=5))
    out = f"{scratch}/audit"
    q = rs.audit_stream_sink(rs.audit_events_stream(req), out, f"{scratch}/ck")
    q.awaitTermination()
    back = spark.read.parquet(out)
    n_events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert back.count() == n_events
    assert back.select("request_id").distinct().count() == n_events
    assert {"epoch", "event_date", "status", "variant"} <= set(back.columns)
    # a time lookup prunes by the date partition
    plan = back.where(F.col("event_date") == F.lit("2024-01-05").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
