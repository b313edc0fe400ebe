"""Structured Streaming twins of the request-log operators.

* ``windowed_counts_stream``: event-time window counts with a watermark
  (append mode: a window is emitted once the watermark passes its end;
  rows later than the watermark are dropped by Spark).
* ``rate_limit_stream`` / ``cache_replay_stream``: stateful per-key folds
  with ``applyInPandasWithState``.  State per key is bounded (at most
  ``limit`` timestamps, or one stored-at time) and expires through an
  event-time timeout once the watermark is a full window past the key's
  last event, which is exactly when the batch fold would start a new
  session.  Within a micro-batch a key's rows are sorted by (ts, id); rows
  of one key must not arrive after rows with a later ts in an earlier
  micro-batch for results to equal the batch replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.requests_log import _seconds, client_key

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def requests_stream(events: DataFrame) -> DataFrame:
    """Request projection of the event stream (event time as a zoned timestamp,
    which ``withWatermark`` requires)."""
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("props").alias("payload_key"),
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(", 10.0."), (F.col("user_id") % 7).cast("string"), F.lit(".1")).alias("xff"),
    )


def windowed_counts_stream(req: DataFrame, width: str, labels: list[str], delay: str) -> DataFrame:
    return (
        req.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), *labels)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"), *labels, "n")
    )


def _set_timeout(state: GroupState, ms: int) -> None:
    """Event-time timeout, never at or before the current watermark."""
    state.setTimeoutTimestamp(max(ms, int(state.getCurrentWatermarkMs()) + 1))


OUT_LIMIT = "request_id bigint, admitted boolean"
STATE_LIMIT = "bucket array<bigint>"


def _limit_fn(limit: int, window_s: int):
    win_us = window_s * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = list(state.get[0]) if state.exists else []
        out_ids, out_adm = [], []
        frames = [p for p in pdfs]
        pdf = pd.concat(frames).sort_values(["ts", "request_id"]) if frames else None
        if pdf is not None and len(pdf):
            us = (pdf["ts"].astype("datetime64[us]").astype("int64")).to_numpy()
            for rid, now in zip(pdf["request_id"].to_numpy(), us, strict=True):
                bucket = [b for b in bucket if not (now - b) > win_us]
                ok = limit <= 0 or len(bucket) < limit  # no limit admits everything
                if ok and limit > 0:
                    bucket.append(int(now))
                out_ids.append(int(rid))
                out_adm.append(ok)
            state.update((bucket,))
            _set_timeout(state, int(max(bucket or [int(us.max())]) // 1000) + window_s * 1000 + 1)
        yield pd.DataFrame({"request_id": out_ids, "admitted": out_adm})

    return fn


def rate_limit_stream(req: DataFrame, limit: int, window: str, delay: str) -> DataFrame:
    ws = _seconds(window)
    keyed = req.withColumn("client_key", client_key(F.col("xff"), F.col("endpoint"))).withWatermark("ts", delay)
    return keyed.select("client_key", "request_id", "ts").groupBy("client_key").applyInPandasWithState(
        _limit_fn(limit, ws), OUT_LIMIT, STATE_LIMIT, "append", GroupStateTimeout.EventTimeTimeout
    )


OUT_CACHE = "request_id bigint, cache_hit boolean"
STATE_CACHE = "stored_at bigint"


def _cache_fn(ttl_s: int):
    ttl_us = ttl_s * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        frames = [p for p in pdfs]
        ids, hits = [], []
        pdf = pd.concat(frames).sort_values(["ts", "request_id"]) if frames else None
        if pdf is not None and len(pdf):
            us = (pdf["ts"].astype("datetime64[us]").astype("int64")).to_numpy()
            for rid, now in zip(pdf["request_id"].to_numpy(), us, strict=True):
                hit = stored is not None and not (ttl_s > 0 and (now - stored) > ttl_us)
                if not hit:
                    stored = int(now)
                ids.append(int(rid))
                hits.append(bool(hit))
            state.update((stored,))
            if ttl_s > 0:
                _set_timeout(state, int(stored // 1000) + ttl_s * 1000 + 1)
        yield pd.DataFrame({"request_id": ids, "cache_hit": hits})

    return fn


def cache_replay_stream(req: DataFrame, ttl: str, delay: str) -> DataFrame:
    ttl_s = _seconds(ttl)
    keyed = req.select("payload_key", "request_id", "ts").withWatermark("ts", delay)
    return keyed.groupBy("payload_key").applyInPandasWithState(
        _cache_fn(ttl_s), OUT_CACHE, STATE_CACHE, "append",
        GroupStateTimeout.EventTimeTimeout if ttl_s > 0 else GroupStateTimeout.NoTimeout,
    )


def error_ratio_stream(req: DataFrame, width: str, slide: str, delay: str, threshold: float) -> DataFrame:
    """5xx ratio per sliding event-time window (append mode: emitted once the
    watermark passes the window end)."""
    out = (
        req.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("n_bad"))
    )
    ratio = F.col("n_bad") / F.greatest(F.col("n").cast("double"), F.lit(1e-9))
    return out.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n", "n_bad", ratio.alias("ratio"), (ratio > threshold).alias("above"),
    )


def audit_stream_sink(events: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append audit events from a stream, one folder per micro-batch.

    ``foreachBatch`` may replay a batch after a failure; each batch overwrites
    its own ``epoch=<id>`` folder (partitioned by event date inside), so a
    replay replaces rather than duplicates its rows.  Readers load ``path``
    with partition discovery (``epoch`` and ``event_date`` columns).
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("event_date").parquet(f"{path.rstrip('/')}/epoch={epoch_id}")

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def audit_events_stream(req: DataFrame, canary_percent: float = 10.0) -> DataFrame:
    """Audit projection of the request stream (same columns as the batch audit)."""
    from ..operators.scoring import audit_projection, canary_variant

    r = req.select(
        "request_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("endpoint"), F.lit("1.0.0").alias("model_version"),
        canary_variant(F.col("request_id"), canary_percent).alias("variant"),
        F.lit(None).cast("double").alias("prediction"),
        F.lit(None).cast("double").alias("predicted_latency_ms"),
        F.lit(0).alias("cache_hit"), F.lit(None).cast("double").alias("latency_ms"),
        F.when(F.col("status") >= 500, F.lit("error")).alias("status"),
    )
    return audit_projection(r)
