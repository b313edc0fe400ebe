"""Replays of streams whose rows come out of order equal the batch replays."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from stratus.operators import requests_log as rl
from stratus.sources import adapters
from stratus.sources.tables import Tables
from stratus.streaming import ordered_replay as od
from stratus.streaming import requests_stream as rs
from test_streaming import run_to_completion


def _dealt(spark, scratch, files: int, place) -> str:
    """Events in files by ``place``, and a last file with one event far in the future,
    which lets the watermark pass all others."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for i in range(files):
        ev.where(place == i).coalesce(1).write.parquet(f"{scratch}/part={i:03d}")
    last = ev.limit(1).select(*[F.lit(-1).cast("bigint").alias(c) if c == "event_id" else (F.col(c) + F.expr("INTERVAL 1000 DAYS")).alias(c) if c == "ts" else F.col(c) for c in ev.columns])
    last.coalesce(1).write.parquet(f"{scratch}/part={files:03d}")
    return f"{scratch}/*"


def test_shuffled_arrival_equals_batch(spark, scratch):
    od.use_rocksdb(spark)
    try:
        # half of the rows a day late, over files of ten days: the watermark moves with each
        begin = spark.read.parquet(f"{SF_SMALL}/events.parquet").agg(F.min("ts")).first()[0]
        late = F.datediff("ts", F.lit(begin)) + F.pmod(F.xxhash64("event_id"), F.lit(2))
        days = spark.read.parquet(f"{SF_SMALL}/events.parquet").agg(F.max(F.datediff("ts", F.lit(begin)))).first()[0]
        files = _dealt(spark, f"{scratch}/late", (days + 1) // 10 + 1, F.floor(late / 10))
        req = rs.requests_stream(rs.read_events_stream(spark, files, max_files_per_trigger=1))
        got = run_to_completion(od.rate_limit_ordered(req, 2, "1 day", "2 days"), f"{scratch}/ck1")
        r = adapters.requests(Tables(spark, SF_SMALL)).withColumn("client_key", rl.client_key(F.col("xff"), F.col("endpoint")))
        want = {x["request_id"]: x["admitted"] for x in rl.rate_limit(r, "client_key", "ts", "request_id", 2, "1 day").select("request_id", "admitted").collect()}
        assert {x["request_id"]: x["admitted"] for x in got} == want and len(got) == len(want) and not all(want.values())

        # every file spans the whole time
        files = _dealt(spark, f"{scratch}/mixed", 3, F.pmod(F.xxhash64("event_id"), F.lit(3)))
        req = rs.requests_stream(rs.read_events_stream(spark, files, max_files_per_trigger=1))
        got = run_to_completion(od.cache_replay_ordered(req, "6 hours", "400 days"), f"{scratch}/ck2")
        want = {x["request_id"]: x["cache_hit"] for x in rl.cache_replay(r, "payload_key", "ts", "request_id", "6 hours").select("request_id", "cache_hit").collect()}
        assert {x["request_id"]: x["cache_hit"] for x in got} == want and len(got) == len(want) and any(want.values())
    finally:
        spark.conf.unset(od.USE_ROCKSDB[0])
