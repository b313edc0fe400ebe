"""Replays of request streams that do not depend on the order of arrival.

A row waits in the state store until the watermark has passed its time; a timer then
replays what is due in the order of (ts, request_id), by the rule of the batch replay. Rows
that come at most ``delay`` late therefore give the batch result; later ones are dropped by
the watermark. The state store must be RocksDB (``USE_ROCKSDB``), so waiting rows lie on
disk; a replay holds the times and ids that are due of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.requests_log import _seconds, cached, client_key, limiter

# Fixed value: the state store that transformWithState needs.
USE_ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OrderedReplay(StatefulProcessor):
    """``decide(times, now)`` gives (flag, times) for a key's next event; times older than
    ``age`` microseconds decide nothing (None: they never grow old)."""

    def __init__(self, decide: Callable, age: int | None):
        self.decide, self.age = decide, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, request_id bigint")
        self.times = handle.getValueState("times", "times array<bigint>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, us: int, fired: int | None = None) -> None:
        """One timer per key, at the first millisecond after ``us`` or an earlier one that is set."""
        at, old = us // 1000 + 1, self.timer.get()
        if old is not None and old[0] != fired:
            if old[0] <= at:
                return
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(zip(pdf["us"].tolist(), pdf["request_id"].tolist(), strict=True)))
                least = min(int(pdf["us"].min()), least if least is not None else int(pdf["us"].min()))
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for us, rid in self.waiting.get():
            (due if us <= passed else rest).append((us, rid))
        held = self.times.get()
        times, out = list(held[0]) if held is not None else None, []
        for us, rid in sorted(due):
            flag, times = self.decide(times, us)
            out.append((rid, flag))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if times and not (self.age is not None and times[-1] + self.age < passed and not rest):
            self.times.update((times,))
        else:
            self.times.clear()
            times = None
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if rest:
            self._wake(min(us for us, _ in rest), fired)
        elif times and self.age is not None:
            self._wake(times[-1] + self.age + 1000, fired)
        else:
            self.timer.clear()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "flag"])


def _replayed(req: DataFrame, key: str, delay: str, decide: Callable, age: int | None, flag: str) -> DataFrame:
    rows = req.select(key, "request_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    out = rows.groupBy(key).transformWithStateInPandas(OrderedReplay(decide, age), "request_id bigint, flag boolean", "Append", "EventTime")
    return out.withColumnRenamed("flag", flag)


def rate_limit_ordered(req: DataFrame, limit: int, window: str, delay: str) -> DataFrame:
    """``requests_log.rate_limit`` over a stream whose rows come up to ``delay`` late."""
    age = int(_seconds(window) * 1_000_000)
    keyed = req.withColumn("client_key", client_key(F.col("xff"), F.col("endpoint")))
    return _replayed(keyed, "client_key", delay, limiter(limit, age), age, "admitted")


def cache_replay_ordered(req: DataFrame, ttl: str, delay: str) -> DataFrame:
    """``requests_log.cache_replay`` over a stream whose rows come up to ``delay`` late."""
    age = int(_seconds(ttl) * 1_000_000)
    return _replayed(req, "payload_key", delay, cached(age), age or None, "cache_hit")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*USE_ROCKSDB)
