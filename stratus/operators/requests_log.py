"""Request-log analytics: counters, histograms, percentiles, alert rules,
and the two stateful replays (sliding-window rate limiter, TTL cache).

Windowed counts use ``window()`` group-bys (partial aggregation, so a hot
endpoint or status costs nothing extra).  The limiter is an ordered fold cut
at exact independence points (a quiet gap longer than the window empties the
state); each piece is a sorted streaming pass that holds at most ``limit``
timestamps.  The cache is replayed in time buckets.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

# Latency histogram bucket upper bounds in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def client_key(xff: Column, endpoint: Column) -> Column:
    """First forwarded address, trimmed, joined with the endpoint: ``client:endpoint``."""
    return F.concat_ws(":", F.trim(F.split(xff, ",").getItem(0)), endpoint)


def _seconds(d: str) -> int:
    n, unit = d.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "day": 86400, "days": 86400}
    return int(float(n) * mult[unit])


# ------------------------------------------------------------------ counters

def window_counts(df: DataFrame, ts: str, width: str, labels: list[str], slide: str | None = None) -> DataFrame:
    """Counts per (window, labels); also a per-second rate."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    out = df.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n"))
    return out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "n",
        (F.col("n") / F.lit(_seconds(width))).alias("rate_per_s"),
    )


def bucket_index(x: Column, bounds: list[float] = LATENCY_BOUNDS) -> Column:
    """Index of the first bound >= x (len(bounds) for +Inf)."""
    e = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        e = F.when(x <= bounds[i], F.lit(i)).otherwise(e)
    return e


def _le_label(b: Column, bounds: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(str(v)) for v in bounds], F.lit("+Inf")), b + 1)


def latency_histogram(df: DataFrame, x: str, labels: list[str], bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts ``count(x <= le)`` for every bound plus +Inf.

    Rows are counted once into their first bucket (one aggregation), then
    the per-label table of at most len(bounds)+1 rows is accumulated.
    """
    per = df.groupBy(*labels, bucket_index(F.col(x), bounds).alias("b")).agg(F.count("*").alias("c"))
    # every label gets all len(bounds)+1 buckets (explode, bounded by the label count)
    grid = df.select(*labels).distinct().select(*labels, F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("b"))
    full = grid.join(per, [*labels, "b"], "left").fillna(0, ["c"])
    w = Window.partitionBy(*labels).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*labels, "b", _le_label(F.col("b"), bounds).alias("le"), F.sum("c").over(w).alias("cum_count"))


def windowed_quantile(df: DataFrame, ts: str, x: str, width: str, slide: str, q: float = 0.95,
                      bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Bucket-interpolated quantile per sliding window (histogram_quantile rule):
    first bucket whose cumulative count reaches q*n, linear inside it, lower
    edge 0 for the first bucket; a +Inf bucket yields the highest finite bound."""
    w = F.window(F.col(ts), width, slide)
    per = df.groupBy(w.alias("w"), bucket_index(F.col(x), bounds).alias("b")).agg(F.count("*").alias("c"))
    ws = Window.partitionBy("w").orderBy("b")
    per = per.select(
        "w", "b", "c",
        F.sum("c").over(ws.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.sum("c").over(Window.partitionBy("w")).alias("n"),
    )
    per = per.withColumn("rank", F.col("n") * q).where(F.col("cum") >= F.col("rank"))
    first = per.groupBy("w").agg(F.min_by(F.struct("b", "c", "cum", "n", "rank"), F.col("b")).alias("s"))
    ub = F.element_at(F.array(*[F.lit(v) for v in bounds]), F.least(F.col("s.b"), F.lit(len(bounds) - 1)) + 1)
    lb = F.when(F.col("s.b") == 0, F.lit(0.0)).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in bounds]), F.greatest(F.col("s.b"), F.lit(1)))
    )
    prev = F.col("s.cum") - F.col("s.c")
    val = F.when(F.col("s.b") == len(bounds), F.lit(bounds[-1])).otherwise(
        lb + (ub - lb) * (F.col("s.rank") - prev) / F.col("s.c")
    )
    return first.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        F.col("s.n").alias("n"), val.alias("p95"),
    )


def ratio_series(df: DataFrame, ts: str, bad: Column, width: str, slide: str, threshold: float) -> DataFrame:
    """``count_if(bad) / greatest(count, 1e-9)`` per sliding window, flagged above threshold."""
    w = F.window(F.col(ts), width, slide)
    out = df.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    ratio = F.col("n_bad") / F.greatest(F.col("n").cast("double"), F.lit(1e-9))
    return out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "n_bad",
        ratio.alias("ratio"), (ratio > threshold).alias("above"),
    )


# ------------------------------------------------------------------ alert rules

def tick_grid(df: DataFrame, ts: str, step: str) -> DataFrame:
    """Evaluation ticks every ``step`` from the first to the last event (bounded by
    the time span / step, not by the row count)."""
    sec = _seconds(step)
    r = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    lo = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("lo").cast("timestamp")) / sec) * sec).cast("timestamp_ntz")
    hi = F.timestamp_seconds((F.floor(F.unix_seconds(F.col("hi").cast("timestamp")) / sec) + 1) * sec).cast("timestamp_ntz")
    return r.select(F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL {sec} SECONDS"))).alias("tick"))


def sustained(series: DataFrame, key: str, tick: str, cond: Column, for_: str) -> DataFrame:
    """Gaps and islands: an alert fires at a tick once its condition has been
    true at every tick since the island start for at least ``for_``."""
    s = series.withColumn("cond", cond)
    w = Window.partitionBy(key).orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_grp", F.sum(F.when(F.col("cond"), 0).otherwise(1)).over(w))
    start = F.min(F.when(F.col("cond"), F.col(tick))).over(Window.partitionBy(key, "_grp"))
    s = s.withColumn("island_start", F.when(F.col("cond"), start))
    fire = F.col("cond") & (F.col(tick) - F.col("island_start") >= F.expr(f"INTERVAL {_seconds(for_)} SECONDS"))
    return s.withColumn("firing", F.coalesce(fire, F.lit(False))).drop("_grp")


def alert_states(req: DataFrame, width: str, step: str, rules: dict[str, tuple], gauge_for: str, oob: Column) -> DataFrame:
    """All rules over one tick grid, each a value per tick (of the sliding window that ends
    there), its condition and how long that must hold. ``rules``: threshold and duration
    of high_5xx_ratio, predict_error_ratio, select_error_ratio, latency_p95 and oob_rate;
    model_not_loaded fires on a gauge of 0 that lasts ``gauge_for``. ``oob`` marks
    requests with a feature out of band."""
    grid = tick_grid(req, "ts", step)
    ratio = lambda bad, rows=None: ratio_series(req if rows is None else rows, "ts", bad, width, step, 0.0).select(F.col("window_end").alias("tick"), F.col("ratio").alias("value"))
    failed = F.col("outcome") == "error"
    series = {
        "high_5xx_ratio": ratio(F.col("status") >= 500),
        "predict_error_ratio": ratio(failed),
        "select_error_ratio": ratio(failed, req.where(F.col("endpoint") != "view")),
        "latency_p95": windowed_quantile(req, "ts", "latency_s", width, step).select(F.col("window_end").alias("tick"), F.col("p95").alias("value")),
        "oob_rate": window_counts(req.where(oob), "ts", width, [], slide=step).select(F.col("window_end").alias("tick"), F.col("rate_per_s").alias("value")),
    }
    out = None
    for name, values in series.items():
        threshold, lasting = rules[name]
        s = grid.join(values, "tick", "left").select(F.lit(name).alias("alert"), "tick", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
        s = sustained(s, "alert", "tick", F.col("value") > threshold, lasting)
        out = s if out is None else out.unionByName(s)
    # gauge: last observed value at or before each tick, carried forward
    g = req.groupBy(F.window("ts", step).alias("w")).agg(F.max_by("model_loaded", F.struct("ts", "request_id")).alias("last_v"))
    g = grid.join(g.select(F.col("w.end").alias("tick"), "last_v"), "tick", "left")
    wg = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # one row per tick: bounded
    g = g.select(F.lit("model_not_loaded").alias("alert"), "tick",
                 F.last("last_v", ignorenulls=True).over(wg).cast("double").alias("value"))
    return out.unionByName(sustained(g, "alert", "tick", F.col("value") == 0, gauge_for))


# ------------------------------------------------------------------ sessionize

def sessionize(df: DataFrame, key: str, ts: str, order_tie: str, gap_seconds: float, bucket: str = "1 day") -> DataFrame:
    """Add ``session_start``: ts of the first event of the run of events of a
    key whose consecutive gaps are all <= ``gap_seconds``.

    Distributed: windows are partitioned by (key, time bucket); the one
    value that crosses a bucket border (last ts and last session start of
    earlier buckets) comes from a per-(key, bucket) summary table.
    """
    bsec = _seconds(bucket)
    t = df.withColumn("_b", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bsec * 1_000_000)))
    per_b = t.groupBy(key, "_b").agg(F.max(ts).alias("_bmax"))
    wb = Window.partitionBy(key).orderBy("_b")
    per_b = per_b.withColumn("_prev_bmax", F.lag("_bmax").over(wb))
    wi = Window.partitionBy(key, "_b").orderBy(ts, order_tie)
    t = t.join(per_b.select(key, "_b", "_prev_bmax"), [key, "_b"])
    prev = F.coalesce(F.lag(ts).over(wi), F.col("_prev_bmax"))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    t = t.withColumn("_new", prev.isNull() | (gap > F.lit(int(gap_seconds * 1_000_000))))
    # last session start in each bucket, carried over buckets
    t = t.withColumn("_start_in_b", F.max(F.when(F.col("_new"), F.col(ts))).over(wi.rowsBetween(Window.unboundedPreceding, 0)))
    last_in_b = t.groupBy(key, "_b").agg(F.max(F.when(F.col("_new"), F.col(ts))).alias("_ls"))
    last_in_b = last_in_b.withColumn(
        "_carry", F.last("_ls", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1))
    )
    t = t.join(last_in_b.select(key, "_b", "_carry"), [key, "_b"])
    return t.withColumn("session_start", F.coalesce(F.col("_start_in_b"), F.col("_carry"))).drop(
        "_b", "_prev_bmax", "_new", "_start_in_b", "_carry"
    )


def _folded(df: DataFrame, key: str, ts: str, tie: str, quiet_s: float, flag: str, decide) -> DataFrame:
    """``df`` with a boolean ``flag`` from an ordered fold over each session of a key:
    rows are dealt by (key, session start) and sorted, and ``decide(state, now)`` returns
    (flag, state) for one event; times in microseconds, a session begins with state None.
    The rows themselves pass through, so nothing is joined back."""
    s = sessionize(df, key, ts, tie, quiet_s)
    s = s.repartition(shuffle_partitions(df), key, "session_start").sortWithinPartitions(key, "session_start", ts, tie)

    def run(batches):
        cur, state = None, None
        for pdf in batches:
            out = []
            times = pdf[ts].astype("datetime64[us]").astype("int64").tolist()
            for k, start, now in zip(pdf[key].tolist(), pdf["session_start"].tolist(), times, strict=True):
                if (k, start) != cur:
                    cur, state = (k, start), None
                got, state = decide(state, now)
                out.append(got)
            yield pdf.drop(columns="session_start").assign(**{flag: out})

    return s.mapInPandas(run, T.StructType([*[f for f in s.schema.fields if f.name != "session_start"], T.StructField(flag, T.BooleanType())]))


def limiter(limit: int, age: int):
    """Rule of the rate limiter: (admitted, admitted times not older than ``age``)."""

    def decide(hits, now):
        hits = [h for h in hits or () if now - h <= age]  # at most ``limit``
        ok = limit <= 0 or len(hits) < limit
        return ok, [*hits, now] if ok and limit > 0 else hits

    return decide


def cached(age: int):
    """Rule of the cache: (hit, [time of the entry]); 0 never expires."""

    def decide(entry, now):
        hit = bool(entry) and (age <= 0 or now - entry[0] <= age)
        return hit, entry if hit else [now]

    return decide


def rate_limit(df: DataFrame, key: str, ts: str, tie: str, limit: int = 60, window: str = "60 seconds") -> DataFrame:
    """Sliding-window admission per key: at most ``limit`` admitted hits whose age
    is <= window; rejected hits do not count; limit <= 0 admits everything."""
    if limit <= 0:
        return df.withColumn("admitted", F.lit(True))
    return _folded(df, key, ts, tie, _seconds(window), "admitted", limiter(limit, int(_seconds(window) * 1_000_000)))


# Width of a time bucket of the cache replay, in lifetimes of an entry.
BUCKET_LIFETIMES = 32


class _Exits:
    """A time bucket's last miss as a function of the last miss before it, from the
    bucket's events in order.

    Each event of the first lifetime, and the first one after it, may be the bucket's first
    miss, so each starts a chain of misses. Chains that meet stay together, and those
    that have met began at neighbouring events: ``chains`` holds (last miss, ends of the
    runs of starts) in the order of the last misses."""

    def __init__(self, begin: int, age: int):
        self.until, self.age, self.seen, self.more = begin + age, age, None, True
        self.chains: deque[tuple[int, list[int]]] = deque()

    def event(self, now: int) -> None:
        if now == self.seen:
            return
        self.seen, starts = now, []
        if self.more:
            starts, self.more = [now], now <= self.until
        met = bool(starts)
        while self.chains and self.chains[0][0] + self.age < now:
            met = True
            for end in self.chains.popleft()[1]:
                if starts and starts[-1] < end:
                    starts[-1] = end  # the run before it ends here now
                else:
                    starts.append(end)
        if met:
            self.chains.append((now, starts))

    def steps(self) -> list[tuple[int, int]]:
        """(last start of a run, last miss of its chains) by start."""
        return sorted((end, miss) for miss, ends in self.chains for end in ends)


def cache_replay(df: DataFrame, key: str, ts: str, tie: str, ttl: str = "300 seconds") -> DataFrame:
    """Replay a TTL cache per key: hit when the entry stored by the last miss
    is at most ``ttl`` old (hits don't refresh it); ttl = 0 never expires (only the first
    is a miss).

    A miss is followed by the first event more than ``ttl`` after it, so a time bucket's
    last miss is a step function of the last miss before it. Three sorted streams: each
    (key, bucket) computes its function, a fold over a key's buckets reads only
    the steps and gives every bucket its entry, and a pass over the rows marks the hits.
    A task holds the distinct times of one key's single lifetime in the first of them
    and one time in the others, however many rows a key has."""
    ttl_s = _seconds(ttl)
    if ttl_s <= 0:
        first = df.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("_first"))
        return df.join(first, key).withColumn("cache_hit", F.struct(ts, tie) != F.col("_first")).drop("_first")
    age = int(ttl_s * 1_000_000)
    width = age * BUCKET_LIFETIMES
    held = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    held = held.withColumn("_bkt", F.floor(F.col("_us") / width))
    kind = df.schema[key].dataType.simpleString()
    parts = shuffle_partitions(df)

    def exits(batches):
        cur, bucket = None, None
        for pdf in batches:
            out = []
            for k, b, now in zip(pdf[key].tolist(), pdf["_bkt"].tolist(), pdf["_us"].tolist(), strict=True):
                if (k, b) != cur:
                    if bucket is not None:
                        out += [(*cur, *step) for step in bucket.steps()]
                    cur, bucket = (k, b), _Exits(b * width, age)
                bucket.event(now)
            yield pd.DataFrame(out, columns=[key, "_bkt", "at", "last"])
        if bucket is not None:
            yield pd.DataFrame([(*cur, *step) for step in bucket.steps()], columns=[key, "_bkt", "at", "last"])

    def entries(batches):
        """The last miss before each bucket of a key; rows stand in order."""
        cur = bucket = state = None
        done = False
        for pdf in batches:
            out = []
            for k, b, at, last in zip(pdf[key].tolist(), pdf["_bkt"].tolist(), pdf["at"].tolist(), pdf["last"].tolist(), strict=True):
                if k != cur:
                    cur, bucket, state = k, None, None
                if b != bucket:
                    bucket, done = b, False
                    out.append((k, b, state))
                if not done and (state is None or at > state + age):
                    state, done = last, True
            yield pd.DataFrame({key: [x[0] for x in out], "_b": [x[1] for x in out], "_entry": pd.array([x[2] for x in out], dtype="Int64")})

    def marks(batches):
        cur = miss = None
        for batch in batches:
            hits = []
            for k, b, now, entry in zip(*(batch.column(c).to_pylist() for c in (key, "_bkt", "_us", "_entry")), strict=True):
                if (k, b) != cur:
                    cur, miss = (k, b), entry
                hits.append(miss is not None and now - miss <= age)
                if not hits[-1]:
                    miss = now
            yield batch.drop_columns(["_us", "_bkt", "_entry"]).append_column("cache_hit", pa.array(hits, pa.bool_()))

    steps = held.select(key, "_us", "_bkt").repartition(parts, key, "_bkt").sortWithinPartitions(key, "_bkt", "_us")
    steps = steps.mapInPandas(exits, f"`{key}` {kind}, _bkt bigint, at bigint, last bigint")
    steps = steps.repartition(parts, key).sortWithinPartitions(key, "_bkt", "at")
    state = steps.mapInPandas(entries, f"`{key}` {kind}, _b bigint, _entry bigint").withColumnRenamed(key, "_k")
    rows = held.join(state, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bkt") == F.col("_b"))).select(*df.columns, "_us", "_bkt", "_entry")
    rows = rows.repartition(parts, key, "_bkt").sortWithinPartitions(key, "_bkt", "_us", tie)
    return rows.mapInArrow(marks, T.StructType([*df.schema.fields, T.StructField("cache_hit", T.BooleanType())]))
