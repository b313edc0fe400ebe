"""Feature drift: training ranges (exact quantiles), out-of-band checks, PSI.

Exact quantiles are computed in two passes: approximate quantiles bracket each
position, and only values inside the brackets are grouped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Accuracy of the bracketing quantiles: rank error at most one in so many rows.
ACCURACY = 10_000

# Monitored numeric fields, in check order.
NUMERIC_FIELDS = ["cpu_usage", "memory_usage", "net_io", "disk_io", "RAM_GB", "vCPU", "latency_ms", "throughput", "utilization"]
# Default (low, high) range per field.
DEFAULT_RANGES = {
    "cpu_usage": (0.0, 100.0),
    "memory_usage": (0.0, 100.0),
    "net_io": (0.0, 5000.0),
    "disk_io": (0.0, 5000.0),
    "RAM_GB": (0.25, 256.0),
    "vCPU": (1.0, 128.0),
    "latency_ms": (0.0, 10000.0),
    "throughput": (0.0, 100000.0),
    "utilization": (0.0, 100.0),
}


def lenient_double(df: DataFrame, field: str) -> Column:
    """The field as double; text that is no number, and NaN, become null."""
    c = F.col(field)
    v = c.cast("double") if isinstance(df.schema[field].dataType, NumericType) else c.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def exact_quantiles(df: DataFrame, fields: list[str], probs: list[float]) -> DataFrame:
    """``(field, prob, q)`` with linear interpolation at position (n-1)*prob; fields
    without values have no rows.

    Two passes, neither of which moves the table's values.  The first brackets each
    requested position by approximate quantiles a little before and after it.  The second
    counts the values below each bracket and groups the few inside; the exact order
    statistics are among those.  A bracket that misses its position (the approximation has
    a stated error, so it should not) is widened and the second pass repeated.
    """
    have = [f for f in dict.fromkeys(fields) if f in df.columns]
    schema = "field string, prob double, q double"
    if not have or not probs:
        return df.sparkSession.createDataFrame([], schema)
    vals = df.select(*[lenient_double(df, f).alias(f"v{i}") for i, f in enumerate(have)])
    width, todo, out = 4.0 / ACCURACY, [(i, p) for i in range(len(have)) for p in probs], []
    while todo:
        marks = {}
        aggs = [F.count(f"v{i}").alias(f"n{i}") for i in range(len(have))]
        for k, (i, p) in enumerate(todo):
            aggs.append(F.percentile_approx(f"v{i}", [max(0.0, p - width), min(1.0, p + width)], ACCURACY).alias(f"b{k}"))
        first = vals.agg(*aggs).first()
        todo = [(k, i, p) for k, (i, p) in enumerate(todo) if first[f"n{i}"]]
        if not todo:
            break
        inside, below = [], []
        for k, i, p in todo:
            lo = first[f"b{k}"][0] if p > width else float("-inf")
            hi = first[f"b{k}"][1] if p < 1 - width else float("inf")
            marks[k] = (first[f"n{i}"] - 1) * p
            v = F.col(f"v{i}")
            below.append(F.count_if(v < F.lit(lo)).alias(f"c{k}"))
            inside.append(F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.struct(F.lit(k).alias("k"), v.alias("v"))))
        before = vals.agg(*below).first()
        few = vals.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c"))
        w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        at = F.element_at(F.create_map(*[x for k in marks for x in (F.lit(k), F.lit(before[f"c{k}"]))]), F.col("k"))
        pos = F.element_at(F.create_map(*[x for k, m in marks.items() for x in (F.lit(k), F.lit(m))]), F.col("k"))
        t = few.withColumn("end", F.sum("c").over(w) + at).withColumn("pos", pos)
        holds = lambda place: (F.col("end") - F.col("c") <= place) & (place < F.col("end"))
        got = t.groupBy("k").agg(F.max(F.when(holds(F.floor("pos")), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil("pos")), F.col("v"))).alias("hi"))
        found = {r["k"]: (r["lo"], r["hi"]) for r in got.collect()}  # fields x probs rows
        again = []
        for k, i, p in todo:
            lo, hi = found.get(k, (None, None))
            if lo is None or hi is None:
                again.append((i, p))
            else:
                out.append((have[i], float(p), lo + (hi - lo) * (marks[k] - math.floor(marks[k]))))
        todo, width = again, width * 10
    return df.sparkSession.createDataFrame(out, schema)


def training_ranges(df: DataFrame, fields: list[str] = NUMERIC_FIELDS, defaults: dict = DEFAULT_RANGES) -> DataFrame:
    """``(field, low, high, source)``: 1 % / 99 % quantiles where data exist and
    high > low, else the default range."""
    q = exact_quantiles(df, fields, [0.01, 0.99])
    qq = q.groupBy("field").agg(
        F.max(F.when(F.col("prob") == 0.01, F.col("q"))).alias("ql"), F.max(F.when(F.col("prob") == 0.99, F.col("q"))).alias("qh")
    )
    d = df.sparkSession.createDataFrame([(f, float(lo), float(hi)) for f, (lo, hi) in defaults.items() if f in fields],
                                        "field string, d_low double, d_high double")
    use = F.col("qh") > F.col("ql")
    return d.join(qq, "field", "left").select(
        "field",
        F.when(use, F.col("ql")).otherwise(F.col("d_low")).alias("low"),
        F.when(use, F.col("qh")).otherwise(F.col("d_high")).alias("high"),
        F.when(use, F.lit("data")).otherwise(F.lit("default")).alias("source"),
    )


def ranges_dict(ranges: DataFrame) -> dict[str, tuple[float, float]]:
    """Collect a ranges table: one row per monitored field (bounded by the field list)."""
    return {r["field"]: (r["low"], r["high"]) for r in ranges.collect()}


def oob_fields(df: DataFrame, ranges: dict[str, tuple[float, float]], fields: list[str] = NUMERIC_FIELDS) -> Column:
    """Array of fields whose value is outside [low, high]; NaN is never an offender."""
    names = []
    for f in fields:
        if f not in df.columns or f not in ranges:
            continue
        lo, hi = ranges[f]
        v = lenient_double(df, f)
        names.append(F.when((v < lo) | (v > hi), F.lit(f)))
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def psi(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10, edge_digits: int | None = None) -> DataFrame:
    """Population stability index over quantile bins of the expected sample.

    Edges = distinct quantiles (0, 1/bins, ..., 1) of expected (``edge_digits``: rounded); bins are [e_i, e_i+1) with the last one closed; values
    outside the edges are dropped (and reported as ``out_of_range_fraction``);
    percentages are clipped at 1e-4.  0.0 when either sample has < bins rows
    or fewer than 3 edges remain.
    """
    e = expected.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    a = actual.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    probs = [i / bins for i in range(bins + 1)]
    qs = [r["q"] for r in exact_quantiles(e, ["v"], probs).collect()]  # at most bins + 1 numbers
    edges = sorted(set(qs) if edge_digits is None else {round(q, edge_digits) for q in qs})
    ne, na = e.count(), a.count()
    spark = expected.sparkSession
    if ne < bins or na < bins or len(edges) < 3:
        return spark.createDataFrame([(0.0, None, ne, na, len(edges))],
                                     "psi double, out_of_range_fraction double, n_expected bigint, n_actual bigint, n_edges int")
    arr = F.array(*[F.lit(x) for x in edges])
    k = len(edges) - 1

    def binned(df: DataFrame, side: str) -> DataFrame:
        b = F.when((F.col("v") < edges[0]) | (F.col("v") > edges[-1]), F.lit(None)).otherwise(
            F.least(F.size(F.filter(arr, lambda x: x <= F.col("v"))) - 1, F.lit(k - 1))
        )
        return df.select(b.alias("b")).groupBy("b").agg(F.count("*").alias(side))

    h = binned(e, "ce").join(binned(a, "ca"), "b", "full").fillna(0, ["ce", "ca"])
    te = F.sum(F.when(F.col("b").isNotNull(), F.col("ce")).otherwise(0)).over(Window.partitionBy())
    ta = F.sum(F.when(F.col("b").isNotNull(), F.col("ca")).otherwise(0)).over(Window.partitionBy())
    h = h.select("b", "ce", "ca", te.alias("te"), ta.alias("ta"))  # at most bins + 1 rows
    pe = F.greatest(F.col("ce") / F.greatest(F.col("te"), F.lit(1)), F.lit(1e-4))
    pa = F.greatest(F.col("ca") / F.greatest(F.col("ta"), F.lit(1)), F.lit(1e-4))
    inb = F.col("b").isNotNull()
    return h.agg(
        F.sum(F.when(inb, (pa - pe) * F.ln(pa / pe))).alias("psi"),
        (F.sum(F.when(~inb, F.col("ca")).otherwise(0)) / F.lit(na)).alias("out_of_range_fraction"),
    ).select("psi", "out_of_range_fraction", F.lit(ne).cast("bigint").alias("n_expected"), F.lit(na).cast("bigint").alias("n_actual"), F.lit(len(edges)).alias("n_edges"))
