"""Shared building blocks for distributed ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def order_number(df: DataFrame, column: str) -> Column:
    """A double that never decreases in the column's order: the value of a number, the
    microseconds of a time, the first six bytes of a text."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def range_buckets(df: DataFrame, major: Column, n_buckets: int | None = None, accuracy: int = 10000) -> Column:
    """A bucket id that is monotone in ``major`` (numeric), from approximate quantiles.

    One small job computes at most ``n_buckets`` cut points (a bounded list on
    the driver); the id is then a pure expression of the row, so recomputing a
    lost partition gives the same buckets.  Nulls are in the first bucket.
    """
    n = n_buckets or max(2, shuffle_partitions(df))
    probs = [i / n for i in range(1, n)]
    row = df.select(F.percentile_approx(major.cast("double"), probs, accuracy).alias("q")).first()
    cuts = sorted({float(x) for x in (row["q"] or []) if x is not None})
    if not cuts:
        return F.lit(0)
    # bucket = number of cut points <= value; the list is at most n_buckets long
    arr = F.array(*[F.lit(c) for c in cuts])
    return F.coalesce(F.size(F.filter(arr, lambda c: c <= major.cast("double"))), F.lit(0))


def running_total(df: DataFrame, order_cols: list[str], value: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """``sum(value) over (partition by group order by order_cols rows unbounded
    preceding)`` without a window over a whole group.

    Rows are cut into range buckets on the first order column; each bucket gets a
    local running sum plus the total of all earlier buckets of its group (at most
    one row per group and bucket).
    """
    group = group or []
    tagged = df.withColumn("_bkt", range_buckets(df, order_number(df, order_cols[0]))).withColumn("_v", value)
    totals = tagged.groupBy(*group, "_bkt").agg(F.sum("_v").alias("_bt"))
    earlier = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_bkt").alias("_o_bkt"), F.coalesce(F.sum("_bt").over(earlier), F.lit(0)).alias("_off"))
    on = F.col("_bkt") == F.col("_o_bkt")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    w = Window.partitionBy(*group, "_bkt").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return tagged.join(offs, on).withColumn(out, F.sum("_v").over(w) + F.col("_off")).drop("_bkt", "_v", "_off", "_o_bkt", *[f"_o_{g}" for g in group])


# Accuracy of the quantiles that bracket a position, and rows that are sorted in the end.
ACCURACY, LAST_ROWS = 10_000, 10_000


def nth_row(df: DataFrame, order_cols: list[str], n: int):
    """The ``n``-th row (from 1) in the order of ``order_cols``, nulls first.

    Approximate quantiles bracket the row's place in the first column; rows before the
    bracket are counted and rows outside it left out, which keeps about one row in 5,000.
    That is repeated until few rows are left to sort, going on to the next column when the
    rows agree in this one.
    """
    rows, left, size = df.select(*order_cols), n, None
    for c in order_cols:
        number = order_number(rows, c)
        while size is None or size > LAST_ROWS:
            seen = rows.agg(F.count("*").alias("n"), F.count(c).alias("known"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
            size, nulls = seen["n"], seen["n"] - seen["known"]
            if size <= LAST_ROWS or seen["lo"] == seen["hi"] and nulls in (0, size):
                break
            if left <= nulls:
                rows, size = rows.where(F.col(c).isNull()), nulls
                break
            rows, left, known = rows.where(F.col(c).isNotNull()), left - nulls, seen["known"]
            place, width = (left - 0.5) / known, 1.0 / ACCURACY
            while True:
                lo, hi = rows.agg(F.percentile_approx(number, [max(0.0, place - width), min(1.0, place + width)], ACCURACY).alias("q")).first()["q"]
                counts = rows.agg(F.count_if(number < lo).alias("before"), F.count_if((number >= lo) & (number <= hi)).alias("inside")).first()
                if counts["before"] < left <= counts["before"] + counts["inside"] or width >= 1:
                    break
                width *= 10
            rows, left = rows.where((number >= lo) & (number <= hi)), left - counts["before"]
            if counts["inside"] == known:
                break  # texts that share their first bytes, or one value
            size = counts["inside"]
    w = Window.orderBy(*order_cols)  # of the few rows left
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == left).drop("_rn").first()
