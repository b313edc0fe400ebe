"""Feature engineering (calendar, ratios) and label-dictionary encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut_lineage
from .common import running_total

# Categorical columns that get a `<col>_encoded` twin, in order.
CATEGORICAL_COLUMNS = ["cloud_provider", "region", "vm_type", "target"]
# Columns excluded from the cost feature matrix (label leakage).
EXCLUDED_COLUMNS = ["cost", "price_per_hour", "cost_to_price_ratio"]
# Extra columns removed for the latency model.
LATENCY_EXCLUDED = ["latency_ms", "latency_throughput_ratio"]
TIMESTAMP_FORMAT = "M/d/yyyy H:mm"


def parse_timestamp(text: Column, tolerant: bool = False) -> Column:
    """Telemetry timestamp text (``1/1/2024 0:00``) -> timestamp without zone."""
    if tolerant:
        return F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)).cast("timestamp_ntz")
    return F.to_timestamp_ntz(text, F.lit(TIMESTAMP_FORMAT))


def temporal_features(df: DataFrame, ts: Column) -> DataFrame:
    """hour, day, month, day_of_week (Monday = 0) and is_weekend."""
    dow = F.weekday(ts)
    return df.select(
        "*",
        F.hour(ts).alias("hour"),
        F.dayofmonth(ts).alias("day"),
        F.month(ts).alias("month"),
        dow.alias("day_of_week"),
        dow.isin(5, 6).cast("int").alias("is_weekend"),
    )


def ratio_features(df: DataFrame, include_latency_ratio: bool = True) -> DataFrame:
    """Ratio and interaction features; a zero denominator gives null."""
    c = F.col
    cols = [
        F.try_divide(c("cpu_usage"), c("memory_usage") + 1).alias("cpu_memory_ratio"),
        (c("net_io") + c("disk_io")).alias("total_io"),
        F.try_divide(c("net_io"), c("disk_io") + 1).alias("io_ratio"),
        F.try_divide(c("throughput"), c("cpu_usage") + c("memory_usage") + 1).alias("resource_efficiency"),
    ]
    if include_latency_ratio:
        cols.append(F.try_divide(c("latency_ms"), c("throughput") + 1).alias("latency_throughput_ratio"))
    cols += [
        (c("cpu_usage") * c("memory_usage") * c("utilization")).alias("resource_intensity"),
        F.try_divide(c("RAM_GB"), c("vCPU")).alias("ram_per_vcpu"),
    ]
    return df.select("*", *cols)


def fit_encoders(df: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Label dictionary ``(column, value, code)``: sorted distinct values -> 0..k-1.

    The distinct is a partial+final hash aggregate, written once (a fitted dictionary is
    an artefact of its own); codes are running counts over range buckets of the values, so
    a column with a very large vocabulary is ranked by many tasks.
    """
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(col).alias("column"), F.col(col).cast("string").alias("value")) for col in columns])).alias("kv")
    ).select("kv.column", "kv.value")
    dic = cut_lineage(pairs.where(F.col("value").isNotNull()).distinct(), "encoder-values")
    ranked = running_total(dic, ["value"], F.lit(1), "code", group=["column"])
    return cut_lineage(ranked.withColumn("code", (F.col("code") - 1).cast("int")), "encoder-dictionary")


def apply_encoders(df: DataFrame, dictionary: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Add ``<col>_encoded``; unknown values and columns without an encoder get 0.

    A left join per column against its part of the dictionary, which Spark broadcasts if
    its size allows and otherwise shuffles.
    """
    out = df
    for col in columns:
        d = dictionary.where(F.col("column") == col).select(
            F.col("value").alias(f"_v_{col}"), F.col("code").alias(f"_c_{col}")
        )
        out = out.join(d, F.col(col).cast("string") == F.col(f"_v_{col}"), "left")
    codes = [F.coalesce(F.col(f"_c_{col}"), F.lit(0)).alias(f"{col}_encoded") for col in columns]
    return out.select(*[F.col(c) for c in df.columns if c not in {f"{col}_encoded" for col in columns}], *codes)


def encoder_unknowns(df: DataFrame, dictionary: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Per column: rows and distinct values that the dictionary does not know."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(col).alias("column"), F.col(col).cast("string").alias("value")) for col in columns])).alias("kv")
    ).select("kv.column", "kv.value")
    unk = pairs.join(dictionary.select("column", "value"), ["column", "value"], "left_anti")
    return unk.groupBy("column").agg(
        F.count("*").alias("unknown_rows"), F.countDistinct("value").alias("unknown_values")
    )


def feature_order(columns: list[str], for_latency: bool = False) -> list[str]:
    """Columns of the feature matrix, in table order (leakage columns removed)."""
    out = [
        c for c in columns
        if c not in EXCLUDED_COLUMNS and (c.endswith("_encoded") or c not in CATEGORICAL_COLUMNS)
    ]
    if for_latency:
        out = [c for c in out if c not in LATENCY_EXCLUDED]
    return out
