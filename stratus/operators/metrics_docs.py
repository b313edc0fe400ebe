"""Metric documents: model card (union by name) and numeric flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate


def model_card(df: DataFrame, version: str) -> DataFrame:
    """Cost and latency metrics as rows of one table (missing columns null)."""
    cost = evaluate.regression_metrics(df, "cost", "pred").select(
        F.lit("cost").alias("model"), F.lit(version).alias("model_version"), "*"
    )
    lat = evaluate.regression_metrics(df.where(F.col("latency_ms").isNotNull()), "latency_ms", "latency_pred").select(
        F.lit("latency").alias("model"), F.lit(version).alias("model_version"), "*",
        F.lit("latency_ms").alias("label_column"),
    )
    return cost.unionByName(lat, allowMissingColumns=True)


def metrics_long(split_df: DataFrame) -> DataFrame:
    """Numeric metrics of the train/test document as ``(metric, value)`` rows,
    prefixed ``rf_`` (cost) and ``latency_`` (latency model)."""
    gaps = evaluate.metric_gaps(split_df, "cost", "pred")
    lat = evaluate.regression_metrics(
        split_df.where(F.col("split") == "test").withColumn("latency_pred", F.col("latency_ms") * 0.95 + 1),
        "latency_ms", "latency_pred",
    )
    def unpivot(df: DataFrame, prefix: str) -> DataFrame:
        cols = [c for c, t in df.dtypes if t in ("double", "bigint", "int")]
        return df.select(
            F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv")
        ).select("kv.metric", "kv.value")

    return unpivot(gaps, "rf_").unionByName(unpivot(lat, "latency_"))
