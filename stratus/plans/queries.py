"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Parameters follow FIXTURES.md (adapter views); function defaults keep the
reference values.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, features, split
from ..sources import adapters
from ..sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded for comparison; operators return full doubles."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(Tables(spark, sf_dir))


def _split_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = _telemetry(spark, sf_dir)
    return split.temporal_split(tel, "ts", adapters.ROW_KEY)


# --------------------------------------------------------------------------
# flagship: validate -> features -> encode -> temporal split -> metrics
# --------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: metrics of the stand-in prediction and of the train-mean baseline."""
    from ..operators import contracts

    tel = _telemetry(spark, sf_dir)
    contracts.assert_required_columns(tel)
    df = split.temporal_split(tel, "ts", adapters.ROW_KEY)
    df = features.temporal_features(df, features.parse_timestamp(F.col("timestamp")))
    dic = features.fit_encoders(df)
    df = features.ratio_features(features.apply_encoders(df, dic))
    mu = F.lit(evaluate.train_mean(df, "cost")).cast("double")
    out = df.groupBy("split").agg(
        *evaluate.metric_exprs(F.col("cost"), F.col("pred")),
        F.avg(F.abs(F.col("cost") - mu)).alias("baseline_MAE"),
    )
    return rounded(out.withColumn("lift_MAE", F.col("baseline_MAE") - F.col("MAE")))


query("flagship_metrics")(flagship)


# --------------------------------------------------------------------------
# FEA / ENC
# --------------------------------------------------------------------------


@query("temporal_features")
def q_temporal_features(spark, sf_dir):
    tel = _telemetry(spark, sf_dir).select("row_id", "timestamp")
    df = features.temporal_features(tel, features.parse_timestamp(F.col("timestamp")))
    return df.drop("timestamp")


@query("ratio_features")
def q_ratio_features(spark, sf_dir):
    tel = _telemetry(spark, sf_dir)
    df = features.ratio_features(tel)
    return df.select(
        "row_id", "cpu_memory_ratio", "total_io", "io_ratio", "resource_efficiency",
        "latency_throughput_ratio", "resource_intensity", "ram_per_vcpu",
    )


@query("encoder_fit")
def q_encoder_fit(spark, sf_dir):
    return features.fit_encoders(_telemetry(spark, sf_dir))


@query("encoder_apply")
def q_encoder_apply(spark, sf_dir):
    tel = _telemetry(spark, sf_dir)
    dic = features.fit_encoders(tel)
    out = features.apply_encoders(tel.select("row_id", *features.CATEGORICAL_COLUMNS), dic)
    return out.select("row_id", *[f"{c}_encoded" for c in features.CATEGORICAL_COLUMNS])


@query("encoder_unknowns")
def q_encoder_unknowns(spark, sf_dir):
    tel = _telemetry(spark, sf_dir)
    fit_rows = tel.where((F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("vm_type") != "PROMO"))
    dic = features.fit_encoders(fit_rows)
    return features.encoder_unknowns(tel, dic)


@query("feature_matrix")
def q_feature_matrix(spark, sf_dir):
    """Cost feature matrix (leakage columns dropped) plus the label."""
    tel = _telemetry(spark, sf_dir)
    df = features.temporal_features(tel, features.parse_timestamp(F.col("timestamp")))
    df = features.ratio_features(features.apply_encoders(df, features.fit_encoders(df)))
    base = [c for c in df.columns if c not in ("row_id", "ts", "timestamp", "pred", "n_nationkey", *adapters.ROW_KEY)]
    order = features.feature_order(base)
    return df.select("row_id", *order, "cost")


# --------------------------------------------------------------------------
# SPL / EVA / MOD7
# --------------------------------------------------------------------------


@query("temporal_split")
def q_temporal_split(spark, sf_dir):
    return _split_telemetry(spark, sf_dir).select("row_id", "split")


@query("hash_split")
def q_hash_split(spark, sf_dir):
    return split.hash_split(_telemetry(spark, sf_dir), F.col("row_id")).select("row_id", "split")


@query("split_metadata")
def q_split_metadata(spark, sf_dir):
    tel = _telemetry(spark, sf_dir)
    t = split.split_metadata(split.temporal_split(tel, "ts", adapters.ROW_KEY), "temporal")
    h = split.split_metadata(split.hash_split(tel, F.col("row_id")), "random")
    return t.unionByName(h)


@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    """Metrics per provider/region with rollup subtotals (GROUPING SETS)."""
    tel = _telemetry(spark, sf_dir)
    return rounded(tel.rollup("cloud_provider", "region").agg(*evaluate.metric_exprs(F.col("cost"), F.col("pred"))))


@query("metric_gaps")
def q_metric_gaps(spark, sf_dir):
    return rounded(evaluate.metric_gaps(_split_telemetry(spark, sf_dir), "cost", "pred"))


@query("mean_baseline")
def q_mean_baseline(spark, sf_dir):
    return rounded(evaluate.mean_baseline(_split_telemetry(spark, sf_dir), "cost"))


@query("baseline_lift")
def q_baseline_lift(spark, sf_dir):
    return rounded(evaluate.baseline_lift(_split_telemetry(spark, sf_dir), "cost", "pred"))


@query("model_card")
def q_model_card(spark, sf_dir):
    """Cost and latency model metrics in one long table (union by name)."""
    from ..operators import metrics_docs

    tel = _telemetry(spark, sf_dir)
    tel = tel.withColumn("latency_pred", F.col("latency_ms") * 0.95 + 1)
    return rounded(metrics_docs.model_card(tel, "1.0.0"))


@query("metrics_long")
def q_metrics_long(spark, sf_dir):
    from ..operators import metrics_docs

    return rounded(metrics_docs.metrics_long(_split_telemetry(spark, sf_dir)))


def all_queries() -> dict[str, Query]:
    # import the query modules so their @query registrations run
    from . import queries_more  # noqa: F401

    return dict(REGISTRY)
