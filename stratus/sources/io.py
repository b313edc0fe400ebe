"""Sources and sinks: CSV telemetry, trial documents, deny lists, ledgers, writers.

All readers are plain ``spark.read`` calls with explicit schemas (no
inference pass over the data); all writers are ``DataFrame.write`` with
partitioning chosen for the later filters.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Telemetry CSV schema (column order of the data file).
TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("cpu_usage", T.DoubleType()),
    T.StructField("memory_usage", T.DoubleType()),
    T.StructField("net_io", T.DoubleType()),
    T.StructField("disk_io", T.DoubleType()),
    T.StructField("cloud_provider", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("vm_type", T.StringType()),
    T.StructField("vCPU", T.LongType()),
    T.StructField("RAM_GB", T.DoubleType()),
    T.StructField("price_per_hour", T.DoubleType()),
    T.StructField("target", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("throughput", T.DoubleType()),
    T.StructField("utilization", T.DoubleType()),
    T.StructField("cost", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA, strict: bool = True) -> DataFrame:
    """Header CSV with a fixed schema; FAILFAST rejects malformed rows when strict.
    Column names are trimmed (the header may carry spaces)."""
    df = (spark.read.schema(schema).option("header", True)
          .option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path))
    return df.toDF(*[c.strip() for c in df.columns])


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file -> typed columns plus raw ``params`` text.

    ``wholetext=True`` reads each file as one row; the raw params object is
    kept as text (and parsed as Variant for the fingerprint) because
    ``max_features`` is a string in some files and a number in others.
    ``source_file`` keeps the file name: repeated trial ids resolve to the
    first file in name order.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("doc"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file")
    )
    v = F.parse_json(F.col("doc"))
    mf = F.variant_get(v, "$.params.max_features", "string")
    return raw.select(
        "source_file",
        F.variant_get(v, "$.trial_id", "string").alias("trial_id"),
        F.variant_get(v, "$.params.n_estimators", "bigint").alias("n_estimators"),
        F.variant_get(v, "$.params.max_depth", "bigint").alias("max_depth"),
        F.variant_get(v, "$.params.min_samples_leaf", "bigint").alias("min_samples_leaf"),
        mf.alias("max_features"),
        F.variant_get(v, "$.params.random_state", "bigint").alias("random_state"),
        F.variant_get(v, "$.metrics.RMSE", "double").alias("RMSE"),
        F.variant_get(v, "$.metrics.MAE", "double").alias("MAE"),
        F.variant_get(v, "$.metrics.R2", "double").alias("R2"),
        F.variant_get(v, "$.pred_var", "double").alias("pred_var"),
        F.to_json(F.variant_get(v, "$.params", "variant")).alias("params_json"),
    )


def first_per_trial_id(trials: DataFrame) -> DataFrame:
    """Keep the first file (by name) of each trial id."""
    return trials.groupBy("trial_id").agg(F.min_by(F.struct(*trials.columns), F.col("source_file")).alias("t")).select("t.*")


def read_deny_list(spark: SparkSession, path: str) -> DataFrame:
    """Line list: trimmed, lower-cased, blank and ``#`` lines skipped."""
    t = spark.read.text(path).select(F.lower(F.trim(F.col("value"))).alias("fingerprint"))
    return t.where((F.col("fingerprint") != "") & ~F.col("fingerprint").startswith("#"))


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """Election constraints from a parameter file of ``key: value`` lines (``#`` comments);
    keys that are no constraint are skipped, absent ones keep their default.  One row."""
    from dataclasses import fields

    from ..operators.election import Constraints

    lines = spark.read.text(path).where(F.col("value").contains(":")).collect()  # a parameter file
    found = {k.strip(): v.split("#")[0].strip() for k, _, v in (r["value"].partition(":") for r in lines) if not k.strip().startswith("#")}
    kinds = {"int": int, "float": float, "str": str, "bool": lambda v: {"true": True, "false": False}[v.lower()]}
    return Constraints(**{f.name: kinds[f.type](found[f.name]) for f in fields(Constraints) if f.name in found}).frame(spark)


def parse_release_ledger(lines: DataFrame) -> DataFrame:
    """``<unix_ms> <version> <class> <ring> <token> <nonce> <mac>`` per line."""
    p = F.split(F.col("value"), " ")
    return lines.where(F.trim("value") != "").select(
        F.timestamp_millis(p.getItem(0).cast("bigint")).alias("released_at"),
        p.getItem(1).alias("version"), p.getItem(2).alias("promotion_class"), p.getItem(3).alias("digest_ring"),
        p.getItem(4).alias("lineage_token"), p.getItem(5).alias("publish_nonce"), p.getItem(6).alias("binding_mac"),
    )


def format_release_ledger(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(
        " ", F.unix_millis(F.col("released_at")).cast("string"), "version", "promotion_class", "digest_ring",
        "lineage_token", "publish_nonce", "binding_mac").alias("value"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Blob files with SHA-256 and size (``binaryFile`` source)."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


# ------------------------------------------------------------------ sinks

def write_split(df: DataFrame, path: str) -> None:
    """Train/test rows in one table partitioned by ``split`` (readers prune by it)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_runs(metrics_long: DataFrame, path: str, run_id: str) -> None:
    """Append ``(run_id, metric, value)`` rows to the runs table."""
    metrics_long.select(F.lit(run_id).alias("run_id"), "*").write.mode("append").parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    """Audit events appended, partitioned by event date (time lookups prune)."""
    events.write.mode("append").partitionBy("event_date").parquet(path)


def overwrite_catalog(packages: DataFrame, blobs: DataFrame, root: str) -> None:
    packages.write.mode("overwrite").parquet(f"{root}/packages")
    blobs.write.mode("overwrite").parquet(f"{root}/blobs")


def append_release(rows: DataFrame, path: str) -> None:
    """Appends ledger lines, a file per partition; readers order by the time in a line."""
    format_release_ledger(rows).write.mode("append").text(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query inside go when the query ends, not when the driver's
    memory is next tidied: a job of many rounds else fills the disks with the files of all."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` under the session's shared checkpoint folder and read it
    back (survives executor loss).  Each call has a folder of its own, so a frame built
    earlier stays readable and jobs don't meet."""
    from ..session import checkpoint_dir

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
