"""Data contracts: column checks, payload validation, document checks, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Telemetry schema column names, in schema order.
TELEMETRY_SCHEMA = [
    "timestamp", "cpu_usage", "memory_usage", "net_io", "disk_io", "cloud_provider", "region",
    "vm_type", "vCPU", "RAM_GB", "price_per_hour", "target", "latency_ms", "throughput",
    "utilization", "cost",
]
# Payload fields in message order, and their kinds. A field marked
# "filled" may be absent where the latency model fills it.
PAYLOAD_FIELDS = {
    "cpu_usage": "number",
    "memory_usage": "number",
    "net_io": "number",
    "disk_io": "number",
    "cloud_provider": "text",
    "region": "text",
    "vm_type": "text",
    "vCPU": "whole",
    "RAM_GB": "number",
    "target": "text",
    "latency_ms": "filled",
    "throughput": "number",
    "utilization": "number",
}
TEMPORAL_FIELDS = ["hour", "day", "month", "day_of_week", "is_weekend"]
NUMERIC_FIELDS = [*[f for f, kind in PAYLOAD_FIELDS.items() if kind != "text"], *TEMPORAL_FIELDS]
# Keys every metrics document must have.
REQUIRED_METRICS = ["MAE", "MSE", "RMSE", "R2"]
# Manifest keys and core blob names.
MANIFEST_KEYS = ["model_version", "blobs", "digest_ring", "binding_mac", "promotion_class"]
CORE_BLOBS = ["model.pkl", "metrics.json", "label_encoders.pkl", "feature_columns.json"]
# Error messages.
MSG_BODY = "Request body must be a JSON object"
MSG_MISSING = "Missing required fields: "
MSG_TEMPORAL = "Provide 'timestamp' or temporal fields hour/day/month/day_of_week/is_weekend"


def assert_required_columns(df: DataFrame, required: list[str] = TELEMETRY_SCHEMA) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def required_columns(df: DataFrame, required: list[str] = TELEMETRY_SCHEMA) -> DataFrame:
    """``(status, missing, n_missing)`` from the column names; no row is read."""
    missing = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([(not missing, ",".join(missing), len(missing))], "status boolean, missing string, n_missing int")


def parse_payload(df: DataFrame, payload: str, out: str = "_m") -> DataFrame:
    """Parse the JSON payload once into a ``map<string,string>`` column; the
    validators below take that column, so the text is parsed once per row."""
    return df.withColumn(out, F.from_json(F.col(payload), "map<string,string>"))


def payload_errors(m: Column, require_latency: bool = True) -> Column:
    """Error text for a parsed payload map (key presence, fixed order) or null. A body
    that is null, no JSON, or no object has a null map."""
    lacks = [F.when(~F.map_contains_key(m, f), F.lit(f)) for f, kind in PAYLOAD_FIELDS.items() if require_latency or kind != "filled"]
    names = F.array_join(F.array_compact(F.array(*lacks)), ", ")
    calendar = F.forall(F.array(*[F.lit(f) for f in TEMPORAL_FIELDS]), lambda f: F.map_contains_key(m, f))
    return (
        F.when(m.isNull(), F.lit(MSG_BODY))
        .when(names != "", F.concat(F.lit(MSG_MISSING), names))
        .when(~(F.map_contains_key(m, "timestamp") | calendar), F.lit(MSG_TEMPORAL))
    )


def _whole(c: Column) -> Column:
    return c.try_cast("double").try_cast("bigint")  # a number's fraction is cut off


def _numeric(own: Column, text, value) -> list[Column]:
    """``numeric_fields`` from each field's text and value, given by name, and whether the
    calendar fields count."""
    cols, bad = [], []
    for f in NUMERIC_FIELDS:
        calendar = f in TEMPORAL_FIELDS
        t, v = text(f), value(f)
        cols.append((F.when(own, v) if calendar else v).alias(f))
        wrong = t.isNotNull() & v.isNull()
        bad.append(F.when(own & wrong if calendar else wrong, F.lit(f)))
    names = F.array_join(F.array_compact(F.array(*bad)), ", ")
    return [*cols, F.concat(F.lit("could not convert: "), F.nullif(names, F.lit(""))).alias("cast_error")]


def _own_calendar(m: Column) -> Column:
    return m.isNotNull() & ~F.map_contains_key(m, "timestamp")


def _text(m: Column, f: str) -> Column:
    return F.nullif(F.trim(m[f]), F.lit("")) if PAYLOAD_FIELDS.get(f) == "filled" else m[f]


def _value(text: Column, f: str) -> Column:
    return _whole(text) if PAYLOAD_FIELDS.get(f, "whole") == "whole" else text.try_cast("double")


def numeric_fields(m: Column) -> list[Column]:
    """Strict typed projection of a parsed payload map: every numeric field, the calendar
    fields where no timestamp is given, and ``cast_error``, which names the fields whose
    text is no number. A blank ``latency_ms`` is absent."""
    return _numeric(_own_calendar(m), lambda f: _text(m, f), lambda f: _value(_text(m, f), f))


def with_numeric_fields(df: DataFrame, m: Column) -> tuple[DataFrame, list[Column]]:
    """``df`` for a projection, and ``numeric_fields`` of its map column ``m``: each field is
    looked up once a row and cast once, in columns of their own (``_text_*``, ``_value_*``)."""
    df = df.withColumns({"_own": _own_calendar(m), **{f"_text_{f}": _text(m, f) for f in NUMERIC_FIELDS}})
    df = df.withColumns({f"_value_{f}": _value(F.col(f"_text_{f}"), f) for f in NUMERIC_FIELDS})
    return df, _numeric(F.col("_own"), lambda f: F.col(f"_text_{f}"), lambda f: F.col(f"_value_{f}"))


def metrics_complete(metric_names: Column, required: list[str] = REQUIRED_METRICS) -> Column:
    """Required metric keys that a document lacks (array, empty when complete)."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), metric_names)


def metrics_gate(r2: Column, mae: Column, r2_floor: float = 0.90, mae_ceiling: float = 0.05, complete: Column | None = None) -> Column:
    """Gate code: 0 ok, 1 missing metrics, 2 R2 below floor, 3 MAE above ceiling."""
    c = F.when(r2 < r2_floor, F.lit(2)).when(mae > mae_ceiling, F.lit(3)).otherwise(F.lit(0))
    if complete is not None:
        c = F.when(~complete, F.lit(1)).otherwise(c)
    return c


def feature_doc_valid(feature_order: Column, n_features: Column, model_version: Column) -> Column:
    return (
        feature_order.isNotNull() & (F.size(feature_order) > 0)
        & (n_features == F.size(feature_order))
        & model_version.isNotNull() & (F.length(model_version) > 0)
    )


def manifest_valid(manifest: Column, folder_version: Column) -> Column:
    """All required keys present, version equals its folder, all core blobs listed.

    ``manifest`` is a ``map<string,string>`` of top-level keys; blob names are
    in ``manifest['blob_names']`` as a comma list.
    """
    keys_ok = F.forall(F.array(*[F.lit(k) for k in MANIFEST_KEYS]), lambda k: F.map_contains_key(manifest, k))
    names = F.split(F.coalesce(manifest["blob_names"], F.lit("")), ",")
    blobs_ok = F.forall(F.array(*[F.lit(b) for b in CORE_BLOBS]), lambda b: F.array_contains(names, b))
    return keys_ok & (manifest["model_version"] == folder_version) & blobs_ok


def table_ready(df: DataFrame, label: str) -> bool:
    """A training table is usable when it has the label column and at least one
    row (``limit(1)``: reads one row, not the table)."""
    return label in df.columns and len(df.limit(1).take(1)) == 1
