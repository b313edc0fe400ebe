"""More registered queries (contracts, promotion, election, drift, requests)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import promotion as prm
from ..sources import adapters
from ..sources.tables import Tables
from .queries import query, rounded

P = prm.QUERY_PARAMS


def _fold(spark, sf_dir):
    return prm.promotion_fold(adapters.candidates(Tables(spark, sf_dir)), P)


FOLD_COLS = ["line", "cand_id", "decision", "promotion_class", "refusal", "version", "parent_version", "bundle_epoch", "created_at"]


@query("promotion_fold")
def q_promotion_fold(spark, sf_dir):
    f = _fold(spark, sf_dir)
    return f.select(*FOLD_COLS, F.round("delta_R2", 6).alias("delta_R2"), F.round("mae_rel", 6).alias("mae_rel"))


@query("promotion_step")
def q_promotion_step(spark, sf_dir):
    """One decision-table step per candidate against the previous candidate of
    its line (stateless; the fold chains accepted ones)."""
    c = adapters.candidates(Tables(spark, sf_dir))
    w = Window.partitionBy("line").orderBy("ts", "cand_id")
    c = c.select("*", *[F.lag(x).over(w).alias(f"p_{x}") for x in ("R2", "MAE", "feature_order")])
    d = F.col("R2") - F.col("p_R2")
    rel = (F.col("MAE") - F.col("p_MAE")) / F.greatest(F.col("p_MAE"), F.lit(1e-12))
    gate = prm.gate_reason(F.col("R2"), F.col("MAE"), P)
    dec = (
        F.when(gate.isNotNull(), F.concat(F.lit("refused:"), gate))
        .when(F.col("p_R2").isNull(), F.lit("bootstrap"))
        .otherwise(prm.step_decision(d, rel, F.col("feature_order") != F.col("p_feature_order"), P))
    )
    return c.select("line", "cand_id", dec.alias("decision"), F.round(d, 6).alias("delta_R2"), F.round(rel, 6).alias("mae_rel"))


@query("parent_lookup")
def q_parent_lookup(spark, sf_dir):
    """As-of lookup: the latest accepted version of the line before each
    candidate -- emitted by the fold itself, so no second sort per line."""
    f = _fold(spark, sf_dir)
    return f.select("line", "cand_id", F.col("seen_parent").alias("parent_version"),
                    F.col("seen_parent_R2").alias("parent_R2"), F.col("seen_parent_MAE").alias("parent_MAE"))


@query("active_pointer")
def q_active_pointer(spark, sf_dir):
    return prm.active_pointer(_fold(spark, sf_dir))


def _manifests(spark, sf_dir):
    return prm.manifests(_fold(spark, sf_dir))


@query("catalog_packages")
def q_catalog_packages(spark, sf_dir):
    """Version rows joined to their metrics (r2, mae) and lineage token."""
    return _manifests(spark, sf_dir).select(
        "line", F.col("model_version").alias("version"), "parent_version", "created_at", "promotion_class",
        "bundle_epoch", F.col("R2").alias("r2"), F.col("MAE").alias("mae"), prm.token().alias("lineage_token"),
        "digest_ring", "seal_tag", "publish_nonce", "binding_mac",
    )


@query("blob_first_seen")
def q_blob_first_seen(spark, sf_dir):
    """Catalogue ``blobs``: first version (by publish time) that referenced each digest."""
    m = _manifests(spark, sf_dir)
    e = m.select("line", "model_version", "created_at", F.explode("blobs").alias("logical_name", "b"))
    order = F.struct("created_at", "line", prm.version_struct(F.col("model_version")))
    return e.groupBy(F.col("b.sha256").alias("sha256")).agg(
        F.min_by("logical_name", order).alias("logical_name"),
        F.min(F.col("b.size")).alias("size"),
        F.min_by("line", order).alias("first_seen_line"),
        F.min_by("model_version", order).alias("first_seen_version"),
        F.count("*").alias("n_refs"),
    )


@query("lineage_token")
def q_lineage_token(spark, sf_dir):
    return prm.lineage(_manifests(spark, sf_dir))


@query("parent_chain")
def q_parent_chain(spark, sf_dir):
    return prm.parent_chain(_manifests(spark, sf_dir))


@query("version_parse")
def q_version_parse(spark, sf_dir):
    """Parse version text (plus malformed variants) and order numerically per line."""
    f = _fold(spark, sf_dir).where(F.col("version").isNotNull())
    text = (
        F.when(F.col("cand_id") % 7 == 0, F.concat(F.lit("v"), F.col("version")))
        .when(F.col("cand_id") % 11 == 0, F.concat(F.col("version"), F.lit(".1")))
        .otherwise(F.col("version"))
    )
    v = f.select("line", "cand_id", text.alias("text")).withColumn("v", prm.version_struct(F.col("text")))
    w = Window.partitionBy("line").orderBy(F.col("v"))
    rank = F.when(F.col("v").isNotNull(), F.row_number().over(w))
    return v.select(
        "line", "cand_id", "text", F.col("v.major").alias("major"), F.col("v.minor").alias("minor"),
        F.col("v.patch").alias("patch"), F.col("v").isNotNull().alias("valid"),
        # nulls sort first; rank among the valid ones
        (rank - F.count(F.when(F.col("v").isNull(), 1)).over(Window.partitionBy("line"))).alias("version_rank"),
    )


# ------------------------------------------------------------------ election
from ..operators import election as ele  # noqa: E402


def _election_inputs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return adapters.trials(t), ele.Constraints().frame(spark), adapters.deny_list(t)


@query("eligible_trials")
def q_eligible_trials(spark, sf_dir):
    tr, c, d = _election_inputs(spark, sf_dir)
    return ele.eligibility(tr, c, d).select("election_id", "trial_id", "fingerprint", "reason")


def _survivors(trials, constraints, deny):
    """The eligible trials, written once: Borda reads them twice, and a parameter set's
    fingerprint is dear."""
    found = ele.eligibility(trials, constraints, deny).where(F.col("reason").isNull())
    return io.cut_lineage(found.select("election_id", "trial_id", "RMSE", "MAE", "R2"), "survivors")


@query("borda_points")
def q_borda_points(spark, sf_dir):
    tr, c, d = _election_inputs(spark, sf_dir)
    return ele.borda(_survivors(tr, c, d)).select("election_id", "trial_id", "n_survivors", "borda_rmse", "borda_mae", "borda_r2", "borda")


@query("copeland_leaders")
def q_copeland_leaders(spark, sf_dir):
    tr, c, d = _election_inputs(spark, sf_dir)
    return ele.copeland_for_leaders(ele.borda(_survivors(tr, c, d)))


@query("copeland_all")
def q_copeland_all(spark, sf_dir):
    """Copeland scores of all survivors."""
    tr, c, d = _election_inputs(spark, sf_dir)
    return ele.copeland(ele.eligibility(tr, c, d).where(F.col("reason").isNull()))


@query("election_winner")
def q_election_winner(spark, sf_dir):
    tr, c, d = _election_inputs(spark, sf_dir)
    w = ele.elect(tr, c, d)
    return ele.winner_documents(w, tr).select(
        "election_id", "status", "winner", "borda", "copeland", "n_survivors", "n_estimators", "max_depth", "max_features", "pred_var",
    )


# ------------------------------------------------------------------ request log
from ..operators import requests_log as rl  # noqa: E402

# adapter scale (events are sparse): FIXTURES.md
RL_LIMIT, RL_WINDOW, CACHE_TTL = 2, "1 day", "6 hours"
AL_WIDTH, AL_STEP, AL_THRESHOLD, AL_FOR, GAUGE_FOR = "6 hours", "1 hour", 0.25, "3 hours", "1 hour"


def _requests(spark, sf_dir):
    return adapters.requests(Tables(spark, sf_dir))


@query("request_counts")
def q_request_counts(spark, sf_dir):
    return rl.window_counts(_requests(spark, sf_dir), "ts", "1 hour", ["service", "method", "endpoint", "status"]).drop("rate_per_s")


@query("outcome_counts")
def q_outcome_counts(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn(
        "error_class", F.when(F.col("status") >= 500, F.lit("server")).when(F.col("status") >= 400, F.lit("client")).otherwise(F.lit("none"))
    )
    return rl.window_counts(r, "ts", "1 day", ["outcome", "error_class"]).drop("rate_per_s")


@query("request_rate")
def q_request_rate(spark, sf_dir):
    return rounded(rl.window_counts(_requests(spark, sf_dir), "ts", "1 hour", ["status", "outcome"]))


@query("latency_histogram")
def q_latency_histogram(spark, sf_dir):
    return rl.latency_histogram(_requests(spark, sf_dir), "latency_s", ["endpoint"]).drop("b")


@query("latency_p95")
def q_latency_p95(spark, sf_dir):
    return rl.windowed_quantile(_requests(spark, sf_dir), "ts", "latency_s", AL_WIDTH, AL_STEP, 0.95)


@query("error_ratio")
def q_error_ratio(spark, sf_dir):
    """Error ratios per sliding window: 5xx, prediction errors, selection errors."""
    r = _requests(spark, sf_dir)
    a = rl.ratio_series(r, "ts", F.col("status") >= 500, AL_WIDTH, AL_STEP, AL_THRESHOLD).withColumn("series", F.lit("http_5xx"))
    b = rl.ratio_series(r.where(F.col("endpoint") != "view"), "ts", F.col("outcome") == "error", AL_WIDTH, AL_STEP, 0.10).withColumn(
        "series", F.lit("select_errors")
    )
    c = rl.ratio_series(r, "ts", F.col("outcome") == "error", AL_WIDTH, AL_STEP, 0.20).withColumn("series", F.lit("predict_errors"))
    return rounded(a.unionByName(b).unionByName(c))


# thresholds and durations at the adapter's scale
ALERTS = {
    "high_5xx_ratio": (AL_THRESHOLD, AL_FOR),
    "predict_error_ratio": (0.20, "2 hours"),
    "select_error_ratio": (0.35, AL_FOR),
    "latency_p95": (4.5, "2 hours"),
    "oob_rate": (0.0005, "1 hour"),
}


@query("alert_states")
def q_alert_states(spark, sf_dir):
    """The six alert rules at every tick."""
    return rounded(rl.alert_states(_requests(spark, sf_dir), AL_WIDTH, AL_STEP, ALERTS, GAUGE_FOR, F.col("latency_s") > 4.8))


def _keyed_requests(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.withColumn("client_key", rl.client_key(F.col("xff"), F.col("endpoint")))


@query("rate_limit")
def q_rate_limit(spark, sf_dir):
    r = _keyed_requests(spark, sf_dir).select("request_id", "ts", "client_key")
    return rl.rate_limit(r, "client_key", "ts", "request_id", RL_LIMIT, RL_WINDOW)


@query("cache_replay")
def q_cache_replay(spark, sf_dir):
    r = _requests(spark, sf_dir).select("request_id", "ts", "payload_key")
    return rl.cache_replay(r, "payload_key", "ts", "request_id", CACHE_TTL)


# ------------------------------------------------------------------ drift
from ..operators import drift as drf  # noqa: E402
from .queries import _telemetry  # noqa: E402


@query("training_ranges")
def q_training_ranges(spark, sf_dir):
    r = drf.training_ranges(_telemetry(spark, sf_dir))
    return r.select("field", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "source")


def _oob(spark, sf_dir):
    tel = _telemetry(spark, sf_dir)
    ranges = drf.ranges_dict(drf.training_ranges(tel))
    return tel.withColumn("offenders", drf.oob_fields(tel, ranges))


@query("oob_fields")
def q_oob_fields(spark, sf_dir):
    o = _oob(spark, sf_dir)
    return o.select("row_id", F.array_join("offenders", ",").alias("offenders"), F.size("offenders").alias("n_offenders"))


@query("oob_counts")
def q_oob_counts(spark, sf_dir):
    o = _oob(spark, sf_dir)
    per = o.select(F.explode("offenders").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    rows = o.where(F.size("offenders") > 0).agg(F.count("*").alias("n")).select(F.lit("*rows*").alias("field"), "n")
    return per.unionByName(rows)


@query("oob_rate")
def q_oob_rate(spark, sf_dir):
    o = _oob(spark, sf_dir).where(F.size("offenders") > 0)
    r = rl.window_counts(o, "ts", "7 days", [], slide="1 day")
    return rounded(r.withColumn("above", F.col("rate_per_s") > 0.2))


@query("psi")
def q_psi(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    cut = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    exp, act = li.where(cut), li.where(~cut)
    base = rounded(drf.psi(exp, act, "l_extendedprice", edge_digits=6)).withColumn("scenario", F.lit("baseline"))
    shaped = act.select((F.col("l_extendedprice") * F.col("l_extendedprice") / 105000).alias("l_extendedprice"))
    drifted = rounded(drf.psi(exp, shaped, "l_extendedprice", edge_digits=6)).withColumn("scenario", F.lit("drifted"))
    return base.unionByName(drifted)


# ------------------------------------------------------------------ contracts
from ..functions import hashing as hsh  # noqa: E402
from ..operators import contracts as con  # noqa: E402
from ..operators import lineage as lin  # noqa: E402
from ..operators import scoring as sco  # noqa: E402
from ..operators.features import feature_order as _feature_order  # noqa: E402


@query("required_columns")
def q_required_columns(spark, sf_dir):
    return con.required_columns(_telemetry(spark, sf_dir))


def _payloads(spark, sf_dir):
    return adapters.payloads(Tables(spark, sf_dir))


@query("payload_errors")
def q_payload_errors(spark, sf_dir):
    p = con.parse_payload(_payloads(spark, sf_dir), "payload")
    return p.select("row_id", con.payload_errors(F.col("_m"), True).alias("error"),
                    con.payload_errors(F.col("_m"), False).alias("error_latency_endpoint"))


@query("numeric_cast")
def q_numeric_cast(spark, sf_dir):
    p = con.parse_payload(_payloads(spark, sf_dir), "payload")
    p, fields = con.with_numeric_fields(p.select("row_id", "_m"), F.col("_m"))
    return p.select("row_id", *fields)


def _stand_in_latency() -> F.Column:
    return F.col("net_io") / 4 * 0.98 + 2


@query("latency_fill")
def q_latency_fill(spark, sf_dir):
    """Blank or absent latency_ms is filled from a latency predictor (stand-in
    expression of the other features) and the source is recorded."""
    tel = _telemetry(spark, sf_dir)
    text = (F.when(F.col("l_orderkey") % 10 == 0, F.lit(None))
            .when(F.col("l_partkey") % 13 == 0, F.lit(""))
            .otherwise(F.col("latency_ms").cast("string")))
    blank = F.nullif(F.trim(text), F.lit("")).isNull()
    return tel.select(
        "row_id",
        F.when(blank, _stand_in_latency()).otherwise(text.cast("double")).alias("latency_ms"),
        F.when(blank, F.lit("model")).otherwise(F.lit("request")).alias("latency_source"),
    )


def _runs(spark, sf_dir):
    """Metrics documents per (provider, region) run, long form; runs of nations
    with n_nationkey % 5 = 0 lack MSE."""
    tel = _telemetry(spark, sf_dir)
    m = rounded(tel.groupBy("cloud_provider", "region").agg(
        F.first("n_nationkey").alias("n_nationkey"), *evaluate_exprs()
    ))
    kv = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("MAE", "MSE", "RMSE", "R2")]))
    long = m.select(F.concat_ws("/", "cloud_provider", "region").alias("run_id"), "n_nationkey", kv.alias("kv")).select(
        "run_id", "n_nationkey", "kv.metric", "kv.value"
    )
    return long.where(~((F.col("n_nationkey") % 5 == 0) & (F.col("metric") == "MSE")))


def evaluate_exprs():
    from ..operators import evaluate

    return evaluate.metric_exprs(F.col("cost"), F.col("pred"))[1:]


@query("metrics_complete")
def q_metrics_complete(spark, sf_dir):
    r = _runs(spark, sf_dir)
    per = r.groupBy("run_id").agg(F.collect_set("metric").alias("names"))  # <= 4 names per run
    miss = con.metrics_complete(F.col("names"))
    return per.select("run_id", F.array_join(miss, ",").alias("missing"), (F.size(miss) == 0).alias("complete"))


@query("metrics_gate")
def q_metrics_gate(spark, sf_dir):
    """Gate code per run: 0 ok, 1 missing keys, 2 R2 below floor, 3 MAE above ceiling
    (thresholds scaled to the adapter: R2 >= 0.99, MAE <= 0.33)."""
    r = _runs(spark, sf_dir)
    per = r.groupBy("run_id").agg(
        F.max(F.when(F.col("metric") == "R2", F.col("value"))).alias("R2"),
        F.max(F.when(F.col("metric") == "MAE", F.col("value"))).alias("MAE"),
        F.collect_set("metric").alias("names"),
    )
    complete = F.size(con.metrics_complete(F.col("names"))) == 0
    return per.select("run_id", "R2", "MAE", con.metrics_gate(F.col("R2"), F.col("MAE"), 0.99, 0.33, complete).alias("gate_code"))


def _full_feature_order():
    """Feature columns of the schema, calendar, encoded and ratio columns, in that order."""
    from ..operators import features as fe

    schema = [c for c in con.TELEMETRY_SCHEMA if c != "timestamp"]
    ratios = ["cpu_memory_ratio", "total_io", "io_ratio", "resource_efficiency", "latency_throughput_ratio",
              "resource_intensity", "ram_per_vcpu"]
    return _feature_order([*schema, *con.TEMPORAL_FIELDS, *[f"{c}_encoded" for c in fe.CATEGORICAL_COLUMNS], *ratios])


def _feature_docs(spark, sf_dir):
    """Feature-schema documents per accepted version: 'A' lines carry the full
    order, 'B' lines drop ram_per_vcpu; n_features always says 25; versions of
    cand_id % 17 = 0 lack a model_version."""
    m = prm.manifests(_fold(spark, sf_dir))
    full = _full_feature_order()
    arr_a = F.array(*[F.lit(x) for x in full])
    arr_b = F.array(*[F.lit(x) for x in full if x != "ram_per_vcpu"])
    return m.select(
        "line", "cand_id", "model_version",
        F.when(F.col("feature_order") == "A", arr_a).otherwise(arr_b).alias("order"),
        F.lit(len(full)).alias("n_features"),
        F.when(F.col("cand_id") % 17 != 0, F.col("model_version")).alias("doc_version"),
    )


@query("feature_doc_valid")
def q_feature_doc_valid(spark, sf_dir):
    d = _feature_docs(spark, sf_dir)
    return d.select("line", "model_version", F.size("order").alias("n_listed"),
                    con.feature_doc_valid(F.col("order"), F.col("n_features"), F.col("doc_version")).alias("valid"))


@query("schema_fingerprint")
def q_schema_fingerprint(spark, sf_dir):
    """Train-side fingerprint of (feature_order, model_version) vs the serving schema (full order)."""
    d = _feature_docs(spark, sf_dir)
    full = F.array(*[F.lit(x) for x in _full_feature_order()])
    fp = hsh.schema_fingerprint(F.col("order"), F.col("model_version"))
    serve = hsh.schema_fingerprint(full, F.col("model_version"))
    return d.select("line", "model_version", fp.alias("fingerprint"), (fp == serve).alias("serve_ok"))


@query("manifest_valid")
def q_manifest_valid(spark, sf_dir):
    """Manifest checks: required keys, version equals its folder, four core blobs."""
    m = prm.manifests(_fold(spark, sf_dir))
    names = F.array_join(F.filter(F.map_keys("blobs"), lambda k: ~((F.col("cand_id") % 17 == 0) & (k == "label_encoders.pkl"))), ",")
    entries = [
        ("model_version", F.col("model_version")),
        ("binding_mac", F.when(F.col("cand_id") % 13 != 0, F.col("binding_mac"))),
        ("digest_ring", F.col("digest_ring")),
        ("promotion_class", F.col("promotion_class")),
        ("bundle_epoch", F.col("bundle_epoch").cast("string")),
        ("blobs", F.lit("4")),
        ("blob_names", names),
    ]
    mp = F.map_filter(F.create_map(*[x for k, v in entries for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    folder = F.when(F.col("cand_id") % 19 == 0, F.lit("0.0.0")).otherwise(F.col("model_version"))
    return m.select("line", "model_version", con.manifest_valid(mp, folder).alias("valid"))


@query("params_fingerprint")
def q_params_fingerprint(spark, sf_dir):
    t = adapters.trials(Tables(spark, sf_dir))
    return t.select("trial_id", hsh.params_fingerprint(F.col("params_json")).alias("fingerprint"))


@query("payload_key")
def q_payload_key(spark, sf_dir):
    """Cache key: SHA-256 of {"p": payload (keys sorted), "v": model version}."""
    r = _requests(spark, sf_dir)
    return r.select("request_id", hsh.cache_key(F.col("payload_key"), F.lit("1.0.0")).alias("cache_key"))


# ------------------------------------------------------------------ blobs and digests

def _blobs(spark, sf_dir):
    b = adapters.blobs(Tables(spark, sf_dir))
    return b.select("doc_id", "logical_name", F.sha2(F.col("content"), 256).alias("sha256"),
                    F.octet_length("content").cast("bigint").alias("size"))


@query("git_blob_digest")
def q_git_blob_digest(spark, sf_dir):
    b = adapters.blobs(Tables(spark, sf_dir))
    return b.select("doc_id", hsh.git_blob_digest(F.col("content")).alias("git_sha256"))


@query("blob_scan")
def q_blob_scan(spark, sf_dir):
    b = _blobs(spark, sf_dir)
    return b.select("doc_id", "logical_name", "sha256", "size", hsh.content_path(F.col("sha256")).alias("object_path"))


@query("content_dedup")
def q_content_dedup(spark, sf_dir):
    """Store each digest once; flag a collision if one digest shows two sizes."""
    b = _blobs(spark, sf_dir)
    return b.groupBy("sha256").agg(
        F.count("*").alias("n_copies"),
        F.min("doc_id").alias("stored_doc_id"),
        F.min_by("logical_name", "doc_id").alias("logical_name"),
        (F.min("size") != F.max("size")).alias("collision"),
    )


@query("blob_integrity")
def q_blob_integrity(spark, sf_dir):
    """Manifest (recorded digest/size per path) vs a fresh scan: full outer join.

    Recorded digests are altered when doc_id % 31 = 0, sizes when % 37 = 0;
    the scan misses doc_id % 41 = 0."""
    b = _blobs(spark, sf_dir)
    rec = b.select(
        F.col("doc_id").alias("path"),
        F.when(F.col("doc_id") % 31 == 0, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("rec_sha"),
        F.when(F.col("doc_id") % 37 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("rec_size"),
    )
    scan = b.where(F.col("doc_id") % 41 != 0).select(F.col("doc_id").alias("path"), F.col("sha256").alias("cur_sha"), F.col("size").alias("cur_size"))
    j = rec.join(scan, "path", "full")
    status = (
        F.when(F.col("cur_sha").isNull(), F.lit("missing"))
        .when(F.col("rec_sha").isNull(), F.lit("unlisted"))
        .when(F.col("rec_sha") != F.col("cur_sha"), F.lit("hash_mismatch"))
        .when(F.col("rec_size") != F.col("cur_size"), F.lit("size_mismatch"))
        .otherwise(F.lit("ok"))
    )
    return j.select("path", status.alias("status"))


def _digests(spark, sf_dir):
    return adapters.digests(Tables(spark, sf_dir))


@query("digest_snapshot")
def q_digest_snapshot(spark, sf_dir):
    d = _digests(spark, sf_dir).where(F.col("snapshot") == "recorded")
    return lin.snapshot(d, ["pipeline", "stage", "kind"])


@query("digest_diff")
def q_digest_diff(spark, sf_dir):
    d = _digests(spark, sf_dir)
    return lin.digest_diff(d.where(F.col("snapshot") == "recorded"), d.where(F.col("snapshot") == "current"), ["pipeline", "stage", "kind"])


@query("staleness_plan")
def q_staleness_plan(spark, sf_dir):
    d = _digests(spark, sf_dir)
    diff = lin.digest_diff(d.where(F.col("snapshot") == "recorded"), d.where(F.col("snapshot") == "current"), ["pipeline", "stage", "kind"])
    return lin.staleness_plan(diff, adapters.stages(Tables(spark, sf_dir)))


@query("stage_graph")
def q_stage_graph(spark, sf_dir):
    """Stages of a graph that must run, by their own or an ancestor's staleness."""
    d, t = _digests(spark, sf_dir), Tables(spark, sf_dir)
    diff = lin.digest_diff(d.where(F.col("snapshot") == "recorded"), d.where(F.col("snapshot") == "current"), ["pipeline", "stage", "kind"])
    return lin.stage_graph(lin.own_reasons(diff, adapters.stages(t)), adapters.stage_edges(t))


# ------------------------------------------------------------------ scoring

INSTANCE = "l_linenumber int, l_partkey bigint, l_suppkey bigint, cpu_usage double, vm_type string"


@query("batch_explode")
def q_batch_explode(spark, sf_dir):
    """Batches of instances (one JSON document per order) -> one row per instance with
    its position.  Orders with key % 50 below 3 send an empty list, no JSON, or nothing."""
    tel = _telemetry(spark, sf_dir)
    inst = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "cpu_usage", "vm_type")
    docs = tel.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(inst)).alias("xs"))
    doc = F.to_json(F.struct(F.transform("xs", lambda x: x.dropFields("l_extendedprice", "l_shipdate")).alias("instances")))
    odd = F.col("l_orderkey") % 50
    doc = F.when(odd == 0, F.lit('{"instances": []}')).when(odd == 1, F.lit("not json")).when(odd == 2, F.lit(None)).otherwise(doc)
    docs = docs.select("l_orderkey", doc.alias("doc"))
    return sco.explode_batch(docs, "doc", INSTANCE, "l_orderkey")


def _stand_in_score(cpu, ram, vcpu):
    return cpu * 0.01 + ram * 0.05 + vcpu * 0.1


@query("batch_status")
def q_batch_status(spark, sf_dir):
    """Per-row status of a batch: invalid rows get the error text, others a score."""
    p = con.parse_payload(_payloads(spark, sf_dir), "payload")
    m = F.col("_m")
    p, fields = con.with_numeric_fields(p.select("row_id", "_m"), m)
    # the checks stand in a column of their own, read by three others
    p = p.withColumn("_error", F.coalesce(con.payload_errors(m, False), fields[-1]))
    err = F.col("_error")
    score = _stand_in_score(F.col("_value_cpu_usage"), F.col("_value_RAM_GB"), F.col("_text_vCPU").try_cast("double"))
    return p.select(
        "row_id", F.when(err.isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"), err.alias("error"),
        F.when(err.isNull(), score).alias("prediction"),
    )


@query("payload_dedup")
def q_payload_dedup(spark, sf_dir):
    """Identical payloads are scored once and the score is reused."""
    r = _requests(spark, sf_dir)
    scorer = lambda d: d.select("payload_key", (F.variant_get(F.parse_json("payload_key"), "$.k", "double") * 1.5 + F.length("payload_key")).alias("score"))
    out = sco.score_distinct(r, "payload_key", scorer)
    return out.select("request_id", "payload_key", "score")


CANARY_PERCENT = 0.5


def _variant_scores(df):
    anchor = F.col("latency_s") * 2 + 1
    probe = F.col("latency_s") * 2.1 + 0.9
    return df.select("*", anchor.alias("primary"), probe.alias("shadow"))


@query("canary_route")
def q_canary_route(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("request_id", sco.canary_variant(F.col("request_id"), CANARY_PERCENT).alias("variant"))


@query("shadow_delta")
def q_shadow_delta(spark, sf_dir):
    """Score with anchor and probe versions, delta = probe - primary, per endpoint."""
    r = _variant_scores(_requests(spark, sf_dir))
    if CANARY_PERCENT <= 0:
        r = r.limit(0)  # shadow mode needs a canary percentage
    d = F.col("shadow") - F.col("primary")
    return r.groupBy("endpoint").agg(
        F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.max(F.abs(d)), 6).alias("max_abs_delta")
    )


def _audit(spark, sf_dir):
    r = _requests(spark, sf_dir)
    r = r.select(
        "request_id", "ts",
        F.when(F.col("endpoint") != "view", F.col("endpoint")).alias("endpoint"),
        F.lit("1.0.0").alias("model_version"),
        sco.canary_variant(F.col("request_id"), CANARY_PERCENT).alias("variant"),
        (F.col("latency_s") * 2 + 1).alias("prediction"),
        F.when(F.col("request_id") % 10 == 0, F.col("latency_s") * 980 + 2).alias("predicted_latency_ms"),
        (F.col("outcome") == "cache_hit").alias("cache_hit"),
        (F.col("latency_s") * 1000).alias("latency_ms"),
        F.when(F.col("status") >= 500, F.lit("error")).alias("status"),
    )
    return sco.audit_projection(r)


@query("audit_events")
def q_audit_events(spark, sf_dir):
    return _audit(spark, sf_dir).drop("event_date")


@query("audit_lookup")
def q_audit_lookup(spark, sf_dir):
    """The three audit lookups: by status, by time range (date-partition prunable), and
    by a set of request ids (those of slow requests, semi join)."""
    a = _audit(spark, sf_dir)
    by_status = a.where(F.col("status") == "error").groupBy("endpoint").agg(F.count("*").alias("n")).select(
        F.lit("status=error").alias("lookup"), "endpoint", "n")
    by_time = a.where((F.col("event_date") >= F.lit("2024-01-10").cast("date")) & (F.col("event_date") < F.lit("2024-01-12").cast("date"))) \
        .groupBy("endpoint").agg(F.count("*").alias("n")).select(F.lit("date in [01-10, 01-12)").alias("lookup"), "endpoint", "n")
    slow = _requests(spark, sf_dir).where(F.col("latency_s") > 4.5).select(F.col("request_id").cast("string").alias("request_id"))
    by_id = a.join(slow, "request_id", "left_semi").groupBy("endpoint").agg(F.count("*").alias("n")).select(
        F.lit("request_id in slow set").alias("lookup"), "endpoint", "n")
    return by_status.unionByName(by_time).unionByName(by_id)


# ------------------------------------------------------------------ models (rows-only checks)
from ..operators import features as fea  # noqa: E402
from ..operators import train as trn  # noqa: E402
from ..sources import io  # noqa: E402

COST_FEATURES = _full_feature_order()
LATENCY_FEATURES = [c for c in COST_FEATURES if c not in fea.LATENCY_EXCLUDED]


_FRAMES: dict[tuple, tuple] = {}
_MODELS: dict[tuple, object] = {}


def _version(spark, sf_dir):
    """The session and the files of the telemetry's table, with their times and sizes: what is
    kept of one version is not used for another."""
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    mark = files.distinct().agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
    return spark.sparkContext.applicationId, sf_dir, str(mark)


def _kept(table, key, make):
    """What ``make`` gives, once for each key; other sessions' and versions' entries go."""
    if key not in table:
        for old in [k for k in table if k[0] != key[0] or k[1] == key[1] and k[2] != key[2]]:
            del table[old]
        table[key] = make()
    return table[key]


def _model_frame(spark, sf_dir):
    """(frame, dictionary): telemetry with calendar, encoded and ratio features, temporally
    split, written once per session and shared by the queries."""
    from ..operators import split as spl

    def make():
        df = spl.temporal_split(_telemetry(spark, sf_dir), "ts", adapters.ROW_KEY)
        df = fea.temporal_features(df, fea.parse_timestamp(F.col("timestamp")))
        dic = fea.fit_encoders(df)
        df = fea.ratio_features(fea.apply_encoders(df, dic))
        cols = list(dict.fromkeys(["row_id", "split", "cost", "latency_ms", *COST_FEATURES]))
        # every row goes down hundreds of trees: spread by key, whatever the tables' files are
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return io.cut_lineage(df.select(*cols).repartition(parts, "row_id"), "model-frame"), dic

    with io.shuffles_dropped(spark):
        return _kept(_FRAMES, _version(spark, sf_dir), make)


# Forest of the registered queries: the reference values (300 trees of depth 20), and the
# probe version's of the shadow comparison.
FOREST = trn.ForestParams()
PROBE = trn.ForestParams(num_trees=100, seed=43)
# what a fitted forest must reach on the held-out rows
R2_FLOOR = 0.99
KEY = ["row_id"]


def _fitted(spark, sf_dir, features, label, params=None):
    """The forest of ``label``, fitted on the train split once per session and shared by the
    queries; what is kept is where it lies."""
    frame, _ = _model_frame(spark, sf_dir)
    params = params or FOREST
    return _kept(_MODELS, (*_version(spark, sf_dir), label, params), lambda: trn.fit(frame.where(F.col("split") == "train"), features, label, params, KEY))


def _checked_report(spark, sf_dir, features, label):
    """Rows and label mean per split, and whether the fit passes its gate (``model_metrics``
    has the metrics)."""
    frame, _ = _model_frame(spark, sf_dir)
    report = trn.holdout_report(frame, features, label, FOREST, _fitted(spark, sf_dir, features, label)).first()  # one row
    rows = frame.groupBy("split").agg(F.count(label).alias("n"), F.avg(label).alias("label_mean"))
    return rounded(rows).withColumns({"label": F.lit(label), "gate": F.lit(report["test_R2"] >= R2_FLOOR)})


@query("cost_model")
def q_cost_model(spark, sf_dir):
    return _checked_report(spark, sf_dir, COST_FEATURES, "cost")


@query("latency_model")
def q_latency_model(spark, sf_dir):
    return _checked_report(spark, sf_dir, LATENCY_FEATURES, "latency_ms")


def _both_models(spark, sf_dir):
    return [(label, features, _fitted(spark, sf_dir, features, label)) for label, features in (("cost", COST_FEATURES), ("latency_ms", LATENCY_FEATURES))]


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    """The forests' own numbers: train, test and gaps for both labels."""
    frame, _ = _model_frame(spark, sf_dir)
    out = [trn.holdout_report(frame, features, label, FOREST, model) for label, features, model in _both_models(spark, sf_dir)]
    return rounded(out[0].unionByName(out[1]))


@query("model_predictions")
def q_model_predictions(spark, sf_dir):
    """Every telemetry row with its predicted cost and latency."""
    frame, _ = _model_frame(spark, sf_dir)
    for label, features, model in _both_models(spark, sf_dir):
        frame = trn.score(model, frame, features, f"predicted_{label}")
    return rounded(frame.select("row_id", "split", "predicted_cost", "predicted_latency_ms"))


@query("oob_r2")
def q_oob_r2(spark, sf_dir):
    """Training rows with an out-of-bag prediction, by label, and whether their R2 reaches
    the floor."""
    frame, _ = _model_frame(spark, sf_dir)
    train, out = frame.where(F.col("split") == "train"), None
    for label, _, model in _both_models(spark, sf_dir):
        m = trn.oob_r2(model, train, label, KEY).select(F.lit(label).alias("label"), "n", (F.col("oob_r2") >= R2_FLOOR).alias("gate"))
        out = m if out is None else out.unionByName(m)
    return out


@query("oob_metrics")
def q_oob_metrics(spark, sf_dir):
    """The out-of-bag numbers of both forests."""
    frame, _ = _model_frame(spark, sf_dir)
    train, out = frame.where(F.col("split") == "train"), None
    for label, _, model in _both_models(spark, sf_dir):
        m = trn.oob_r2(model, train, label, KEY).withColumn("label", F.lit(label))
        out = m if out is None else out.unionByName(m)
    return rounded(out)


@query("cv_r2")
def q_cv_r2(spark, sf_dir):
    """Rows per fold, and whether the out-of-fold R2 reaches the floor."""
    frame, _ = _model_frame(spark, sf_dir)
    m = trn.cv_r2(frame, "row_id", COST_FEATURES, "cost", FOREST, k=3).first()  # one row
    rows = frame.groupBy(hsh.md5_bucket(F.col("row_id"), 3).alias("fold")).agg(F.count("*").alias("n"), F.avg("cost").alias("label_mean"))
    return rounded(rows).withColumn("gate", F.lit(m["cv_r2"] >= R2_FLOOR))


@query("shadow_fitted")
def q_shadow_fitted(spark, sf_dir):
    """Two fitted versions of the cost model side by side: shadow - primary, per split."""
    frame, _ = _model_frame(spark, sf_dir)
    anchor, probe = (_fitted(spark, sf_dir, COST_FEATURES, "cost", p) for p in (FOREST, PROBE))
    x = trn.shadow_scores(anchor, probe, frame, COST_FEATURES)
    return rounded(x.groupBy("split").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.max(F.abs("delta")).alias("max_abs_delta")))


def payload_frame(p, m, dictionary):
    """Model features from a parsed payload map: numbers, calendar from the timestamp or
    the fields, encoded categories, ratios (of a latency still blank: null)."""
    p, cols = con.with_numeric_fields(p, m)
    text = [m[c].alias(c) for c in fea.CATEGORICAL_COLUMNS]
    x = p.select("row_id", F.coalesce(con.payload_errors(m, False), cols[-1]).alias("error"), m["timestamp"].alias("timestamp"), *cols[:-1], *text)
    sent = x.withColumnsRenamed({c: f"_{c}" for c in con.TEMPORAL_FIELDS})
    x = fea.temporal_features(sent, fea.parse_timestamp(F.col("timestamp"), tolerant=True))
    x = x.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in con.TEMPORAL_FIELDS}).drop(*[f"_{c}" for c in con.TEMPORAL_FIELDS])
    return fea.apply_encoders(x, dictionary)


def _scored_batch(spark, sf_dir):
    _, dictionary = _model_frame(spark, sf_dir)
    (_, _, cost), (_, _, latency) = _both_models(spark, sf_dir)
    # spread by key like the model frame: the files' few parts would be all that scores
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = con.parse_payload(_payloads(spark, sf_dir).select("row_id", "payload").repartition(parts, "row_id"), "payload")
    return score_payloads(payload_frame(p, F.col("_m"), dictionary), latency, cost)


@query("batch_score")
def q_batch_score(spark, sf_dir):
    """Batch scoring end to end: features come from the payload itself, a blank latency is
    filled by the latency model, the cost model scores the rest; an invalid payload gets
    its error.  Predictions are reported as present or not (``batch_predictions`` has them)."""
    x = _scored_batch(spark, sf_dir)
    return x.select("row_id", "status", "error", "latency_source", F.col("prediction").isNotNull().alias("has_prediction"),
                    F.col("predicted_latency_ms").isNotNull().alias("has_predicted_latency"))


@query("batch_predictions")
def q_batch_predictions(spark, sf_dir):
    """The costs and latencies that batch scoring answers with."""
    return rounded(_scored_batch(spark, sf_dir).select("row_id", "status", "prediction", "predicted_latency_ms"))


def score_payloads(x, latency, cost):
    """Status, latency source, predicted latency and cost prediction of payload features."""
    ok, blank = F.col("error").isNull(), F.col("latency_ms").isNull()
    x = trn.score(latency, fea.ratio_features(x), LATENCY_FEATURES, "_latency", only=ok & blank)
    x = x.drop(*[c for c in COST_FEATURES if c in ("cpu_memory_ratio", "total_io", "io_ratio", "resource_efficiency", "latency_throughput_ratio", "resource_intensity", "ram_per_vcpu")])
    x = x.withColumns({
        "latency_source": F.when(ok, F.when(blank, F.lit("model")).otherwise(F.lit("request"))),
        "predicted_latency_ms": F.when(ok & blank, F.col("_latency")),
        "latency_ms": F.coalesce("latency_ms", "_latency"),
    }).drop("_latency")
    x = trn.score(cost, fea.ratio_features(x), COST_FEATURES, only=ok)
    return x.withColumns({"status": F.when(ok, F.lit("success")).otherwise(F.lit("error")), "prediction": F.when(ok, F.col("prediction"))})


def _lab(spark, sf_dir):
    """Lab regression table from ``embeddings``: f0..f5 = first six components,
    target = 10 * label + 50 * component 6; eval = md5 bucket < 25."""
    e = Tables(spark, sf_dir).embeddings
    cols = [F.col("embedding").getItem(i).cast("double").alias(f"f{i}") for i in range(6)]
    target = (F.col("label") * 10 + F.col("embedding").getItem(6).cast("double") * 50).alias("target")
    lab = e.select("vec_id", *cols, target)
    return lab.withColumn("split", F.when(md5_b(F.col("vec_id")) < 25, F.lit("eval")).otherwise(F.lit("train")))


def md5_b(c):
    return hsh.md5_bucket(c, 100)


def refit_elected(lab, elected, election_id, features, label):
    """(model, winner's document): a forest with the parameters that an election chose,
    fitted on the lab table's train split."""
    r = elected.where(F.col("election_id") == election_id).first()  # a row per election
    if r is None or r["status"] != "OK":
        raise ValueError(f"no winner in election {election_id}")
    params = trn.params_from_trial(r["n_estimators"], r["max_depth"], r["max_features"], 1, r["random_state"])
    return trn.fit(lab.where(F.col("split") == "train"), features, label, params), r


def _refit(spark, sf_dir):
    """(scored eval rows, election, winner): the lab model refitted with the parameters that
    the last election by name chose."""
    tr, c, d = _election_inputs(spark, sf_dir)
    elected = io.cut_lineage(ele.winner_documents(ele.elect(tr, c, d), tr), "elected")
    last = elected.where("status = 'OK'").agg(F.max("election_id")).first()[0]
    lab, feats = io.cut_lineage(_lab(spark, sf_dir), "lab"), [f"f{i}" for i in range(6)]
    model, r = refit_elected(lab, elected, last, feats, "target")
    return trn.score(model, lab.where(F.col("split") == "eval"), feats), last, r


@query("elected_refit")
def q_elected_refit(spark, sf_dir):
    """The refitted model's eval split: rows, label mean, and whether all rows have a
    prediction."""
    scored, last, r = _refit(spark, sf_dir)
    out = scored.agg(F.count("target").alias("n"), F.avg("target").alias("label_mean"), (F.count("prediction") == F.count("*")).alias("all_predicted"))
    return rounded(out).select(F.lit(last).alias("election_id"), F.lit(r["winner"]).alias("trial_id"), F.lit(int(r["n_estimators"])).alias("n_estimators"), "*")


@query("elected_predictions")
def q_elected_predictions(spark, sf_dir):
    """The refitted model's predictions for the eval split."""
    return rounded(_refit(spark, sf_dir)[0].select("vec_id", "target", "prediction"))
