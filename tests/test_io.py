"""Sources and sinks round trips."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from stratus.sources import io


def test_csv_with_schema_and_trimmed_header(spark, scratch):
    p = f"{scratch}/t.csv"
    header = ",".join(f" {f.name} " for f in io.TELEMETRY_SCHEMA.fields)
    row = "1/1/2024 0:00,43.71,95.56,379.4,638.79,Azure,us-east,t2.micro,1,1,0.1,scale_up,228.02,1380.99,69.64,0.5"
    open(p, "w").write(header + "\n" + row + "\n")
    df = io.read_csv(spark, p)
    r = df.first()
    assert r["vCPU"] == 1 and r["cloud_provider"] == "Azure" and df.columns[0] == "timestamp"


def test_deny_list_and_ledger(spark, scratch):
    p = f"{scratch}/deny.txt"
    open(p, "w").write("# comment\n\n  ABCDEF  \nabc123\n")
    assert sorted(r[0] for r in io.read_deny_list(spark, p).collect()) == ["abc123", "abcdef"]
    rows = spark.createDataFrame(
        [("2024-01-01 00:00:00", "1.0.0", "bootstrap", "r", "t", "n", "m")],
        "released_at string, version string, promotion_class string, digest_ring string, lineage_token string, publish_nonce string, binding_mac string",
    ).withColumn("released_at", F.col("released_at").cast("timestamp"))
    led = f"{scratch}/RELEASES"
    io.append_release(rows, led)
    back = io.parse_release_ledger(spark.read.text(led)).first()
    assert back["version"] == "1.0.0" and back["binding_mac"] == "m"


def test_split_sink_prunes_by_partition(spark, scratch):
    df = entry.queries()["temporal_split"](spark, SF_SMALL)
    io.write_split(df, f"{scratch}/split")
    t = spark.read.parquet(f"{scratch}/split").where(F.col("split") == "test")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and t.count() == df.where(F.col("split") == "test").count()


def test_cut_lineage_uses_checkpoint_dir(spark):
    df = spark.range(10)
    back = io.cut_lineage(df, "cut-test")
    assert back.count() == 10
    assert spark.conf.get("spark.checkpoint.dir") in back.inputFiles()[0]


def test_partition_count_invariance(spark):
    q = entry.queries()
    keys = ["promotion_fold", "rate_limit", "borda_points", "training_ranges", "temporal_split"]
    before = {k: sorted(map(tuple, q[k](spark, SF_SMALL).collect()), key=str) for k in keys}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for k in keys:
            assert sorted(map(tuple, q[k](spark, SF_SMALL).collect()), key=str) == before[k], k
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_metrics_catalogue_and_audit_sinks(spark, scratch):
    m = spark.createDataFrame([("MAE", 0.5), ("R2", 0.9)], "metric string, value double")
    io.append_runs(m, f"{scratch}/runs", "a")
    io.append_runs(m, f"{scratch}/runs", "b")
    assert {(r["run_id"], r["count"]) for r in spark.read.parquet(f"{scratch}/runs").groupBy("run_id").count().collect()} == {("a", 2), ("b", 2)}
    p, b = spark.createDataFrame([("1.0.0",)], "version string"), spark.createDataFrame([("ab",)], "sha256 string")
    for _ in range(2):
        io.overwrite_catalog(p, b, f"{scratch}/catalog")
    assert spark.read.parquet(f"{scratch}/catalog/packages").count() == spark.read.parquet(f"{scratch}/catalog/blobs").count() == 1
    e = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "request_id int, d string").select("request_id", F.to_date("d").alias("event_date"))
    io.append_audit(e, f"{scratch}/audit")
    io.append_audit(e, f"{scratch}/audit")
    assert spark.read.parquet(f"{scratch}/audit").where("event_date = DATE '2024-01-02'").count() == 2


def test_blobs_and_absent_features(spark, scratch):
    import hashlib

    from stratus.operators.forest import feature_columns

    open(f"{scratch}/x.bin", "wb").write(b"\x00\xffblob")
    r = io.read_blobs(spark, f"{scratch}/x.bin").first()
    assert (r["sha256"], r["size"]) == (hashlib.sha256(b"\x00\xffblob").hexdigest(), 6)
    df = spark.createDataFrame([(1.0,)], "a double")
    assert tuple(df.select(*feature_columns(df, ["b", "a"])).first()) == (None, 1.0)


def test_constraints_file(spark, scratch):
    p = f"{scratch}/constraints.yaml"
    open(p, "w").write("# bounds\nn_estimators_min: 50\nrequire_unlimited_depth: false  # any\npred_var_max: 3.5\nscore_epsilon: 1.0e-9\n")
    r = io.read_constraints(spark, p).collect()
    assert len(r) == 1 and (r[0]["n_estimators_min"], r[0]["n_estimators_max"], r[0]["require_unlimited_depth"], r[0]["pred_var_max"]) == (50, 800, False, 3.5)
