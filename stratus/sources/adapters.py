"""Adapter views: give the driver tables the shapes the operators expect.

Each adapter is a lazy DataFrame derived from the driver tables, so every
query built on it scans and grows with them.  Dimension tables of fixed size
(nation, region: 25 and 5 rows by definition) are broadcast explicitly; every
other join is left to Catalyst/AQE, which broadcasts only sides whose
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables

# Natural row key of a lineitem row; (l_orderkey, l_linenumber) alone repeats.
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _with_geo(df: DataFrame, t: Tables, suppkey: str) -> DataFrame:
    """Attach nation and region names through the supplier.

    The supplier scan is joined on its own, so Catalyst sizes it from its
    files (broadcast when small, sort-merge when it grows with the scale
    factor); nation and region are fixed-size dimensions (25 and 5 rows) and
    are broadcast explicitly.  Joining them to supplier first would make the
    size estimate of that side a product of all three and force a shuffle of
    the fact table.
    """
    nation = F.broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(t.region.select("r_regionkey", "r_name"))
    sup = t.supplier.select("s_suppkey", "s_nationkey")
    return (
        df.join(sup, F.col(suppkey) == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def telemetry(t: Tables) -> DataFrame:
    """One row per VM observation (lineitem joined to part, supplier, nation, region)."""
    li = t.lineitem
    part = t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")
    df = _with_geo(li.join(part, li.l_partkey == part.p_partkey), t, "l_suppkey")
    ts = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)
    row_id = F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.date_format("l_shipdate", "yyyyMMdd"),
    )
    return df.select(
        row_id.alias("row_id"),
        *ROW_KEY,
        F.col("n_nationkey"),
        ts.alias("ts"),
        F.date_format(ts, "M/d/yyyy H:mm").alias("timestamp"),
        (F.col("l_quantity") * 2).alias("cpu_usage"),
        (F.col("l_discount") * 1000).alias("memory_usage"),
        (F.col("l_extendedprice") / 25).alias("net_io"),
        F.col("p_retailprice").alias("disk_io"),
        F.col("r_name").alias("cloud_provider"),
        F.col("n_name").alias("region"),
        F.col("p_type").alias("vm_type"),
        F.col("l_returnflag").alias("target"),
        F.col("p_size").cast("bigint").alias("vCPU"),
        (F.col("p_size") * 2).cast("double").alias("RAM_GB"),
        (F.col("p_retailprice") / 1000).alias("price_per_hour"),
        (F.col("l_extendedprice") / 100).alias("latency_ms"),
        (F.col("l_partkey") + 100).cast("double").alias("throughput"),
        (F.col("l_tax") * 1000).alias("utilization"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10000).alias("cost"),
    ).withColumn("pred", F.col("cost") * 0.9 + F.col("vCPU") / 100)


def requests(t: Tables) -> DataFrame:
    """Request log over ``events`` (one row per served request)."""
    e = t.events
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("event_type") == "error", F.lit("error"))
        .when(F.col("event_id") % 4 == 0, F.lit("cache_hit"))
        .otherwise(F.lit("success"))
        .alias("outcome"),
        (F.col("value") / 100).alias("latency_s"),
        F.col("props").alias("payload_key"),
        F.lit("inference-api").alias("service"),
        F.when(F.col("event_type") == "view", F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.when(F.hour("ts").isin(3, 4), F.lit(0)).otherwise(F.lit(1)).alias("model_loaded"),
        # forwarded-for header: client first, then a proxy hop
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(", 10.0."), (F.col("user_id") % 7).cast("string"), F.lit(".1")).alias("xff"),
    )


def _json_str(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def trials(t: Tables) -> DataFrame:
    """Trial documents, one election per brand.

    ``params_json`` is the raw parameter object as a trial file would hold it
    (file key order, spaces); the fingerprint canonicalises it through Variant.
    Trials of p_partkey % 40 = 3 also stand in the election ``again``, those of
    p_partkey % 80 = 3 without an RMSE there.
    ``min_samples_split`` (2 + p_partkey % 100000) makes parameter sets, and so
    fingerprints, distinct per trial, so the deny list removes about 1 in 13.
    """
    p = t.part
    max_depth = F.when(F.col("p_partkey") % 7 == 0, F.lit(12))
    max_features = (
        F.when(F.col("p_type") == "PROMO", F.lit("0.5"))
        .when(F.col("p_type") == "LARGE", F.lit("log2"))
        .otherwise(F.lit("sqrt"))
    )
    random_state = F.when(F.col("p_partkey") % 10 == 0, F.lit(7)).otherwise(F.lit(42))
    n_est = F.col("p_size") * 20
    mf_json = F.when(max_features == "0.5", max_features).otherwise(_json_str(max_features))
    params_json = F.concat(
        F.lit('{"n_estimators": '), n_est.cast("string"),
        F.lit(', "max_depth": '), F.coalesce(max_depth.cast("string"), F.lit("null")),
        F.lit(', "min_samples_split": '), (F.col("p_partkey") % 100000 + 2).cast("string"),
        F.lit(', "min_samples_leaf": 1, "max_features": '), mf_json,
        F.lit(', "random_state": '), random_state.cast("string"), F.lit("}"),
    )
    own = p.select(
        F.col("p_brand").alias("election_id"),
        F.concat(F.lit("trial_"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("trial_id"),
        F.col("p_partkey").alias("source_key"),
        n_est.alias("n_estimators"),
        max_depth.alias("max_depth"),
        max_features.alias("max_features"),
        random_state.alias("random_state"),
        # round(p_retailprice / 100, 2), half up, in integer cents so every engine agrees
        (((F.round(F.col("p_retailprice") * 100).cast("bigint") + 50) / 100).cast("bigint") / 100).alias("RMSE"),
        (F.col("p_size") / 10).alias("MAE"),
        ((F.col("p_partkey") % 50) / 50).alias("R2"),
        ((F.col("p_partkey") % 11) / 2).alias("pred_var"),
        params_json.alias("params_json"),
    )
    again = own.where(F.col("source_key") % 40 == 3).withColumns({
        "election_id": F.lit("again"), "RMSE": F.when(F.col("source_key") % 80 != 3, F.col("RMSE"))})
    return own.unionByName(again)


def deny_list(t: Tables) -> DataFrame:
    """Denied fingerprints, written upper-case (matching must ignore case)."""
    from ..functions.hashing import params_fingerprint

    tr = trials(t).where(F.col("source_key") % 13 == 0)
    return tr.select(F.upper(params_fingerprint(F.col("params_json"))).alias("fingerprint"))


def candidates(t: Tables) -> DataFrame:
    """Promotion candidates: one model line per customer, ordered by (date, key)."""
    o = t.orders
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        F.col("o_custkey").alias("line"),
        F.col("o_orderkey").alias("cand_id"),
        F.col("o_orderdate").alias("ts"),
        (F.lit(0.88) + (cents % 120) / 1000).alias("R2"),
        ((cents % 53) / 1000).alias("MAE"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("B")).otherwise(F.lit("A")).alias("feature_order"),
    )


def blobs(t: Tables) -> DataFrame:
    """Content blobs over ``documents`` (name = source, content = text bytes)."""
    d = t.documents
    return d.select(
        F.col("doc_id"),
        F.col("source").alias("logical_name"),
        F.encode(F.col("text"), "UTF-8").alias("content"),
    )


def digests(t: Tables) -> DataFrame:
    """Stage ledgers over ``documents``: recorded vs current digest per path.

    pipeline = lang, stage = source, path = doc_id, kind = output when doc_id % 5 = 0, else
    dependency.  The current snapshot has
    changed text when doc_id % 97 = 0, is missing when doc_id % 193 = 0 and has
    extra paths (doc_id + 1e9) when doc_id % 197 = 0.
    """
    from ..functions.hashing import git_blob_digest

    d = t.documents.select("doc_id", "lang", "source", "text")
    base = d.select(
        F.col("lang").alias("pipeline"),
        F.col("source").alias("stage"),
        F.col("doc_id").alias("path"),
        F.col("text"),
    )
    recorded = base.select(
        "pipeline", "stage", "path", F.lit("recorded").alias("snapshot"),
        git_blob_digest(F.encode("text", "UTF-8")).alias("digest"),
    )
    cur_text = F.when(F.col("path") % 97 == 0, F.concat(F.col("text"), F.lit(" "))).otherwise(F.col("text"))
    current = base.where(F.col("path") % 193 != 0).select(
        "pipeline", "stage", "path", F.lit("current").alias("snapshot"),
        git_blob_digest(F.encode(cur_text, "UTF-8")).alias("digest"),
    )
    extra = base.where(F.col("path") % 197 == 0).select(
        "pipeline", "stage", (F.col("path") + 1000000000).alias("path"), F.lit("current").alias("snapshot"),
        git_blob_digest(F.encode("text", "UTF-8")).alias("digest"),
    )
    kind = F.when(F.col("path") % 5 == 0, F.lit("output")).otherwise(F.lit("dependency"))
    return recorded.unionByName(current).unionByName(extra).withColumn("kind", kind)


def stages(t: Tables) -> DataFrame:
    """Declared stages: position = number in the source's name, except that src7 stands
    first; the ledger's status is failed for position 11."""
    d = t.documents.select(F.col("lang").alias("pipeline"), F.col("source").alias("stage")).distinct()
    number = F.regexp_extract("stage", "([0-9]+)$", 1).try_cast("int")
    return d.select("pipeline", "stage", F.when(number == 7, -1).otherwise(number).alias("position"), F.when(number == 11, F.lit("failed")).otherwise(F.lit("success")).alias("status"))


def stage_edges(t: Tables) -> DataFrame:
    """Declared inputs of stages: the one of number k reads those of k // 2 and k // 3 (none
    reads itself), of k % 9 = 4 also ``gone``, which is no stage; in the pipeline ``de``
    number 3 also reads 6, which reads 3."""
    s = stages(t).select("pipeline", "stage", F.regexp_extract("stage", "([0-9]+)$", 1).try_cast("int").alias("k"))
    name = lambda k: F.concat(F.lit("src"), k.cast("int").cast("string"))
    parents = F.array_compact(F.array(
        F.when(F.col("k") > 0, name(F.floor(F.col("k") / 2))), F.when(F.col("k") > 0, name(F.floor(F.col("k") / 3))),
        F.when(F.col("k") % 9 == 4, F.lit("gone")), F.when((F.col("pipeline") == "de") & (F.col("k") == 3), F.lit("src6"))))
    return s.select("pipeline", "stage", F.explode(parents).alias("parent"))


def payloads(t: Tables) -> DataFrame:
    """JSON request payloads built from telemetry rows.

    Keys are dropped (absent, not null) by rule: ``cpu_usage`` when
    l_partkey % 11 = 0; ``timestamp`` when % 12 = 0, with the five calendar
    fields sent instead when % 24 = 0; ``latency_ms`` is blank text when
    % 13 = 0; ``vCPU`` is the text ``x`` when % 29 = 0; ``RAM_GB`` is ``zz`` when % 31 = 0;
    ``month`` is ``June`` when calendar fields are sent and % 7 = 0.  The body is null, no
    JSON, a list or a text when % 101 is 1, 2, 3 or 4.
    """
    tel = telemetry(t)
    pk = F.col("l_partkey")
    ts = F.col("ts")
    cal = pk % 24 == 0
    fields = [
        F.when(pk % 12 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(cal, F.hour(ts)).alias("hour"),
        F.when(cal, F.dayofmonth(ts)).alias("day"),
        F.when(cal, F.when(pk % 7 == 0, F.lit("June")).otherwise(F.month(ts).cast("string"))).alias("month"),
        F.when(cal, F.weekday(ts)).alias("day_of_week"),
        F.when(cal, F.weekday(ts).isin(5, 6).cast("int")).alias("is_weekend"),
        F.when(pk % 11 != 0, F.col("cpu_usage")).alias("cpu_usage"),
        F.col("memory_usage"), F.col("net_io"), F.col("disk_io"),
        F.col("cloud_provider"), F.col("region"), F.col("vm_type"),
        F.when(pk % 29 == 0, F.lit("x")).otherwise(F.col("vCPU").cast("string")).alias("vCPU"),
        F.when(pk % 31 == 0, F.lit("zz")).otherwise(F.col("RAM_GB").cast("string")).alias("RAM_GB"), F.col("target"),
        F.when(pk % 13 == 0, F.lit("")).otherwise(F.col("latency_ms").cast("string")).alias("latency_ms"),
        F.col("throughput"), F.col("utilization"),
    ]
    body = (F.when(pk % 101 == 1, F.lit(None)).when(pk % 101 == 2, F.lit("not json")).when(pk % 101 == 3, F.lit("[1]"))
            .when(pk % 101 == 4, F.lit('"x"')).otherwise(F.to_json(F.struct(*fields))))
    return tel.select("row_id", "l_orderkey", "l_linenumber", "l_partkey", body.alias("payload"))
