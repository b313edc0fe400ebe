"""Edge semantics pinned against plain-Python / NumPy twins."""

import collections
import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratus.operators import drift, evaluate, features, promotion, requests_log


def test_weekday_monday_zero_and_weekend(spark):
    df = spark.createDataFrame([("1/1/2024 0:00",), ("1/6/2024 13:30",), ("1/7/2024 23:59",)], "timestamp string")
    out = features.temporal_features(df, features.parse_timestamp(F.col("timestamp"))).collect()
    assert [r["day_of_week"] for r in out] == [0, 5, 6]
    assert [r["is_weekend"] for r in out] == [0, 1, 1]
    assert out[1]["hour"] == 13


def test_unknown_category_encodes_to_zero(spark):
    fit = spark.createDataFrame([("AWS", "a", "x", "t"), ("GCP", "b", "y", "t")], "cloud_provider string, region string, vm_type string, target string")
    dic = features.fit_encoders(fit)
    new = spark.createDataFrame([("GCP", "zz", "x", "t")], "cloud_provider string, region string, vm_type string, target string")
    r = features.apply_encoders(new, dic).first()
    assert (r["cloud_provider_encoded"], r["region_encoded"], r["vm_type_encoded"]) == (1, 0, 0)
    unk = {x["column"]: x["unknown_rows"] for x in features.encoder_unknowns(new, dic).collect()}
    assert unk == {"region": 1}


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0)],
                               "cpu_usage double, memory_usage double, net_io double, disk_io double, throughput double, latency_ms double, utilization double, RAM_GB double, vCPU int")
    assert features.ratio_features(df).first()["ram_per_vcpu"] is None


def test_r2_constant_label(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert evaluate.regression_metrics(df.limit(2), "y", "p").first()["R2"] == 1.0
    assert evaluate.regression_metrics(df, "y", "p").first()["R2"] == 0.0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "ties": np.round(rng.normal(size=30000) * 10, 1), "wide": rng.lognormal(size=30000), "tiny": rng.normal(size=30000) * 1e-7,
        "one": np.ones(30000), "text": [str(x) for x in rng.integers(0, 50, size=30000)],
    })
    df = spark.createDataFrame(pdf).withColumn("void", F.lit(None).cast("double")).repartition(7)
    probs = [0.0, 0.01, 0.3333, 0.5, 0.99, 1.0]
    got = {(r["field"], r["prob"]): r["q"] for r in drift.exact_quantiles(df, [*pdf.columns, "void", "absent"], probs).collect()}
    assert len(got) == len(pdf.columns) * len(probs)
    for (f, p), q in got.items():
        want = np.quantile(pdf[f].astype(float).to_numpy(), p)
        assert abs(q - want) <= 1e-12 * max(1, abs(want)) + 1e-16


def test_psi_of_tiny_values(spark):
    rng = np.random.default_rng(6)
    e, a = (spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=1000) * 1e-7 + k * 1e-7})) for k in (0, 1))
    r = drift.psi(e, a, "x").first()
    assert r["n_edges"] == 11 and r["psi"] > 0.5


def test_metrics_of_small_errors_are_not_rounded(spark):
    df = spark.createDataFrame([(0.002 * (-1) ** i, 0.0, "test") for i in range(100)], "y double, p double, split string")
    assert abs(evaluate.regression_metrics(df, "y", "p").first()["MSE"] - 4e-6) < 1e-18


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    e, a = rng.normal(size=4000), rng.normal(0.3, 1.2, size=3000)
    edges = np.unique(np.quantile(e, np.linspace(0, 1, 11)))
    eh, _ = np.histogram(e, bins=edges)
    ah, _ = np.histogram(a, bins=edges)
    ep, ap = np.clip(eh / eh.sum(), 1e-4, None), np.clip(ah / ah.sum(), 1e-4, None)
    want = float(np.sum((ap - ep) * np.log(ap / ep)))
    ed = spark.createDataFrame(pd.DataFrame({"x": e}))
    ad = spark.createDataFrame(pd.DataFrame({"x": a}))
    got = drift.psi(ed, ad, "x").first()
    assert abs(got["psi"] - want) < 1e-5
    assert drift.psi(ed.limit(5), ad, "x").first()["psi"] == 0.0


def test_percentile_check_value(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    q = {r["prob"]: r["q"] for r in drift.exact_quantiles(df, ["v"], [0.01, 0.99]).collect()}
    assert abs(q[0.01] - 1.03) < 1e-12 and abs(q[0.99] - 3.97) < 1e-12


def test_oob_fields_band(spark):
    df = spark.createDataFrame([(40.0,), (150.0,), (float("nan"),)], "cpu_usage double")
    out = [r[0] for r in df.select(drift.oob_fields(df, {"cpu_usage": (0.0, 100.0)})).collect()]
    assert out == [[], ["cpu_usage"], []]


def _py_limiter(events, limit, window):
    hits, out = collections.defaultdict(collections.deque), {}
    for rid, ts, key in sorted(events, key=lambda e: (e[1], e[0])):
        b = hits[key]
        while b and (ts - b[0]).total_seconds() > window:
            b.popleft()
        ok = len(b) < limit
        if ok:
            b.append(ts)
        out[rid] = ok
    return out


def _py_cache(events, ttl):
    st, out = {}, {}
    for rid, ts, key in sorted(events, key=lambda e: (e[1], e[0])):
        hit = key in st and not (ttl > 0 and (ts - st[key]).total_seconds() > ttl)
        if not hit:
            st[key] = ts
        out[rid] = hit
    return out


def _random_events(n, keys, seed):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    # bursts and quiet gaps, many exact-boundary ties
    ev, t = [], t0
    for i in range(n):
        t = t + dt.timedelta(seconds=rnd.choice([0, 1, 30, 60, 60, 61, 300, 3600]))
        ev.append((i, t, f"k{rnd.randrange(keys)}"))
    return ev


def test_rate_limiter_matches_python(spark):
    ev = _random_events(600, 4, 1)
    df = spark.createDataFrame(ev, "request_id bigint, ts timestamp_ntz, k string")
    for limit in (1, 2, 5):
        got = {r["request_id"]: r["admitted"] for r in requests_log.rate_limit(df, "k", "ts", "request_id", limit, "60 seconds").collect()}
        assert got == _py_limiter(ev, limit, 60)
    assert all(r["admitted"] for r in requests_log.rate_limit(df, "k", "ts", "request_id", 0, "60 seconds").collect())


def test_cache_replay_matches_python(spark):
    ev = _random_events(600, 3, 2)
    df = spark.createDataFrame(ev, "request_id bigint, ts timestamp_ntz, k string")
    for ttl in (60, 300):
        got = {r["request_id"]: r["cache_hit"] for r in requests_log.cache_replay(df, "k", "ts", "request_id", f"{ttl} seconds").collect()}
        assert got == _py_cache(ev, ttl)
    got0 = {r["request_id"]: r["cache_hit"] for r in requests_log.cache_replay(df, "k", "ts", "request_id", "0 seconds").collect()}
    assert got0 == _py_cache(ev, 0)


def test_cache_bucket_is_a_step_function(spark):
    """Steps of a bucket equal the chain from every possible entry, and are few."""
    rnd = random.Random(3)
    for age, n in ((10, 400), (50, 2000), (7, 3), (1, 1)):
        times = sorted(rnd.randrange(32 * age) for _ in range(n))
        bucket = requests_log._Exits(0, age)
        held = 0
        for t in times:
            bucket.event(t)
            held = max(held, sum(len(ends) for _, ends in bucket.chains))
        steps = bucket.steps()
        assert held <= age + 2 and len(steps) <= held
        for entry in [*range(-2 * age, 0), None]:
            last = entry
            for t in times:
                if last is None or t - last > age:
                    last = t
            found = next((miss for end, miss in steps if entry is None or end > entry + age), entry)
            assert found == last


def test_cache_replay_of_a_key_without_pauses(spark):
    """Traffic without a quiet gap, over many buckets, with ties and exact lifetimes."""
    rnd = random.Random(8)
    t, ev = dt.datetime(2024, 1, 1), []
    for i in range(3000):
        t = t + dt.timedelta(seconds=rnd.choice([0, 0, 1, 5, 10, 30]))
        ev.append((i, t, "hot" if i % 3 else rnd.choice(["a", None])))
    ev += [(9000 + i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=60 * i), "exact") for i in range(200)]
    df = spark.createDataFrame(ev, "request_id bigint, ts timestamp_ntz, k string").withColumn("more", F.lit("x"))
    for ttl in (10, 60):
        out = requests_log.cache_replay(df, "k", "ts", "request_id", f"{ttl} seconds")
        assert out.columns == ["request_id", "ts", "k", "more", "cache_hit"]
        assert {r["request_id"]: r["cache_hit"] for r in out.collect()} == _py_cache(ev, ttl)


def _by_contract(d, rel, broken, p):
    """The decision table of the bundle contract, written anew: the region of (d, rel)."""
    size = "major" if d >= p.r2_major else "minor" if d >= p.r2_minor else "flat" if d >= 0 else "loss"
    worse = "better" if rel < 0 else "same" if rel == 0 else "soft" if rel <= p.mae_tolerance else "hard"
    if broken:
        return "schema_break_accepted" if size in ("major", "minor") and worse != "hard" else "refused:schema_break"
    gain = {"major": "major_gain", "minor": "minor_gain", "flat": "stable_or_better"}
    if size == "loss":
        return "refused:dual_regression" if worse != "better" else "tradeoff_mae" if p.allow_patch else "refused:tradeoff_disabled"
    if worse in ("better", "same"):
        return gain[size]
    if size == "flat":
        return "r2_ok_mae_worse" if p.allow_patch else "refused:patch_disabled"
    return "minor_gain_mae_soft" if worse == "soft" else "refused:mae_regression"


def _py_fold(rows, p):
    out, parent = {}, {}
    for line, cid, _ts, r2, mae, fo in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if r2 < p.r2_floor or mae > p.mae_ceiling:
            out[cid] = "refused:" + ("r2_below_floor" if r2 < p.r2_floor else "mae_above_ceiling")
            continue
        if line in parent:
            r2_0, mae_0, fo_0 = parent[line]
            out[cid] = _by_contract(r2 - r2_0, (mae - mae_0) / max(mae_0, 1e-12), fo != fo_0, p)
        else:
            out[cid] = "bootstrap"
        if not out[cid].startswith("refused"):
            parent[line] = (r2, mae, fo)
    return out


def test_promotion_fold_matches_python(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(800):
        rows.append((rnd.randrange(20), i, dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60)),
                     0.85 + rnd.randrange(150) / 1000, rnd.randrange(60) / 1000, rnd.choice("AAAB")))
    df = spark.createDataFrame(rows, "line bigint, cand_id bigint, ts timestamp_ntz, R2 double, MAE double, feature_order string")
    for p in (promotion.QUERY_PARAMS, promotion.PromotionParams(), promotion.PromotionParams(r2_floor=0.0, allow_patch=False)):
        got = {r["cand_id"]: r["decision"] for r in promotion.promotion_fold(df, p).collect()}
        assert got == _py_fold(rows, p)


def test_decision_table_rows(spark):
    p = promotion.PromotionParams(r2_floor=0.0, mae_ceiling=1.0, r2_minor=0.05, r2_major=0.15, mae_tolerance=0.05)
    cases = {
        (0.20, 0.0, False): "major_gain", (0.06, -0.1, False): "minor_gain", (0.06, 0.04, False): "minor_gain_mae_soft",
        (0.06, 1.0, False): "refused:mae_regression", (0.0, 0.0, False): "stable_or_better", (0.01, 0.1, False): "r2_ok_mae_worse",
        (-0.01, -0.1, False): "tradeoff_mae", (-0.01, 0.0, False): "refused:dual_regression", (0.06, 0.0, True): "schema_break_accepted",
        (0.20, -0.1, True): "schema_break_accepted", (0.02, 0.0, True): "refused:schema_break", (0.16, 0.03, False): "minor_gain_mae_soft",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "d double, rel double, brk boolean, want string")
    got = df.select("want", promotion.step_decision(F.col("d"), F.col("rel"), F.col("brk"), p).alias("got")).collect()
    assert all(r["got"] == r["want"] == _by_contract(*k, p) for r, k in zip(got, cases))
    off = promotion.PromotionParams(allow_patch=False)
    got = df.select("d", "rel", "brk", promotion.step_decision(F.col("d"), F.col("rel"), F.col("brk"), off).alias("got")).collect()
    assert all(r["got"] == _by_contract(r["d"], r["rel"], r["brk"], off) for r in got)


def test_seal_is_reproducible():
    ring, token, tag, mac = promotion._seal(None, "1.0.0", 7, *(["ab" * 32] * 4), "0123456789abcdef")
    assert len(ring) == 64 and len(token) == 64 and len(tag) == 32 and len(mac) == 64
    assert promotion._seal(None, "1.0.0", 7, *(["ab" * 32] * 4), "0123456789abcdef")[3] == mac
    assert promotion._seal("1.0.0", "1.0.1", 7, *(["ab" * 32] * 4), "0123456789abcdef")[1] != token


def test_version_parse(spark):
    df = spark.createDataFrame([("1.2.3",), ("10.0.1",), ("v1.0.0",), ("1.0",), ("1.a.0",)], "t string")
    out = [r[0] for r in df.select(promotion.version_struct(F.col("t"))).collect()]
    assert out[0] == (1, 2, 3) and out[1] == (10, 0, 1) and out[2:] == [None, None, None]


def test_seal_audit_detects_tampering(spark):
    from conftest import SF_SMALL
    from stratus.sources import adapters
    from stratus.sources.tables import Tables

    m = promotion.manifests(promotion.promotion_fold(adapters.candidates(Tables(spark, SF_SMALL)), promotion.QUERY_PARAMS))
    audit = promotion.seal_audit(m, tamper=(F.col("cand_id") % 11 == 0))
    rows = audit.join(m.select("line", "model_version", "cand_id"), ["line", "model_version"]).collect()
    assert rows
    assert all(r["verified"] == (r["cand_id"] % 11 != 0) for r in rows)


def test_table_ready_and_model_versions(spark, scratch):
    from stratus.operators import contracts, train

    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 6.2), (4.0, 7.9)], "x double, cost double")
    assert contracts.table_ready(df, "cost")
    assert not contracts.table_ready(df.limit(0), "cost") and not contracts.table_ready(df, "nope")
    m = train.fit(df, ["x"], "cost", train.ForestParams(num_trees=3, max_depth=3, min_samples_leaf=1, max_features="all"))
    train.save_model(m, scratch, "1.0.0")
    ptr = spark.createDataFrame([(7, "1.0.0", None, "1.0.0")], "line bigint, anchor string, probe string, active string")
    back = train.load_model(scratch, pointer=ptr, line=7)
    a = [r["prediction"] for r in train.score(m, df, ["x"]).collect()]
    b = [r["prediction"] for r in train.score(back, df, ["x"]).collect()]
    assert a == b


def test_running_total_bucketed_equals_plain(spark):
    from stratus.operators.common import running_total

    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": rng.integers(0, 500, size=4000), "id": np.arange(4000), "v": rng.integers(1, 5, size=4000)})
    df = spark.createDataFrame(pdf)
    got = {r["id"]: r["cum"] for r in running_total(df, ["k", "id"], F.col("v"), "cum").collect()}
    want = pdf.sort_values(["k", "id"]).assign(cum=lambda d: d.v.cumsum()).set_index("id")["cum"].to_dict()
    assert got == want


def test_running_total_by_group_and_text(spark):
    from stratus.operators.common import running_total

    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 2000), "t": ["word%05d" % i for i in rng.permutation(2000)]})
    got = {r["t"]: r["n"] for r in running_total(spark.createDataFrame(pdf), ["t"], F.lit(1), "n", group=["g"]).collect()}
    want = pdf.sort_values("t").assign(n=lambda d: d.groupby("g", dropna=False).cumcount() + 1).set_index("t")["n"].to_dict()
    assert got == want


def test_nth_row_of_ties(spark, monkeypatch):
    """One timestamp for all rows, repeated keys and nulls: the split is still exact."""
    from stratus.operators import common
    from stratus.operators.common import nth_row
    from stratus.operators.split import temporal_split

    monkeypatch.setattr(common, "LAST_ROWS", 5)

    rng = np.random.default_rng(13)
    rows = [(dt.datetime(2024, 1, 1), int(k), "prefix-%03d" % t) for k, t in zip(rng.integers(0, 20, 1500), rng.integers(0, 400, 1500))]
    rows += [(None, 3, "x"), (dt.datetime(2023, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k int, t string")
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    order = sorted(rows, key=key)
    for n in (1, 2, 3, 300, 700, 1501, 1502):
        assert tuple(nth_row(df, ["ts", "k", "t"], n)) == order[n - 1]
    unique = spark.createDataFrame([(dt.datetime(2024, 1, 1), i) for i in range(1000)], "ts timestamp_ntz, k int")
    split = {r["k"]: r["split"] for r in temporal_split(unique, "ts", ["k"]).collect()}
    assert all(split[i] == ("train" if i < 800 else "test") for i in range(1000))


def test_encoders_join_by_column(spark):
    fit = spark.createDataFrame([("AWS", "a", "x", "t"), ("GCP", "b", "y", "u")], "cloud_provider string, region string, vm_type string, target string")
    new = spark.createDataFrame([("GCP", "zz", "x", "u"), ("AWS", "b", None, "t")], "cloud_provider string, region string, vm_type string, target string")
    out = features.apply_encoders(new, features.fit_encoders(fit))
    cols = [f"{c}_encoded" for c in features.CATEGORICAL_COLUMNS]
    assert sorted(tuple(r) for r in out.select(*cols).collect()) == [(0, 1, 0, 0), (1, 0, 0, 1)]


def test_payload_bodies_and_numbers(spark):
    import json

    from stratus.operators import contracts

    whole = {"cpu_usage": 1, "memory_usage": 2, "net_io": 3, "disk_io": 4, "cloud_provider": "a", "region": "b", "vm_type": "c", "vCPU": 2.9,
             "RAM_GB": 8, "target": "d", "latency_ms": "", "throughput": 5, "utilization": 6, "timestamp": "1/1/2024 0:00"}
    odd = [None, "not json", "[1]", '"x"']
    bad = [dict(whole, memory_usage="abc"), dict(whole, RAM_GB="zz"), {k: v for k, v in whole.items() if k != "timestamp"},
           {**{k: v for k, v in whole.items() if k != "timestamp"}, "hour": 1, "day": 1, "month": "June", "day_of_week": 0, "is_weekend": 0}]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*odd, json.dumps(whole), *map(json.dumps, bad)])], "i int, payload string")
    p = contracts.parse_payload(df, "payload")
    m = F.col("_m")
    got = {r["i"]: (r["e"], r["cast_error"], r["vCPU"]) for r in p.select("i", contracts.payload_errors(m).alias("e"), *contracts.numeric_fields(m)).collect()}
    assert all(got[i][0] == contracts.MSG_BODY for i in range(4))
    assert got[4] == (None, None, 2)
    assert got[5][1] == "could not convert: memory_usage" and got[6][1] == "could not convert: RAM_GB"
    assert got[7][0] == contracts.MSG_TEMPORAL and got[8][1] == "could not convert: month"


def test_required_columns_by_name(spark):
    from stratus.operators import contracts

    df = spark.createDataFrame([(None,)], "timestamp string")
    r = contracts.required_columns(df, ["timestamp", "cost"]).first()
    assert (r["status"], r["missing"], r["n_missing"]) == (False, "cost", 1)


def test_canary_takes_a_share_of_the_whole_range(spark):
    from stratus.operators import scoring

    n = spark.range(200000).where(scoring.canary_variant(F.col("id"), 0.5) == "probe").count()
    assert 850 < n < 1150
    assert spark.range(500).where(scoring.canary_variant(F.col("id"), 100) == "anchor").count() == 0


def test_batch_documents_are_never_lost(spark):
    from stratus.operators import scoring

    df = spark.createDataFrame([(1, '{"instances": [{"a": 1}, {"a": 2}]}'), (2, '[{"a": 3}]'), (3, "no"), (4, None), (5, "[]")], "b int, doc string")
    got = sorted((r["b"], r["index"], r["a"], r["error"]) for r in scoring.explode_batch(df, "doc", "a int", "b").collect() if r["error"] is None)
    assert got == [(1, 0, 1, None), (1, 1, 2, None), (2, 0, 3, None)]
    assert {r["b"]: r["error"] for r in scoring.explode_batch(df, "doc", "a int", "b").where("error IS NOT NULL").collect()} == {3: scoring.MSG_BATCH, 4: scoring.MSG_BATCH, 5: scoring.MSG_EMPTY}


def test_elections_keep_apart_and_reject_nulls(spark):
    from stratus.operators import election as ele

    def trial(e, t, rmse, n=200, mf="sqrt", pv=1.0):
        return (e, t, n, None, mf, 42, rmse, 0.5, 0.5, pv, '{"t": "%s%s"}' % (e, t))

    rows = [trial("e1", "t1", 1.0), trial("e1", "t2", None), trial("e1", "t3", 2.0, mf=None), trial("e1", "t4", 2.0, pv=None), trial("e1", "t5", 3.0, n=300),
            trial("e2", "t1", 5.0, n=400), trial("e2", "t1", 5.0, n=400)]
    tr = spark.createDataFrame(rows, "election_id string, trial_id string, n_estimators bigint, max_depth bigint, max_features string, "
                                     "random_state bigint, RMSE double, MAE double, R2 double, pred_var double, params_json string")
    c, deny = ele.Constraints().frame(spark), spark.createDataFrame([("#none",)], "fingerprint string")
    reasons = {r["trial_id"]: r["reason"] for r in ele.eligibility(tr, c, deny).where("election_id = 'e1'").collect()}
    assert reasons == {"t1": None, "t2": "metrics", "t3": "max_features", "t4": "pred_var", "t5": None}
    docs = {r["election_id"]: (r["winner"], r["n_survivors"], r["n_estimators"]) for r in ele.winner_documents(ele.elect(tr, c, deny), tr).collect()}
    assert docs == {"e1": ("t1", 2, 200), "e2": ("t1", 1, 400)}



def test_frames_of_two_calls_stay_readable(spark):
    from stratus.sources import io

    a, b = (io.cut_lineage(spark.range(n), "same-name") for n in (5, 7))
    assert (a.count(), b.count()) == (5, 7)


def test_split_options(spark):
    from stratus.operators.split import hash_split, temporal_split

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 40, hours=i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz")
    by_text = {r["id"] for r in temporal_split(df.withColumn("t", F.date_format("ts", "M/d/yyyy H:mm")), "t", ["id"], order="text").where("split = 'train'").collect()}
    text = lambda d: f"{d.month}/{d.day}/{d.year} {d.hour}:{d.minute:02d}"
    assert by_text == {i for i, _ in sorted(rows, key=lambda r: (text(r[1]), r[0]))[:800]}
    assert hash_split(df, F.col("id"), 20, exact=True).where("split = 'test'").count() == 200
    assert hash_split(df.where("id < 101"), F.col("id"), 20, exact=True).where("split = 'test'").count() == 21


def test_staleness_follows_the_declared_order(spark):
    from stratus.operators import lineage

    diff = spark.createDataFrame([("p", "b", "dependency", False), ("p", "b", "output", True), ("p", "a", "dependency", False), ("p", "c", "dependency", False)], "pipeline string, stage string, kind string, stale boolean")
    stages = spark.createDataFrame([("p", "c", 1, "success"), ("p", "b", 2, "success"), ("p", "a", 3, "success"), ("q", "x", 1, None)], "pipeline string, stage string, position int, status string")
    got = {(r["pipeline"], r["stage"]): (r["stale"], r["reason"], r["must_run"]) for r in lineage.staleness_plan(diff, stages).collect()}
    assert got == {("p", "c"): (False, None, False), ("p", "b"): (True, "output", True), ("p", "a"): (False, None, True), ("q", "x"): (True, "status", True)}


def test_shadow_scores_of_two_versions(spark):
    from stratus.operators import train

    df = spark.createDataFrame([(float(i), float(i * 2)) for i in range(40)], "x double, cost double")
    a, b = (train.fit(df, ["x"], "cost", train.ForestParams(num_trees=n, max_depth=3, max_features="all", seed=n)) for n in (3, 9))
    got = train.shadow_scores(a, b, df, ["x"]).collect()
    alone = {r["x"]: r["prediction"] for r in train.score(b, df, ["x"]).collect()}
    assert all(r["shadow"] == alone[r["x"]] and r["delta"] == r["shadow"] - r["primary"] for r in got)
    assert any(r["delta"] for r in got)


def test_model_queries_fit_the_reference_forest(spark, monkeypatch):
    """Every fit of the registered queries asks for 300 trees of depth 20; a session fits the
    cost and the latency forest once."""
    from conftest import SF_SMALL
    from stratus.operators import train
    from stratus.plans import queries_more as q

    asked, fit = [], train.fit

    def small(df, features, label, params, key=None):
        asked.append((label, params.num_trees, params.max_depth))
        return fit(df, features, label, train.ForestParams(num_trees=2, max_depth=3), key)

    monkeypatch.setattr(train, "fit", small)
    monkeypatch.setattr(q, "_MODELS", {}, raising=False)
    for run in (q.q_cost_model, q.q_latency_model, q.q_batch_score, q.q_cv_r2):
        run(spark, SF_SMALL)
    assert sorted(asked) == [("cost", 300, 20)] * 4 + [("latency_ms", 300, 20)]


def test_numeric_fields_in_columns_of_their_own(spark):
    """The same values and errors as from the map, but no field is looked up twice."""
    from pyspark.sql import functions as F

    from stratus.operators import contracts as con

    rows = [(None,), ("{}",), ('{"cpu_usage": "x", "vCPU": "2.7", "latency_ms": " ", "month": "June"}',), ('{"timestamp": "t", "month": "June", "RAM_GB": null, "vCPU": "zz", "latency_ms": "a"}',), ('{"cpu_usage": 1.5, "hour": 3, "day": "4.9"}',)]
    p = con.parse_payload(spark.createDataFrame(rows, "payload string"), "payload")
    wide, fields = con.with_numeric_fields(p, F.col("_m"))
    got = wide.select("payload", *fields)
    assert sorted(map(str, got.collect())) == sorted(map(str, p.select("payload", *con.numeric_fields(F.col("_m"))).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[cpu_usage]") == plan.count("[month]") == 1
