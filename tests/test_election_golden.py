"""Election goldens: the shipped registry's finalists and the six acceptance cases."""

import json

import pytest
from pyspark.sql import functions as F

from stratus.functions.hashing import params_fingerprint
from stratus.operators import election as ele
from stratus.sources import io

# Trial id, number of trees, RMSE, MAE, R2, prediction variance; all other
# parameters are those of PARAMS.
PARAMS = {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt", "random_state": 42}
REGISTRY = [
    ("trial_200", 800, 0.55, 0.48, 0.88, 4.0),
    ("trial_201", 750, 0.05, 0.04, 0.999, 5.75),
    ("trial_202", 420, 1.55, 1.22, 0.71, 2.4),
    ("trial_203", 430, 1.55, 1.22, 0.71, 2.1),
    ("trial_204", 799, 0.35, 0.25, 0.98, 1.8),
    ("trial_205", 500, 0.12, 4.8, 0.99, 2.0),
]
FINGERPRINTS = {
    "trial_200": "bc36528edb521abd12c99aebc41b9621951cc72095089e6d783863118c214231",
    "trial_204": "878bf15af82a7de4825beb8e74934dcb8d6d709af59014eba6ae459702c08dc9",
}
# The acceptance cases, (winner, denied fingerprints, trials).
CASES = {
    "borda over one good metric": ("syn_borda_champ", [], [
        ("syn_blend_bait", 200, 0.05, 9.0, 0.995, 2.0), ("syn_borda_champ", 210, 0.3, 0.28, 0.92, 2.0),
        ("syn_filler", 220, 0.6, 0.55, 0.7, 2.0), ("syn_mid", 230, 0.45, 0.4, 0.8, 2.0)]),
    "the strong one is denied": ("syn_weak_allowed", ["26c43b5ab34c102eeee701ba4d68072541ea9319ec0223d768e334491ab20830"], [
        ("syn_strong_denied", 300, 0.1, 0.1, 0.99, 1.0), ("syn_weak_allowed", 200, 1.0, 0.9, 0.7, 1.0)]),
    "bounds are included": ("syn_boundary", [], [("syn_boundary", 800, 0.5, 0.4, 0.9, 1.0)]),
    "the strong one is unstable": ("syn_stable", [], [("syn_stable", 200, 1.0, 0.9, 0.7, 4.4), ("syn_unstable_strong", 300, 0.1, 0.1, 0.99, 5.5)]),
    "ties share ranks": ("syn_b", [], [("syn_a", 200, 1.0, 0.5, 0.5, 3.0), ("syn_b", 210, 1.0, 0.6, 0.6, 3.0), ("syn_c", 220, 2.0, 0.7, 0.4, 3.0)]),
    "three metrics": ("syn_c3", [], [("syn_c1", 200, 0.1, 2.0, 0.5, 3.0), ("syn_c2", 210, 2.0, 0.1, 0.5, 3.0), ("syn_c3", 220, 1.0, 1.0, 0.9, 3.0)]),
}


def _docs(trials):
    return [{"trial_id": t, "params": {"n_estimators": n, **PARAMS}, "metrics": {"RMSE": rmse, "MAE": mae, "R2": r2}, "pred_var": v} for t, n, rmse, mae, r2, v in trials]


@pytest.fixture()
def registry(spark, scratch):
    """The finalists as files, with one trial of odd parameters and a second file of a
    trial id that already stands in an earlier one."""
    docs = _docs(REGISTRY)
    docs.append({**docs[0], "trial_id": "trial_047", "params": {**docs[0]["params"], "max_features": 0.5, "max_depth": 8}})
    for d in docs:
        with open(f"{scratch}/{d['trial_id']}.json", "w") as f:
            json.dump(d, f, indent=2)
    with open(f"{scratch}/zz_again.json", "w") as f:
        json.dump({**docs[2], "metrics": {"RMSE": 0.0, "MAE": 0.0, "R2": 1.0}}, f)
    return io.read_trials(spark, scratch)


def _docs_frame(spark, trials):
    rows = []
    for t in trials:
        p = t["params"]
        rows.append((
            "case", t["trial_id"], int(p["n_estimators"]), p.get("max_depth"), str(p["max_features"]), int(p["random_state"]),
            float(t["metrics"]["RMSE"]), float(t["metrics"]["MAE"]), float(t["metrics"]["R2"]), float(t["pred_var"]),
            json.dumps(p),
        ))
    return spark.createDataFrame(rows, "election_id string, trial_id string, n_estimators bigint, max_depth bigint, "
                                       "max_features string, random_state bigint, RMSE double, MAE double, R2 double, "
                                       "pred_var double, params_json string")


def test_registry_elects_trial_200(spark, registry):
    tr = registry.withColumn("election_id", F.lit("registry"))
    deny = spark.createDataFrame([(FINGERPRINTS["trial_204"].upper(),)], "fingerprint string")
    c = ele.Constraints().frame(spark)
    assert ele.elect(tr, c, deny).first()["winner"] == "trial_200"
    el = ele.eligibility(ele.one_per_trial(tr), c, deny)
    surv = ele.borda(el.where(F.col("reason").isNull()))
    assert {r["trial_id"]: r["borda"] for r in surv.collect()} == {"trial_200": 7.0, "trial_205": 6.0, "trial_203": 2.5, "trial_202": 2.5}
    assert {r["trial_id"]: r["reason"] for r in el.collect() if r["reason"]} == {"trial_201": "pred_var", "trial_204": "denied", "trial_047": "max_features"}
    assert {r["trial_id"]: r["copeland"] for r in ele.copeland_for_leaders(surv).collect()} == {"trial_200": 2}


def test_fingerprint_goldens(registry):
    fp = {r["trial_id"]: r["fp"] for r in registry.select("trial_id", params_fingerprint(F.col("params_json")).alias("fp")).collect()}
    assert {k: fp[k] for k in FINGERPRINTS} == FINGERPRINTS


@pytest.mark.parametrize("case", CASES)
def test_acceptance_cases(spark, case):
    winner, denied, trials = CASES[case]
    deny = spark.createDataFrame([(x,) for x in denied or ["#none"]], "fingerprint string")
    w = ele.elect(_docs_frame(spark, _docs(trials)), ele.Constraints().frame(spark), deny).collect()
    assert w[0]["winner"] == winner


def test_no_survivor_gives_none(spark):
    tr = _docs_frame(spark, [{"trial_id": "x", "params": {"n_estimators": 5, "max_depth": None, "max_features": "sqrt",
                                                          "random_state": 42}, "metrics": {"RMSE": 1, "MAE": 1, "R2": 0.5}, "pred_var": 1}])
    deny = spark.createDataFrame([("#none",)], "fingerprint string")
    w = ele.elect(tr, ele.Constraints().frame(spark), deny).collect()
    assert w[0]["status"] == "NONE" and w[0]["winner"] is None


def test_nine_digit_comparison_ties(spark):
    base = {"n_estimators": 200, "max_depth": None, "max_features": "sqrt", "random_state": 42}
    trials = [
        {"trial_id": "a", "params": dict(base, n_estimators=200), "metrics": {"RMSE": 1.0000000001, "MAE": 0.5, "R2": 0.5}, "pred_var": 2.0},
        {"trial_id": "b", "params": dict(base, n_estimators=210), "metrics": {"RMSE": 1.0000000002, "MAE": 0.5, "R2": 0.5}, "pred_var": 1.0},
    ]
    tr = _docs_frame(spark, trials)
    deny = spark.createDataFrame([("#none",)], "fingerprint string")
    c = ele.Constraints().frame(spark)
    # full doubles: a has the lower RMSE and wins on Borda
    assert ele.elect(tr, c, deny).first()["winner"] == "a"
    # 9 significant digits: RMSE ties, Borda and Copeland tie, lower pred_var (b) wins
    assert ele.elect(tr, c, deny, digits=9).first()["winner"] == "b"
