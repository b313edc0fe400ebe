"""Copeland scores by dominance counts, stage graphs and canonical keys against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from stratus.functions import hashing as hsh
from stratus.operators import election as ele
from stratus.operators import lineage as lin


def _copeland(rows):
    """{(election, trial): score} by all pairs."""
    out = {}
    for e, t, *m in rows:
        out[e, t] = 0
        for e2, t2, *n in rows:
            if e2 == e and t2 != t:
                sign = [(a > b) - (a < b) for a, b in zip((-m[0], -m[1], m[2]), (-n[0], -n[1], n[2]))]
                out[e, t] += sum(sign) > 0
    return out


def _survivors(seed, sizes, values):
    rng = random.Random(seed)
    return [(f"e{e}", f"t{i:04d}", *[float(rng.randrange(v)) for v in values]) for e, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("values, block_bits", [((4, 5, 6), 2), ((1000, 1000, 1000), 3), ((1, 40, 40), 2), ((2, 2, 300), 1), ((1, 1, 1), 2)])
def test_copeland_equals_all_pairs(spark, values, block_bits):
    rows = _survivors(7, [1, 2, 9, 130], values)
    got = ele.copeland(spark.createDataFrame(rows, "election_id string, trial_id string, RMSE double, MAE double, R2 double"), block_bits)
    assert {(r["election_id"], r["trial_id"]): r["copeland"] for r in got.collect()} == _copeland(rows)


def test_copeland_zeros_and_no_survivors(spark):
    rows = [("e", "a", 0.0, 1.0, -0.0), ("e", "b", -0.0, 1.0, 0.0), ("e", "c", 0.0, 2.0, 0.0)]
    frame = spark.createDataFrame(rows, "election_id string, trial_id string, RMSE double, MAE double, R2 double")
    assert {r["trial_id"]: r["copeland"] for r in ele.copeland(frame, 1).collect()} == {"a": 1, "b": 1, "c": 0}
    assert ele.copeland(frame.where("false")).count() == 0


def test_copeland_blocks_are_bounded(spark, monkeypatch):
    """One election with ties in every metric: no block has more rows than its bits allow."""
    seen = spark.sparkContext.accumulator(0)
    inner = ele._block_counts

    def counted(names):
        count = inner(names)

        def run(rows):
            if len(rows) > 8:
                seen.add(1)
            return count(rows)

        return run

    monkeypatch.setattr(ele, "_block_counts", counted)
    rows = _survivors(3, [200], (2, 3, 2))
    got = ele.copeland(spark.createDataFrame(rows, "election_id string, trial_id string, RMSE double, MAE double, R2 double"), 3)
    assert {(r["election_id"], r["trial_id"]): r["copeland"] for r in got.collect()} == _copeland(rows)
    assert seen.value == 0


def _plan(spark, own, edges):
    o = spark.createDataFrame(own, "pipeline string, stage string, reason string")
    e = spark.createDataFrame(edges, "pipeline string, stage string, parent string")
    return {(r["pipeline"], r["stage"]): (r["reason"], r["must_run"], r["error"]) for r in lin.stage_graph(o, e).collect()}


def test_stage_graph_diamond_and_unknown_parent(spark):
    own = [("p", s, "output" if s == "b" else None) for s in "abcdef"] + [("q", "b", None)]
    edges = [("p", "b", "a"), ("p", "c", "a"), ("p", "d", "b"), ("p", "d", "c"), ("p", "d", "c"), ("p", "e", "c"),
             ("p", "f", "nobody"), ("p", "nobody", "b"), ("p", "a", None), ("q", "b", "a")]
    assert _plan(spark, own, edges) == {
        ("p", "a"): (None, False, None), ("p", "b"): ("output", True, None), ("p", "c"): (None, False, None),
        ("p", "d"): (None, True, None), ("p", "e"): (None, False, None), ("p", "f"): ("parent", True, None),
        ("q", "b"): ("parent", True, None)}


def test_stage_graph_cycles(spark):
    own = [("p", s, "status" if s == "a" else None) for s in "abcdx"] + [("q", "a", None)]
    edges = [("p", "b", "a"), ("p", "b", "c"), ("p", "c", "b"), ("p", "d", "c"), ("p", "x", "x"), ("q", "a", None)]
    assert _plan(spark, own, edges) == {
        ("p", "a"): ("status", True, None), ("p", "b"): (None, None, "cycle"), ("p", "c"): (None, None, "cycle"),
        ("p", "d"): (None, None, "cycle"), ("p", "x"): (None, None, "cycle"), ("q", "a"): (None, False, None)}
    assert _plan(spark, [], []) == {}


def _canonical(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["c"] for r in df.select("i", hsh.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]


TEXTS = [
    '{"b": 1, "a": 1.0}', '{"a": 1e3, "c": [1.50, -0.0, -0, 0.0001, 0.00001, 1e16, 123456789012345678, 1E-7, 1e22, 12345678.25]}',
    '{"t": "holds \\": 1.0,", "n": ": 1.0,", "s": "n5", "q": "x\\"n5", "e": "end\\\\", "k\\"s": ",\\"s"}', '[1.0,[2],{"n1":"s1"}]', '"n5"', "95", "95.0",
    '{"é": "日本 \U0001F600 \\u00e9 \\n \\u001f \\/ \x7f", "z": null, "y": true, "x": false}', '{"b":{"d":[{}],"c":[]},"a":""}', "1e999", '{"a": 0.1, "A": 100.0}',
]


def test_canonical_json_equals_python(spark):
    want = [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) for t in TEXTS]
    assert _canonical(spark, TEXTS) == want


def test_canonical_numbers_equal_python(spark):
    rng = random.Random(5)
    numbers = [round(rng.uniform(-10, 10) * 10.0 ** rng.randrange(-12, 20), rng.randrange(0, 9)) for _ in range(400)]
    numbers += [float(f"{rng.randrange(1, 10**12)}e{rng.randrange(-30, 30)}") for _ in range(400)]
    texts = [f"{x:.15g}" for x in numbers]
    assert _canonical(spark, texts) == [json.dumps(json.loads(t)) for t in texts]


def test_canonical_json_of_no_json(spark):
    assert _canonical(spark, [None, "", "{", "01", "1.2.3", "{'a': 1}", '{"a": 1, "a": 2}', "-", '"', "nan"]) == [None] * 10


def test_cache_keys_keep_kinds_apart(spark):
    texts = ['{"a": 95}', '{"a": 95.0}', '{"a": "95"}', '{ "a":95 }', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for version in ("1.0.0", 'v"é'):
        got = [r["k"] for r in df.select("i", hsh.cache_key(F.col("t"), F.lit(version)).alias("k")).orderBy("i").collect()]
        want = [t and hashlib.sha256(json.dumps({"p": json.loads(t), "v": version}, separators=(",", ":")).encode()).hexdigest() for t in texts]
        assert got == want and len(set(got)) == 4


def test_odd_parameters_reject_a_trial_and_not_the_job(spark):
    cols = "election_id string, trial_id string, n_estimators int, max_features string, random_state int, max_depth int, pred_var double, RMSE double, MAE double, R2 double, params_json string"
    row = lambda t, p: ("e", t, 200, "sqrt", 42, None, 1.0, 0.1, 0.1, 0.9, p)
    trials = spark.createDataFrame([row("a", '{"x": 1.0, "y": 1e3}'), row("b", "{"), row("c", None)], cols)
    deny = spark.createDataFrame([("#none",)], "fingerprint string")
    got = {r["trial_id"]: r["reason"] for r in ele.eligibility(trials, ele.Constraints().frame(spark), deny).collect()}
    assert got == {"a": None, "b": "params", "c": "params"}
