"""Whitening against numpy."""

import math

import numpy as np
from conftest import SF_SMALL

from stratus.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x int, index int, n string, y int"


def plain(vectors, k=4):
    """{row number: (n, deviations, whitened up to signs, explained)} for vectors of one length."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = fit.astype(float) - (s.astype(float) / n)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    white = (x.astype(float) - s.astype(float) / n) @ vecs[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
    return n, [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x], white, values[:k] / values.sum()


def check(got, ids, vectors, k=4):
    n, deviation, white, explained = plain(vectors, k)
    k = min(k, len(vectors[0]))
    assert len(got) == len(vectors) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        mine = np.array([by[i][c][0].whitened for i in ids])
        sign = 1 if mine @ white[:, c - 1] > 0 else -1
        assert np.allclose(mine, sign * white[:, c - 1], rtol=1e-9, atol=1e-9)
    for i, d in zip(ids, deviation):
        for c in range(1, k + 1):
            assert {(r.n, r.deviation) for r in by[i][c]} == {(n, d)}
            assert abs(by[i][c][0].explained / explained[c - 1] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_equals_numpy(spark, monkeypatch):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(150, 6)) * [5, 4, 3, 2, 1, 0.5] + 40).round(3).tolist()
    vectors += [vectors[0]] * 50 + [[v + 1e-7 for v in vectors[1]]]  # copies, and equal after rounding or not
    bad = [None, [], [1.0, None, 3.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), *[0.0] * 5], [float("-inf"), *[0.0] * 5]]
    rows = [(i, v, 1, 2, "n", 3) for i, v in enumerate(vectors + bad)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block_rows, splits in ((1024, 16), (7, 2)):
        monkeypatch.setattr(wh, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(wh, "SPLIT_BLOCKS", splits)
        check(wh.whiten(docs).collect(), range(len(vectors)), vectors)
    monkeypatch.setattr(wh, "BLOCK_COLS", 4)
    check(wh.whiten(docs, n_components=2).collect(), range(len(vectors)), vectors, 2)


def test_defined_cases(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], "vec_id long, embedding array<float>")
    got = wh.whiten(one).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == sorted((i, c, 1, 0, None, None, None) for i in ("1", "1", "None") for c in (1, 2))
    lengths = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(5)] + [(10 + i, [float(i)]) for i in range(3)], "vec_id long, embedding array<double>")
    got = wh.whiten(lengths).collect()
    check([r for r in got if r.vec_id < 10], range(5), [[i, i * i] for i in range(5)])
    check([r for r in got if r.vec_id >= 10], range(10, 13), [[i] for i in range(3)])
    huge = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in wh.whiten(huge).collect()} <= {None, 1}
    assert wh.whiten(one.limit(0)).count() == 0


def test_query(spark):
    got = wh.query(spark, SF_SMALL)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    check(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
