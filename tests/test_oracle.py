"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from stratus.sources.tables import TABLE_NAMES

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in idx) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_model():
    rows_only = {"model_metrics", "model_predictions", "oob_metrics", "shadow_fitted", "batch_predictions", "elected_predictions"}  # test_forest.py
    own = {k for k in QUERIES if k != "pipeline" and not (k.startswith("op") and k[2].isdigit())}
    assert own - set(SQL) == rows_only


def test_copeland_is_named_for_the_leaders_it_scores():
    for registered in (QUERIES, SQL):
        assert "copeland_leaders" in registered and "copeland" not in registered


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = df.columns
    got = _rows(cols, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[key])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    assert got == _rows(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert {r["split"] for r in rows} == {"train", "test"}
