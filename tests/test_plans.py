"""Physical plans of every registered query avoid non-scaling operators."""

import sys
from pathlib import Path

import __spark_entry__ as entry
from conftest import SF_SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from plan_audit import audit  # noqa: E402


def test_no_cartesian_or_nested_loop_joins(spark):
    bad = {}
    for k, q in entry.queries().items():
        a = audit(q(spark, SF_SMALL))
        if a["cartesian"] or a["bnlj"]:
            bad[k] = a
    assert not bad, bad


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from stratus.sources import adapters
    from stratus.sources.tables import Tables

    df = adapters.requests(Tables(spark, SF_SMALL)).where(F.col("endpoint") == "error").select("request_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def _plan(spark, key):
    return entry.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_split_reads_each_table_once(spark):
    """The split is a comparison with one row: as many scans as without it, no window."""
    plan = _plan(spark, "temporal_split")
    assert plan.count("FileScan") == _plan(spark, "hash_split").count("FileScan") and "Window" not in plan


def test_election_shuffles_little(spark):
    assert audit(entry.queries()["election_winner"](spark, SF_SMALL))["shuffle"] < 20


def test_one_python_node_per_fold(spark):
    for key in ("promotion_fold", "catalog_packages", "rate_limit"):
        plan = _plan(spark, key)
        assert plan.count("MapInPandas") == 1, key


def test_quantiles_move_no_table(spark):
    """Ranges are read from two aggregates over the table; the result is a few rows."""
    assert "FileScan" not in _plan(spark, "training_ranges")


def test_borda_reads_written_survivors(spark):
    """Parameter sets are fingerprinted once, not once more when points are joined back."""
    from conftest import SF_SMALL

    from stratus.plans import queries_more as q

    for query in (q.q_borda_points, q.q_copeland_leaders):
        assert "sha2" not in query(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
