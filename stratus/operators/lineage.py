"""Stage lineage: digest snapshots, recorded-vs-current comparison, staleness of lists and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut_lineage


def entry_hash(path: Column, digest: Column) -> Column:
    """60-bit integer from SHA-256 of ``path|digest`` (for order-free set digests)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", path.cast("string"), digest), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def snapshot(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Per stage: number of entries and an order-independent set digest
    (count + sum of entry hashes), computed with a partial aggregate instead
    of collecting the stage's file list."""
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("n_paths"),
        F.concat_ws(":", F.count("*").cast("string"), F.sum(entry_hash(F.col("path"), F.col("digest"))).cast("string")).alias("snapshot_digest"),
    )


def digest_diff(recorded: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on (keys, path); a stage is stale unless key sets and
    digests agree exactly (null-safe)."""
    r = recorded.select(*keys, "path", F.col("digest").alias("rec"))
    c = current.select(*keys, "path", F.col("digest").alias("cur"))
    j = r.join(c, [*keys, "path"], "full")
    return j.groupBy(*keys).agg(
        F.count_if(F.col("rec").isNotNull() & F.col("cur").isNotNull() & (F.col("rec") != F.col("cur"))).alias("n_changed"),
        F.count_if(F.col("cur").isNull()).alias("n_missing"),
        F.count_if(F.col("rec").isNull()).alias("n_extra"),
        (~F.bool_and(F.col("rec").eqNullSafe(F.col("cur")))).alias("stale"),
    )


def own_reasons(diff: DataFrame, stages: DataFrame) -> DataFrame:
    """``stages`` with ``reason``: why a stage is stale by itself (its ledger has no success,
    or a dependency or an output differs), else null."""
    per = diff.groupBy("pipeline", "stage").agg(
        F.bool_or(F.col("stale") & (F.col("kind") == "dependency")).alias("dep"), F.bool_or(F.col("stale") & (F.col("kind") == "output")).alias("out"))
    reason = (F.when(~F.col("status").eqNullSafe(F.lit("success")), F.lit("status"))
              .when(F.col("dep"), F.lit("dependency")).when(F.col("out"), F.lit("output")))
    return stages.join(per, ["pipeline", "stage"], "left").withColumn("reason", reason).drop("dep", "out")


def staleness_plan(diff: DataFrame, stages: DataFrame) -> DataFrame:
    """Which stages must run: (pipeline, stage, position, stale, reason, must_run).

    ``stages`` declares each pipeline's stages in order (position) and the status its
    ledger recorded.  A stale stage (``own_reasons``) forces every later one to run.  The
    window is per pipeline over its stage list (one row per stage)."""
    w = Window.partitionBy("pipeline").orderBy("position", "stage").rowsBetween(Window.unboundedPreceding, 0)
    s = own_reasons(diff, stages).withColumn("stale", F.col("reason").isNotNull())
    return s.select("pipeline", "stage", "position", "stale", "reason", F.bool_or("stale").over(w).alias("must_run"))


def stage_graph(own: DataFrame, edges: DataFrame) -> DataFrame:
    """Which stages of a graph must run: (pipeline, stage, reason, must_run, error).

    ``own`` has a row per stage with the reason why it is stale by itself (or null), ``edges``
    a row (pipeline, stage, parent) per declared input; repeats count once, edges of stages
    that aren't declared are left out, and one to a parent that isn't declared gives the reason
    ``parent``.  A stage must run if it or any ancestor is stale.  Stages on a cycle or below
    one have no order to run in: their error is ``cycle`` and must_run is null.

    A round decides the stages whose parents are all decided and tells their children, so an
    edge is used once and there are as many rounds as the longest path has stages.
    """
    e = edges.select("pipeline", "stage", "parent").where("parent is not null").distinct()
    names = own.select("pipeline", F.col("stage").alias("parent"), F.lit(True).alias("known"))
    e = cut_lineage(e.join(names, ["pipeline", "parent"], "left").withColumn("known", F.col("known").isNotNull()), "stage-edges")
    n = e.groupBy("pipeline", "stage").agg(F.count_if("known").alias("left"), F.bool_or(~F.col("known")).alias("odd"))
    reason = F.coalesce("reason", F.when(F.col("odd"), F.lit("parent")))
    s = own.select("pipeline", "stage", "reason").join(n, ["pipeline", "stage"], "left").withColumn("reason", reason)
    todo = cut_lineage(s.select("pipeline", "stage", "reason", F.col("reason").isNotNull().alias("must_run"), F.coalesce("left", F.lit(0)).alias("left")), "stages")
    decided = []
    while not (ready := todo.where("left = 0")).isEmpty():
        decided.append(ready)
        told = ready.select("pipeline", F.col("stage").alias("parent"), F.col("must_run").alias("up")).join(e, ["pipeline", "parent"])
        told = told.groupBy("pipeline", "stage").agg(F.count("*").alias("n"), F.bool_or("up").alias("up"))
        rest = todo.where("left > 0").join(told, ["pipeline", "stage"], "left")
        todo = cut_lineage(rest.select("pipeline", "stage", "reason", (F.col("must_run") | F.coalesce("up", F.lit(False))).alias("must_run"),
                                       (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "stages")
    out = [d.select("pipeline", "stage", "reason", "must_run", F.lit(None).cast("string").alias("error")) for d in decided]
    out.append(todo.select("pipeline", "stage", "reason", F.lit(None).cast("boolean").alias("must_run"), F.lit("cycle").alias("error")))
    return reduce(DataFrame.unionByName, out)
