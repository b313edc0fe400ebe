"""Trial election: eligibility, deny list, Borda midranks, Copeland, winner.

Works on a table of many elections keyed by ``election_id``; a trial is known
by its election and id.  The winner needs Copeland only to break ties among the
Borda leaders, so there it is computed for leaders against all survivors, with
the survivors of a huge election spread over buckets.  ``copeland`` has the scores
of all survivors, by dominance counts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import params_fingerprint
from ..sources.io import cut_lineage
from .common import running_total


@dataclass(frozen=True)
class Constraints:
    # Default constraint set.
    n_estimators_min: int = 100
    n_estimators_max: int = 800
    required_max_features: str = "sqrt"
    required_random_state: int = 42
    require_unlimited_depth: bool = True
    pred_var_max: float = 4.5

    def frame(self, spark: SparkSession) -> DataFrame:
        """One-row parameter table (joined by broadcast: exactly one row)."""
        return spark.createDataFrame([asdict(self)])


def with_fingerprint(trials: DataFrame) -> DataFrame:
    return trials.withColumn("fingerprint", params_fingerprint(F.col("params_json")))


def eligibility(trials: DataFrame, constraints: DataFrame, deny: DataFrame) -> DataFrame:
    """All trials with ``reason`` = first failed rule (null when eligible).

    ``constraints`` has one row (global) or one row per ``election_id``.
    The deny list matches case-insensitively (left join on lower(digest)).
    """
    t = with_fingerprint(trials) if "fingerprint" not in trials.columns else trials
    if "election_id" in constraints.columns:
        # one row per election: bounded by the election count; AQE sizes the join
        t = t.join(constraints, "election_id")
    else:
        rows = constraints.take(2)
        if len(rows) != 1:
            raise ValueError("constraints without election_id must be exactly one row")
        row = rows[0].asDict()
        t = t.select("*", *[F.lit(v).alias(k) for k, v in row.items()])
    d = deny.select(F.lower(F.trim(F.col("fingerprint"))).alias("_deny")).where(
        (F.col("_deny") != "") & ~F.col("_deny").startswith("#")
    ).distinct()
    t = t.join(d, F.lower(F.col("fingerprint")) == F.col("_deny"), "left")
    c = F.col
    # a rule that a null field cannot meet rejects the trial
    rules = {
        "n_estimators_min": c("n_estimators") >= c("n_estimators_min"),
        "n_estimators_max": c("n_estimators") <= c("n_estimators_max"),
        "max_features": c("max_features") == c("required_max_features"),
        "random_state": c("random_state") == c("required_random_state"),
        "max_depth": ~c("require_unlimited_depth") | c("max_depth").isNull(),
        "pred_var": c("pred_var") <= c("pred_var_max"),
        "metrics": c("RMSE").isNotNull() & c("MAE").isNotNull() & c("R2").isNotNull(),
        "params": c("fingerprint").isNotNull(),  # no JSON: the deny list can't be asked
        "denied": c("_deny").isNull(),
    }
    reason = F.coalesce(*[F.when(~F.coalesce(met, F.lit(False)), F.lit(name)) for name, met in rules.items()])
    keep = [c for c in trials.columns if c not in ("fingerprint",)]
    return t.select(*keep, F.lower(F.col("fingerprint")).alias("fingerprint"), reason.alias("reason"))


def borda(survivors: DataFrame) -> DataFrame:
    """Borda points per metric (RMSE, MAE low is good; R2 high is good) and total:
    ``n - midrank``, where ties share (first + last) / 2.

    One aggregate counts the values of all three metrics; ranks are running counts over
    distinct values in range buckets, so a huge election is ranked by many tasks.
    """
    good_first = {"borda_rmse": F.col("RMSE"), "borda_mae": F.col("MAE"), "borda_r2": -F.col("R2")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), v.cast("double").alias("v")) for k, v in good_first.items()]))
    counts = survivors.select("election_id", each.alias("x")).groupBy("election_id", "x.m", "x.v").agg(F.count("*").alias("c"))
    counts = cut_lineage(counts, "borda-values")
    ranks = running_total(counts, ["v"], F.col("c"), "upto", group=["election_id", "m"])
    ranks = cut_lineage(ranks.select("election_id", "m", "v", (F.col("upto") - (F.col("c") - 1) / 2.0).alias("mid")), "borda-ranks")
    n = counts.where(F.col("m") == "borda_mae").groupBy("election_id").agg(F.sum("c").alias("n_survivors"))
    out = survivors.join(n, "election_id")
    for name, v in good_first.items():
        r = ranks.where(F.col("m") == name).select(F.col("election_id").alias("_e"), F.col("v").alias("_v"), F.col("mid").alias("_mid"))
        out = out.join(r, (F.col("election_id") == F.col("_e")) & (v.cast("double") == F.col("_v")))
        out = out.withColumn(name, F.col("n_survivors") - F.col("_mid")).drop("_e", "_v", "_mid")
    return out.withColumn("borda", F.col("borda_rmse") + F.col("borda_mae") + F.col("borda_r2"))


# Survivors that a leader meets in a task, about.
ROWS_PER_BUCKET = 10_000


def copeland_for_leaders(scored: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Copeland score (pairwise majority wins over 3 metrics, ties 0) for the
    trials tied at the top Borda total of their election.

    An election has a bucket for every ``rows_per_bucket`` survivors; leaders are copied
    into each of their election's buckets and a survivor goes to one by hash, so a huge
    election's comparisons spread over many tasks and a small one's leaders stay single.
    """
    buckets = F.ceil(F.col("n_survivors") / rows_per_bucket).cast("bigint")
    top = scored.groupBy("election_id").agg(F.max("borda").alias("_top"))
    leaders = scored.join(top, "election_id").where(F.col("borda") == F.col("_top")).select(
        "election_id", F.col("trial_id").alias("a_id"), F.col("RMSE").alias("a_rmse"),
        F.col("MAE").alias("a_mae"), F.col("R2").alias("a_r2"), F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1)).alias("_salt"),
    )
    others = scored.select(
        "election_id", F.col("trial_id").alias("b_id"), F.col("RMSE").alias("b_rmse"),
        F.col("MAE").alias("b_mae"), F.col("R2").alias("b_r2"),
        F.pmod(F.xxhash64("trial_id"), buckets).alias("_salt"),
    )
    pairs = leaders.join(others, ["election_id", "_salt"]).where(F.col("a_id") != F.col("b_id"))
    sgn = lambda x: F.when(x, 1).otherwise(0)
    wins = sgn(F.col("a_rmse") < F.col("b_rmse")) + sgn(F.col("a_mae") < F.col("b_mae")) + sgn(F.col("a_r2") > F.col("b_r2"))
    losses = sgn(F.col("a_rmse") > F.col("b_rmse")) + sgn(F.col("a_mae") > F.col("b_mae")) + sgn(F.col("a_r2") < F.col("b_r2"))
    got = pairs.groupBy("election_id", "a_id").agg(F.sum(F.when(wins > losses, 1).otherwise(0)).alias("copeland"))
    # a lone survivor has no pairs: its score is 0
    lead_ids = leaders.select("election_id", "a_id").distinct()
    return lead_ids.join(got, ["election_id", "a_id"], "left").select(
        "election_id", F.col("a_id").alias("trial_id"), F.coalesce(F.col("copeland"), F.lit(0)).cast("bigint").alias("copeland")
    )


# Rows of a block whose pairs one task compares itself.
BLOCK_BITS = 11


def _block_counts(names: list[str]):
    """Counts within one block: for each row that may win, the rows that may lose and come
    later in all of ``names``."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        win, lose = rows[rows["can_win"]], rows[rows["can_lose"]]
        # as ranks, where NaN is last as in an ORDER BY
        ranks = {n: np.unique(rows[n].to_numpy(), return_inverse=True)[1] for n in names}
        w, o = rows["can_win"].to_numpy(), rows["can_lose"].to_numpy()
        got = np.zeros(len(win), dtype=np.int64)
        for i in range(0, len(win), 256):
            later = np.ones((min(256, len(win) - i), len(lose)), dtype=bool)
            for n in names:
                later &= ranks[n][w][i:i + 256, None] < ranks[n][o][None, :]
            got[i:i + 256] = later.sum(axis=1)
        return pd.DataFrame({"part": win["part"], "election_id": win["election_id"], "trial_id": win["trial_id"], "n": got})

    return count


def _dominated(rows: DataFrame, places: list[str], last: str, block_bits: int) -> DataFrame:
    """(part, election_id, trial_id, n): for each row the rows of its part and election that
    come later in all of ``places`` (row numbers from 0, no ties) and have a greater ``last``.

    Two row numbers either share their block (the bits above ``block_bits``), or there is one
    highest bit at which their blocks differ.  So each pair is met once: in its block, by one
    task, or at one bit, where the rows with 0 may win over those with 1 and the next place is
    treated alike.  What is left after the last place is a running count along ``last``.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("part", "election_id", "trial_id").schema) + ", n bigint"
    group, found = ["part", "election_id"], []
    cur = rows.withColumn("can_win", F.lit(True)).withColumn("can_lose", F.lit(True))
    for i, place in enumerate(places):
        block = F.shiftright(F.col(place), block_bits)
        tagged = cur.withColumn("block", block)
        seen = tagged.select(*group, "block", "trial_id", "can_win", "can_lose", *places[i:], last)
        found.append(seen.groupBy(*group, "block").applyInPandas(_block_counts([*places[i:], last]), schema))
        bits = F.length(F.conv(F.shiftright(F.col("n_rows") - 1, block_bits).cast("string"), 10, 2))  # 1 where there is one block
        level = F.explode(F.when(F.col("n_rows") > 1 << block_bits, F.sequence(F.lit(0), bits - 1)).otherwise(F.array().cast("array<int>")))
        cur = tagged.select("*", level.alias(f"bit{i}"))
        one = F.expr(f"(block >> bit{i}) & 1") == 1
        cur = cur.withColumn(f"high{i}", F.expr(f"block >> (bit{i} + 1)")).withColumn("can_win", F.col("can_win") & ~one)
        cur = cur.withColumn("can_lose", F.col("can_lose") & one).where("can_win or can_lose").drop("block")
        group += [f"bit{i}", f"high{i}"]
    cur = cut_lineage(cur.withColumn("from_last", -F.col(last)).withColumn("loses", F.col("can_lose").cast("int")), "copeland-bits")
    ran = running_total(cur, ["from_last", "loses"], F.col("loses").cast("bigint"), "n", group=group)
    found.append(ran.where("can_win").select("part", "election_id", "trial_id", "n"))
    return reduce(DataFrame.unionByName, found)


def copeland(survivors: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Copeland score of every survivor: (election_id, trial_id, copeland), the trials of its
    election over which it wins more of RMSE, MAE and R2 than it loses.

    No pairs are formed.  A trial wins if it is better in at least two metrics, or better in
    one and equal in two.  The first kind is the sum of the three counts of trials worse in
    two metrics, less twice the count of those worse in all three; the second is a count
    among trials that share two values.  Ties in a metric are ordered by the next one
    downwards, so that rows which tie there never come later in all.  A row is copied once for
    each bit of the number of blocks, for three metrics once for each pair of bits.
    """
    good_first = {"x": F.col("RMSE"), "y": F.col("MAE"), "z": -F.col("R2")}
    # an added 0.0 makes one zero of the two
    base = survivors.select("election_id", "trial_id", *[(v.cast("double") + 0.0).alias(k) for k, v in good_first.items()])
    size = base.groupBy("election_id").agg(F.count("*").alias("n_rows"))
    base = cut_lineage(base.join(size, "election_id"), "copeland-rows")

    def placed(rows: DataFrame, order: list[str], out: str) -> DataFrame:
        falling = [F.col(c) if i == 0 or c == "trial_id" else -F.col(c) for i, c in enumerate(order)]
        keyed = rows.select("*", *[v.alias(f"k{i}") for i, v in enumerate(falling)])
        keys = [f"k{i}" for i in range(len(order))]
        got = running_total(keyed, keys, F.lit(1).cast("bigint"), out, group=["part", "election_id"]).drop(*keys)
        return cut_lineage(got.withColumn(out, F.col(out) - 1), "copeland-places")

    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    two = base.select("election_id", "trial_id", "n_rows", F.explode(F.array(*[
        F.struct(F.lit(a + b).alias("part"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])).alias("v"))
    two = placed(two.select("election_id", "trial_id", "n_rows", "v.*"), ["a", "b", "trial_id"], "p")
    three = placed(base.withColumn("part", F.lit("xyz")), ["x", "y", "z", "trial_id"], "p")
    three = placed(three, ["y", "z", "trial_id"], "q")
    # x, y and z each as the metric that differs
    same = base.select("election_id", "trial_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), (-F.col(c)).alias("from_c"))
        for a, b, c in [("x", "y", "z"), ("x", "z", "y"), ("y", "z", "x")]])).alias("v")).select("election_id", "trial_id", "v.*")
    keys = ["part", "election_id", "a", "b"]
    values = cut_lineage(same.groupBy(*keys, "c", "from_c").agg(F.count("*").alias("c_rows")), "copeland-values")
    worse = running_total(values, ["from_c"], F.col("c_rows"), "upto", group=keys).withColumn("n", F.col("upto") - F.col("c_rows"))
    alone = same.join(worse.select(*keys, "c", "n").where("n > 0"), [*keys, "c"]).select("part", "election_id", "trial_id", "n")
    weight = F.when(F.col("part") == "xyz", -2).otherwise(1)
    won = _dominated(two, ["p"], "b", block_bits).unionByName(_dominated(three, ["p", "q"], "z", block_bits)).unionByName(alone)
    won = won.groupBy("election_id", "trial_id").agg(F.sum(weight * F.col("n")).alias("copeland"))
    return base.select("election_id", "trial_id").join(won, ["election_id", "trial_id"], "left").fillna(0, ["copeland"])


def round_significant(c: Column, digits: int) -> Column:
    """``c`` rounded to ``digits`` significant digits (decimal arithmetic rule of
    the original elector: metrics equal to that many digits tie)."""
    return F.format_string(f"%.{digits - 1}e", c).cast("double")


def one_per_trial(trials: DataFrame) -> DataFrame:
    """One row per trial of an election: the first file by name where ``source_file``
    tells, else the least row."""
    first = [F.col("source_file")] if "source_file" in trials.columns else []
    row = F.struct(*trials.columns)
    return trials.groupBy("election_id", "trial_id").agg(F.min(F.struct(*first, row.alias("_row"))).alias("_first")).select("_first._row.*")


def elect(trials: DataFrame, constraints: DataFrame, deny: DataFrame, digits: int | None = None) -> DataFrame:
    """One row per election: winner by Borda desc, Copeland desc, pred_var asc,
    fingerprint asc, trial_id asc; ``status = 'NONE'`` when nobody survives.

    ``digits`` (e.g. 9) rounds RMSE, MAE, R2 and pred_var to that many
    significant digits before comparing; default compares full doubles."""
    if digits:
        trials = trials.select(
            *[round_significant(F.col(c), digits).alias(c) if c in ("RMSE", "MAE", "R2", "pred_var") else F.col(c)
              for c in trials.columns]
        )
    trials = one_per_trial(trials)
    el = eligibility(trials, constraints, deny)
    surv = cut_lineage(el.where(F.col("reason").isNull()), "survivors")
    scored = cut_lineage(borda(surv), "borda")
    cope = copeland_for_leaders(scored)
    lead = scored.join(cope, ["election_id", "trial_id"])
    key = F.struct(
        (-F.col("borda")).alias("a"), (-F.col("copeland")).alias("b"), F.col("pred_var").alias("c"),
        F.upper(F.col("fingerprint")).alias("d"), F.col("trial_id").alias("e"),
    )
    win = lead.groupBy("election_id").agg(
        F.min_by("trial_id", key).alias("winner"),
        F.min_by("borda", key).alias("borda"),
        F.min_by("copeland", key).alias("copeland"),
        F.first("n_survivors").alias("n_survivors"),
    )
    elections = trials.select("election_id").distinct()
    out = elections.join(win, "election_id", "left")
    return out.select(
        "election_id",
        F.when(F.col("winner").isNull(), F.lit("NONE")).otherwise(F.lit("OK")).alias("status"),
        "winner", "borda", "copeland", F.coalesce(F.col("n_survivors"), F.lit(0)).alias("n_survivors"),
    )


def winner_documents(winners: DataFrame, trials: DataFrame) -> DataFrame:
    """Full trial document of each winner in its own election (left join keeps NONE
    elections)."""
    trials = one_per_trial(trials)
    docs = trials.select(F.col("election_id").alias("_e"), F.col("trial_id").alias("_t"), *[c for c in trials.columns if c not in ("trial_id", "election_id")])
    return winners.join(docs, (F.col("election_id") == F.col("_e")) & (F.col("winner") == F.col("_t")), "left").drop("_e", "_t")
