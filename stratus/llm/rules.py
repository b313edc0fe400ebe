"""Quality rules, DataFrame functions only: base limits on text statistics, then robust
multivariate outliers.

Base statistics come from the whole text inside its row. Documents that pass the base
limits are judged by the Mahalanobis distance of a vector of transformed statistics from
a minimum-covariance-determinant estimate for their cell, a language and source.

Every cell, every language and the whole have an estimate. A cell of n documents that pass
is judged by its own with the weight n / (n + ``PRIOR``), the rest being its language's,
which is drawn towards that of all documents in the same way: small cells need no pool, and
no document goes unjudged.

An estimate has four starts (``_starts``). From each, concentration steps are taken:
distances under the current estimate, then mean and covariance of the half of the documents
that are nearest. After ``TRIAL_STEPS`` the start whose covariance has the least determinant
goes on alone. A step is one scan of a narrow table with one aggregate: rows
are counted and their moments summed by cell and by a fine logarithmic bin of the
distance, so the nearest half is a running sum over a cell's bins, and a cell with a
third of all documents is reduced before it is shuffled. The half ends at a bin's edge, so
it may hold a few documents more. When no cell's mean moves any more, a last step
re-estimates from all documents within the 97.5 % point.

Statistics that are constant in half of a cell would make any other value infinitely far,
so ``FLOORS`` (the least spread that counts, by statistic) are added to the variances.
Those of the repetition shares are what chance does to the shortest document that passes:
the root of a share of n units has a standard deviation of at most 1 / (2 sqrt(n)), and 50
words, of which a repeat always covers both occurrences, are 25 units. In a cell without
repeats either share then rejects alone from about 26 %.

Defined cases: a null or empty text has no words and fails the base limits; null languages
and sources are values of their own; rows that repeat an id are judged each; other
columns pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.llm.common import WORD, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics: log words, log word length, and square roots of the shares of
#: symbols, repeated lines and repeated words; and the least spread of each.
FEATURES = ("x1", "x2", "x3", "x4", "x5")
FLOORS = (0.5, 0.05, 0.05, 0.1, 0.1)
P = len(FEATURES)
#: Documents of a cell that count as much as its language's estimate.
PRIOR = 100
#: Share of clean documents (of normal statistics) that the cutoff would reject: 1e-4.
KEEP = 0.9999
#: Estimates have settled when no cell's mean moves further in a step (sum over statistics; a
#: fifth of the least floor, as halves that end at a bin's edge can alternate).
TRIAL_STEPS, MAX_STEPS, SETTLED = 2, 30, 0.01
#: Distance bins in a factor of e; value bins in 1.
DISTANCE_BINS, VALUE_BINS = 48, 256


# ---- base statistics --------------------------------------------------------------------


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the BASE columns and n_lines (lines with a word) appended."""
    text, blank = F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\x20\x09-\x0D]")
    x = docs.withColumns({"__w": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__lines": F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))})
    x = x.withColumns(
        {
            "__n": F.size("__w").cast("long"),
            "__word_chars": (F.length(text) - F.regexp_count(text, blank)).cast("long"),
            "__n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))),
        }
    )
    # positions of windows that occur again: sorted by hash, equal neighbours
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    x = x.withColumn("__eq", F.zip_with(F.slice("__p", F.lit(1), F.size("__p") - 1), F.slice("__p", F.lit(2), F.size("__p") - 1), lambda a, b: a["h"] == b["h"]))
    either = F.zip_with(F.concat(F.array(F.lit(False)), "__eq"), F.concat("__eq", F.array(F.lit(False))), lambda a, b: a | b)
    x = x.withColumn("__again", F.sort_array(F.array_compact(F.zip_with("__p", either, lambda p, e: F.when(e, p["i"])))))
    following = F.concat(F.slice("__again", F.lit(2), F.size("__again") - 1), F.array(F.element_at("__again", -1) + 3))
    covered = F.aggregate(F.zip_with("__again", following, lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda s, v: s + v)
    named = {"n_words": F.col("__n"), "word_chars": F.col("__word_chars"), "n_symbols": F.col("__n_symbols"), "n_dup_lines": F.col("__n_dup_lines"), "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "n_lines": F.col("__n_lines")}
    return x.select(*[F.col(f"`{c}`") for c in docs.columns if c not in named], *[v.alias(k) for k, v in named.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> dict[str, Column]:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {"x1": F.log1p("n_words"), "x2": F.log1p(F.col("word_chars") / words), "x3": F.sqrt(F.col("n_symbols") / chars), "x4": F.sqrt(F.col("n_dup_lines") / lines), "x5": F.sqrt(F.col("n_repeat_words") / words)}


# ---- minimum covariance determinant -----------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    if x <= 0:
        return 0.0
    a, x, n = k / 2, x / 2, 0
    term = total = 1 / a
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_point(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < share else (low, middle)
    return low


#: Makes the covariance of the nearest half that of the whole, for normal data.
HALF = 0.5 / chi2_cdf(chi2_point(0.5, P), P + 2)


#: The entries of a vector and of a lower triangle.
ONE = range(1, P + 1)
LOWER = [(i, j) for i in ONE for j in range(1, i + 1)]


def _keys(lang: str, source: str) -> list[Column]:
    """A document's cell, its language and the whole, as texts."""
    own = F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))
    return [F.concat(F.lit("cell "), F.to_json(own)), F.concat(F.lit("lang "), F.to_json(F.struct(F.col(lang).alias("lang")))), F.lit("all")]


def _factored(x: DataFrame, *keep: str) -> DataFrame:
    """The Cholesky factor l of the covariances c plus the floors, beside the means m."""
    for i, j in LOWER:
        left = F.col(f"c{i}{j}") + (FLOORS[i - 1] ** 2 if i == j else 0.0)
        for k in range(1, j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        x = x.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}{j}"))
    return x.select(*keep, *[f"m{i}" for i in ONE], *[f"l{i}{j}" for i, j in LOWER])


def _starts(rows: DataFrame) -> DataFrame:
    """(cell, start, m, l): of each cell, four first estimates. Around the medians, with
    quartile spreads as a diagonal, and with those spreads and the correlations of the
    hyperbolic tangents and of the spatial signs of the standardised rows; and the plain mean
    and covariance."""
    each = rows.select("cell", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.floor(F.col(x) * VALUE_BINS).cast("int").alias("bin")) for i, x in enumerate(FEATURES, 1)])).alias("e"))
    bins = each.groupBy("cell", F.col("e.f").alias("f"), F.col("e.bin").alias("bin")).count()
    w = Window.partitionBy("cell", "f")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("count").over(run)).withColumn("n", F.sum("count").over(w))
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("n"), (F.col("bin") + 0.5) / VALUE_BINS)) for q in (0.25, 0.5, 0.75)}
    q = bins.groupBy("cell", "f").agg(at[0.5].alias("m"), ((at[0.75] - at[0.25]) / 1.349).alias("s"))
    wide = q.groupBy("cell").agg(*[F.max(F.when(F.col("f") == i, F.col(c))).alias(f"{c}{i}") for i in ONE for c in ("m", "s")])
    wide = written(wide.select("cell", *[f"m{i}" for i in ONE], *[F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") + FLOORS[i - 1] ** 2).alias(f"s{i}") for i in ONE]), "rule-medians")

    x = rows.join(wide, "cell").withColumns({f"z{i}": (F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(FEATURES, 1)})
    far = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(2, P + 1)), F.col("z1") * F.col("z1")))
    x = x.withColumns({f"t{i}": F.tanh(f"z{i}") for i in ONE}).withColumns({f"u{i}": F.when(far > 0, F.col(f"z{i}") / far).otherwise(0.0) for i in ONE})
    sums = [F.avg(F.col(f"{v}{i}") * F.col(f"{v}{j}")).alias(f"{v}{i}{j}") for v in "ztu" for i, j in LOWER]
    got = x.groupBy("cell").agg(*sums, *[F.avg(f"{v}{i}").alias(f"{v}{i}") for v in "zt" for i in ONE])
    got = written(got.join(wide, "cell"), "rule-starts")

    def around(start: int, moment) -> DataFrame:
        """Correlations of second moments about the medians, with the spreads."""
        def entry(i: int, j: int) -> Column:
            by = F.sqrt(moment(i, i) * moment(j, j))
            return F.when(by > 0, moment(i, j) / by).otherwise(0.0) if i != j else F.lit(1.0)

        return got.select("cell", F.lit(start).alias("start"), *[f"m{i}" for i in ONE], *[(entry(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in LOWER])

    plain = [(F.col(f"z{i}{j}") - F.col(f"z{i}") * F.col(f"z{j}")) * F.col(f"s{i}") * F.col(f"s{j}") for i, j in LOWER]
    made = [
        around(0, lambda i, j: F.lit(1.0 if i == j else 0.0)),
        around(1, lambda i, j: F.col(f"t{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}")),
        around(2, lambda i, j: F.col(f"u{i}{j}")),
        got.select("cell", F.lit(3).alias("start"), *[(F.col(f"m{i}") + F.col(f"z{i}") * F.col(f"s{i}")).alias(f"m{i}") for i in ONE], *[c.alias(f"c{i}{j}") for c, (i, j) in zip(plain, LOWER)]),
    ]
    return _factored(reduce(DataFrame.unionByName, made), "cell", "start")


def distances(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with their squared Mahalanobis distance (d2) from each estimate of their cell."""
    named = params.select(F.col("cell").alias("__cell"), *[F.col(c).alias(f"__{c}") for c in params.columns if c != "cell"])
    x = rows.join(named, F.col("cell") == F.col("__cell"), "left")
    for i, name in enumerate(FEATURES, 1):  # forward substitution with the Cholesky factor
        left = F.col(name) - F.col(f"__m{i}")
        for j in range(1, i):
            left = left - F.col(f"__l{i}{j}") * F.col(f"__z{j}")
        x = x.withColumn(f"__z{i}", left / F.col(f"__l{i}{i}"))
    d2 = sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(2, P + 1)), F.col("__z1") * F.col("__z1"))
    return x.withColumn("d2", d2)


def _covariances(sums: DataFrame, factor: float) -> DataFrame:
    """Means m and covariances c (times ``factor``) from moments about the old mean, and how
    far the means have moved."""
    x = sums.withColumns({f"e{i}": F.col(f"s{i}") / F.col("n") for i in ONE})
    c = [((F.col(f"s{i}{j}") / F.col("n") - F.col(f"e{i}") * F.col(f"e{j}")) * factor).alias(f"c{i}{j}") for i, j in LOWER]
    return x.select("cell", "start", *[(F.col(f"o{i}") + F.col(f"e{i}")).alias(f"m{i}") for i in ONE], *c, sum((F.abs(F.col(f"e{i}")) for i in range(2, P + 1)), F.abs("e1")).alias("moved"))


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    off = [F.col(x) - F.col(f"__m{i}") for i, x in enumerate(FEATURES, 1)]
    sums = [F.sum(off[i - 1]).alias(f"s{i}") for i in ONE] + [F.sum(off[i - 1] * off[j - 1]).alias(f"s{i}{j}") for i, j in LOWER]
    return rows.groupBy("cell", F.col("__start").alias("start"), *keys).agg(F.count(F.lit(1)).alias("n"), *sums, *[F.max(f"__m{i}").alias(f"o{i}") for i in ONE])


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """A concentration step: the estimate of each (cell, start) from its nearest half."""
    bins = _moments(distances(rows, params).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * DISTANCE_BINS)), "bin")
    w = Window.partitionBy("cell", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumn("before", before).withColumn("half", F.floor((F.sum("n").over(w) + P + 1) / 2)).filter("before < half")
    sums = [f"s{i}" for i in ONE] + [f"s{i}{j}" for i, j in LOWER]
    total = near.groupBy("cell", "start").agg(*[F.sum(c).alias(c) for c in ("n", *sums)], *[F.max(f"o{i}").alias(f"o{i}") for i in ONE])
    return _factored(_covariances(total, HALF), "cell", "start", "moved")


def _least(params: DataFrame) -> DataFrame:
    """Of each cell the start of the least determinant (the square of the factor's diagonal)."""
    determinant = sum((F.log(f"l{i}{i}") for i in range(2, P + 1)), F.log("l11"))
    return params.groupBy("cell").agg(F.min(F.struct(determinant.alias("d"), *[c for c in params.columns if c != "cell"])).alias("best")).select("cell", *[f"best.{c}" for c in params.columns if c != "cell"])


def estimates(rows: DataFrame) -> DataFrame:
    """(cell, n, m, c) for each cell of ``rows`` (cell and FEATURES): the mean and covariance
    of the rows near the estimate of least determinant."""
    params = written(_starts(rows), "rule-estimate")
    for step in range(MAX_STEPS):
        params = written(_step(rows, params), "rule-estimate")
        if step + 1 == TRIAL_STEPS:
            params = written(_least(params), "rule-estimate")
        elif step >= TRIAL_STEPS and (params.agg(F.max("moved")).first()[0] or 0.0) < SETTLED:  # a row per cell
            break
    inner = distances(rows, params).filter(F.col("d2") <= chi2_point(0.975, P))
    return _covariances(_moments(inner), 1.0).join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell")


def shrunk(cells: DataFrame, made: DataFrame) -> DataFrame:
    """(cell, m, l): of each row of ``cells`` (cell, lang_cell, all_cell) its own estimate
    drawn towards its language's, which is drawn towards that of all."""
    entries = [f"m{i}" for i in ONE] + [f"c{i}{j}" for i, j in LOWER]
    x = cells
    for key, mark in (("cell", "own"), ("lang_cell", "lang"), ("all_cell", "all")):
        named = made.select(F.col("cell").alias(f"{mark}_key"), *[F.col(c).alias(f"{mark}_{c}") for c in ("n", *entries)])
        x = x.join(named, F.col(key) == F.col(f"{mark}_key"))
    share = lambda mark: F.col(f"{mark}_n") / (F.col(f"{mark}_n") + PRIOR)
    for e in entries:
        wide = share("lang") * F.col(f"lang_{e}") + (1 - share("lang")) * F.col(f"all_{e}")
        x = x.withColumn(e, share("own") * F.col(f"own_{e}") + (1 - share("own")) * wide)
    return _factored(x, "cell")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with the BASE columns, base_failed,
    d2 (null for documents that fail the base limits) and kept appended. The rows are written
    once."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in (*BASE, "base_failed", "d2", "kept")]
    own = [f"own{i}" for i in range(len(names))]  # the result has the names; here they are numbers
    held = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], F.col(text_col).alias("__text"), F.col(lang_col).alias("__of_lang"), F.col(source_col).alias("__of_source"))
    x = base_statistics(held, "__text").drop("__text").withColumn("base_failed", base_failed()).withColumns(vector())
    cell, lang, whole = _keys("__of_lang", "__of_source")
    stats = written(x.withColumns({"cell": cell, "lang_cell": lang, "all_cell": whole}), "rule-statistics")
    passed = stats.filter(~F.col("base_failed"))
    rows = written(passed.select(F.explode(F.array("cell", "lang_cell", "all_cell")).alias("cell"), *FEATURES), "rule-rows")
    cells = passed.select("cell", "lang_cell", "all_cell").distinct()
    out = distances(stats, written(shrunk(cells, written(estimates(rows), "rule-estimate")), "rule-estimate"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_point(KEEP, P), F.lit(False))
    return out.select(*[F.col(o).alias(c) for c, o in zip(names, own)], *BASE, "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", *BASE, "base_failed", "kept")
