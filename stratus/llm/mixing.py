"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, ``-ln(u) / w``, from a hash of its id and its
quality weight ``w``; ordering a source by key is a weighted sample without replacement
for every prefix at once. A source whose target is t times its size gives floor(t)
complete epochs; the rest of its token budget is filled from the front of the key order.

Targets: source weights share the sum of all sizes; a target stops at ``max_epochs``
times its source's size, and what is cut off is shared again by weight. That ends at
``min(max_epochs * size, level * weight)`` for one level, found from running sums over
the table of sources (a row for each source, of the size of the mix's configuration).

The key order is never sorted as a whole. A source of n documents has sqrt(n) key
buckets; running sums of the bucket sizes find the bucket in which the budget ends, and
only its documents (about sqrt(n)) are sorted. The decision for a document is a
comparison with its source's cut, so texts don't move at all.

Whole documents are taken: the one on which the budget ends is taken if at least half
of it lies within, so a source's words differ from its target by half of one document.

Defined cases: a null text has size 0; a null source is a source that sorts last; rows
that repeat an id share its key and are ordered by a hash of their texts, full repeats
being taken or left together; null ids draw their key from the text; columns of other names pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratus.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
#: Quality weights lie in this range, which bounds how uneven the key buckets are.
LEAST_WEIGHT, MOST_WEIGHT = 0.25, 1.0
SYMBOLS = "#*$%&|<>{}[]\\^~_=+/@"


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: lower for texts with many symbols (none: 1, 15 % or more: 0.25)."""
    share = 1.0 - F.length(F.translate(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), F.lit(MOST_WEIGHT) - 5.0 * share), F.lit(LEAST_WEIGHT))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, n_docs) to the same with target. Sources by code point, null
    last, weigh ``weights`` in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    below = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    # the level holds from the first source, by cap over weight, that it leaves below its cap
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("by"), "rank", "level"))).over(whole)["level"])
    return s.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")))).select("source", "source_size", "n_docs", "target")


def _keyed(id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> dict[str, Column]:
    """Size, source, exponential key and tie of a document. The key's uniform number is 52
    bits of an MD5 of the id, so that any SQL engine can draw the same."""
    text, w = F.col(text_col), quality_weight(F.col(text_col)) if weight is None else weight
    w = F.least(F.greatest(F.coalesce(w, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text).cast("string")))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return {"__size": word_count(text), "__key": -F.log(u) / w, "__tie": F.xxhash64(text), "__source": F.col(source_col)}


def _bucket(n_docs: str) -> Column:
    """Key buckets of nearly even load: at most MOST_WEIGHT / LEAST_WEIGHT times the mean."""
    n = F.ceil(F.sqrt(F.col(n_docs)))
    return F.least(F.floor((1.0 - F.exp(-F.col("__key") * LEAST_WEIGHT)) * n), n - 1).cast("long")


def plan(keyed: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """A row per source: source_size, target, epochs, and the cut in its key order.
    ``keyed`` has __source, __size, __key and __tie."""
    sizes = keyed.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    t = targets(sizes, weights, max_epochs).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = written(t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    held = keyed.join(t, F.col("__source").eqNullSafe(F.col("source"))).withColumn("bucket", _bucket("n_docs"))
    sums = held.groupBy("source", "bucket", "rest").agg(F.sum("__size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).filter("before < rest AND rest <= before + words")
    ends = written(ends.select(F.col("source").alias("s"), F.col("bucket").alias("cut_bucket"), "before"), "mix-ends")
    last = held.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("cut_bucket")))
    run = Window.partitionBy("source").orderBy("__key", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("at", F.col("before") + F.coalesce(F.sum("__size").over(run), F.lit(0)) + F.col("__size") / 2)
    cut = last.filter("at <= rest").groupBy(F.col("source").alias("c")).agg(F.max(F.struct("__key", "__tie")).alias("cut"))
    both = t.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
    return written(both.select("source", "source_size", "n_docs", "target", "epochs", "cut_bucket", "cut"), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights: tuple = WEIGHTS, max_epochs: int = 3, seed: int = 42, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and copies (how often the mix
    has the document) appended, their names after ``prefix``; columns of those names are
    replaced. ``weight``: a column of quality weights from 0.25 to 1."""
    own = _keyed(id_col, text_col, source_col, weight, seed)
    keyed = written(docs.select(*[v.alias(k) for k, v in own.items()]), "mix-keys")
    held = [f"c{i}" for i in range(len(docs.columns))]  # the result has the names; here they are numbers
    numbered = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held)], *[v.alias(k) for k, v in own.items()])
    return _decided(numbered, plan(keyed, weights, max_epochs), dict(zip(docs.columns, held)), prefix)


def _decided(keyed: DataFrame, planned: DataFrame, columns: dict[str, str], prefix: str = "") -> DataFrame:
    planned = planned.select(*[F.col(c).alias(f"__p_{c}") for c in planned.columns])
    x = keyed.join(planned, F.col("__source").eqNullSafe(F.col("__p_source")), "left")
    bucket = _bucket("__p_n_docs")
    inside = (bucket < F.col("__p_cut_bucket")) | ((bucket == F.col("__p_cut_bucket")) & (F.struct(F.col("__key"), F.col("__tie")) <= F.col("__p_cut")))
    own = {"size": F.col("__size"), "source_size": F.col("__p_source_size"), "target": F.col("__p_target"), "copies": F.col("__p_epochs") + F.coalesce(inside, F.lit(False)).cast("long")}
    own = {prefix + k: v for k, v in own.items()}
    return x.select(*[F.col(held).alias(c) for c, held in columns.items() if c not in own], *[v.alias(k) for k, v in own.items()])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = _keyed("doc_id", "text", "source", None, 42)
    keyed = written(docs.select("doc_id", *[v.alias(k) for k, v in own.items()]), "mix-keys")
    out = _decided(keyed, plan(keyed), {"doc_id": "doc_id"})
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(greatest(0.25::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (1.0::DOUBLE - length(translate(text, '#*$%&|<>{}[]\^~_=+/@', ''))::DOUBLE / greatest(length(text), 1))), 0.25::DOUBLE) AS w,
         (('0x' || substr(md5('42:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
c AS (SELECT *, 3.0 * source_size / weight AS ratio,
             (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE * source_size, weight * (SELECT arg_min(level, ratio) FROM c WHERE level <= ratio))::DOUBLE END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (SELECT d.doc_id, d.size, e.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS mid
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM (SELECT *, epochs + CASE WHEN target - epochs * source_size > 0 AND mid <= target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM o)
"""
