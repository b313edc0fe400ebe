"""Line dedup, DataFrame functions only.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted per
hash; lines found in too many documents go everywhere but in the last document that
holds them; what stays is put together again in the order of its positions.

Only hashes are shuffled by line: the texts move once, by document, to meet the set of
hashes that each must drop. A line that a third of all documents hold is counted with
map-side combine, and meets the frequent lines in a join whose two sides are plain
exchanges, which AQE can split. The hashes that a document drops lie in buckets, so that
a text of n lines and d such hashes takes about (n + d) sqrt(d) comparisons.

Defined cases: a null or empty text is one empty line; rows that repeat an id are one
document for the counts, and each such row is rewritten; null ids are one document that
sorts before all others; columns other than id and text pass unchanged; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratus.llm.common import BLANKS, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key, null for keys that are too short to count."""
    return F.when(F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars, F.unhex(F.md5(line_key(line))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(hash, n_docs, keep_id): keys of at least ``min_chars`` code points found in at
    least ``min_docs`` documents, with the largest id that holds each."""
    return _exploded(docs, id_col, text_col, min_chars).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keep_id")).filter(F.col("n_docs") >= min_docs)


def _exploded(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    hashes = F.transform(_lines(F.col(text_col)), lambda x: _hash(x, min_chars))
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array_compact(hashes))).alias("h"))


def _buckets(hashes: Column) -> Column:
    """The hashes in about as many buckets as each then holds."""
    n = F.ceil(F.sqrt(F.size(hashes)))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: F.filter(hashes, lambda h: F.pmod(F.xxhash64(h), n) == b))


def _in_buckets(buckets: Column, h: Column) -> Column:
    return F.array_contains(F.get(buckets, F.pmod(F.xxhash64(h), F.size(buckets)).cast("int")), h)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the text rewritten, and with n_lines (before) and
    n_dropped appended, their names after ``prefix``; columns of those names are replaced."""
    drop_id, drops_col, kept_col = (unused(n, docs) for n in ("drop_id", "drops", "kept"))
    hot = written(frequent_lines(docs, id_col, text_col, min_chars, min_docs), "frequent-lines")
    drops = (
        _exploded(docs, id_col, text_col, min_chars)
        .join(hot.select("h", "keep_id"), "h")
        .filter(~F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("id").alias(drop_id))
        .agg(F.collect_set("h").alias(drops_col))
        .withColumn(drops_col, _buckets(F.col(drops_col)))
    )
    joined = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col(drop_id)), "left")
    lines = _lines(F.col(text_col))
    hashed = F.transform(lines, lambda x: F.struct(x.alias("line"), _hash(x, min_chars).alias("h")))
    stay = F.filter(hashed, lambda x: ~F.coalesce(_in_buckets(F.col(drops_col), x["h"]), F.lit(False)))
    kept = F.transform(stay, lambda x: x["line"])
    joined = joined.withColumn(kept_col, F.when(F.col(drops_col).isNotNull(), kept))
    n_lines = F.size(lines).cast("long")
    return joined.select(
        *[F.coalesce(F.array_join(kept_col, "\n"), F.col(text_col), F.lit("")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in (f"{prefix}n_lines", f"{prefix}n_dropped")],
        n_lines.alias(f"{prefix}n_lines"),
        F.coalesce(n_lines - F.size(kept_col), F.lit(0)).cast("long").alias(f"{prefix}n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keep_id FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
y AS (SELECT k.r, k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keep_id AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM y GROUP BY r, doc_id
"""
