"""Corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns documents, the last one packed pieces.
``run`` writes what a stage returns into the shared folder before the next one reads it,
so every stage runs once and a lost executor never reaches back over a stage.

Defined cases are those of the operators: a null text is scored as empty, and after the
line stage it is an empty text; rows that repeat an id are rows of their own in the first
two stages, then one of each group of near-duplicates stays; columns beyond those of
``documents`` pass through all stages but the last; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratus.llm import line_dedup, mixing, packing, quality, simhash
from stratus.llm.common import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.5. It is fitted on these
    documents and the labels outside the held-out third."""
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~quality.held_out())
    return quality.score(docs, machine, score_col="__score").filter("__score >= 0.5").drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without frequent lines; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, prefix="__").drop("__n_lines", "__n_dropped")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them, a row each time."""
    out = mixing.mix(docs, prefix="__").filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; a document that the mix repeats has its
    pieces as often."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", good), ("line_dedup", lines), ("near_dedup", distinct), ("mix", mixed), ("pack", packed)]
#: Model fitting, fingerprints and token ids aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
