"""Train/test splits: temporal holdout, deterministic hash split, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..sources.io import cut_lineage
from .common import nth_row


def temporal_split(df: DataFrame, ts_col: str, key_cols: list[str], train_fraction: float = 0.8, order: str = "time") -> DataFrame:
    """Order rows by (ts, key), nulls first; the first ``floor(n * train_fraction)`` are
    train.  ``order='text'`` compares timestamps as the texts they are printed as.

    The last train row is found from a narrow table of the order columns; the split is
    then a comparison of each row with it: no window, no union, one scan.
    """
    if order not in ("time", "text"):
        raise ValueError(f"order {order!r}: time or text")
    columns = {"_s0": F.col(ts_col).cast("string") if order == "text" else F.col(ts_col), **{f"_s{i}": F.col(k) for i, k in enumerate(key_cols, 1)}}
    return _first_part(df, columns, lambda n: int(n * train_fraction), "train", "test")


def _first_part(df: DataFrame, columns: dict[str, Column], rows: Callable[[int], int], first: str, rest: str) -> DataFrame:
    """``split`` = ``first`` for the first ``rows(n)`` of n rows in the columns' order."""
    keys = cut_lineage(df.select(*[c.alias(k) for k, c in columns.items()]), "split-keys")
    n = keys.count()
    cut = rows(n)
    if cut < 1 or cut >= n:
        raise ValueError("Split produced empty train or test")
    last = nth_row(keys, list(columns), cut)
    bound = F.struct(*[F.lit(last[k]).cast(keys.schema[k].dataType).alias(k) for k in columns])
    return df.withColumn("split", F.when(F.struct(*[c.alias(k) for k, c in columns.items()]) <= bound, first).otherwise(rest))


def hash_split(df: DataFrame, key: Column, test_percent: int = 20, exact: bool = False) -> DataFrame:
    """Repeatable split: md5 bucket of the row key below ``test_percent`` is test.  With
    ``exact``, test has ceil(n * test_percent / 100) rows: the first in the order of the
    key's md5 (rows of equal keys at the cut go together)."""
    if exact:
        return _first_part(df, {"_s0": md5_bucket(key, 1 << 32), "_s1": F.md5(key.cast("string"))}, lambda n: -(-n * test_percent // 100), "test", "train")
    return df.withColumn("split", F.when(md5_bucket(key, 100) < test_percent, "test").otherwise("train"))


def split_metadata(df: DataFrame, mode: str) -> DataFrame:
    train = F.count_if(F.col("split") == "train")
    test = F.count_if(F.col("split") == "test")
    return df.agg(train.alias("train_rows"), test.alias("test_rows")).select(
        F.lit(mode).alias("split_mode"),
        "train_rows",
        "test_rows",
        F.round(F.col("test_rows") / F.greatest(F.col("train_rows") + F.col("test_rows"), F.lit(1)), 4).alias("test_fraction"),
    )
