"""Samples of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_n(rows: DataFrame, n: int, order: str, seed: int = 0, keep_order: bool = False) -> DataFrame:
    """n rows at random without repetition, all if there are fewer. A row's chance hangs on the hash of its unique
    ``order`` value and the seed, so a rerun or a lost task draws the same rows; every task keeps only its n best."""
    picked = rows.orderBy(F.xxhash64(order, F.lit(seed)), order).limit(n)
    return picked.orderBy(order) if keep_order else picked


def sample_per_group(rows: DataFrame, n: int, group: str, order: str, seed: int = 0) -> DataFrame:
    """n rows of each group (of each file, say)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(order, F.lit(seed)), order))
    return rows.withColumn("place_", place).where(F.col("place_") <= n).drop("place_")
