"""Places and running sums in an order, over ranges that many tasks share, so that no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.names import free_name
from hitweave.session import cut


def _ranged(rows: DataFrame, keys: list[str], order: list[Column | str]) -> tuple[DataFrame, str]:
    """rows in written ranges of (keys, order), as many as the session has tasks, and the column of their number."""
    part = free_name("part_", rows.columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges"), part


def _from_before(x: DataFrame, keys: list[str], part: str, one: Column, earlier: Column, out: str) -> DataFrame:
    """x with ``out``: what the earlier ranges of a key say, null in its first range. one: the aggregate of a range, named
    ``one_``; earlier: a window function of it.

    Only keys that lie in several ranges matter, of which there are no more than twice as many as ranges: broadcast."""
    sizes = x.groupBy(*keys, part).agg(one.alias("one_"))
    if keys:
        sizes = sizes.withColumn("ranges_", F.count("*").over(Window.partitionBy(*keys))).where("ranges_ > 1")
    sizes = sizes.withColumn(out, earlier).select(*[F.col(k).alias(f"range_{i}") for i, k in enumerate(keys)], F.col(part).alias("range_part"), out)
    same = F.col(part) == F.col("range_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"range_{i}"))
    return x.join(F.broadcast(sizes), same, "left").drop("range_part", *[f"range_{i}" for i in range(len(keys))])


def running(rows: DataFrame, keys: list[str], order: list[Column | str], add: Column, out: str) -> DataFrame:
    """rows with the sum of ``add`` over the rows of the same keys up to each row in the order, which should be unique.

    Rows are summed within ranges, and what lies before is added. Null keys are a key; an empty table gives an empty
    result."""
    x, part = _ranged(rows, keys, order)
    before = free_name("before_", rows.columns)
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    within = F.sum(add).over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    y = _from_before(x.withColumn(out, within), keys, part, F.sum(add), F.sum("one_").over(w), before)
    return y.withColumn(out, F.col(out) + F.coalesce(before, F.lit(0))).drop(part, before)


def previous(rows: DataFrame, keys: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """rows with a struct (value) of the row before in the order, by ascending columns; null for the first of its keys. The
    last row of each range is handed to the next."""
    x, part = _ranged(rows, keys, order)
    before = free_name("before_", rows.columns)
    value = F.struct(F.col(column).alias("value"))
    last = F.last("one_", True).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    within = F.lag(value).over(Window.partitionBy(*keys, part).orderBy(*order))
    y = _from_before(x.withColumn(out, within), keys, part, F.max_by(value, F.struct(*order)), last, before)
    return y.withColumn(out, F.coalesce(out, before)).drop(part, before)
