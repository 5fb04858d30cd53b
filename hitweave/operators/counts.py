"""Counting values over reads, and tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.operators.places import running

GROUP = ("label", "read")


def read_weights(weights: DataFrame) -> DataFrame:
    """(read, weight), one row for each read. weights: (read, weight) and, of several files, pos: the last row holds, as a
    later file overrides an earlier one; without pos the highest weight."""
    last = F.max_by("weight", "pos") if "pos" in weights.columns else F.max("weight")
    return weights.groupBy("read").agg(last.alias("weight"))


def _weight(values: DataFrame, weights: DataFrame | None) -> DataFrame:
    """values with a weight w: that of the read where weights has one, else 1."""
    if weights is None:
        return values.withColumn("w", F.lit(1))
    return values.join(read_weights(weights), "read", "left").withColumn("w", F.coalesce("weight", F.lit(1))).drop("weight")


def count_values(values: DataFrame, method: str = "all", weights: DataFrame | None = None, by: tuple[str, ...] = ("label",), group=GROUP, order: str = "pos") -> DataFrame:
    """(by, value, n): every value of a read counts (all), a read counts once in equal parts (portion), or only the first
    value does (first). weights: (read, weight), 1 where a read has none."""
    x = values
    if method == "first":
        x = x.groupBy(*group).agg(F.min_by("value", order).alias("value"))
    elif method == "portion":
        size = values.groupBy(*group).agg(F.count("*").alias("size"))
        x = x.join(size, list(group))
    elif method != "all":
        raise ValueError(f"no way of counting: {method}")
    x = _weight(x, weights)
    return x.groupBy(*by, "value").agg(F.sum(F.col("w") / F.col("size") if method == "portion" else F.col("w")).alias("n"))


def count_reads(values: DataFrame, by: tuple[str, ...] = ("label",), group=GROUP) -> DataFrame:
    """Reads that have values, unweighted: (by, total)."""
    return values.select(*group).distinct().groupBy(*by).agg(F.count("*").alias("total"))


def fold_rare(counts: DataFrame, threshold: Column, label: str = "Other", by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Values counted less than threshold become label; a row for label is always there."""
    folded = counts.withColumn("value", F.when(F.col("n") < threshold, F.lit(label)).otherwise(F.col("value")))
    zero = counts.select(*by).distinct().select(*by, F.lit(label).alias("value"), F.lit(0).alias("n"))
    return folded.select(*by, "value", "n").unionByName(zero).groupBy(*by, "value").agg(F.sum("n").alias("n"))


def fold_below_cutoff(counts: DataFrame, cutoff: float, target: Column, by: str = "label") -> DataFrame:
    """A value stays if it makes up more than cutoff of a label's total anywhere; else it is added to ``target`` (a
    Column of the row, null for none) in every label. Counts are conserved."""
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    keep = counts.join(total, by).groupBy("value").agg(F.bool_or(F.col("n") > F.col("total") * cutoff).alias("keep")).select(F.col("value").alias("kv"), "keep")
    x = counts.join(keep, F.col("value").eqNullSafe(F.col("kv"))).withColumn("value", F.when(F.col("keep") | F.col("value").isNull(), F.col("value")).otherwise(target))
    return x.groupBy(by, "value").agg(F.sum("n").alias("n"))


def roll_up(counts: DataFrame, membership: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Counts of values to counts of what they belong to; membership: (value, level_value), several allowed, none: the
    value itself."""
    x = counts.join(membership.distinct(), "value", "left").withColumn("value", F.coalesce("level_value", "value"))
    return x.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def wide(counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One column for each label, 0 where a value isn't counted. labels: the columns, which saves finding them."""
    return counts.groupBy("value").pivot("label", labels).agg(F.sum("n")).na.fill(0)


def crosstab(left: DataFrame, right: DataFrame, weights: DataFrame | None = None, total_reads: float | None = None, unknown: str = "Unknown") -> DataFrame:
    """Pairs of values that two tables (read, value) give to the same read: (value1, value2, n, weighted). A read of one
    table only has unknown in the other. total_reads sets the number of reads of which neither knows anything."""
    a = left.groupBy("read", F.col("value").alias("value1")).agg(F.count("*").alias("n1"))
    b = right.groupBy("read", F.col("value").alias("value2")).agg(F.count("*").alias("n2"))
    # values of a read are counted first, so that rows of a read of very many don't meet one by one
    pairs = a.join(b, "read", "full_outer").na.fill(unknown, ["value1", "value2"]).na.fill(1, ["n1", "n2"])
    x = _weight(pairs.withColumn("n", F.col("n1") * F.col("n2")), weights)
    cells = x.groupBy("value1", "value2").agg(F.sum("n").alias("n"), F.sum(F.col("w") * F.col("n")).alias("weighted"))
    if total_reads is None:
        return cells
    known = pairs.agg(F.countDistinct("read").alias("known"))  # one row
    rest = known.select(F.lit(unknown).alias("value1"), F.lit(unknown).alias("value2"), (F.lit(total_reads) - F.col("known")).cast("long").alias("n"))
    rest = rest.withColumn("weighted", F.col("n"))
    return cells.where(~((F.col("value1") == unknown) & (F.col("value2") == unknown))).unionByName(rest)


def crosstab_inner(left: DataFrame, right: DataFrame, of: str | None = None) -> DataFrame:
    """(value1, value2, n): in how many reads two tables (read, value) have a pair, of reads that both know. of: a column of
    right that names the value of left it was derived from, so that only such pairs count. Values are reduced to one row
    for each read first."""
    a = left.select("read", F.col("value").alias("value1")).distinct()
    b = right.select("read", F.col("value").alias("value2"), *([F.col(of).alias("value1")] if of else [])).distinct()
    return a.join(b, ["read", "value1"] if of else ["read"]).groupBy("value1", "value2").agg(F.countDistinct("read").alias("n"))


def bin_hits(rows: DataFrame, column: str, edges: list[float], by: tuple[str, ...] = ("label",)) -> DataFrame:
    """(by, bin, n): rows by the half-open range of edges that holds a column, from 0 below the first edge to len(edges)
    above the last. Nulls are left out; ranges without rows have none here."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(column))).alias("bin")
    return rows.where(F.col(column).isNotNull()).groupBy(*by, at).agg(F.count("*").alias("n"))


def n_statistics(lengths: DataFrame, column: str, shares=(50, 75, 90)) -> DataFrame:
    """For each share the length such that sequences at least as long hold that share of all bases: (share, length).
    Equal lengths are summed first, so that the running sum is over distinct lengths."""
    d = lengths.select(F.col(column).cast("long").alias("length")).where("length is not null").groupBy("length").agg(F.sum("length").alias("b"))
    total = d.agg(F.sum("b").alias("total"))  # one row
    x = running(d, [], [F.desc("length")], F.col("b"), "run").crossJoin(F.broadcast(total))
    s = lengths.sparkSession.createDataFrame([(k,) for k in shares], "share int")
    return x.crossJoin(F.broadcast(s)).where(F.col("run") >= F.col("total") * F.col("share") / 100).groupBy("share").agg(F.max("length").alias("length"))
