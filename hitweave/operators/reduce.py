"""From the values of each read to what is said of it.

Input is long: one row for each value of a read, in the order of ``pos``; a null value is a value ("nothing known").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("label", "read")


def first(values: DataFrame, group=GROUP, order: str = "pos") -> DataFrame:
    """The first value of each read."""
    return values.groupBy(*group).agg(F.min_by("value", order).alias("value"))


def all_values(values: DataFrame, group=GROUP) -> DataFrame:
    """Each distinct value of a read."""
    return values.select(*group, "value").distinct()


def consensus(values: DataFrame, group=GROUP) -> DataFrame:
    """The value of reads that have only one; others are left out."""
    agg = values.groupBy(*group).agg(F.min("value").alias("value"), F.max("value").alias("m"), F.count("value").alias("n"), F.count("*").alias("rows"))
    return agg.where("value <=> m and (n = 0 or n = rows)").drop("m", "n", "rows")


def most(values: DataFrame, group=GROUP) -> DataFrame:
    """All values tied at the highest frequency in the read."""
    n = values.groupBy(*group, "value").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("n")))).where("r = 1").drop("n", "r")


def lca(taxa: DataFrame, lineages: DataFrame, group=GROUP) -> DataFrame:
    """Lowest common ancestor of the taxa of each read: (group, value). Unknown taxa are passed over; a read without a
    known one is left out.

    A node lies on all paths of a read if as many of its distinct taxa have it as there are; the deepest such node is
    the ancestor. Counting ancestors is summed before the shuffle, so no read is gathered."""
    distinct = taxa.where("value is not null").select(*group, F.col("value").alias("taxid")).distinct()
    up = distinct.join(lineages.select("taxid", F.explode("lineage").alias("a")), "taxid").select(*group, "taxid", F.col("a.taxid").alias("anc"), F.col("a.depth").alias("depth"))
    shared = up.groupBy(*group, "anc", "depth").agg(F.count("*").alias("n"))
    total = up.where("taxid = anc").groupBy(*group).agg(F.count("*").alias("total"))
    return shared.join(total, list(group)).where("n = total").groupBy(*group).agg(F.max_by("anc", "depth").alias("value"))


METHODS = {"first": first, "all": all_values, "consensus": consensus, "most": most}
