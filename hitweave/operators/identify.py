"""Reads whose hits speak for a group of taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.operators.filters import GROUP


def identify(hits: DataFrame, lines: DataFrame, target: int, outer: int, top_pct: float = 0, every: bool = True, group=GROUP) -> DataFrame:
    """Hits (with taxid) in the target group of the reads that are recognised: (hits' columns).

    A read is recognised if all its hits are in the outer group and all (every) or any of its best hits, those within
    top_pct percent of the best score, in the target group. Groups are subtrees; a hit without a taxid speaks against its
    read. The sums of a read are made before the shuffle."""
    ids = lines.select("taxid", F.array_contains("lineage.taxid", target).alias("in_target"), F.array_contains("lineage.taxid", outer).alias("in_outer"))
    x = hits.join(ids, "taxid", "left").na.fill(False, ["in_target", "in_outer"])
    best = x.groupBy(*group).agg(F.max("score").alias("best"), F.bool_and("in_outer").alias("all_outer")).where("all_outer").drop("all_outer")
    top = x.join(best, list(group)).where(F.col("score") >= F.col("best") * (1 - top_pct / 100))
    decide = F.bool_and("in_target") if every else F.bool_or("in_target")
    reads = top.groupBy(*group).agg(decide.alias("ok")).where("ok").drop("ok")
    return x.where("in_target").join(reads, list(group), "left_semi").select(*hits.columns)
