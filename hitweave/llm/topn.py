"""The best rows of every group, exact, with a fixed order among ties.

  1. Rows are reduced, before any shuffle, to one per item of a group: its best score and its number of rows. The best
     scores of the items make a histogram for every group. It gives a floor at or above which at least N items lie: those
     below can't be among the first N.
  2. Items that no set of limits can want, by the floor of their group or by the scores it asks for, are dropped. Of the
     rest the first N are ranked exactly, with the tie keys.
  3. Rows meet their items, and those of dropped items end there. Items with more than N rows have a histogram of their
     rows in turn; rows below its floor have no rank. The others are ranked exactly.

Nothing depends on the size of a group. A group or item of a third of all rows meets its floor in a join of which Spark
splits the hot side, as no other step asks for the join's order; ranks are cut to N in every task before the shuffle, so
that rows of equal scores, which no floor can part, don't meet in one task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.session import cut

#: Most sets of limits; they are the only thing that is collected or broadcast.
MOST_PARAMS = 1000
_GROUP, _ITEM = ["g0", "g1"], ["g0", "g1", "item"]


def score_bin(score: Column, per_octave: int = 64) -> Column:
    """A whole number that never falls as the score rises: 64 bins for each doubling, some thousands in all."""
    return (F.signum(score) * F.least(F.floor(F.log2(1 + F.abs(score)) * per_octave), F.lit(1 << 20))).cast("int")


def histogram_floor(rows: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """For each key the highest bin such that at least n rows lie in it or above, or the lowest bin that occurs, and the
    highest score: (keys, floor, best). The histogram is counted before the shuffle; a key has some thousands of bins,
    however many rows."""
    bins = rows.groupBy(*keys, score_bin(F.col(score)).alias("bin_")).agg(F.count("*").alias("n_"), F.max(score).alias("top_"))
    w = Window.partitionBy(*keys).orderBy(F.desc("bin_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.withColumn("above_", F.sum("n_").over(w)).where(F.col("above_") - F.col("n_") < n).groupBy(*keys).agg(F.min("bin_").alias("floor"), F.max("top_").alias("best"))


def _meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys in which null equals null; b's keys are left out."""
    named = b.select(*[F.col(k).alias(f"b_{k}") if k in keys else F.col(k) for k in b.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(named, same, how).drop(*[f"b_{k}" for k in keys])


def _least(cuts: list[Column]) -> Column:
    """The lowest of the scores that sets of limits ask for; none of them: a score that no row has."""
    return F.least(*cuts) if len(cuts) > 1 else cuts[0] if cuts else F.lit(float("inf"))


def _cut_at(pct: Column, bits: Column) -> Column:
    best = F.greatest(F.col("best"), F.lit(0.0))
    return F.when(pct >= 0, F.greatest(best - pct * best / 100, bits)).otherwise(bits)


def top_rows(rows: DataFrame, params: DataFrame, group_cols: tuple[str, str], item_col: str, score_col: str, row_col: str) -> DataFrame:
    """The rows kept under each row of params: (param_id, row_col).

    params: (param_id, hits_per_read, hsps_per_hit, top_pct, bits), MOST_PARAMS rows at most. A group is ordered by score
    descending, item ascending (by bytes; a null item is an item of its own and comes first), row_col ascending. With
    top_pct >= 0 rows below greatest(best - top_pct * best / 100, bits) fall out, best being the highest score of the
    group and at least 0; else rows below bits. Of the rest a row is kept if its item is among the first hits_per_read
    items of the group and it is among the first hsps_per_hit rows of its item (0: no limit).

    A null or NaN score is never kept; of a group whose best score is infinite nothing is kept under top_pct >= 0. Null group columns make groups of their own. Repeated rows count each; rows that
    are equal in all of these columns are interchangeable. Columns beside the named ones are ignored. Empty tables give
    an empty result.
    """
    p = params.select("param_id", F.coalesce("hits_per_read", F.lit(0)).alias("n_items"), F.coalesce("hsps_per_hit", F.lit(0)).alias("n_rows"), F.coalesce("top_pct", F.lit(-1.0)).alias("pct"), F.coalesce("bits", F.lit(0.0)).alias("bits"))
    limits = p.limit(MOST_PARAMS + 1).collect()
    if len(limits) > MOST_PARAMS:
        raise ValueError(f"more than {MOST_PARAMS} sets of limits")
    # no row below the lowest bits is ever kept
    x = rows.select(F.col(group_cols[0]).alias("g0"), F.col(group_cols[1]).alias("g1"), F.col(item_col).alias("item"), F.col(score_col).cast("double").alias("score"), F.col(row_col).alias("row"))
    x = x.where("score is not null and not isnan(score)").where(F.col("score") >= min((r.bits for r in limits), default=0.0))
    by_items = sorted({(r.pct, r.bits) for r in limits if r.n_items})
    by_rows = sorted({r.n_rows for r in limits if r.n_rows})
    any_item = _least([_cut_at(F.lit(a), F.lit(b)) for a, b in sorted({(r.pct, r.bits) for r in limits if not r.n_items})])
    first_items = _least([_cut_at(F.lit(a), F.lit(b)) for a, b in by_items])
    most_items = max([1, *(r.n_items for r in limits)])

    items = x.groupBy(*_ITEM).agg(F.max("score").alias("top"), F.count("*").alias("n"))
    floors = histogram_floor(items, _GROUP, "top", most_items)
    among = (F.col("top") >= first_items) & (score_bin(F.col("top")) >= F.col("floor"))
    wanted = _meet(items, floors, _GROUP).withColumn("among", among).where(F.col("among") | (F.col("top") >= any_item))
    wanted = cut(wanted.drop("floor"), "items")
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("top"), "item"))
    first = wanted.where("among").withColumn("nth_item", place).where(F.col("nth_item") <= most_items)
    if not by_items:
        wanted = wanted.withColumn("nth_item", F.lit(None).cast("int"))
    else:
        wanted = first if all(r.n_items for r in limits) else _meet(wanted, first.select(*_ITEM, "nth_item"), _ITEM, "left")
    wanted = wanted.select(*_ITEM, "n", "best", "nth_item")
    asked = (F.col("score") >= any_item) | ((F.col("score") >= first_items) & F.col("nth_item").isNotNull())
    kept = cut(_meet(x, wanted, _ITEM).where(asked), "rows")

    def under(df: DataFrame, which: DataFrame, ranked: bool) -> DataFrame:
        ok = (F.col("score") >= _cut_at(F.col("pct"), F.col("bits"))) & ((F.col("n_items") == 0) | (F.col("nth_item") <= F.col("n_items")))
        ok = ok & (F.col("nth_row") <= F.col("n_rows")) if ranked else ok
        return df.join(F.broadcast(which), ok).select("param_id", F.col("row").alias(row_col))

    out = under(kept, p.where("n_rows = 0"), False)
    if not by_rows:
        return out
    # an item of no more rows than the lowest limit keeps them all; one of no more than the highest needs no floor
    out = out.unionByName(under(kept.where(F.col("n") <= by_rows[0]), p.where("n_rows > 0"), False))
    many = kept.where(F.col("n") > by_rows[0])
    low = histogram_floor(many.where(F.col("n") > by_rows[-1]), _ITEM, "score", by_rows[-1]).drop("best")
    high = _meet(many, low, _ITEM, "left").where(F.col("floor").isNull() | (score_bin(F.col("score")) >= F.col("floor")))
    nth = F.row_number().over(Window.partitionBy(*_ITEM).orderBy(F.desc("score"), "row"))
    return out.unionByName(under(high.withColumn("nth_row", nth).where(F.col("nth_row") <= by_rows[-1]), p.where("n_rows > 0"), True))
