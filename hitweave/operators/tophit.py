"""One hit or organism for each read, by how common it is among the reads that leave no doubt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.counts import read_weights
from hitweave.operators.places import running

GROUP = ("label", "read")


def candidates(hits: DataFrame, org: str = "hit", group=GROUP, order: str = "pos") -> DataFrame:
    """(group, org, hit, pos): the organisms of each read with their alphabetically first hit; pos is the read's last. A
    null organism is an organism of its own."""
    return hits.groupBy(*group, F.col(org).alias("org")).agg(F.min("hit").alias("hit"), F.max(order).alias("pos"))


def clear_counts(cand: DataFrame, group=GROUP, weights: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, org, n): weighted number of reads of a single organism; by: columns of the group to count apart, its file, say."""
    one = cand.groupBy(*group).agg(F.count("*").alias("k"), F.first("org").alias("org")).where("k = 1")
    if weights is not None:
        one = one.join(read_weights(weights), "read", "left")
    w = F.coalesce("weight", F.lit(1)) if weights is not None else F.lit(1)
    return one.groupBy(*by, "org").agg(F.sum(w).alias("n"))


def clear_rows(hits: DataFrame, org: str = "hit", group=GROUP, order: str = "pos") -> DataFrame:
    """The last row of each read that has but one organism; a null organism is one."""
    one = candidates(hits, org, group, order).groupBy(*group).agg(F.count("*").alias("k"), F.max("pos").alias("last_pos")).where("k = 1")
    return hits.join(one.select(F.col("last_pos").alias(order)), order, "left_semi")


def _counted(cand: DataFrame, counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    c = counts.select(*[F.col(b).alias(f"c_{b}") for b in by], F.col("org").alias("c_org"), F.col("n").cast("double").alias("n"))
    same = F.col("org").eqNullSafe(F.col("c_org"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"c_{b}"))
    return cand.join(c, same, "left").withColumn("n", F.coalesce("n", F.lit(0.5))).drop("c_org", *[f"c_{b}" for b in by])


def top_hit(hits: DataFrame, org: str = "hit", group=GROUP, order: str = "pos", weights: DataFrame | None = None, counts: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(group, org, hit): each read goes to the most abundant of its organisms, ties to the first in the alphabet (null
    before all). Abundance is counted over reads of one organism, of all files or apart by columns of the group (by), or
    given as counts (by, org, n); an organism without a count has 0.5."""
    cand = candidates(hits, org, group, order)
    scored = _counted(cand, clear_counts(cand, group, weights, by) if counts is None else counts, by)
    return scored.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), "org", "hit")).alias("b")).select(*group, "b.org", "b.hit")


def top_hit_proportional(hits: DataFrame, org: str = "hit", group=GROUP, order: str = "pos", weights: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(group, org): reads that share a set of organisms are dealt to them by abundance, of all files or apart by columns
    of the group (by).

    Of n such reads an organism gets the whole part of n times its share, the larger quotas first, taken from the last
    read backwards; what is left goes, read by read, to the organisms of the largest remainders, ties to the later one in
    the alphabet."""
    cand = candidates(hits, org, group, order)
    counts = clear_counts(cand, group, weights, by)
    reads = cand.groupBy(*group).agg(F.array_sort(F.collect_set("org")).alias("orgs"), F.max("pos").alias("pos"))
    clear = reads.where("size(orgs) <= 1").select(*group, F.try_element_at("orgs", F.lit(1)).alias("org"))
    # a set of organisms goes by a digest of its text, which is shorter than most sets
    doubt = reads.where("size(orgs) > 1").withColumn("set", F.sha2(F.to_json(F.struct(*by, "orgs")), 256))
    sets = doubt.groupBy("set").agg(F.count("*").alias("reads"), F.first("orgs").alias("orgs"), *[F.first(b).alias(b) for b in by]).select("set", *by, "reads", F.posexplode("orgs").alias("i", "org"))
    q = _counted(sets, counts, by)
    by_set = Window.partitionBy("set")
    quota = F.col("n") * F.col("reads") / F.sum("n").over(by_set)
    q = q.withColumn("x", quota).withColumn("whole", F.floor(F.col("x") + 1e-12)).withColumn("rest", F.col("x") - F.col("whole"))
    upto = F.sum("whole").over(by_set.orderBy(F.desc("x"), "i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = q.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("whole"))
    q = q.withColumn("dealt", F.sum("whole").over(by_set)).withColumn("k", F.row_number().over(by_set.orderBy(F.desc(F.round("rest", 9)), F.desc("i"))))
    q = q.select(F.col("set").alias("q_set"), "org", "lo", "hi", (F.col("dealt") + F.col("k")).alias("extra"))
    numbered = running(doubt.select(*group, "set", "pos"), ["set"], [F.desc("pos")], F.lit(1), "rn")
    mine = (F.col("rn") > F.col("lo")) & (F.col("rn") <= F.col("hi")) | (F.col("rn") == F.col("extra"))
    dealt = numbered.join(q, (F.col("set") == F.col("q_set")) & mine).select(*group, "org")
    return clear.unionByName(dealt)
