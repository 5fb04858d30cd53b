"""Statistics of contigs: depth, lengths, histograms, hit rates and coverage by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.places import running


def depth_stats(depths: DataFrame, contig: str = "contig", depth: str = "depth") -> DataFrame:
    """(contig, mean, min, max, median) of the depths of each contig; the median is exact, of counts of depths."""
    d = F.col(depth)
    return depths.groupBy(contig).agg(F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.percentile(d, F.lit(0.5)).alias("median"))


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, mean, median, std) of numeric columns, std of a sample; one pass over the rows."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std")))
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of equal width between least and greatest value; the last bin holds the greatest. All bins are
    there, also empty ones. Nulls are left out; no values: no bins."""
    x = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")  # one row
    ends = ends.withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    n = x.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("w") * F.col("bin")).alias("low"), (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def closed_bin(value: Column, low: Column, width: Column, bins: int, strict: bool = False) -> Column:
    """Bin from 1 of ranges closed at both ends, the lower one for a value on an edge; null outside, or with strict an
    error there."""
    b = F.greatest(F.ceil((value - low) / width), F.lit(1))
    outside = F.raise_error(F.concat(F.lit("outside of all bins: "), value.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    return F.when((value >= low) & (b <= bins), b.cast("int")).when(value.isNotNull(), outside)


def contig_table(contigs: DataFrame, read_counts: DataFrame | None = None, depths: DataFrame | None = None, least: int = 0) -> DataFrame:
    """contigs (contig, length, gc) of at least least bases, with reads and depth statistics where known (0 if not) and
    the bases of all contigs as long or longer, cumulated by length."""
    x = contigs.where(F.col("length") >= least)
    if read_counts is not None:
        x = x.join(read_counts.groupBy("contig").agg(F.sum("reads").alias("reads")), "contig", "left").na.fill(0, ["reads"])
    if depths is not None:
        x = x.join(depth_stats(depths), "contig", "left").na.fill(0, ["mean", "min", "max", "median"])
    by_length = contigs.where(F.col("length") >= least).groupBy("length").agg(F.sum("length").alias("bases"))
    run = running(by_length, [], [F.desc("length")], F.col("bases"), "cumulative").select("length", "cumulative")
    return x.join(run, "length")


def hit_rate_by_length(seqs: DataFrame, hit_ids: DataFrame, edges: list[float]) -> DataFrame:
    """(bin, sequences, hits, rate) by length: how many of the sequences (id, length) of a bin have a hit (id)."""
    found = hit_ids.select("id").distinct().withColumn("hit", F.lit(1))
    x = seqs.join(found, "id", "left").withColumn("bin", length_bin(F.col("length"), edges))
    return _with_all_bins(x.groupBy("bin").agg(F.count("*").alias("sequences"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")), edges, ["sequences", "hits"]).withColumn("rate", F.coalesce(F.try_divide("hits", "sequences"), F.lit(0.0)))


def coverage_by_length(seqs: DataFrame, spans: DataFrame, edges: list[float]) -> DataFrame:
    """(bin, bases, covered, coverage) by length: bases of the sequences (id, length), and of their longest hit each
    (spans: id, start, stop)."""
    longest = spans.groupBy("id").agg(F.max(F.abs(F.col("stop") - F.col("start")) + 1).alias("span"))
    x = seqs.join(longest, "id", "left").withColumn("bin", length_bin(F.col("length"), edges))
    return _with_all_bins(x.groupBy("bin").agg(F.sum("length").alias("bases"), F.coalesce(F.sum("span"), F.lit(0)).alias("covered")), edges, ["bases", "covered"]).withColumn("coverage", F.coalesce(F.try_divide("covered", "bases"), F.lit(0.0)))


def reference_coverage(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, length, covered, coverage): bases of each sequence (id, length) that any span (id, s, e, in either direction)
    covers, counted once. Spans are reduced to the furthest end of each start before the shuffle."""
    ends = spans.where("s is not null and e is not null").groupBy("id", F.least("s", "e").alias("lo")).agg(F.max(F.greatest("s", "e")).alias("hi"))
    w = Window.partitionBy("id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("hi") - F.greatest(F.coalesce(F.max("hi").over(w), F.lit(0)), F.col("lo") - 1), F.lit(0))
    got = ends.withColumn("new", new).groupBy("id").agg(F.sum("new").alias("covered"))
    x = lengths.join(got, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return x.withColumn("coverage", F.coalesce(F.try_divide("covered", "length"), F.lit(0.0)))


def length_bin(value: Column, edges: list[float]) -> Column:
    """Number of the half-open range of edges that holds value, from 1; 0 below the first, len(edges) above the last."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def _with_all_bins(binned: DataFrame, edges: list[float], columns: list[str]) -> DataFrame:
    every = binned.sparkSession.range(0, len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(binned, "bin", "left").na.fill(0, columns)
