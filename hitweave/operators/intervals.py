"""Intervals: overlaps between tables, merging the parts of a hit, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.names import free_name
from hitweave.functions.spans import Taken
from hitweave.operators.filters import GROUP
from hitweave.operators.folds import fold

#: Width of the bins by which intervals meet.
BIN = 1024


def _bins(start: Column, stop: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(stop / width)))


def overlap_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner", buffer: int = 0, width: int = BIN) -> DataFrame:
    """Rows of a by whether they overlap a row of b of the same key: all pairs (inner, with b's columns as b_...), or the
    rows of a that do (left_semi) or don't (left_anti).

    Both have columns key, start and stop (start <= stop). Ends that touch, or overlap by no more than buffer, don't
    count. For pairs, intervals meet in bins of the line, and a pair counts in the first bin that both have. Whether a row
    overlaps anything is read off the furthest end of all intervals of b that begin before its own end; b is reduced to
    one row for each start before the shuffle, and a to its distinct ends, so that a key of very many rows, or very many
    rows of one place, don't meet. Repeated rows count each; null keys and ends overlap nothing."""
    if how == "inner":
        bin_, k = free_name("bin_", a.columns), free_name("key_", a.columns)
        x = a.withColumn(k, F.col(key)).withColumn(bin_, _bins(F.col("start"), F.col("stop"), width))
        y = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("b_bin", _bins(F.col("b_start"), F.col("b_stop"), width))
        first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("b_start") / width)) == F.col(bin_)
        apart = (F.col("start") + buffer >= F.col("b_stop")) | (F.col("stop") - buffer <= F.col("b_start"))
        return x.join(y, (F.col(k) == F.col(f"b_{key}")) & (F.col(bin_) == F.col("b_bin"))).where(~apart & first).drop(k, bin_, "b_bin")
    begun = b.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), F.col("start").alias("x")).agg(F.max("stop").alias("e"))
    asked = a.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), (F.col("stop") - buffer).alias("x")).distinct()
    points = begun.withColumn("kind", F.lit(1)).unionByName(asked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # at one place those who ask come first: what begins there is not before their end
    reach = F.max("e").over(Window.partitionBy("k").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = [free_name(n, a.columns) for n in ("reach_k", "reach_x", "reach_e")]
    top = points.withColumn("reach", reach).where("kind = 0 and reach is not null").select(*[F.col(c).alias(n) for c, n in zip(("k", "x", "reach"), names)])
    met = (F.col(key) == F.col(names[0])) & (F.col("stop") - buffer == F.col(names[1]))
    hit = F.coalesce(F.col(names[2]) > F.col("start") + buffer, F.lit(False))
    return a.join(top, met, "left").where(hit if how == "left_semi" else ~hit).drop(*names)


def merge_hsps(hits: DataFrame, buffer: int = 0, group=GROUP, order: str = "pos") -> DataFrame:
    """The parts of each hit of a read as one row: (group, hit, n, mlen, score, pctid, qstart, qend, hstart, hend).

    First parts are taken in order if they overlap no part taken before on the reference (by its coordinates as they
    stand), then of these the ones that don't overlap on the query. Lengths and scores add up, identities are weighted by
    length."""
    keys = [*group, "hit"]
    cols = [*keys, order, "mlen", "score", "pctid", "qstart", "qend", "hstart", "hend"]
    x = hits.select(*cols).where("qstart is not null and qend is not null and hstart is not null and hend is not null")

    n = len(keys)

    def merge(key: tuple, rows):
        on_hit, on_query = Taken(), Taken()
        count = length = weight = 0
        score = identity = None
        box: list[int] = []
        for _, mlen, s, pctid, qs, qe, hs, he in (r[n:] for r in rows):
            if on_hit.meets(hs, he, buffer):
                continue
            on_hit.add(hs, he)
            q = (min(qs, qe), max(qs, qe))
            if on_query.meets(*q, buffer):
                continue
            on_query.add(*q)
            count, length = count + 1, length + (mlen or 0)
            score = s if score is None else score + (s or 0.0)
            if pctid is not None and mlen:
                identity, weight = (identity or 0.0) + pctid * mlen, weight + mlen
            h = (min(hs, he), max(hs, he))
            box = [min(box[0], q[0]), max(box[1], q[1]), min(box[2], h[0]), max(box[3], h[1])] if box else [*q, *h]
        yield (*key, count, length, score, identity / weight if weight else None, *box)

    kinds = ", ".join(f"`{k}` {hits.schema[k].dataType.simpleString()}" for k in keys)
    return fold(x, n, [order], merge, f"{kinds}, n int, mlen long, score double, pctid double, qstart int, qend int, hstart int, hend int")


def uncovered(spans: DataFrame, lengths: DataFrame, least: int = 1) -> DataFrame:
    """The stretches (id, s, e) of 1..n that no span covers, of at least least bases. spans: (id, s, e) in any order and
    direction, null ends ignored; lengths: (id, n). An id without spans is one stretch. Spans are reduced to the furthest
    end of each start before the shuffle."""
    lo, hi = F.least("s", "e"), F.greatest("s", "e")
    ends = spans.where("s is not null and e is not null").groupBy("id", lo.alias("lo")).agg(F.max(hi).alias("hi"))
    w = Window.partitionBy("id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    between = ends.withColumn("before", F.coalesce(F.max("hi").over(w), F.lit(0))).select("id", (F.col("before") + 1).alias("s"), (F.col("lo") - 1).alias("e"))
    between = between.join(lengths, "id").select("id", "s", F.least("e", "n").alias("e"))
    last = lengths.join(ends.groupBy("id").agg(F.max("hi").alias("hi")), "id", "left").select("id", (F.coalesce("hi", F.lit(0)) + 1).alias("s"), F.col("n").alias("e"))
    return between.unionByName(last).where(F.col("e") - F.col("s") + 1 >= F.greatest(F.lit(least), F.lit(1))).select("id", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))
