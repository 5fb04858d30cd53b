"""Filters on the hits of each read.

All filters keep whole rows. A read is what ``group`` says (by default label and read); ``order`` puts the hits of a read
in file order. Row filters are plain predicates below everything else; the best score of a read is an aggregate joined
back, so that a read of very many hits is summed before the shuffle and its join can be split; only limits per read need
a rank, and Spark cuts those rows to the limit before the shuffle where the rank allows it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.names import free_name
from hitweave.functions.spans import Taken
from hitweave.operators.folds import fold
from hitweave.operators.places import running

GROUP, ORDER = ("label", "read"), "pos"


@dataclass(frozen=True)
class FilterParams:
    """What to keep of each read; a default value leaves its filter out.

    top_pct: least score in percent below the best of the read; bits: least score; evalue: most; pctid: least; length:
    least absolute alignment length; aln: least aligned fraction; hits_per_read: distinct hits; hsps_per_hit: rows of a
    hit; nonoverlapping: bases by which kept regions may overlap, -1 for off; sort: evalue, pctid or score; bad_refs: a
    DataFrame of one column of hits to drop first.
    """

    top_pct: float = -1
    bits: float = 0
    evalue: float | None = None
    pctid: float = 0
    length: int = 0
    aln: float | None = None
    hits_per_read: int = 0
    hsps_per_hit: int = 0
    nonoverlapping: int = -1
    sort: str | None = None
    bad_refs: DataFrame | None = None

    @property
    def active(self) -> bool:
        return replace(self, sort=None) != FilterParams()

    def name(self, base: str) -> str:
        """base with a suffix that tells the active filters."""
        parts = [("I", self.pctid), ("L", self.length), ("B", self.bits), ("E", self.evalue), ("N", self.aln), ("P", self.hsps_per_hit), ("F", self.top_pct if self.top_pct >= 0 else None)]
        out = "".join(f".{k}{v:g}" for k, v in parts if v)
        if self.top_pct == 0:
            out += ".F0"
        if self.nonoverlapping >= 0:
            out += f".U{self.nonoverlapping or ''}"
        return base + out + (f".H{self.hits_per_read}" if self.hits_per_read else "")


def sort_order(sort: str | None, order: str = ORDER) -> list[Column]:
    """Order of the hits of a read: best first, then by hit; file order decides ties."""
    keys = {"evalue": F.col("evalue").asc_nulls_last(), "pctid": F.desc_nulls_last("pctid"), "score": F.desc_nulls_last("score")}
    if sort is None:
        return [F.col(order).asc()]
    if sort not in keys:
        raise ValueError(f"hits can't be sorted by {sort}")
    return [keys[sort], F.col("hit").asc(), F.col(order).asc()]


def best_scores(hits: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The highest score of each read, 0 at least: (group, best)."""
    return hits.groupBy(*group).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))


def row_predicate(p: FilterParams, columns: list[str], fmt: str | None = None) -> Column:
    """The filters that look at one row; fmt "last" knows no limit on evalue. A value that a limit asks for and the row
    lacks fails it."""
    keep = F.lit(True)
    for name, wanted in (("pctid", p.pctid > 0), ("aln", p.aln is not None), ("evalue", p.evalue is not None), ("mlen", p.length > 0)):
        if wanted and name not in columns:
            raise ValueError(f"the hits have no {name} to filter by")
    if p.bits > 0:
        keep = keep & (F.col("score") >= p.bits)
    if p.evalue is not None and fmt != "last":
        keep = keep & (F.col("evalue") <= p.evalue)
    if p.pctid > 0:
        keep = keep & (F.col("pctid") >= p.pctid)
    if p.length > 0:
        keep = keep & (F.abs("mlen") >= p.length)
    if p.aln is not None:
        keep = keep & (F.col("aln") >= p.aln)
    return keep


def sort_value(sort: str | None) -> Column:
    """A number that rises in the order of sort; what lacks the value comes last."""
    by = {"evalue": F.col("evalue"), "pctid": -F.col("pctid"), "score": -F.col("score"), None: F.lit(0.0)}
    if sort not in by:
        raise ValueError(f"hits can't be sorted by {sort}")
    return F.coalesce(by[sort].cast("double"), F.lit(float("inf")))


def limit_hits(hits: DataFrame, n: int, group=GROUP, sort: str | None = None, order: str = ORDER) -> DataFrame:
    """Rows of the first n distinct hits of each read.

    The first row of each hit is found before the shuffle, and tasks keep no more than n hits of a read when these are
    ranked, so that a read of very many rows or hits is nowhere gathered."""
    keys = [*group, "hit"]
    names = [f"first_{i}" for i in range(len(keys))]
    tie = [F.col("hit")] if sort else []
    first = hits.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, names)]).agg(F.min(F.struct(sort_value(sort).alias("k"), *[t.alias("t") for t in tie], F.col(order).alias("o"))).alias("first_row"))
    place = F.row_number().over(Window.partitionBy(*names[:-1]).orderBy("first_row"))
    kept = first.withColumn("first_place", place).where(F.col("first_place") <= n)
    same = F.lit(True)
    for k, a in zip(keys, names):
        same = same & hits[k].eqNullSafe(kept[a])
    return hits.join(kept, same, "left_semi")


def limit_hsps(hits: DataFrame, n: int, group=GROUP, order: list[Column] | None = None) -> DataFrame:
    """The first n rows of each hit of a read."""
    rank = free_name("rank_", hits.columns)
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*group, "hit").orderBy(*(order or [F.col(ORDER)])))).where(F.col(rank) <= n).drop(rank)


def _greedy(rows, buffer: int, most_hits: int, most_rows: int):
    """Of rows (start, stop, hit, id) the ids of those that overlap no kept one by more than buffer, within the limits."""
    taken, per_hit = Taken(), {}
    for s, e, h, i in rows:
        n = per_hit.get(h, 0)
        if (most_hits and not n and len(per_hit) >= most_hits) or (most_rows and n >= most_rows) or taken.meets(s, e, buffer):
            continue
        taken.add(s, e)
        per_hit[h] = n + 1
        yield (i,)


def nonoverlapping(hits: DataFrame, buffer: int, group=GROUP, sort: str | None = None, order: str = ORDER, most_hits: int = 0, most_rows: int = 0) -> DataFrame:
    """Greedy choice of rows whose query regions overlap by no more than buffer, in order; touching ends don't overlap.

    Whether a row stays depends on all rows kept before it, so a read is decided by one task. What goes there is, of all
    rows of a read on one and the same region (and, with limits, of one hit), the first, as it keeps the others out. So a
    read has no more rows there than regions, and of these only the columns that the decision needs. Rows without
    coordinates are dropped."""
    keys = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
    s, e = F.least("qstart", "qend"), F.greatest("qstart", "qend")
    small = hits.where("qstart is not null and qend is not null").select(*keys, sort_value(sort).alias("k"), (F.col("hit") if sort else F.lit("")).alias("t"), F.col(order).alias("p"), F.col("hit").alias("h"), s.alias("s"), e.alias("e"))
    n = len(group)
    # a region of no more bases than the buffer keeps nothing out
    alone = F.when(F.col("e") - F.col("s") <= buffer, F.col("p"))
    regions = small.groupBy(*[f"g{i}" for i in range(n)], "s", "e", (F.col("h") if most_hits or most_rows else F.lit("")).alias("of"), alone.alias("alone")).agg(F.min(F.struct("k", "t", "p", "h")).alias("m"))
    regions = regions.select(*[f"g{i}" for i in range(n)], "m.k", "m.t", "m.p", "m.h", "s", "e")
    kept = fold(regions, n, ["k", "t", "p"], lambda _, rows: _greedy(((r[n + 4], r[n + 5], r[n + 3], r[n + 2]) for r in rows), buffer, most_hits, most_rows), f"p {hits.schema[order].dataType.simpleString()}")
    return hits.join(kept.select(F.col("p").alias(order)), order, "left_semi")


def filter_hits(hits: DataFrame, p: FilterParams, group=GROUP, order: str = ORDER, fmt: str | None = None) -> DataFrame:
    """The rows that pass all filters of p. ``order`` must be unique. The best score of a read is taken of all its rows
    that bad_refs leaves; limits count only rows that pass everything else."""
    if p.bad_refs is not None:
        bad = p.bad_refs.select(F.col(p.bad_refs.columns[0]).alias("hit")).distinct()
        hits = hits.join(bad, "hit", "left_anti").select(*hits.columns)
    kept = hits
    if p.top_pct >= 0:
        best = best_scores(hits, group)
        same = F.lit(True)
        for i, g in enumerate(group):
            best = best.withColumnRenamed(g, f"best_{i}")
            same = same & hits[g].eqNullSafe(F.col(f"best_{i}"))
        cut = F.col("best") - F.lit(float(p.top_pct)) * F.col("best") / 100
        kept = hits.join(best, same).where(F.col("score") >= cut).select(*hits.columns)
    kept = kept.where(row_predicate(p, hits.columns, fmt))
    by = sort_order(p.sort, order)
    if p.nonoverlapping >= 0:
        return nonoverlapping(kept, p.nonoverlapping, group, p.sort, order, p.hits_per_read, p.hsps_per_hit)
    if p.hits_per_read:
        kept = limit_hits(kept, p.hits_per_read, group, p.sort, order)
    if p.hsps_per_hit:
        kept = limit_hsps(kept, p.hsps_per_hit, group, by)
    return kept


def ranked(hits: DataFrame, sort: str, group=GROUP, order: str = ORDER) -> DataFrame:
    """Hits with their place in the read when sorted."""
    return running(hits, list(group), sort_order(sort, order), F.lit(1), "place").withColumn("place", F.col("place").cast("int"))
