"""Whole tasks, composed of operators: what a user asks for in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.functions.names import free_name
from hitweave.operators import assembly, counts, intervals, reduce, taxonomy, tophit, translate
from hitweave.operators.filters import GROUP, FilterParams, filter_hits
from hitweave.operators.sequences import region
from hitweave.schema import RANKS
from hitweave.sources.hits import read_hits


def values_of(hits: DataFrame, style: str | None = None, mapping: DataFrame | None = None, from_description: bool | None = None, missing: str = "none", group=GROUP) -> DataFrame:
    """(group, pos, value): what each hit stands for. style: a form of ids (translate.PATTERNS) looked for in the hit's id,
    or its description for organisms, pathways and families; mapping: (key, value), several of a key allowed."""
    text = "hit_desc" if (from_description if from_description is not None else style in ("organism", "ko", "pfam")) else "hit"
    ids = translate.extract(F.col(text), style) if style else F.array(text)
    x = hits.select(*group, F.col("pos").alias("at"), F.posexplode(ids).alias("i", "value")).select(*group, F.struct("at", "i").alias("pos"), "value")
    if mapping is None:
        return x
    got = translate.lookup_many(x, "value", mapping, "to")
    return got.withColumn("value", F.coalesce("to", F.col("value").cast(mapping.schema["value"].dataType)) if missing == "key" else F.col("to")).drop("to")


def reduced(values: DataFrame, method: str = "first", lines: DataFrame | None = None) -> DataFrame:
    """What is said of each read: first, all, most, consensus or LCA of its values."""
    if method.lower() in ("lca", "rlca"):
        if lines is None:
            raise ValueError("an ancestor needs a taxonomy")
        return reduce.lca(values, lines)
    return reduce.METHODS[method](values)


def assign_taxa(hits: DataFrame, params: FilterParams, mapping: DataFrame, lines: DataFrame, method: str = "first", style: str = "accession", rank: str | None = None) -> DataFrame:
    """(label, read, value): taxa of reads, at a rank if one is given."""
    got = reduced(values_of(filter_hits(hits, params), style, mapping), method, lines)
    return at_rank(got, lines, rank) if rank else got


def at_rank(values: DataFrame, lines: DataFrame, rank: str) -> DataFrame:
    """values with the ancestor nearest to a rank in place of each taxon."""
    near = lines.select(F.col("taxid").alias("value"), taxonomy.ancestor_closest_to_rank(F.col("lineage"), rank).alias("near"))
    return values.join(near, "value", "left").withColumn("value", F.coalesce("near", "value")).drop("near").select(*values.columns)


def count_taxa(hits: DataFrame, params: FilterParams, mapping: DataFrame, lines: DataFrame, ranks: list[str] = ("phylum",), method: str = "first", style: str = "accession", how: str = "all", cutoff: float = 0, weights: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counts (label, value, n) of taxa for each rank, from the highest down; method tophit or toporg chooses by abundance
    over all samples. Taxa of no more than cutoff of every sample go to their superkingdom, or root."""
    ranks = clean_ranks(list(ranks))
    if len(ranks) > 1 and method in ("consensus", "most"):
        raise ValueError(f"{method} values belong to one rank")
    kept = filter_hits(hits, params)
    if method in ("tophit", "toporg"):
        named = translate.lookup(kept.withColumn("acc", translate.extract(F.col("hit"), style)[0]), "acc", mapping, "taxid")
        values = tophit.top_hit(named.withColumn("org", F.col("taxid")), "acc" if method == "tophit" else "org", weights=weights)
        values = values.select("label", "read", F.col("org").alias("value"))
        values = translate.lookup(values, "value", mapping, "t").drop("value").withColumnRenamed("t", "value") if method == "tophit" else values
    else:
        values = reduced(values_of(kept, style, mapping), method, lines)
    if "pos" not in values.columns:
        values = values.withColumn("pos", F.lit(0))
    n = counts.count_values(values, how, weights)
    home = lines.select(F.col("taxid").alias("tid"), F.coalesce(taxonomy.ancestor_at_rank(F.col("lineage"), "superkingdom"), F.col("lineage")[0]["taxid"]).alias("home"))
    out = {}
    for rank in ranks:
        r = at_rank(n, lines, rank).groupBy("label", "value").agg(F.sum("n").alias("n"))
        out[rank] = counts.fold_below_cutoff(r.join(home, F.col("value") == F.col("tid"), "left"), cutoff, F.col("home")) if cutoff else r
    return out


def clean_ranks(ranks: list[str]) -> list[str]:
    """Each rank once, domain as superkingdom, the highest first; unknown ones are refused."""
    names = {"superkingdom" if r == "domain" else r for r in ranks}
    unknown = names - set(RANKS)
    if unknown:
        raise ValueError(f"no ranks: {sorted(unknown)}")
    return sorted(names, key=RANKS.index, reverse=True)


def clean_levels(levels: list[str]) -> list[str]:
    """Each level once, as text, in the order given; None and the empty text stand for the genes themselves."""
    return list(dict.fromkeys("gene" if x is None or str(x).strip().lower() in ("", "none") else str(x).strip() for x in levels))


def count_hit_files(spark: SparkSession, paths, fmt: str = "gene", mapping: DataFrame | None = None, style: str | None = None, params: FilterParams = FilterParams(top_pct=0), how: str = "first") -> DataFrame:
    """(label, value, n) of files of hits in one call: parsed, filtered to the best hits, translated and counted."""
    hits = filter_hits(read_hits(spark, paths, fmt), params)
    return counts.count_values(values_of(hits, style, mapping), how)


def count_paths(hits: DataFrame, params: FilterParams, links: DataFrame, levels: dict[str, DataFrame | None], method: str = "tophit", style: str | None = None, how: str = "all", cutoff: float = 0, weights: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counts (label, value, n) of genes at each level; levels: name -> (value, level_value), None for the genes. links:
    (key, value), ids to genes; a top hit is translated to the first of its genes."""
    kept = filter_hits(hits, params)
    if method == "tophit":
        ids = kept.withColumn("org", translate.extract(F.col("hit"), style)[0] if style else F.col("hit"))
        one = links.groupBy("key").agg(F.min("value").alias("value"))
        values = translate.lookup(tophit.top_hit(ids, "org", weights=weights), "org", one, "value").select("label", "read", "value").withColumn("pos", F.lit(0))
    else:
        values = reduced(values_of(kept, style, links), method)
        values = values if "pos" in values.columns else values.withColumn("pos", F.lit(0))
    n = counts.count_values(values, how, weights)
    out = {}
    for name, membership in levels.items():
        r = counts.roll_up(n, membership) if membership is not None else n
        out[name] = counts.fold_below_cutoff(r, cutoff, F.lit("Other")) if cutoff else r
    return out


def assign_paths(hits: DataFrame, params: FilterParams, links: DataFrame, levels: dict[str, DataFrame | None], method: str = "first", style: str | None = None, squash: bool = False) -> DataFrame:
    """(label, read, a column for each level): the levels of the reads' genes. Of several members a read has a row for each
    combination, or with squash one row of sorted lists."""
    x = reduced(values_of(filter_hits(hits, params), style, links), method).select(*GROUP, F.col("value").alias("gene_"))
    for name, membership in levels.items():
        if membership is None:
            x = x.withColumn(name, F.array("gene_"))
            continue
        m = membership.groupBy(F.col("value").alias("m_gene")).agg(F.array_sort(F.collect_set("level_value")).alias("m"))
        x = x.join(m, F.col("gene_") == F.col("m_gene"), "left").withColumn(name, F.coalesce("m", F.array("gene_"))).drop("m", "m_gene")
    if not squash:
        for name in levels:
            x = x.withColumn(name, F.explode(name))
    return x.drop("gene_")


def count_hits(values: DataFrame, how: str = "all", cutoff: float = 0, total: bool = False) -> DataFrame:
    """(value, n) of an assignment table; values of less than cutoff of its reads as Other; total: with a row Total."""
    n = counts.count_values(values.withColumn("all_", F.lit(1)), how, by=("all_",))
    reads = values.select(*GROUP).distinct().agg(F.count("*").alias("reads"))  # one row
    if cutoff:
        n = counts.fold_rare(n.crossJoin(F.broadcast(reads)), F.col("reads") * cutoff, by=("all_",))
    out = n.select("value", F.col("n").cast("double"))
    return out.unionByName(reads.select(F.lit("Total").alias("value"), F.col("reads").cast("double").alias("n"))) if total else out


def merge_annotations(cds: DataFrame, rna: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Coding regions that overlap no RNA region, with the RNA regions, numbered along each contig: both inputs' columns
    and ``number``. Both are hits with read, qstart, qend and the same columns; contigs: (id, seq) adds the bases."""
    span = lambda d: d.withColumn("start", F.least("qstart", "qend")).withColumn("stop", F.greatest("qstart", "qend"))
    kept = intervals.overlap_join(span(cds), span(rna), "read", "left_anti").unionByName(span(rna))
    number = free_name("number", kept.columns)
    out = kept.withColumn(number, F.row_number().over(Window.partitionBy("read").orderBy("start", "stop")))
    if contigs is None:
        return out.drop("start", "stop")
    return out.join(contigs.select(F.col("id").alias("read"), F.col("seq").alias("contig_seq")), "read").withColumn("bases", region(F.col("contig_seq"), F.col("qstart"), F.col("qend"))).drop("contig_seq", "start", "stop")


def contig_report(contigs: DataFrame, shares=(50, 75, 90)) -> tuple[DataFrame, DataFrame]:
    """N statistics and column statistics of contigs (contig, length, gc)."""
    return counts.n_statistics(contigs, "length", shares), assembly.column_stats(contigs, ["length", "gc"])
