"""Writing results: lines, annotations, tables, taxonomies, sequences, fragments, bars of text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(hits: DataFrame, path: str, column: str = "line") -> None:
    """The original lines of hits."""
    hits.select(F.col(column).alias("value")).where("value is not null").write.text(path)


def gff_line(columns: list[str]) -> Column:
    """A hit as a line of nine columns of annotation."""
    has = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in columns else F.lit(d)
    no_places = F.concat(F.lit("Target="), F.col("hit"))
    target = no_places if "hstart" not in columns else F.when(F.col("hstart").isNotNull(), F.concat(F.lit("Target="), F.col("hit"), F.lit(" "), F.col("hstart"), F.lit(" "), F.col("hend"))).otherwise(F.concat(F.lit("Target="), F.col("hit")))
    cigar = F.when(F.col("cigar").isNotNull(), F.concat(F.lit(";Cigar="), F.col("cigar"))).otherwise("") if "cigar" in columns else F.lit("")
    return F.concat_ws("\t", F.col("read"), has("source", "hitweave"), has("hit_type", "match"), F.least("qstart", "qend").cast("string"), F.greatest("qstart", "qend").cast("string"), has("score", "."), has("strand", "."), F.lit("."), F.concat(target, cigar))


def assignment_lines(values: DataFrame, group=("label", "read")) -> DataFrame:
    """(label, line): a read and its sorted values, between tabs."""
    got = values.groupBy(*group).agg(F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("v"))
    return got.select("label", F.concat_ws("\t", "read", F.array_join("v", "\t")).alias("line"))


def write_by_label(lines: DataFrame, path: str) -> None:
    """A folder of text for each label."""
    lines.select("label", F.col("line").alias("value")).write.partitionBy("label").text(path)


def write_counts(counts: DataFrame, path: str, wide: bool = True, labels: list[str] | None = None, text: Column | None = None, about: DataFrame | None = None) -> None:
    """A table of counts by label as columns, or long, in the order of the value, or of text (a formatted name, say), which
    then stands in its place. about: (value, ...), further columns of each value, put behind it."""
    from hitweave.operators.counts import wide as spread

    table = spread(counts, labels) if wide else counts
    if about is not None:
        more = [c for c in about.columns if c != "value"]
        table = table.join(about.withColumnRenamed("value", "of_"), F.col("value") == F.col("of_"), "left").select("value", *more, *[c for c in table.columns if c != "value"])
    table = table.withColumn("value", text if text is not None else F.col("value"))
    table.orderBy(F.coalesce(F.col("value").cast("string"), F.lit(""))).write.option("sep", "\t").option("header", True).csv(path)


def write_annotations(regions: DataFrame, folder: str) -> None:
    """Regions (read, hit, qstart, qend, number, bases, line) as three files of text: annotations, bases and proteins."""
    from hitweave.operators.sequences import translated

    name = F.concat_ws("_", "read", "number")
    place = F.concat_ws(" # ", F.lit(""), F.col("qstart").cast("string"), F.col("qend").cast("string"))
    line = F.coalesce("line", gff_line(regions.columns)) if "line" in regions.columns else gff_line(regions.columns)
    regions.select(line.alias("value")).write.text(f"{folder}/gff")
    regions.select(fasta_text(name, F.trim(place), F.col("bases")).alias("value")).write.text(f"{folder}/fna")
    regions.select(fasta_text(name, F.trim(place), translated(F.col("bases"))).alias("value")).write.text(f"{folder}/faa")


def fasta_text(seq_id: Column, description: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), F.concat_ws(" ", seq_id, F.nullif(description, F.lit(""))), F.lit("\n"), seq)


def write_fragments(records: DataFrame, path: str, text: str = "text", fragment: str = "fragment") -> None:
    """Records in a folder for each fragment."""
    records.select(fragment, F.col(text).alias("value")).write.partitionBy(fragment).text(path)


def write_taxdump(nodes: DataFrame, folder: str) -> None:
    """nodes (taxid, parent, rank, name) as dump files; a root is its own parent, domains are superkingdoms."""
    end = F.lit("\t|")
    rank = F.when(F.col("rank").isNull() | (F.trim("rank") == ""), "no rank").when(F.col("rank") == "domain", "superkingdom").otherwise(F.col("rank"))
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *c), end).alias("value")
    nodes.select(line(F.col("taxid").cast("string"), F.coalesce("parent", "taxid").cast("string"), rank)).write.text(f"{folder}/nodes.dmp")
    nodes.select(line(F.col("taxid").cast("string"), F.coalesce("name", F.lit("")), F.lit(""), F.lit("scientific name"))).write.text(f"{folder}/names.dmp")


def bars(histogram: list[tuple[float, float, int]], width: int = 60, log: bool = False) -> str:
    """A histogram (low, high, n) as lines of text; of the bins only, which are few."""
    size = lambda n: math.log10(n + 1) if log else n
    top = max((size(n) for _, _, n in histogram), default=0) or 1
    return "\n".join(f"{lo:>12g} {'|' * round(width * size(n) / top)} {n}" for lo, _, n in histogram)


def escaped(column: Column, delimiter: str) -> Column:
    """Text in which a delimiter is replaced by _."""
    return F.replace(column, F.lit(delimiter), F.lit("_"))


def sorted_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines in the order of their bytes."""
    return lines.orderBy(column)


def in_order(counts: DataFrame, text: Column | None = None) -> DataFrame:
    """Counts in the order of the value, or of a text for it; null first."""
    return counts.orderBy(F.coalesce(text if text is not None else F.col("value").cast("string"), F.lit("")))


def head(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first n rows (the number is the feature)."""
    return rows.orderBy(order).limit(n)


def matching_lines(lines: DataFrame, pattern: str, column: str = "line") -> DataFrame:
    return lines.where(F.col(column).rlike(pattern))


def byte_stream(lines: DataFrame, column: str = "line"):
    """Lines one after the other as bytes, for what reads a stream; one partition at a time is fetched."""
    for r in lines.select(column).toLocalIterator():
        yield (r[0] or "").encode() + b"\n"


def none_option(text: str | None) -> str | None:
    """An option that may be the word None."""
    return None if text is None or text.strip().lower() == "none" else text
