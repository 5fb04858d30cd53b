"""Lookup tables, lists, clusters, taxonomies, hierarchies and other dimensions in text files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.operators.translate import last_wins, strip_prefix, strip_version
from hitweave.sources.hits import read_lines


def _cells(lines: DataFrame, delimiter: str | None) -> Column:
    return F.split(F.trim("line"), r"\s+") if delimiter is None else F.split("line", F.lit(delimiter).cast("string") if delimiter == "\t" else delimiter)


def read_map(spark: SparkSession, paths, key: int = 0, value: int = 1, delimiter: str | None = "\t", skip: int = 0, value_delimiter: str | None = None, key_type: str = "string", value_type: str = "string") -> DataFrame:
    """(key, value) of two columns (from 0) of a table; the last row of a key holds, short rows are passed over. With
    value_delimiter values are arrays. skip: lines at the top of each file."""
    lines = _skip(read_lines(spark, paths), skip)
    c = _cells(lines, delimiter)
    rows = lines.select(F.try_element_at(c, F.lit(key + 1)).try_cast(key_type).alias("k"), F.try_element_at(c, F.lit(value + 1)).alias("v"), "pos").where("k is not null and v is not null")
    rows = rows.withColumn("v", F.split("v", value_delimiter) if value_delimiter else F.col("v").try_cast(value_type))
    return last_wins(rows, "k", "v", "pos")


def _skip(lines: DataFrame, n: int) -> DataFrame:
    """Without the first n lines of each file, which lie in its first block."""
    if not n:
        return lines
    head = lines.where(F.col("pos.block") == 0)
    drop = head.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where(F.col("r") <= n).select(F.col("pos").alias("p"))
    return lines.join(drop, F.col("pos") == F.col("p"), "left_anti")


def short_rows(spark: SparkSession, paths, columns: int, delimiter: str | None = "\t") -> DataFrame:
    """(file, line) of the rows of a table that have fewer columns; read_map() passes over them."""
    lines = read_lines(spark, paths)
    return lines.where((F.trim("line") != "") & (F.size(_cells(lines, delimiter)) < columns)).select("file", "line")


def read_list(spark: SparkSession, paths, column: int | None = None, delimiter: str = "\t", accessions: bool = False, first: int = 0) -> DataFrame:
    """Distinct ids of a column (counted from ``first``), or of whole lines; accessions lose their version."""
    lines = read_lines(spark, paths)
    column = None if column is None else column - first
    x = F.trim("line") if column is None else F.trim(F.try_element_at(F.split("line", delimiter), F.lit(column + 1)))
    return lines.select((strip_version(x) if accessions else x).alias("id")).where("id <> ''").distinct()


def read_clusters(spark: SparkSession, paths) -> DataFrame:
    """(name, size) of clusters: a line that begins with > opens one, its first member names it."""
    lines = read_lines(spark, paths)
    w = Window.partitionBy("file").orderBy("pos")
    x = lines.withColumn("c", F.sum(F.col("line").startswith(">").cast("int")).over(w)).withColumn("m", F.regexp_extract("line", r">([^.\s]+)", 1)).where(~F.col("line").startswith(">") & (F.col("m") != ""))
    return x.groupBy("file", "c").agg(F.min_by("m", "pos").alias("name"), F.count("*").alias("size")).select("name", "size")


def read_links(spark: SparkSession, paths, strip_key: bool = False, strip_value: bool = True) -> DataFrame:
    """(key, value) of a link file of two columns, all values of a key; prefixes up to a colon stripped on request."""
    c = F.split("line", "\t")
    k, v = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))
    x = read_lines(spark, paths).select((strip_prefix(k) if strip_key else k).alias("key"), (strip_prefix(v) if strip_value else v).alias("value"))
    return x.where("key <> '' and value <> ''").distinct()


def read_taxdump(spark: SparkSession, nodes: str, names: str) -> tuple[DataFrame, DataFrame]:
    """nodes (taxid, parent, rank) and names (taxid, name, unique_name, name_class, pos) of a taxonomy dump."""
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))))
    n = read_lines(spark, nodes).select(cells.alias("c")).select(F.col("c")[0].try_cast("int").alias("taxid"), F.col("c")[1].try_cast("int").alias("parent"), F.col("c")[2].alias("rank"))
    m = read_lines(spark, names).select(cells.alias("c"), "pos").select(F.col("c")[0].try_cast("int").alias("taxid"), F.col("c")[1].alias("name"), F.nullif(F.col("c")[2], F.lit("")).alias("unique_name"), F.col("c")[3].alias("name_class"), "pos")
    return n.where("taxid is not null"), m.where("taxid is not null")


def read_brite(spark: SparkSession, paths, level: str) -> DataFrame:
    """(ko, name) at a level (a letter, its number, or PATH) of hierarchy files: lines begin with the letter of their
    level. A header of a higher level ends that of a lower one. For PATH the name is that of the last header tagged
    [PATH:...]. Levels of the ids themselves can't be asked for."""
    letter = {"1": "A", "2": "B", "3": "C", "4": "D", "5": "E", "6": "F"}.get(str(level), str(level).upper())
    if letter != "PATH" and letter not in "ABCDEF":
        raise ValueError(f"no such level: {level}")
    text = F.trim(F.regexp_replace(F.expr("substring(line, 2)"), r"<[^>]*>", ""))
    x = read_lines(spark, paths).withColumn("l", F.substring("line", 1, 1)).where(F.col("l").rlike("^[A-F]$")).withColumn("t", text).where("t <> ''")
    x = x.withColumn("ko", F.nullif(F.regexp_extract("t", r"^(?:\S+\s+)?(K\d{5})\b", 1), F.lit("")))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("ko").isNull()
    if letter == "PATH":
        own = F.when(head, F.struct(F.when(F.col("t").contains("[PATH:"), F.col("t")).alias("n")))
    else:
        own = F.when(head & (F.col("l") <= letter), F.struct(F.when(F.col("l") == letter, F.col("t")).alias("n")))
    x = x.withColumn("name", F.last(own, True).over(w)["n"])
    return x.where("ko is not null and name is not null").select("ko", "name").distinct()


def read_ko_flat(spark: SparkSession, paths) -> DataFrame:
    """(ko, field, value) of flat files of records that end with ///: NAME, DEFINITION, PATHWAY and GENES lines (one row
    each; of genes one row for each id as organism:gene)."""
    records = spark.read.option("lineSep", "\n///").text(paths).select("value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for record in b["value"]:
                ko = field = None
                for line in record.strip("\n").split("\n"):
                    if line[:12].strip():
                        field = line[:12].strip()
                    text = line[12:].strip()
                    if field == "ENTRY":
                        ko = text.split()[0] if text else None
                    elif field == "GENES" and ":" in text:
                        org, _, genes = text.partition(":")
                        out += [(ko, "GENES", f"{org.strip().lower()}:{g.split('(')[0]}") for g in genes.split()]
                    elif field in ("NAME", "DEFINITION", "PATHWAY") and text:
                        out.append((ko, field, text))
            yield pd.DataFrame(out, columns=["ko", "field", "value"])

    return records.mapInPandas(run, "ko string, field string, value string").where("ko is not null")


def read_role_tree(spark: SparkSession, paths) -> DataFrame:
    """(role, subsystem, level2, level1) of a table of four columns."""
    c = F.split("line", "\t")
    return read_lines(spark, paths).where(F.size(c) >= 4).select(*[F.trim(c[i]).alias(n) for i, n in enumerate(("role", "subsystem", "level2", "level1"))])


def read_cog_table(spark: SparkSession, paths) -> DataFrame:
    """(gene, description, groups) of the five-column table of conserved domains; groups are split at slashes."""
    c = F.split("line", "\t")
    groups = F.transform(F.split(F.coalesce(F.try_element_at(c, F.lit(5)), F.lit("")), "/"), lambda x: F.trim(x))
    return read_lines(spark, paths).where(F.size(c) >= 4).select(c[1].alias("gene"), F.split(c[3], ",")[0].alias("description"), groups.alias("groups"))


def read_depths(spark: SparkSession, paths) -> DataFrame:
    """(contig, base, depth)."""
    c = F.split(F.trim("line"), r"\s+")
    return read_lines(spark, paths).where(F.size(c) >= 3).select(c[0].alias("contig"), c[1].try_cast("int").alias("base"), c[2].try_cast("int").alias("depth"))


def read_read_counts(spark: SparkSession, paths) -> DataFrame:
    """(contig, reads) of lines that begin with the number."""
    c = F.split(F.trim("line"), r"\s+", 2)
    return read_lines(spark, paths).where(F.size(c) == 2).select(F.trim(c[1]).alias("contig"), c[0].try_cast("long").alias("reads"))


def read_lineage_headers(spark: SparkSession, paths, sep: str = ";") -> DataFrame:
    """(acc, lineage) of the headers of a sequence file: the id, then names from the root down."""
    m = F.regexp_extract("line", r"^>(\S+)\s+(.*)$", 2)
    x = read_lines(spark, paths).where(F.col("line").startswith(">"))
    return x.select(F.regexp_extract("line", r"^>(\S+)", 1).alias("acc"), F.filter(F.transform(F.split(m, sep), lambda y: F.trim(F.regexp_replace(y, r"^[a-z]__", ""))), lambda y: y != "").alias("lineage"))


def read_assignments(spark: SparkSession, paths, read: int = 0, hit: int = 1, skip: int = 0, split: str | None = None) -> DataFrame:
    """(label, read, value, pos) of assignment tables: a hit column, or with hit < 0 every other column, a row each. split:
    a delimiter of several values in the hit column, a row each."""
    lines = _skip(read_lines(spark, paths), skip)
    c = F.split("line", "\t")
    if hit >= 0:
        x = lines.where(F.size(c) > max(read, hit)).select("label", c[read].alias("read"), c[hit].alias("value"), "pos")
        if split is None:
            return x
        parts = x.select("label", "read", "pos", F.posexplode(F.split("value", F.lit(re.escape(split)))).alias("i", "value")).withColumn("value", F.trim("value"))
        return parts.where("value <> ''").select("label", "read", "value", F.struct("pos", "i").alias("pos"))
    x = lines.select("label", c[read].alias("read"), F.posexplode(c).alias("i", "value"), "pos").where((F.col("i") != read) & (F.col("value") != ""))
    return x.select("label", "read", "value", F.struct("pos", "i").alias("pos"))


def catalog_taxa(spark: SparkSession, paths) -> DataFrame:
    """(acc, taxid) of a catalogue of taxid, name and accession."""
    c = F.split("line", "\t")
    return read_lines(spark, paths).where(F.size(c) >= 3).select(c[2].alias("acc"), c[0].try_cast("int").alias("taxid")).where("taxid is not null")


def genbank_taxa(spark: SparkSession, paths) -> DataFrame:
    """(acc, taxid): for each taxon reference of a GenBank file the last accession before it."""
    x = read_lines(spark, paths).withColumn("a", F.nullif(F.regexp_extract("line", r"^ACCESSION\s+(\S+)", 1), F.lit(""))).withColumn("t", F.regexp_extract("line", r'db_xref="taxon:(\d+)"', 1).try_cast("int"))
    x = x.where("a is not null or t is not null")
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("acc", F.last("a", True).over(w)).where("t is not null and acc is not null").select("acc", F.col("t").alias("taxid")).distinct()


def match_files(spark: SparkSession, pattern: str, constraints: dict[str, str] | None = None) -> DataFrame:
    """(file, name...) of the files that a path with named wildcards, like "in/{sample}.{ext}", matches. A wildcard doesn't
    cross a slash; one that comes again must have the same value; constraints: regular expressions for values."""
    constraints = constraints or {}
    names: list[str] = []
    form = ""
    for part in re.split(r"(\{\w+\})", pattern):
        if part[:1] == "{" and part[1:-1] in names:
            form += rf"\{names.index(part[1:-1]) + 1}"
        elif part[:1] == "{":
            names.append(part[1:-1])
            form += f"({constraints.get(part[1:-1], '[^/]+')})"
        else:
            form += re.escape(part)
    files = spark.read.format("binaryFile").load(re.sub(r"\{\w+\}", "*", pattern)).select(F.regexp_replace("path", "^file:/*", "/").alias("file"))
    return files.where(F.col("file").rlike(f"{form}$")).select("file", *[F.regexp_extract("file", f"{form}$", i).alias(n) for i, n in enumerate(names, 1)])


def read_subsystem_links(spark: SparkSession, paths, skip: int = 2) -> DataFrame:
    """(key, value) of accessions and their subsystems, all of each."""
    c = F.split("line", "\t")
    return _skip(read_lines(spark, paths), skip).where(F.size(c) >= 2).select(F.trim(c[0]).alias("key"), F.trim(c[1]).alias("value")).distinct()


def read_category_lines(spark: SparkSession, paths) -> DataFrame:
    """(gene, groups, description) of lines like "[JK] COG0001 about it": letters of groups in brackets."""
    form = r"^\[([A-Z]+)\]\s+(\S+)\s+(.*)$"
    x = read_lines(spark, paths).where(F.col("line").rlike(form))
    return x.select(F.regexp_extract("line", form, 2).alias("gene"), F.split(F.regexp_extract("line", form, 1), "").alias("groups"), F.trim(F.regexp_extract("line", form, 3)).alias("description"))


def read_ranked_list(spark: SparkSession, paths) -> DataFrame:
    """(id, name, lineage) of a list whose headers tell their depth by the number of # signs; other lines are leaves of
    an id and a name under the headers above them."""
    x = read_lines(spark, paths).where("trim(line) <> ''").withColumn("d", F.length(F.regexp_extract("line", r"^(#*)", 1))).withColumn("t", F.trim(F.regexp_replace("line", r"^#+", "")))
    most = x.agg(F.max("d")).collect()[0][0] or 0  # the depth of the deepest header
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, most + 1):  # a header ends those of its depth and below
        x = x.withColumn(f"h{k}", F.last(F.when((F.col("d") > 0) & (F.col("d") <= k), F.struct(F.when(F.col("d") == k, F.col("t")).alias("n"))), True).over(w)["n"])
    above = F.filter(F.array(*[F.col(f"h{k}") for k in range(1, most + 1)]).cast("array<string>"), lambda y: y.isNotNull())
    c = F.split("line", "\t")
    return x.where("d = 0").select(F.trim(c[0]).alias("id"), F.trim(F.element_at(c, -1)).alias("name"), above.alias("lineage"))


def lengths_from_caf(spark: SparkSession, paths) -> DataFrame:
    """(contig, length) of an assembly file: lengths of the DNA blocks of sequences that are contigs."""
    x = read_lines(spark, paths).withColumn("name", F.nullif(F.regexp_extract("line", r"^(?:DNA|Sequence|BaseQuality) ?: ?(\S+)", 1), F.lit("")))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("block", F.last(F.when(F.col("name").isNotNull(), F.struct(F.split("line", r" ?:")[0].alias("kind"), "name")), True).over(w))
    contigs = x.where("block.kind = 'Sequence' and trim(line) = 'Is_contig'").select("file", F.col("block.name").alias("contig")).distinct()
    size = x.where("block.kind = 'DNA' and name is null").groupBy("file", F.col("block.name").alias("contig")).agg(F.sum(F.length(F.regexp_replace("line", r"[\s-]", ""))).alias("length"))
    return size.join(contigs, ["file", "contig"]).select("contig", "length")


def read_table(spark: SparkSession, paths, names: dict[str, str] | None = None, sep: str = "\t", header: bool = True) -> DataFrame:
    """A table with a header (or numbered columns c0, c1, ...), columns renamed as names tells, all of text."""
    df = spark.read.option("sep", sep).option("header", header).csv(paths)
    if not header:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.withColumnsRenamed(names or {})


def read_bar_headers(spark: SparkSession, paths) -> DataFrame:
    """(acc, names, pos) of sequence headers like >acc|Aa|Bb|...: names from the root down."""
    c = F.split(F.regexp_replace(F.expr("substring(line, 2)"), r"[\r\n]+$", ""), r"\|")
    x = read_lines(spark, paths).where(F.col("line").startswith(">"))
    return x.select(c[0].alias("acc"), F.slice(c, F.lit(2), F.size(c)).alias("names"), "pos")


def read_second_lineage(spark: SparkSession, paths, sep: str = r"\s+") -> DataFrame:
    """(acc, lineage) of sequence headers whose second part, between sep, is the lineage as text."""
    c = F.split(F.expr("substring(line, 2)"), sep)
    return read_lines(spark, paths).where(F.col("line").startswith(">") & (F.size(c) > 1)).select(c[0].alias("acc"), c[1].alias("lineage"))


#: Other names of the levels of a flat file of orthologs.
LEVELS = {"PATH": "PATHWAY", "PATHS": "PATHWAY", "PATHWAYS": "PATHWAY", "DESCRIPTION": "DEFINITION", "FUNCTION": "DEFINITION", "EC": "ko01000:4"}


def read_ko_levels(spark: SparkSession, paths, level: str) -> DataFrame:
    """(ko, value) of a flat file of orthologs at a level: NAME, DEFINITION, PATHWAY, EC, a number (a level of the
    hierarchy ko00001) or hierarchy:number. Values of a hierarchy are the lines of that depth in its block, in full."""
    level = LEVELS.get(str(level).upper(), str(level))
    if level.upper() in ("NAME", "DEFINITION", "PATHWAY"):
        return read_ko_flat(spark, paths).where(F.col("field") == level.upper()).select("ko", "value")
    m = re.fullmatch(r"(?:(ko\d{5}):)?(\d+)", level)
    if not m:
        raise ValueError(f"no such level: {level}")
    hierarchy, depth = m[1] or "ko00001", int(m[2])
    records = spark.read.option("lineSep", "\n///").text(paths).select("value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for record in b["value"]:
                entry = re.search(r"^ENTRY\s+(K\d+)", record, re.M)
                block = re.search(r"^BRITE.*(?:\n[ \t].*)*", record, re.M)
                indent = None
                for line in (block[0] if block and entry else "").split("\n"):
                    text = line[5:].lstrip() if line.startswith("BRITE") else line.lstrip()
                    at = len(line) - len(text)
                    if head := re.search(r"\[BR:(ko\d+)\]\s*$", text):
                        indent = at if head[1] == hierarchy else None
                    elif indent is not None and at - indent == depth:
                        out.append((entry[1], text.rstrip()))
            yield pd.DataFrame(out, columns=["ko", "value"])

    return records.mapInPandas(run, "ko string, value string").distinct()


def read_kegg(spark: SparkSession, path: str, level: str) -> DataFrame:
    """(ko, value) at a level of either kind of file: a flat file called ko, or a hierarchy (.keg)."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name == "ko":
        return read_ko_levels(spark, path, level)
    if name.endswith(".keg"):
        return read_brite(spark, path, level).withColumnRenamed("name", "value")
    raise ValueError(f"neither a flat file of orthologs nor a hierarchy: {path}")
