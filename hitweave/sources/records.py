"""Sequence records: FASTA, FASTQ, GenBank, tables and records by pattern or number of lines."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.sources.hits import read_lines

#: Endings of file names by kind.
KINDS = {"fasta": (".fa", ".fna", ".faa", ".ffn", ".fasta", ".fas", ".seq"), "fastq": (".fq", ".fastq"), "genbank": (".gb", ".gbk", ".gbff", ".gpff"), "table": (".tsv", ".csv", ".tab", ".txt", ".m8", ".sam", ".gff")}


def kind_of(path: str, kind: str | None = None, pattern: str | None = None, lines: int | None = None) -> str:
    """Kind of a file: as told, by pattern or number of lines (not both), else by its ending, compression aside."""
    if pattern and lines:
        raise ValueError("records are split by a pattern or by lines, not both")
    if kind or pattern or lines:
        return kind or ("pattern" if pattern else "lines")
    name = path.lower()
    for end in (".gz", ".bz2"):
        name = name.removesuffix(end)
    for k, ends in KINDS.items():
        if os.path.splitext(name)[1] in ends:
            return k
    raise ValueError(f"what are the records of {path}?")


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """(id, description, seq, file): the reader splits at headers, so that large files are read in parallel."""
    r = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("t"), F.col("_metadata.file_path").alias("file"))
    head, rest = F.split_part("t", F.lit("\n"), F.lit(1)), F.regexp_extract("t", r"^[^\n]*\n(?s)(.*)$", 1)
    head = F.regexp_replace(head, r"\r$", "")
    x = r.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("description"), F.regexp_replace(rest, r"\s", "").alias("seq"), "file")
    return x.where("id <> ''")


def read_fastq(spark: SparkSession, paths) -> DataFrame:
    """(id, description, seq, quality, file) of records of four lines."""
    x = by_lines(read_lines(spark, paths), 4)
    h = F.col("lines")[0]
    return x.select(F.regexp_extract(h, r"^@(\S+)", 1).alias("id"), F.regexp_extract(h, r"^@\S+\s+(.*)$", 1).alias("description"), F.col("lines")[1].alias("seq"), F.col("lines")[3].alias("quality"), "file")


def by_lines(lines: DataFrame, n: int) -> DataFrame:
    """Records of n lines each: (file, record, lines). Lines are numbered by file, which one task does for a file."""
    i = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return _collect(lines.withColumn("record", F.floor(i / n)))


def by_pattern(lines: DataFrame, pattern: str, id_pattern: str | None = None) -> DataFrame:
    """Records that begin with a line that matches pattern: (file, record, lines, id). The id is the first group of
    pattern, or of id_pattern in any line; records without one are dropped."""
    w = Window.partitionBy("file").orderBy("pos")
    x = lines.withColumn("record", F.sum(F.col("line").rlike(pattern).cast("long")).over(w)).where("record > 0")
    r = _collect(x)
    first = F.regexp_extract(F.col("lines")[0], pattern, 1) if id_pattern is None else F.try_element_at(F.filter(F.transform("lines", lambda s: F.regexp_extract(s, id_pattern, 1)), lambda s: s != ""), F.lit(1))
    return r.withColumn("id", first).where("id <> ''")


def _collect(numbered: DataFrame) -> DataFrame:
    text = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    return numbered.groupBy("file", "record").agg(text.alias("lines"))


def read_genbank(spark: SparkSession, paths) -> DataFrame:
    """One row for each coding sequence of GenBank records: (record, organism, id, description, start, stop, strand, seq,
    protein). Ids by protein_id, GI, locus_tag or gene, else the record's with a number."""
    records = spark.read.option("lineSep", "\n//").text(paths).select("value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([row for t in b["value"] for row in _features(t)], columns=["record", "organism", "id", "description", "start", "stop", "strand", "seq", "protein"])

    return records.mapInPandas(run, "record string, organism string, id string, description string, start int, stop int, strand string, seq string, protein string")


def _spans(where: str, minus: bool = False) -> list[tuple[int, int, bool]] | None:
    """(first, last, on the other strand) of the parts of a location in the order in which they are read, or None if a
    part lies in another record."""
    import re

    m = re.fullmatch(r"(complement|join|order)\((.*)\)", where)
    if not m:
        m = re.fullmatch(r"<?(\d+)(?:[.^]{1,2}>?(\d+))?>?", where)
        return [(int(m[1]), int(m[2] or m[1]), minus)] if m else None
    if m[1] == "complement":
        parts = _spans(m[2], not minus)
        return parts[::-1] if parts else None
    out, depth, at = [], 0, 0
    for i, c in enumerate(m[2] + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            part = _spans(m[2][at:i], minus)
            if part is None:
                return None
            out, at = out + part, i + 1
    return out


def _features(text: str) -> list[tuple]:
    import re

    if "LOCUS" not in text:
        return []
    name = (re.search(r"^VERSION\s+(\S+)", text, re.M) or re.search(r"^ACCESSION\s+(\S+)", text, re.M) or re.search(r"LOCUS\s+(\S+)", text))[1]
    organism = (re.search(r"^\s+ORGANISM\s+(.*)$", text, re.M) or [None, None])[1]
    origin = re.search(r"^ORIGIN.*?$(.*)", text, re.M | re.S)
    dna = re.sub(r"[^a-zA-Z]", "", origin[1]).upper() if origin else ""
    table = re.search(r"^FEATURES.*?$(.*?)(?=^\S|\Z)", text, re.M | re.S)
    out = []
    flip = str.maketrans("ACGTUN", "TGCAAN")
    for block in re.split(r"\n {5}(?=\S)", "\n" + (table[1] if table else "")):
        m = re.match(r"\s*CDS\s+(.*)", block, re.S)
        if not m:
            continue
        place = re.split(r"\n\s+/", m[1])[0]
        where = re.sub(r"\s", "", place)
        q: dict[str, list[str]] = {}
        for k, v in re.findall(r"/(\w+)=(\"(?:[^\"]|\"\")*\"|\S+)", m[1][len(place) :]):
            q.setdefault(k, []).append(re.sub(r"\s*\n\s*", "" if k == "translation" else " ", v.strip('"')))
        spans = _spans(where)
        if not spans:  # a part of it lies in another record
            continue
        seq = "".join(dna[a - 1 : b].translate(flip)[::-1] if other else dna[a - 1 : b] for a, b, other in spans)
        minus = all(other for _, _, other in spans)
        gi = next((x[3:] for x in q.get("db_xref", []) if x.startswith("GI:")), None)
        first = lambda *ks: next((q[k][0] for k in ks if k in q), None)
        ident = first("protein_id") or gi or first("locus_tag", "gene") or f"{name}_GENE_{len(out) + 1}"
        about = first("product", "gene", "note") or ""
        out.append((name, organism, ident, f"{about} [{organism}]" if organism else about, min(a for a, _, _ in spans), max(b for _, b, _ in spans), "-" if minus else "+", seq, first("translation")))
    return out
