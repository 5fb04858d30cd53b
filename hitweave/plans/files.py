"""Queries that write the driver's rows as the files a user has, read them with the readers and give what was read, and
their SQL, which looks at the rows themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave import sinks
from hitweave.plans.hits import _nodes, _seqs, _values
from hitweave.session import load, new_path
from hitweave.sources import hits as readers
from hitweave.sources import records, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _written(lines: DataFrame, line: Column, by: str | None = None) -> str:
    """Folder of text files of lines, of one file for each value of by, in the order of rows."""
    path = new_path(lines.sparkSession, "text")
    x = lines.withColumn("text_", line)
    if by:
        x = x.repartition(by).sortWithinPartitions(by, "o").select(by, "text_")
        x.select(F.col("text_").alias("value"), F.col(by).alias("by_")).write.partitionBy("by_").text(path)
        return f"{path}/*/*.txt"
    x.select(F.col("text_").alias("value")).write.text(path)
    return path


def _row(*cells: Column | str, sep: str = "\t") -> Column:
    """Cells as a line, NA for null."""
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in cells])


# hit tables ----------------------------------------------------------------------------------------------------------

_SQL_ID, _SQL_HIT = "CAST(hit_row AS VARCHAR) AS read", r"coalesce(regexp_replace(hit, '\s', '_', 'g'), 'NA') AS hit"
_SQL_DESC = r"coalesce(regexp_replace(hit_desc, '[\t\r\n;=]', ' ', 'g'), 'NA') AS hit_desc"
_PLACES = "qstart, qend, hstart, hend"
#: name: (columns that are compared, their SQL)
_FORMS: dict[str, tuple[str, str]] = {
    "gene": (f"read, hit, hit_desc, pctid, mlen, {_PLACES}, score, evalue, aln", f"{_SQL_ID}, {_SQL_HIT}, {_SQL_DESC}, pctid, mlen, {_PLACES}, score, evalue, aln"),
    "liz": (f"read, hit, hit_desc, pctid, mlen, {_PLACES}, score, evalue, aln", f"{_SQL_ID}, {_SQL_HIT}, {_SQL_DESC}, pctid, mlen, {_PLACES}, score, evalue, aln"),
    "blast": (f"read, hit, pctid, mlen, mismatch, gaps, {_PLACES}, evalue, score", f"{_SQL_ID}, {_SQL_HIT}, pctid, mlen, 0 AS mismatch, 0 AS gaps, {_PLACES}, evalue, score"),
    "yanmei": (f"read, hit, hit_desc, pctid, mlen, {_PLACES}, evalue, score", f"{_SQL_ID}, {_SQL_HIT}, {_SQL_DESC}, pctid, mlen, {_PLACES}, evalue, score"),
    "last": (f"read, hit, score, {_PLACES}, strand, mlen, evalue, qlen", f"{_SQL_ID}, {_SQL_HIT}, score, CASE WHEN qend IS NOT NULL THEN qstart END AS qstart, CASE WHEN qstart IS NOT NULL THEN qend END AS qend, hstart, hend, CASE WHEN coalesce(qstart > qend, false) = coalesce(hstart > hend, false) THEN '+' ELSE '-' END AS strand, coalesce(abs(mlen), 0) AS mlen, evalue, 100000 AS qlen"),
    "frhit": (f"read, hit, qlen, pctid, mlen, {_PLACES}, evalue, strand", f"{_SQL_ID}, {_SQL_HIT}, 80 AS qlen, pctid, mlen, {_PLACES}, evalue, '+' AS strand"),
    "sam": (f"read, hit, {_PLACES}, strand, mlen, score, pctid", f"""{_SQL_ID}, {_SQL_HIT}, CASE WHEN qstart > qend THEN least(qstart, qend) + n - 1 ELSE least(qstart, qend) END AS qstart, CASE WHEN qstart > qend THEN least(qstart, qend) ELSE least(qstart, qend) + n - 1 END AS qend,
        least(hstart, hend) AS hstart, least(hstart, hend) + n - 1 AS hend, CASE WHEN qstart > qend THEN '-' ELSE '+' END AS strand, n AS mlen, score, 100.0 AS pctid FROM (SELECT *, abs(hend - hstart) + 1 AS n FROM hits)"""),
    "paf": (f"read, hit, {_PLACES}, strand, matches, mlen, pctid, aln, score", f"{_SQL_ID}, {_SQL_HIT}, qstart, qend, least(hstart, hend) AS hstart, greatest(hstart, hend) AS hend, CASE WHEN qstart > qend THEN '-' ELSE '+' END AS strand, abs(mlen) // 2 AS matches, abs(mlen) AS mlen, CASE WHEN mlen <> 0 THEN 100.0::DOUBLE * (abs(mlen) // 2) / abs(mlen) END AS pctid, abs(mlen) / 100000.0::DOUBLE AS aln, score"),
    "gff": ("read, hit, hit_desc, hit_type, qstart, qend, mlen, score, strand", f"{_SQL_ID}, {_SQL_HIT}, {_SQL_DESC}, 'CDS' AS hit_type, qstart, qend, abs(qend - qstart) + 1 AS mlen, score, CASE WHEN qstart > qend THEN '-' ELSE '+' END AS strand"),
    "hmmsearchdom": (f"read, hit, qlen, hlen, {_PLACES}, mlen, aln, score, evalue, read_desc", f"{_SQL_ID}, {_SQL_HIT}, 100000 AS qlen, 50 AS hlen, {_PLACES}, abs(qend - qstart) + 1 AS mlen, (abs(qend - qstart) + 1) / 100000.0::DOUBLE AS aln, score, evalue, 'a text' AS read_desc"),
    "hmmscandom": (f"read, hit, qlen, hlen, {_PLACES}, mlen, aln, score, evalue, hit_desc", f"{_SQL_ID}, {_SQL_HIT}, 100000 AS qlen, 50 AS hlen, {_PLACES}, abs(qend - qstart) + 1 AS mlen, (abs(qend - qstart) + 1) / 100000.0::DOUBLE AS aln, score, evalue, 'a text' AS hit_desc"),
    "hmmsearch": ("read, hit, evalue, score, read_desc", f"{_SQL_ID}, {_SQL_HIT}, evalue, score, 'a text' AS read_desc"),
    "hmmscan": ("read, hit, evalue, score, hit_desc", f"{_SQL_ID}, {_SQL_HIT}, evalue, score, 'a text' AS hit_desc"),
    "cmsearch": (f"read, hit, hit_desc, {_PLACES}, strand, score, evalue, mlen", f"{_SQL_ID}, {_SQL_HIT}, 'acc' AS hit_desc, {_PLACES}, CASE WHEN qstart > qend THEN '-' ELSE '+' END AS strand, score, evalue, abs(hend - hstart) + 1 AS mlen"),
    "cmscan": (f"read, hit, {_PLACES}, strand, score, evalue, mlen", f"{_SQL_ID}, {_SQL_HIT}, {_PLACES}, CASE WHEN qstart > qend THEN '-' ELSE '+' END AS strand, score, evalue, abs(hend - hstart) + 1 AS mlen"),
}


def _line(fmt: str) -> Column:
    """A row of hits as a line of a format."""
    row_id = F.col("hit_row")
    hit, desc = F.regexp_replace("hit", r"\s", "_"), F.regexp_replace("hit_desc", r"[\t\r\n;=]", " ")
    lo, hi = F.least("qstart", "qend"), F.greatest("qstart", "qend")
    h_lo, h_hi = F.least("hstart", "hend"), F.greatest("hstart", "hend")
    back, h_back = F.col("qstart") > F.col("qend"), F.col("hstart") > F.col("hend")
    span = F.abs(F.col("hend") - F.col("hstart")) + 1
    sign, h_sign = F.when(back, "-").otherwise("+"), F.when(h_back, "-").otherwise("+")
    zero = F.lit(0)
    #: A sequence of 100,000 bases is longer than any position.
    long = F.lit(100_000)

    def side(lo: Column, hi: Column, back: Column) -> Column:
        """Start from 0, from the end on the other strand."""
        return F.when(back, long - hi).otherwise(lo - 1)

    lines = {
        "gene": _row(row_id, "read_desc", hit, desc, "pctid", "mlen", "qstart", "qend", "hstart", "hend", "score", "evalue", "aln"),
        "liz": _row(row_id, hit, desc, "pctid", "mlen", "qstart", "qend", "hstart", "hend", "score", "evalue", "aln"),
        "blast": _row(row_id, hit, "pctid", "mlen", zero, zero, "qstart", "qend", "hstart", "hend", "evalue", "score"),
        "yanmei": _row(row_id, hit, "pctid", "mlen", zero, zero, "qstart", "qend", "hstart", "hend", "evalue", "score", desc),
        "last": _row("score", hit, side(h_lo, h_hi, h_back), span, h_sign, long, row_id, side(lo, hi, back), hi - lo + 1, sign, long, F.abs("mlen"), F.concat(F.lit("E="), F.coalesce(F.col("evalue").cast("string"), F.lit("NA")))),
        "frhit": _row(row_id, F.lit("80nt"), "evalue", "mlen", "qstart", "qend", F.lit("+"), F.concat("pctid", F.lit("%")), hit, "hstart", "hend"),
        "sam": _row(row_id, F.when(back, 16).otherwise(0), hit, h_lo, F.lit(9), F.concat(lo - 1, F.lit("S"), span, F.lit("M")), F.lit("*"), zero, zero, F.lit("A"), F.lit("*"), F.concat(F.lit("AS:i:"), F.coalesce(F.col("score").cast("string"), F.lit("NA"))), F.concat(F.lit("MD:Z:"), span)),
        "paf": _row(row_id, long, lo - 1, hi, sign, hit, long, h_lo - 1, h_hi, F.floor(F.abs("mlen") / 2), F.abs("mlen"), F.lit(60), F.concat(F.lit("AS:i:"), F.coalesce(F.col("score").cast("string"), F.lit("NA")))),
        "gff": _row(row_id, F.lit("src"), F.lit("CDS"), lo, hi, "score", sign, zero, F.concat(F.lit("ID="), F.coalesce(hit, F.lit("NA")), F.lit(";product="), F.coalesce(desc, F.lit("NA")))),
        "hmmsearchdom": _row(row_id, F.lit("-"), long, hit, F.lit("acc"), F.lit(50), "evalue", "score", *[zero] * 7, "hstart", "hend", "qstart", "qend", zero, zero, zero, F.lit("a text"), sep=" "),
        "hmmscandom": _row(hit, F.lit("acc"), F.lit(50), row_id, F.lit("-"), long, "evalue", "score", *[zero] * 7, "hstart", "hend", "qstart", "qend", zero, zero, zero, F.lit("a text"), sep=" "),
        "hmmsearch": _row(row_id, F.lit("-"), hit, F.lit("acc"), "evalue", "score", *[zero] * 12, F.lit("a text"), sep=" "),
        "hmmscan": _row(hit, F.lit("acc"), row_id, F.lit("-"), "evalue", "score", *[zero] * 12, F.lit("a text"), sep=" "),
        "cmsearch": _row(row_id, F.lit("-"), hit, F.lit("acc"), F.lit("cm"), "hstart", "hend", "qstart", "qend", sign, F.lit("no"), *[zero] * 3, "score", "evalue", F.lit("!"), sep=" "),
        "cmscan": _row(hit, F.lit("acc"), row_id, F.lit("-"), F.lit("cm"), "hstart", "hend", "qstart", "qend", sign, F.lit("no"), *[zero] * 3, "score", "evalue", F.lit("!"), sep=" "),
    }
    return lines[fmt]


def _read_form(fmt: str):
    columns = _FORMS[fmt][0]

    def f(spark: SparkSession, sf: str) -> DataFrame:
        return readers.read_hits(spark, _written(load(spark, sf, "hits"), _line(fmt)), fmt).select(*columns.split(", "))

    return f


for _fmt, (_, _sql) in _FORMS.items():
    QUERIES[f"k_read_{_fmt}"] = _read_form(_fmt)
    SQL[f"k_read_{_fmt}"] = f"SELECT {_sql}" + ("" if " FROM " in _sql else " FROM hits")


@query(f"SELECT label, {_SQL_ID}, {_SQL_HIT} FROM hits WHERE score >= 60")
def k_lines_by_label(spark, sf):
    """Lines that pass a filter, written by sample and read with the sample as label."""
    lines = load(spark, sf, "hits").withColumn("o", F.col("hit_row"))
    got = readers.read_hits(spark, _written(lines, _line("blast"), "label"), "blast", r"by_=([^/]*)/")
    kept = got.where("score >= 60")
    path = new_path(spark, "kept")
    sinks.write_by_label(kept.select("label", "line"), path)
    return readers.read_hits(spark, f"{path}/*/*.txt", "blast", r"label=([^/]*)/").select("label", "read", "hit")


@query(f"SELECT CAST(hit_row AS VARCHAR) AS read, least(qstart, qend) AS qstart, greatest(qstart, qend) AS qend, score, {_SQL_HIT} FROM hits WHERE qstart IS NOT NULL AND qend IS NOT NULL")
def k_write_gff(spark, sf):
    """Hits as annotation lines, read again."""
    x = load(spark, sf, "hits").where("qstart is not null and qend is not null")
    x = x.select(F.col("hit_row").cast("string").alias("read"), F.coalesce(F.regexp_replace("hit", r"\s", "_"), F.lit("NA")).alias("hit"), "qstart", "qend", "hstart", "hend", F.col("score"), F.lit("+").alias("strand"))
    got = readers.read_hits(spark, _written(x, sinks.gff_line(x.columns)), "gff")
    return got.select("read", "qstart", "qend", "score", F.col("hit"))


# dimensions ----------------------------------------------------------------------------------------------------------

@query(r"SELECT regexp_replace(name, '\s+', ' ', 'g') AS key, CAST(arg_max(taxid, name_row) AS BIGINT) AS value FROM taxon_names WHERE trim(name) <> '' GROUP BY 1")
def k_read_map(spark, sf):
    """Names and taxids as a map of two columns; the later row of a name holds."""
    x = load(spark, sf, "taxon_names").where("trim(name) <> ''").withColumn("o", F.col("name_row")).withColumn("one", F.lit("m"))
    return tables.read_map(spark, _written(x, _row(F.regexp_replace("name", r"\s+", " "), "taxid"), "one"), value_type="bigint")


@query("SELECT DISTINCT trim(hit) AS id FROM hits WHERE trim(hit) <> '' UNION SELECT 'NA' FROM hits WHERE hit IS NULL")
def k_read_list(spark, sf):
    return tables.read_list(spark, _written(load(spark, sf, "hits"), _row("read", "hit")), 1)


@query(r"SELECT DISTINCT label || ':' || read AS key, regexp_replace(hit, '[\t\r\n]', ' ', 'g') AS value FROM read_assignments WHERE hit <> ''")
def k_read_links(spark, sf):
    """Links of which the values' prefixes are taken off."""
    x = load(spark, sf, "read_assignments").where("hit <> ''")
    return tables.read_links(spark, _written(x, _row(F.concat_ws(":", "label", "read"), F.concat(F.lit("p:"), F.regexp_replace("hit", r"[\t\r\n]", " ")))))


@query("""WITH l AS (SELECT taxid, arg_max(coalesce(parentid, taxid), node_row) AS parent, arg_max(coalesce(rank, ''), node_row) AS rank FROM taxnodes WHERE taxid IS NOT NULL GROUP BY taxid)
SELECT taxid, parent, CASE WHEN trim(rank) = '' THEN 'no rank' WHEN rank = 'domain' THEN 'superkingdom' ELSE trim(rank) END AS rank, coalesce(n.name, '') AS name
FROM l LEFT JOIN (SELECT taxid, min(trim(name)) AS name FROM taxon_names WHERE name_class = 'scientific name' GROUP BY taxid) n USING (taxid)""")
def k_taxdump(spark, sf):
    """Nodes and names written as dump files and read again."""
    last = _nodes(spark, sf).where("taxid is not null").groupBy("taxid").agg(F.max(F.struct("node_row", "parent", "rank")).alias("m")).select("taxid", "m.parent", "m.rank")
    names = load(spark, sf, "taxon_names").where("name_class = 'scientific name'").groupBy("taxid").agg(F.min(F.trim("name")).alias("name"))
    path = new_path(spark, "dump")
    sinks.write_taxdump(last.join(names, "taxid", "left"), path)
    nodes, named = tables.read_taxdump(spark, f"{path}/nodes.dmp", f"{path}/names.dmp")
    return nodes.join(named.select("taxid", "name"), "taxid").select("taxid", "parent", "rank", "name")


@query("SELECT label || '/' || read AS contig, mlen AS depth, qstart AS base FROM hits")
def k_read_depths(spark, sf):
    return tables.read_depths(spark, _written(load(spark, sf, "hits"), _row(F.concat_ws("/", "label", "read"), "qstart", "mlen")))


@query("SELECT label || ' ' || read AS contig, count(*) AS reads FROM hits GROUP BY 1")
def k_read_counts(spark, sf):
    n = load(spark, sf, "hits").groupBy("label", "read").agg(F.count("*").alias("n"))
    return tables.read_read_counts(spark, _written(n, _row(F.concat(F.lit("  "), "n"), F.concat_ws(" ", "label", "read"), sep=" ")))


@query(r"SELECT label, read, coalesce(regexp_replace(hit, '[\t\r\n]', ' ', 'g'), 'NA') AS value FROM read_assignments")
def k_read_assignments(spark, sf):
    """Assignment tables of one file for each sample, with a header."""
    x = load(spark, sf, "read_assignments").select("label", F.col("assign_id").alias("o"), _row("read", F.regexp_replace("hit", r"[\t\r\n]", " ")).alias("line"))
    heads = x.select("label").distinct().select("label", F.lit(-1).cast("long").alias("o"), F.lit("Read\tHit").alias("line"))
    got = tables.read_assignments(spark, _written(x.unionByName(heads), F.col("line"), "label"), skip=1)
    folder = F.regexp_extract(F.col("pos.file"), "by_=([^/]*)/", 1)
    return got.select(folder.alias("label"), "read", "value")


@query("SELECT DISTINCT 'A' || node_row AS acc, taxid FROM taxnodes WHERE taxid IS NOT NULL")
def k_read_catalog(spark, sf):
    x = load(spark, sf, "taxnodes")
    return tables.catalog_taxa(spark, _written(x, _row("taxid", F.lit("a name"), F.concat(F.lit("A"), "node_row"))))


@query(r"""WITH m AS (SELECT DISTINCT label, read, regexp_replace(hit, '[.\s]', '_', 'g') AS hit FROM hits WHERE hit <> '')
SELECT min(hit) AS name, count(*) AS size FROM m GROUP BY label, read""")
def k_read_clusters(spark, sf):
    """The distinct hits of each read as a cluster."""
    m = load(spark, sf, "hits").where("hit <> ''").select("label", "read", F.regexp_replace("hit", r"[.\s]", "_").alias("hit")).distinct()
    heads = m.select("label", "read").distinct().select("label", F.struct("read", F.lit("").alias("hit")).alias("o"), F.lit(">Cluster 0").alias("line"))
    lines = heads.unionByName(m.select("label", F.struct("read", "hit").alias("o"), F.concat(F.lit("0\t9aa, >"), "hit", F.lit("... *")).alias("line")))
    return tables.read_clusters(spark, _written(lines, F.col("line"), "label"))


@query(f"""SELECT DISTINCT 'K' || lpad(CAST(name_row AS VARCHAR), 5, '0') AS ko, 'T' || taxid AS name FROM taxon_names WHERE name_row < 100000""")
def k_read_brite(spark, sf):
    """Names under their taxids, as a hierarchy of three levels."""
    x = load(spark, sf, "taxon_names").where("name_row < 100000")
    one = lambda o, line: x.select(F.lit("k").alias("one"), F.struct(*o).alias("o"), line.alias("line"))
    at = lambda n: (F.col("taxid"), F.lit(n).alias("l"), F.col("name_row") if n == 3 else F.lit(-1).cast("long").alias("name_row"))
    lines = one(at(1), F.lit("A<b>Top</b>")).unionByName(one(at(2), F.concat(F.lit("B  T"), "taxid"))).distinct()
    lines = lines.unionByName(one(at(3), F.concat(F.lit("C    K"), F.lpad(F.col("name_row").cast("string"), 5, "0"), F.lit("  a; b"))))
    return tables.read_brite(spark, _written(lines, F.col("line"), "one"), "2")


# records -------------------------------------------------------------------------------------------------------------

_ACGT = r"regexp_replace(upper(text), '[^ACGT]', '', 'g')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS description, {_ACGT} AS seq FROM documents WHERE text IS NOT NULL")
def k_fasta(spark, sf):
    """Sequences written in lines of 60 bases and read again."""
    x = _seqs(spark, sf).join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    text = sinks.fasta_text(F.col("id").cast("string"), F.col("source"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    return records.read_fasta(spark, _written(x, text)).select("id", "description", "seq")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_ACGT} AS seq, repeat('I', length({_ACGT})) AS quality FROM documents WHERE text IS NOT NULL")
def k_fastq(spark, sf):
    x = _seqs(spark, sf)
    text = F.concat(F.lit("@"), "id", F.lit(" d\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    return records.read_fastq(spark, _written(x, text)).select("id", "seq", "quality")


@query("SELECT CAST(row_id AS VARCHAR) AS id, 2 AS n FROM gene_kos")
def k_records_by_pattern(spark, sf):
    """Records that begin with a line of a form, of two lines each."""
    text = F.concat(F.lit("ID "), "row_id", F.lit("\nabout it"))
    got = records.by_pattern(readers.read_lines(spark, _written(load(spark, sf, "gene_kos"), text)), r"^ID (\d+)$")
    return got.select("id", F.size("lines").alias("n"))


@query(f"WITH d AS (SELECT doc_id, {_ACGT} AS s FROM documents WHERE text IS NOT NULL) SELECT 'P' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN s[1:6] ELSE translate(reverse(s[1:6]), 'ACGT', 'TGCA') END || s[9:12] AS seq FROM d WHERE length(s) >= 12")
def k_genbank(spark, sf):
    """Coding regions of two parts, the first of every other record on the other strand."""
    place = F.when(F.col("id") % 2 == 0, "join(1..6,9..12)").otherwise("join(complement(1..6),9..12)")
    text = F.concat(F.lit("LOCUS       X\nACCESSION   A"), "id", F.lit("\nFEATURES             Location/Qualifiers\n     CDS             "), place, F.lit('\n                     /protein_id="P'), "id", F.lit('"\nORIGIN\n        1 '), F.lower("seq"), F.lit("\n//"))
    return records.read_genbank(spark, _written(_seqs(spark, sf).where("length(seq) >= 12"), text)).select("id", "seq")


@query(r"WITH v AS (SELECT label, nullif(lower(regexp_replace(hit, '^[ \t\x{a0}]+|[ \t\x{a0}]+$', '', 'g')), '') AS value FROM read_assignments) SELECT CASE WHEN regexp_full_match(value, 'k[0-9]{5}') THEN 'KO' ELSE 'taxon' END AS value, CAST(count(*) AS VARCHAR) AS n, label FROM v WHERE value IS NOT NULL GROUP BY ALL")
def k_write_counts(spark, sf):
    """A wide table of counts, written, read and made long again."""
    v = _values(spark, sf).where("value is not null").withColumn("value", F.when(F.col("value").rlike("^k[0-9]{5}$"), "KO").otherwise("taxon"))
    path = new_path(spark, "counts")
    sinks.write_counts(v.groupBy("label", "value").agg(F.count("*").alias("n")), path)
    got = spark.read.option("sep", "\t").option("header", True).csv(path)
    labels = [c for c in got.columns if c != "value"]
    return got.select("value", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in labels])).alias("x")).select("value", "x.n", "x.label").where("n <> '0'")
