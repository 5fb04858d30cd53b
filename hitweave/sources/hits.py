"""Hit tables of search tools, read into one schema.

Every format is a projection of the split line, so that columns that aren't asked for aren't computed, and only the text
is read. Numbers that can't be read are null (mode PERMISSIVE), make the row fail (FAILFAST) or drop it (DROPMALFORMED).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.operators.translate import parse_exponent
from hitweave.schema import HIT_COLUMNS


def read_lines(spark: SparkSession, paths, label: str | None = None) -> DataFrame:
    """(line, file, label, pos): lines of text files, plain or compressed (gz, bz2), with a position that orders them in
    their file. label: a regular expression whose first group, in the path, is the label; by default the file name."""
    df = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    name = F.regexp_extract("file", label, 1) if label else F.element_at(F.split("file", "/"), -1)
    # blocks of a file lie in the order of their starts, lines of a block in that of the ids
    return df.withColumn("label", name).withColumn("pos", F.struct("file", "block", F.monotonically_increasing_id().alias("id"))).drop("block")


class Cells:
    """The cells of a line, from 0."""

    def __init__(self, column: Column, pattern: str):
        self.all = F.split(F.trim(column) if pattern == r"\s+" else column, pattern)

    def __getitem__(self, i: int) -> Column:
        return F.try_element_at(self.all, F.lit(i + 1))

    def int(self, i: int) -> Column:
        return self[i].try_cast("int")

    def num(self, i: int) -> Column:
        return parse_exponent(self[i])

    def rest(self, i: int) -> Column:
        return F.slice(self.all, F.lit(i + 1), F.greatest(F.size(self.all) - i, F.lit(0)))


def _span(a: Column, b: Column) -> Column:
    return F.abs(b - a) + 1


def _blast(c: Cells) -> dict[str, Column]:
    names = ("read", "hit")
    ints = {"mlen": 3, "mismatch": 4, "gaps": 5, "qstart": 6, "qend": 7, "hstart": 8, "hend": 9}
    return {n: c[i] for i, n in enumerate(names)} | {"pctid": c.num(2)} | {n: c.int(i) for n, i in ints.items()} | {"evalue": c.num(10), "score": c.num(11)}


def _gene(c: Cells, shift: int = 0) -> dict[str, Column]:
    out = {"read": c[0], "hit": c[2 - shift], "hit_desc": c[3 - shift], "pctid": c.num(4 - shift)}
    out |= {n: c.int(i - shift) for n, i in (("mlen", 5), ("qstart", 6), ("qend", 7), ("hstart", 8), ("hend", 9))}
    out |= {"score": c.num(10 - shift), "evalue": c.num(11 - shift), "aln": c.num(12 - shift)}
    return out if shift else out | {"read_desc": c[1]}


def blocks_length(blocks: Column) -> Column:
    """Aligned length of a list of blocks: numbers count, of a gap a:b the longer side."""
    return F.aggregate(F.split(blocks, ","), F.lit(0), lambda a, x: a + F.coalesce(F.array_max(F.transform(F.split(x, ":"), lambda y: y.try_cast("int"))), F.lit(0)))


def _last(c: Cells) -> dict[str, Column]:
    """Positions count from 0 and, on the minus strand, from the end; here from 1, and backwards on that strand."""

    def side(start: Column, size: Column, strand: Column, length: Column) -> tuple[Column, Column]:
        plus = strand == "+"
        return F.when(plus, start + 1).otherwise(length - start), F.when(plus, start + size).otherwise(length - start - size + 1)

    hs, he = side(c.int(2), c.int(3), c[4], c.int(5))
    qs, qe = side(c.int(7), c.int(8), c[9], c.int(10))
    evalue = F.try_element_at(F.filter(F.transform(c.rest(12), lambda x: F.regexp_extract(x, r"^E=(.+)$", 1)), lambda x: x != ""), F.lit(1))
    return {"read": c[6], "hit": c[1], "score": c.num(0), "hstart": hs, "hend": he, "hlen": c.int(5), "qstart": qs, "qend": qe, "qlen": c.int(10), "strand": F.when(c[4] == c[9], "+").otherwise("-"), "mlen": blocks_length(c[11]), "evalue": parse_exponent(evalue)}


def _cigar_sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))


def _tag(tags: Column, name: str) -> Column:
    """Value of a tag like AS:i:5; null if there is none."""
    return F.regexp_extract(F.try_element_at(F.filter(tags, lambda x: x.startswith(f"{name}:")), F.lit(1)), r"^[^:]*:[^:]*:(.*)$", 1)


def md_identity(md: Column, shift: int = 0) -> Column:
    """Percent of matches in an MD string; deleted bases don't count. shift: mismatches to add."""
    match = F.aggregate(F.regexp_extract_all(md, F.lit(r"(\d+)"), 1), F.lit(0), lambda a, x: a + x.cast("int"))
    other = F.length(F.regexp_replace(md, r"\^[A-Za-z]+|\d+", "")) + shift
    return F.try_divide(100.0 * match, match + other)


def _sam(c: Cells, md_compat: bool = False) -> dict[str, Column]:
    cigar, tags = c[5], c.rest(11)
    lead = F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0)) + F.coalesce(F.regexp_extract(cigar, r"^(\d+)H", 1).try_cast("int"), F.lit(0))
    on_query, on_hit = _cigar_sum(cigar, "MI=X"), _cigar_sum(cigar, "MDN=X")
    qs, qe = lead + 1, lead + on_query
    back = c.int(1).bitwiseAND(16) != 0
    same, other = _cigar_sum(cigar, "="), _cigar_sum(cigar, "X")
    md = F.nullif(_tag(tags, "MD"), F.lit(""))
    identity = F.coalesce(md_identity(md, 1 if md_compat else 0), F.try_divide(100.0 * same, same + other))
    score = F.coalesce(_tag(tags, "AS").try_cast("double"), _tag(tags, "ZW").try_cast("double"))
    return {"read": c[0], "hit": c[2], "cigar": cigar, "hstart": c.int(3), "hend": c.int(3) + on_hit - 1, "qstart": F.when(back, qe).otherwise(qs), "qend": F.when(back, qs).otherwise(qe), "strand": F.when(back, "-").otherwise("+"), "mlen": _cigar_sum(cigar, "MIDN=X"), "score": score, "pctid": identity}


def _paf(c: Cells) -> dict[str, Column]:
    tags, back = c.rest(12), c[4] == "-"
    qs, qe = c.int(2) + 1, c.int(3)
    return {"read": c[0], "hit": c[5], "qlen": c.int(1), "hlen": c.int(6), "strand": c[4], "qstart": F.when(back, qe).otherwise(qs), "qend": F.when(back, qs).otherwise(qe), "hstart": c.int(7) + 1, "hend": c.int(8), "matches": c.int(9), "mlen": c.int(10), "pctid": F.try_divide(100.0 * c.int(9), c.int(10)), "aln": F.try_divide(c.num(10), c.num(1)), "score": F.coalesce(_tag(tags, "AS").try_cast("double"), _tag(tags, "s1").try_cast("double"))}


def attributes(column: Column) -> Column:
    """Map of the attributes k=v;k=v of an annotation."""
    return F.str_to_map(F.rtrim(column, F.lit("; ")), F.lit(";"), F.lit("="))


def _gff(c: Cells) -> dict[str, Column]:
    a = attributes(c[8])
    back = c[6] == "-"
    hit = F.coalesce(F.try_element_at(a, F.lit("ID")), F.try_element_at(a, F.lit("Name")), F.split(F.try_element_at(a, F.lit("Target")), r"\s+")[0])
    return {"read": c[0], "source": c[1], "hit_type": c[2], "qstart": F.when(back, c.int(4)).otherwise(c.int(3)), "qend": F.when(back, c.int(3)).otherwise(c.int(4)), "mlen": c.int(4) + 1 - c.int(3), "score": c.num(5), "evalue": c.num(5), "strand": c[6], "hit": hit, "hit_desc": F.coalesce(F.try_element_at(a, F.lit("product")), c[8])}


def _dom(read: int, hit: int, qlen: int | None, hit_desc: Column | None) -> Callable[[Cells], dict[str, Column]]:
    """Tables of domains: two names with lengths, the profile's coordinates (15, 16), those on the sequence (17, 18)."""

    def f(c: Cells) -> dict[str, Column]:
        rest = F.array_join(c.rest(22), " ")
        seq = {"qstart": c.int(17), "qend": c.int(18), "hstart": c.int(15), "hend": c.int(16)}
        length, span = c.num(5 if read == 3 else 2), _span(c.int(17), c.int(18))
        out = {"read": c[read], "hit": c[hit], "evalue": c.num(6), "score": c.num(7), "mlen": span, "qlen": c.int(5 if read == 3 else 2), "hlen": c.int(2 if read == 3 else 5), "aln": F.try_divide(span.cast("double"), length)}
        return out | seq | ({"hit_desc": rest} if read == 3 else {"read_desc": rest, "hit_desc": c[4]})

    return f


def _tbl(read: int, hit: int) -> Callable[[Cells], dict[str, Column]]:
    def f(c: Cells) -> dict[str, Column]:
        rest = F.array_join(c.rest(18), " ")
        return {"read": c[read], "hit": c[hit], "evalue": c.num(4), "score": c.num(5)} | ({"hit_desc": rest} if read == 2 else {"read_desc": rest, "hit_desc": c[3]})

    return f


def _cm(read: int, hit: int) -> Callable[[Cells], dict[str, Column]]:
    def f(c: Cells) -> dict[str, Column]:
        return {"read": c[read], "hit": c[hit], "hit_desc": c[hit + 1], "hstart": c.int(5), "hend": c.int(6), "qstart": c.int(7), "qend": c.int(8), "strand": c[9], "score": c.num(14), "evalue": c.num(15), "mlen": _span(c.int(5), c.int(6))}

    return f


TAB, BLANK = "\t", r"\s+"
#: name: (pattern between cells, the columns of the line's cells, least cells)
FORMATS: dict[str, tuple[str, Callable[[Cells], dict[str, Column]], int]] = {
    "gene": (TAB, _gene, 13),
    "liz": (TAB, lambda c: _gene(c, 1), 12),
    "yanmei": (TAB, lambda c: _blast(c) | {"hit_desc": c[12]}, 13),
    "blast": (TAB, _blast, 12),
    "last": (TAB, _last, 12),
    "frhit": (TAB, lambda c: {"read": c[0], "qlen": F.regexp_extract(c[1], r"(\d+)", 1).try_cast("int"), "evalue": c.num(2), "mlen": c.int(3), "qstart": c.int(4), "qend": c.int(5), "strand": c[6], "pctid": F.rtrim(c[7], F.lit("%")).try_cast("double"), "hit": c[8], "hstart": c.int(9), "hend": c.int(10)}, 11),
    "sam": (TAB, _sam, 11),
    "paf": (TAB, _paf, 12),
    "gff": (TAB, _gff, 9),
    "hmmscandom": (BLANK, _dom(3, 0, 5, None), 22),
    "hmmscan": (BLANK, _tbl(2, 0), 18),
    "hmmsearchdom": (BLANK, _dom(0, 3, 2, None), 22),
    "hmmsearch": (BLANK, _tbl(0, 2), 18),
    "cmsearch": (BLANK, _cm(0, 2), 16),
    "cmscan": (BLANK, _cm(2, 0), 16),
}
#: Columns of a format in the text: (read, hit, description), None where it has none.
COLUMNS = {"gene": (0, 2, 3), "liz": (0, 1, 2), "yanmei": (0, 1, 12), "blast": (0, 1, None), "last": (6, 1, None), "frhit": (0, 8, None), "sam": (0, 2, None), "paf": (0, 5, None), "gff": (0, 8, 8), "hmmscandom": (3, 0, 22), "hmmscan": (2, 0, 18), "hmmsearchdom": (0, 3, 4), "hmmsearch": (0, 2, 3), "cmsearch": (0, 2, 3), "cmscan": (2, 0, 1)}


def column_of(fmt: str, what: str) -> int:
    """Place of the read, hit or desc column in the lines of a format."""
    at = COLUMNS[fmt][("read", "hit", "desc").index(what)]
    if at is None:
        raise ValueError(f"lines of {fmt} have no {what}")
    return at


def parse_hits(lines: DataFrame, fmt: str = "gene", mode: str = "PERMISSIVE", md_compat: bool = False) -> DataFrame:
    """lines (line, ...) as hits; the other columns stay. Comments, blank lines, headers and rows that name no hit are
    no hits. A line of too few cells is malformed: its columns are null and ``malformed`` is true, or see mode."""
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    if mode not in ("PERMISSIVE", "FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"no such mode: {mode}")
    pattern, columns, least = FORMATS[fmt]
    text = F.regexp_replace("line", r"\r$", "")
    keep = F.trim(text) != ""
    keep = keep & ~text.startswith("@") if fmt == "sam" else keep & ~text.startswith("#")
    c = Cells(text, pattern)
    got = _sam(c, md_compat) if fmt == "sam" else columns(c)
    if fmt == "sam":
        keep = keep & (F.coalesce(c[2], F.lit("")) != "*")
    bad = F.size(c.all) < least
    if mode == "FAILFAST":
        bad = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), text)).cast("boolean")).otherwise(False)
    others = [x for x in lines.columns if x not in HIT_COLUMNS and x != "malformed"]
    out = lines.where(keep)
    cols = [F.when(~bad, got[n].cast(t)).alias(n) if n in got else F.lit(None).cast(t).alias(n) for n, t in HIT_COLUMNS.items() if n != "line"]
    out = out.select(*others, *cols, F.col("line"), bad.alias("malformed"))
    return out if mode == "PERMISSIVE" else out.where("not malformed").drop("malformed")


def read_hits(spark: SparkSession, paths, fmt: str = "gene", label: str | None = None, mode: str = "PERMISSIVE", md_compat: bool = False) -> DataFrame:
    """Hits of text files, with label, file and pos."""
    return parse_hits(read_lines(spark, paths, label), fmt, mode, md_compat)
