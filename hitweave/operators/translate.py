"""From hits to what they stand for: patterns, lookups, names and table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.names import free_name

#: Forms of ids in hit ids and descriptions.
PATTERNS = {
    "accession": r"(?:^|\b[A-Za-z]{2,3}\|{1,2})([-\.0-9a-zA-Z_]+)(?<!\.\d\d)(?<!\.\d\d\d)(?<!\.\d)(?:\.\d+)?(?:\||$)(?=(?:\s|$))",
    "organism": r"\[([^|\[\]]*(?:\[[^|\[\]]+\])?[^|\[\]]*)\]?\s*(?:(?=[a-z]{2,3}\|)|$)",
    "ko": r"\b(K\d{5})\b",
    "gi": r"^gi\|(\d+)\|.*$",
    "pfam": r"\b((?:COG|PF|TIGR)\d+)\.\d+\b",
}


def extract(column: Column, style: str) -> Column:
    """All ids of a style in a text, in order; the text itself if there are none."""
    found = F.regexp_extract_all(column, F.lit(PATTERNS[style]), 1)
    return F.when(F.size(found) > 0, found).otherwise(F.array(column))


def read_and_sample(column: Column, sep: str = "_") -> tuple[Column, Column]:
    """A record id in its two parts around the last sep: the read and what tells its file; the file is null without one."""
    at = F.instr(F.reverse(column), sep)
    cut = F.length(column) - at
    return F.when(at > 0, F.substring(column, F.lit(1), cut)).otherwise(column), F.when(at > 0, F.substring(column, cut + 2, at))


def strip_version(column: Column) -> Column:
    return F.regexp_replace(column, r"\.\d+$", "")


def strip_prefix(column: Column) -> Column:
    """What follows the first colon, or all of it."""
    return F.regexp_replace(column, r"^[^:]*:", "")


def family(column: Column) -> Column:
    """The letters before the first number: the class of an enzyme family."""
    return F.nullif(F.regexp_extract(column, r"([a-zA-Z]+)\d+", 1), F.lit(""))


def simplify(column: Column) -> Column:
    """Lower case, no white space and no dots."""
    return F.regexp_replace(F.lower(column), r"[\s.]", "")


def parse_exponent(column: Column) -> Column:
    """A number; of one that begins with its exponent (e-10) the factor is 1."""
    return F.coalesce(column.try_cast("double"), F.when(column.rlike("^[eE]"), F.concat(F.lit("1"), column)).try_cast("double"))


def last_wins(mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the last row of each key."""
    return mapping.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), F.col(order)).alias("value"))


def lookup(rows: DataFrame, column: str, mapping: DataFrame, out: str, missing: str = "none") -> DataFrame:
    """rows with the value of mapping (key, value, one row each) for a column; missing: none (null), key (the key) or
    drop (no row). A key of a third of all rows is left to the engine's splitting of skewed joins."""
    m = mapping.select(F.col("key").alias("map_key"), F.col("value").alias("map_value"))
    x = rows.join(m, rows[column] == m["map_key"], "inner" if missing == "drop" else "left")
    value = F.coalesce("map_value", F.col(column).cast(mapping.schema["value"].dataType)) if missing == "key" else F.col("map_value")
    return x.withColumn(out, value).drop("map_key", "map_value")


def lookup_many(rows: DataFrame, column: str, links: DataFrame, out: str) -> DataFrame:
    """A row for each value of links (key, value) of a column; one of null if there is none."""
    m = links.select(F.col("key").alias("map_key"), F.col("value").alias(out)).distinct()
    return rows.join(m, rows[column] == m["map_key"], "left").drop("map_key")


def translate_column(rows: DataFrame, column: str, mapping: DataFrame, missing: str | None = None, after: int = -1, delete: tuple[int, ...] = (), name: str = "translated") -> DataFrame:
    """rows with the translation of a column put behind the after-th column (0: first, -1: last), then without the
    columns whose places, from 1, delete names. missing: null drops rows without a translation, "" gives the key, other
    text gives itself."""
    name = free_name(name, rows.columns)
    x = lookup(rows, column, mapping, name, "drop" if missing is None else "key" if missing == "" else "none")
    if missing:
        x = x.withColumn(name, F.coalesce(name, F.lit(missing)))
    cols = [c for c in rows.columns]
    cols.insert(len(cols) if after < 0 else after, name)
    return x.select(*[c for i, c in enumerate(cols, 1) if i not in delete])


def translate_packed(rows: DataFrame, key: str, items: DataFrame, links: DataFrame, default: str | None = None) -> DataFrame:
    """All translations of the items of a cell, each once and sorted: (key, values). items: (key, item); links: (key,
    value). An item without a translation gives default."""
    m = links.select(F.col("key").alias("map_key"), "value").distinct()
    x = items.join(m, items["item"] == m["map_key"], "left").withColumn("value", F.coalesce("value", F.lit(default)))
    got = x.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("values"))
    return rows.select(key).distinct().join(got, key, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def screen(rows: DataFrame, column: str, listed: DataFrame, keep: bool = True, once: str | None = None) -> DataFrame:
    """Rows whose column is in the list (first column of listed), or is not. once: with keep, only the first row of each
    id, in the order of this column."""
    ids = listed.select(F.col(listed.columns[0]).alias("listed_id")).distinct()
    out = rows.join(ids, rows[column] == ids["listed_id"], "left_semi" if keep else "left_anti")
    if once and keep:
        n = free_name("nth", rows.columns)
        out = out.withColumn(n, F.row_number().over(Window.partitionBy(column).orderBy(once))).where(F.col(n) == 1).drop(n)
    return out


#: Names that are listed under others, compared in small letters without blanks.
OTHER_NAMES = {"asaia lannensis": "asaia lannaensis", "uncultured haptophyte": "haptophyta", "acidisoma sibiricum": "acidisoma sibirica"}


def name_cascade(rows: DataFrame, column: str, names: DataFrame, out: str = "taxid", beginnings: bool = True) -> DataFrame:
    """rows with the taxid of a name, tried in steps: as it is, without brackets and what is in them, by OTHER_NAMES, with
    "clade" read as "cluster", as the beginning of a listed name (the first listed), with a listed name as its beginning
    (the longest); the last two only with beginnings.

    names: (name, taxid, pos), pos being the order in the list. Names are compared in small letters without blanks and
    dots. The step to beginnings joins by every beginning of either side, not every name with every other. Null names and
    names not found have a null taxid."""
    listed = names.select(simplify(F.col("name")).alias("nk"), F.col("taxid").alias("nt"), "pos").where("nk <> ''")
    listed = listed.groupBy("nk").agg(F.min(F.struct("pos", "nt")).alias("f")).select("nk", F.col("f.nt").alias("nt"), F.col("f.pos").alias("pos"))
    exact = listed.select("nk", "nt")
    asked = rows.select(F.col(column).alias("asked")).where("asked is not null").distinct()
    base = F.regexp_replace(simplify(F.col("asked")), r"^\|", "")
    plain = F.regexp_replace(base, r"\([^()]*\)", "")
    other = plain
    for was, now in OTHER_NAMES.items():
        other = F.when(plain == was.replace(" ", ""), F.lit(now.replace(" ", ""))).otherwise(other)
    tried = asked.select("asked", F.array(base, plain, other, F.replace(other, F.lit("clade"), F.lit("cluster"))).alias("ks"))
    steps = tried.select("asked", F.posexplode("ks").alias("step", "k")).where("k <> ''")
    found = steps.join(exact, F.col("k") == F.col("nk")).groupBy("asked").agg(F.min_by("nt", "step").alias("t"))
    if not beginnings:
        return rows.join(found, rows[column] == found["asked"], "left").drop("asked").withColumnRenamed("t", out)
    rest = tried.join(found, "asked", "left_anti").select("asked", F.element_at("ks", 3).alias("k")).where("k <> ''")
    starts = lambda k: F.explode(F.transform(F.sequence(F.lit(1), F.length(k)), lambda n: F.substring(k, F.lit(1), n)))
    begins = listed.select(starts(F.col("nk")).alias("k"), "nk", "nt", "pos").where("length(nk) > length(k)")
    longer = rest.where("not k like '%sp'").join(begins, "k").groupBy("asked").agg(F.min_by("nt", "pos").alias("t"))
    cuts = rest.select("asked", starts(F.col("k")).alias("k"))
    shorter = cuts.join(exact, F.col("k") == F.col("nk")).groupBy("asked").agg(F.max_by("nt", F.length("k")).alias("t"))
    both = longer.select("asked", "t", F.lit(0).alias("o")).unionByName(shorter.select("asked", "t", F.lit(1).alias("o"))).groupBy("asked").agg(F.min_by("t", "o").alias("t"))
    known = found.unionByName(both)
    return rows.join(known, rows[column] == known["asked"], "left").drop("asked").withColumnRenamed("t", out)
