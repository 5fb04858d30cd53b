"""The queries p3_, p4_ and p5_ on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.operators.hierarchy import all_descendants, all_subtree_sizes, descendants, hierarchy, opened_hierarchy, subtree_sizes
from hitweave.operators.packed import split_packed
from hitweave.session import load
from hitweave.sources.bad_rows import parse_rows, rejected, valid

READ_FORM = r"[A-Za-z][A-Za-z0-9]*_[0-9]+_[0-9]+"
HIT_FORM = r"K[0-9]{5}|[A-Z][a-z]{2}[A-Za-z0-9 \t.,:'()/\"\-]*"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(load(spark, sf, "taxnodes"), "taxid", "parentid", "node_row")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select(F.col("id").cast("int").alias("taxid"), F.coalesce("path", F.lit("cycle")).alias("path"))


def p3_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Depth, root and rank of each node; the rank is that of the row that holds."""
    nodes = load(spark, sf, "taxnodes")
    ranks = nodes.groupBy("taxid").agg(F.max(F.struct("node_row", "rank")).alias("m")).select(F.col("taxid").cast("long").alias("id"), F.col("m.rank").alias("rank"))
    return _paths(spark, sf).join(ranks, "id").select(F.col("id").alias("taxid"), "rank", "depth", "root")


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(_paths(spark, sf)).withColumnRenamed("id", "taxid")


def p3_subtree_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return subtree_sizes(_paths(spark, sf)).withColumnRenamed("id", "taxid")


def _opened(spark: SparkSession, sf: str) -> DataFrame:
    return opened_hierarchy(load(spark, sf, "taxnodes"), "taxid", "parentid", "node_row")


def p3_descendants_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Also of the nodes on and below cycles."""
    return all_descendants(_opened(spark, sf)).withColumnRenamed("id", "taxid")


def p3_subtree_sizes_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Also of the nodes on and below cycles."""
    return all_subtree_sizes(_opened(spark, sf)).withColumnRenamed("id", "taxid")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "raw_assignments")
    return parse_rows(raw, "line", {"Read": READ_FORM, "Hit": HIT_FORM}, keep=["raw_id"], header=F.col("line_no") == 1)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejected(_parsed(spark, sf), ["Read", "Hit"]).select("raw_id")


def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return valid(_parsed(spark, sf))


def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Bad lines with their reasons."""
    return rejected(_parsed(spark, sf), ["Read", "Hit"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_packed(load(spark, sf, "gene_kos"), "row_id", "ko_column")


QUERIES = {f.__name__: f for f in (p3_found, p3_nodes, p3_descendants, p3_subtree_sizes, p3_descendants_whole, p3_subtree_sizes_whole, p4_found, p4_loaded, p4_reasons, p5_found)}

_TREE = """WITH RECURSIVE last AS (
  SELECT taxid, nullif(arg_max(coalesce(parentid, -1), node_row), -1) AS parentid, arg_max(coalesce(rank, chr(0)), node_row) AS rank
  FROM taxnodes WHERE taxid IS NOT NULL GROUP BY taxid),
walk AS (
  SELECT taxid, CAST(taxid AS VARCHAR) AS path, 1 AS depth, taxid AS root, [taxid] AS above FROM last
  WHERE parentid IS NULL OR parentid = taxid OR parentid NOT IN (SELECT taxid FROM last)
  UNION ALL
  SELECT c.taxid, w.path || '/' || c.taxid, w.depth + 1, w.root, list_append(w.above, c.taxid)
  FROM walk w JOIN last c ON c.parentid = w.taxid AND c.taxid <> c.parentid) """
_ABOVE = _TREE.partition("walk AS")[0] + """e AS (SELECT taxid, parentid FROM last WHERE parentid <> taxid AND parentid IN (SELECT taxid FROM last)),
up AS (
  SELECT taxid AS descendant, parentid AS a, 1 AS distance, [taxid, parentid] AS seen FROM e
  UNION ALL
  SELECT u.descendant, e.parentid, u.distance + 1, list_append(u.seen, e.parentid) FROM up u JOIN e ON e.taxid = u.a AND NOT list_contains(u.seen, e.parentid)) """
_CLEAN = """WITH x AS (SELECT raw_id, regexp_replace(line, '\\r$', '') AS l FROM raw_assignments WHERE line IS NOT NULL AND line_no <> 1),
y AS (SELECT raw_id, l FROM x WHERE NOT regexp_full_match(l, '\\s*') AND NOT starts_with(l, '#')),
z AS (SELECT *, regexp_full_match(l, '(?: *[A-Za-z][A-Za-z0-9]*_[0-9]+_[0-9]+ *|"[A-Za-z][A-Za-z0-9]*_[0-9]+_[0-9]+")\\t(?: *(?:K[0-9]{5}|[A-Z][a-z]{2}[A-Za-z0-9 .,:''()/-]*) *|"(?:K[0-9]{5}|[A-Z][a-z]{2}(?:[A-Za-z0-9 \\t.,:''()/-]|"")*)")') AS ok FROM y) """
_UNQUOTE = """CASE WHEN starts_with({x}, '"') THEN replace({x}[2:-2], '""', '"') WHEN starts_with({x}, '''') THEN trim({x}[2:-2]) ELSE regexp_replace({x}, '\\\\(.)', '\\1', 'g') END"""
SQL = {
    "p3_found": _TREE + "SELECT last.taxid, coalesce(walk.path, 'cycle') AS path FROM last LEFT JOIN walk USING (taxid)",
    "p3_nodes": _TREE + "SELECT CAST(last.taxid AS BIGINT) AS taxid, nullif(last.rank, chr(0)) AS rank, CAST(depth AS BIGINT) AS depth, CAST(root AS BIGINT) AS root FROM last LEFT JOIN walk USING (taxid)",
    "p3_descendants": _TREE + "SELECT CAST(above[i] AS BIGINT) AS taxid, CAST(taxid AS BIGINT) AS descendant, depth - i AS distance FROM (SELECT *, unnest(range(1, depth)) AS i FROM walk)",
    "p3_subtree_sizes": _TREE + "SELECT CAST(a AS BIGINT) AS taxid, count(*) - 1 AS n_descendants FROM (SELECT unnest(above) AS a FROM walk) GROUP BY a",
    "p3_descendants_whole": _ABOVE + "SELECT CAST(a AS BIGINT) AS taxid, CAST(descendant AS BIGINT) AS descendant, distance FROM up",
    "p3_subtree_sizes_whole": _ABOVE + "SELECT CAST(last.taxid AS BIGINT) AS taxid, count(up.a) AS n_descendants FROM last LEFT JOIN up ON up.a = last.taxid GROUP BY last.taxid",
    "p4_found": _CLEAN + "SELECT raw_id FROM z WHERE NOT ok",
    "p4_loaded": _CLEAN + """SELECT raw_id, CASE WHEN starts_with(r, '"') THEN r[2:-2] ELSE trim(r, ' ') END AS "Read", CASE WHEN starts_with(h, '"') THEN replace(h[2:-2], '""', '"') ELSE trim(h, ' ') END AS "Hit"
FROM (SELECT raw_id, regexp_extract(l, '^([^\\t]*)\\t(.*)$', 1) AS r, regexp_extract(l, '^([^\\t]*)\\t((?s:.*))$', 2) AS h FROM z WHERE ok)""",
    "p5_found": """WITH c AS (SELECT row_id, ko_column AS c FROM gene_kos WHERE ko_column IS NOT NULL),
d AS (SELECT row_id, CASE WHEN regexp_full_match(c, '\\s*"(?:[^"]|"")*"\\s*') AND regexp_matches(c, 'K[0-9]{5}') THEN replace(regexp_extract(c, '^\\s*"((?:.|\\n)*)"\\s*$', 1), '""', '"') ELSE c END AS c FROM c),
e AS (SELECT row_id, regexp_extract_all(c, '"(?:[^"]|"")*"|''[^'']*''|(?:ko:)?K[0-9]{5}|[A-Z][a-z](?:\\\\.|[^\\\\;,|/+¦；"\\n\\t<]|[;,|/] ?[a-z])*') AS raw FROM d),
f AS (SELECT row_id, list_filter([""" + _UNQUOTE.format(x="trim(v)") + """ FOR v IN raw], lambda v: trim(v) <> '') AS items FROM e)
SELECT row_id, CAST(unnest(range(1, len(items) + 1)) AS INT) AS item_pos, unnest(items) AS item FROM f""",
}
