"""Queries of the operators on search hits over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.operators import assembly, counts, filters, identify, intervals, reduce, sampling, sequences, taxonomy, tophit, translate
from hitweave.operators.filters import FilterParams, filter_hits
from hitweave.operators.packed import split_packed
from hitweave.plans.problems import _TREE
from hitweave.plans.problems import SQL as PROBLEM_SQL
from hitweave.schema import FAMILY_TAXIDS, RANKS
from hitweave.session import cut, load

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


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "hits").withColumn("pos", F.col("hit_row"))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("hit_row")


# filters -------------------------------------------------------------------------------------------------------------

_BEST = "SELECT *, greatest(max(score) OVER (PARTITION BY label, read), 0) AS best FROM hits"


@query("SELECT hit_row FROM hits WHERE score >= 100")
def f_bits(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(bits=100)))


@query("SELECT hit_row FROM hits WHERE evalue <= 1e-20")
def f_evalue(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(evalue=1e-20)))


@query("SELECT hit_row FROM hits WHERE pctid >= 60")
def f_pctid(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(pctid=60)))


@query("SELECT hit_row FROM hits WHERE abs(mlen) >= 200")
def f_length(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(length=200)))


@query("SELECT hit_row FROM hits WHERE aln >= 0.5")
def f_aln(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(aln=0.5)))


@query(f"SELECT hit_row FROM ({_BEST}) WHERE score >= best - 5.0 * best / 100")
def f_toppct(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(top_pct=5)))


def _bad(spark, sf):
    return load(spark, sf, "hits").where("score > 300").select("hit")


@query("SELECT hit_row FROM hits WHERE hit IS NULL OR hit NOT IN (SELECT hit FROM hits WHERE score > 300 AND hit IS NOT NULL)")
def f_badrefs(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(bad_refs=_bad(spark, sf))))


_LIMITED = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY label, read ORDER BY {order}) AS rn FROM ({source})),
g AS (SELECT *, min(rn) OVER (PARTITION BY label, read, hit) AS first, row_number() OVER (PARTITION BY label, read, hit ORDER BY rn) AS nth FROM f),
k AS (SELECT *, dense_rank() OVER (PARTITION BY label, read ORDER BY first) AS place FROM g) SELECT hit_row FROM k WHERE {limit}"""


@query(_LIMITED.format(order="hit_row", source="SELECT * FROM hits", limit="place <= 2"))
def f_hits_per_read(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(hits_per_read=2)))


@query(_LIMITED.format(order="hit_row", source="SELECT * FROM hits", limit="nth <= 1"))
def f_hsps_per_hit(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(hsps_per_hit=1)))


@query(_LIMITED.format(order="score DESC NULLS LAST, hit NULLS FIRST, hit_row", source=f"SELECT * FROM ({_BEST}) WHERE score >= best - 20.0 * best / 100 AND score >= 50 AND evalue <= 1e-5 AND pctid >= 40 AND abs(mlen) >= 50", limit="place <= 3 AND nth <= 1"))
def f_combo(spark, sf):
    """Limits count only rows that pass the rest; sorted by score."""
    p = FilterParams(top_pct=20, bits=50, evalue=1e-5, pctid=40, length=50, hits_per_read=3, hsps_per_hit=1, sort="score")
    return _rows(filter_hits(_hits(spark, sf), p))


_GREEDY = """WITH l AS (SELECT label, read, list({{'s': least(qstart, qend), 'e': greatest(qstart, qend), 'p': hit_row}} ORDER BY score DESC NULLS LAST, hit NULLS FIRST, hit_row) AS rows
  FROM hits WHERE qstart IS NOT NULL AND qend IS NOT NULL GROUP BY label, read)
SELECT unnest(list_reduce(list_transform(rows, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda r: NOT (b[1].s + {b} >= r.e OR b[1].e - {b} <= r.s))) = 0 THEN list_concat(a, b) ELSE a END)).p AS hit_row FROM l"""


@query(_GREEDY.format(b=0))
def f_nonoverlap(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(nonoverlapping=0, sort="score")))


@query(_GREEDY.format(b=50))
def f_nonoverlap_buffer(spark, sf):
    return _rows(filter_hits(_hits(spark, sf), FilterParams(nonoverlapping=50, sort="score")))


def _sorted(sort: str):
    def f(spark, sf):
        return filters.ranked(_hits(spark, sf), sort).select("hit_row", "place")

    return f


for _sort, _key in (("score", "score DESC NULLS LAST"), ("evalue", "evalue ASC NULLS LAST"), ("pctid", "pctid DESC NULLS LAST")):
    QUERIES[f"o_sort_{_sort}"] = _sorted(_sort)
    SQL[f"o_sort_{_sort}"] = f"SELECT hit_row, CAST(row_number() OVER (PARTITION BY label, read ORDER BY {_key}, hit NULLS FIRST, hit_row) AS INT) AS place FROM hits"

# values of reads -----------------------------------------------------------------------------------------------------

_V = "v AS (SELECT label, read, assign_id AS pos, nullif(lower(regexp_replace(hit, '^[ \\t\\x{a0}]+|[ \\t\\x{a0}]+$', '', 'g')), '') AS value FROM read_assignments)"


def _clean(c: str) -> Column:
    return F.nullif(F.lower(F.regexp_replace(c, r"^[ \t\xa0]+|[ \t\xa0]+$", "")), F.lit(""))


def _values(spark, sf) -> DataFrame:
    return load(spark, sf, "read_assignments").select("label", "read", F.col("assign_id").alias("pos"), _clean("hit").alias("value"))


@query(f"WITH {_V} SELECT label, read, arg_min(coalesce(value, chr(0)), pos) AS value FROM v GROUP BY label, read".replace("SELECT label, read, arg_min(coalesce(value, chr(0)), pos)", "SELECT label, read, nullif(arg_min(coalesce(value, chr(0)), pos), chr(0))"))
def r_first(spark, sf):
    return reduce.first(_values(spark, sf))


@query(f"WITH {_V} SELECT DISTINCT label, read, value FROM v")
def r_all(spark, sf):
    return reduce.all_values(_values(spark, sf))


@query(f"WITH {_V} SELECT label, read, min(value) AS value FROM v GROUP BY label, read HAVING count(DISTINCT coalesce(value, chr(0))) = 1")
def r_consensus(spark, sf):
    return reduce.consensus(_values(spark, sf))


@query(f"WITH {_V}, n AS (SELECT label, read, value, rank() OVER (PARTITION BY label, read ORDER BY count(*) DESC) AS r FROM v GROUP BY label, read, value) SELECT label, read, value FROM n WHERE r = 1")
def r_most(spark, sf):
    return reduce.most(_values(spark, sf))


_NAMES = "nm AS (SELECT lower(name) AS key, min(taxid) AS value FROM taxon_names GROUP BY 1)"
_TAXA = f"t AS (SELECT v.label, v.read, v.pos, nm.value FROM v LEFT JOIN nm ON v.value = nm.key)"
_LINES = _TREE.rstrip().replace("WITH RECURSIVE", "WITH RECURSIVE " + f"{_V}, {_NAMES}, {_TAXA}, ", 1)


def _name_map(spark, sf) -> DataFrame:
    return load(spark, sf, "taxon_names").groupBy(F.lower("name").alias("key")).agg(F.min("taxid").alias("value"))


def _taxa(spark, sf) -> DataFrame:
    return translate.lookup(_values(spark, sf), "value", _name_map(spark, sf), "taxid").select("label", "read", "pos", F.col("taxid").alias("value"))


def _nodes(spark, sf) -> DataFrame:
    return load(spark, sf, "taxnodes").select("taxid", F.col("parentid").alias("parent"), "rank", "node_row", "db")


def _lines(spark, sf) -> DataFrame:
    names = load(spark, sf, "taxon_names").where("name_class = 'scientific name'")
    return taxonomy.lineages(_nodes(spark, sf), names, "node_row")


@query(_LINES + """, d AS (SELECT DISTINCT label, read, value FROM t WHERE value IN (SELECT taxid FROM walk)),
u AS (SELECT d.label, d.read, unnest(w.above) AS anc, unnest(range(1, len(w.above) + 1)) AS depth FROM d JOIN walk w ON w.taxid = d.value),
s AS (SELECT label, read, anc, depth, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT label, read, count(*) AS total FROM d GROUP BY ALL)
SELECT label, read, arg_max(anc, depth) AS value FROM s JOIN k USING (label, read) WHERE n = total GROUP BY label, read""")
def r_lca(spark, sf):
    return reduce.lca(_taxa(spark, sf), _lines(spark, sf))


@query(f"WITH {_V} SELECT label, value, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL")
def c_all(spark, sf):
    return counts.count_values(_values(spark, sf))


@query(f"WITH {_V}, f AS (SELECT *, row_number() OVER (PARTITION BY label, read ORDER BY pos) AS i FROM v) SELECT label, value, count(*) AS n FROM f WHERE i = 1 GROUP BY ALL")
def c_first(spark, sf):
    return counts.count_values(_values(spark, sf), "first")


@query(f"WITH {_V}, f AS (SELECT *, count(*) OVER (PARTITION BY label, read) AS k FROM v) SELECT label, value, round(sum(1.0 / k), 6) AS n FROM f GROUP BY ALL")
def c_portion(spark, sf):
    return counts.count_values(_values(spark, sf), "portion").withColumn("n", F.round("n", 6))


def _weights(spark, sf) -> DataFrame:
    """Weights of reads from two tables, of which the later holds."""
    hits = load(spark, sf, "hits").groupBy("read").agg(F.countDistinct("hit").alias("weight"), F.lit(0).alias("pos"))
    return hits.unionByName(load(spark, sf, "read_assignments").groupBy("read").agg(F.count("*").alias("weight"), F.lit(1).alias("pos")))


_W = "w AS (SELECT read, arg_max(weight, pos) AS weight FROM (SELECT read, count(DISTINCT hit) AS weight, 0 AS pos FROM hits GROUP BY read UNION ALL SELECT read, count(*), 1 FROM read_assignments GROUP BY read) GROUP BY read)"


@query(f"WITH {_V}, {_W} SELECT label, value, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS n FROM v LEFT JOIN w USING (read) GROUP BY label, value")
def c_weighted(spark, sf):
    return counts.count_values(_values(spark, sf), weights=_weights(spark, sf))


@query(f"WITH {_V}, k AS (SELECT label, count(DISTINCT read) AS total FROM v GROUP BY label), n AS (SELECT label, value, count(*) AS n FROM v GROUP BY ALL), f AS (SELECT label, CASE WHEN n < 0.01 * total THEN 'Other' ELSE value END AS value, n FROM n JOIN k USING (label) UNION ALL SELECT label, 'Other', 0 FROM k) SELECT label, value, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY label, value")
def c_cutoff(spark, sf):
    """Values of less than 1 % of a label's reads as Other."""
    v = _values(spark, sf)
    n = counts.count_values(v).join(counts.count_reads(v), "label")
    return counts.fold_rare(n, 0.01 * F.col("total"))


# lookups -------------------------------------------------------------------------------------------------------------

@query(f"WITH {_V}, {_NAMES} SELECT v.pos, nm.value AS taxid FROM v LEFT JOIN nm ON v.value = nm.key")
def j_lookup_none(spark, sf):
    return translate.lookup(_values(spark, sf), "value", _name_map(spark, sf), "taxid").select("pos", "taxid")


@query(f"WITH {_V}, {_NAMES} SELECT v.pos, coalesce(CAST(nm.value AS VARCHAR), v.value) AS translated FROM v LEFT JOIN nm ON v.value = nm.key")
def j_lookup_key(spark, sf):
    m = _name_map(spark, sf).withColumn("value", F.col("value").cast("string"))
    return translate.lookup(_values(spark, sf), "value", m, "translated", "key").select("pos", "translated")


@query(f"WITH {_V}, m AS (SELECT DISTINCT lower(name) AS key, taxid FROM taxon_names) SELECT v.pos, m.taxid FROM v LEFT JOIN m ON v.value = m.key")
def j_lookup_multi(spark, sf):
    links = load(spark, sf, "taxon_names").select(F.lower("name").alias("key"), F.col("taxid").alias("value"))
    return translate.lookup_many(_values(spark, sf), "value", links, "taxid").select("pos", "taxid")


def _listed(spark, sf):
    return load(spark, sf, "hits").where("pctid > 95").select("hit")


@query("SELECT hit_row FROM hits WHERE hit IN (SELECT hit FROM hits WHERE pctid > 95)")
def j_screen_keep(spark, sf):
    return _rows(translate.screen(_hits(spark, sf), "hit", _listed(spark, sf)))


@query("SELECT hit_row FROM hits WHERE hit IS NULL OR hit NOT IN (SELECT hit FROM hits WHERE pctid > 95 AND hit IS NOT NULL)")
def j_screen_drop(spark, sf):
    return _rows(translate.screen(_hits(spark, sf), "hit", _listed(spark, sf), keep=False))


_SPANS = "x AS (SELECT hit_row, label || '/' || read AS k, least(qstart, qend) AS s, greatest(qstart, qend) AS e, hit_desc LIKE 'ribosome%' AS rna FROM hits WHERE qstart IS NOT NULL AND qend IS NOT NULL)"


def _spans(spark, sf) -> tuple[DataFrame, DataFrame]:
    x = _hits(spark, sf).where("qstart is not null and qend is not null").select("hit_row", F.concat_ws("/", "label", "read").alias("k"), F.least("qstart", "qend").alias("start"), F.greatest("qstart", "qend").alias("stop"), F.col("hit_desc").startswith("ribosome").alias("rna"))
    return x, x.where("rna")


@query(f"WITH {_SPANS} SELECT hit_row FROM x WHERE NOT EXISTS (SELECT 1 FROM x r WHERE r.rna AND r.k = x.k AND NOT (x.s >= r.e OR x.e <= r.s))")
def j_overlap_anti(spark, sf):
    a, b = _spans(spark, sf)
    return _rows(intervals.overlap_join(a, b, "k", "left_anti"))


@query(f"WITH {_SPANS} SELECT x.hit_row, r.hit_row AS b_hit_row FROM x JOIN x r ON r.rna AND r.k = x.k AND NOT (x.s >= r.e OR x.e <= r.s)")
def j_overlap_pairs(spark, sf):
    a, b = _spans(spark, sf)
    return intervals.overlap_join(a, b, "k").select("hit_row", "b_hit_row")


_SIMPLE = "regexp_replace(lower({}), '[\\s.]', '', 'g')"


@query(f"""WITH n AS (SELECT nk, arg_min(taxid, name_row) AS nt, min(name_row) AS pos FROM (SELECT {_SIMPLE.format("name")} AS nk, taxid, name_row FROM taxon_names) WHERE nk <> '' GROUP BY nk),
a AS (SELECT DISTINCT hit AS asked FROM read_assignments WHERE hit IS NOT NULL),
b AS (SELECT asked, regexp_replace({_SIMPLE.format("asked")}, '^\\|', '') AS k1 FROM a), c AS (SELECT *, regexp_replace(k1, '\\([^()]*\\)', '', 'g') AS k2 FROM b),
c3 AS (SELECT *, CASE k2 {" ".join(f"WHEN '{k.replace(' ', '')}' THEN '{v.replace(' ', '')}'" for k, v in translate.OTHER_NAMES.items())} ELSE k2 END AS k3 FROM c), d AS (SELECT *, replace(k3, 'clade', 'cluster') AS k4 FROM c3),
e AS (SELECT d.*, coalesce(n1.nt, n2.nt, n3.nt, n4.nt) AS t FROM d LEFT JOIN n n1 ON d.k1 = n1.nk LEFT JOIN n n2 ON d.k2 = n2.nk LEFT JOIN n n3 ON d.k3 = n3.nk LEFT JOIN n n4 ON d.k4 = n4.nk),
l AS (SELECT asked, arg_min(nt, pos) AS t FROM e JOIN n ON e.t IS NULL AND k3 <> '' AND NOT k3 LIKE '%sp' AND length(nk) > length(k3) AND starts_with(nk, k3) GROUP BY asked),
s AS (SELECT asked, arg_max(nt, length(nk)) AS t FROM e JOIN n ON e.t IS NULL AND starts_with(k3, nk) GROUP BY asked)
SELECT r.assign_id, coalesce(e.t, l.t, s.t) AS taxid FROM read_assignments r LEFT JOIN e ON r.hit = e.asked LEFT JOIN l ON r.hit = l.asked LEFT JOIN s ON r.hit = s.asked""")
def j_name_cascade(spark, sf):
    names = load(spark, sf, "taxon_names").select("name", "taxid", F.col("name_row").alias("pos"))
    return translate.name_cascade(load(spark, sf, "read_assignments"), "hit", names).select("assign_id", "taxid")


# taxonomy ------------------------------------------------------------------------------------------------------------

_RANK = "list_position([" + ", ".join(f"'{r}'" for r in RANKS if r != "domain") + "], lower(trim({r})))"
_WALK = _TREE + ", rk AS (SELECT taxid, CASE WHEN lower(trim(rank)) = 'domain' THEN 28 ELSE coalesce(nullif(" + _RANK.format(r="rank") + f", 0), CASE WHEN taxid IN {FAMILY_TAXIDS} THEN 12 END) END AS r FROM last), up AS (SELECT a.taxid, a.anc, a.depth - a.d AS i, rk.r FROM (SELECT taxid, depth, unnest(above) AS anc, unnest(range(1, depth + 1)) AS d FROM walk) a JOIN rk ON rk.taxid = a.anc) "


@query(_WALK + "SELECT w.taxid, g.genus FROM walk w LEFT JOIN (SELECT taxid, arg_min(anc, i) AS genus FROM up WHERE r = 8 GROUP BY taxid) g USING (taxid)")
def t_rank_exact(spark, sf):
    return _lines(spark, sf).select("taxid", taxonomy.ancestor_at_rank(F.col("lineage"), "genus").alias("genus"))


_CLOSEST = _WALK + """, f AS (SELECT taxid, min(i) FILTER (WHERE r >= 12) AS i FROM up GROUP BY taxid), g AS (SELECT f.taxid, f.i, max(u.i) FILTER (WHERE u.r IS NOT NULL AND u.i < f.i) AS j FROM f JOIN up u USING (taxid) GROUP BY ALL),
h AS (SELECT g.*, a.r AS ri, b.r AS rj, a.anc AS ai, c.anc AS below FROM g LEFT JOIN up a ON a.taxid = g.taxid AND a.i = g.i LEFT JOIN up b ON b.taxid = g.taxid AND b.i = g.j LEFT JOIN up c ON c.taxid = g.taxid AND c.i = g.i - 1)
SELECT h.taxid, CASE WHEN h.i IS NULL THEN h.taxid WHEN ri = 12 THEN ai WHEN j IS NULL THEN {alone} ELSE m.anc END AS family
FROM h LEFT JOIN up m ON m.taxid = h.taxid AND m.i = floor(h.i - (ri - 12) / (ri - rj) * (h.i - j))"""


@query(_CLOSEST.replace("{alone}", "coalesce(below, h.taxid)"))
def t_rank_closest(spark, sf):
    return _lines(spark, sf).select("taxid", taxonomy.ancestor_closest_to_rank(F.col("lineage"), "family").alias("family"))


@query(_CLOSEST.replace("{alone}", "h.taxid"))
def t_rank_closest_node(spark, sf):
    """A node of no rank below the next ranked ancestor stands for itself."""
    return _lines(spark, sf).select("taxid", taxonomy.ancestor_closest_to_rank(F.col("lineage"), "family", use_child=False).alias("family"))


_NAMED = "sn AS (SELECT taxid, min(name) AS name FROM taxon_names WHERE name_class = 'scientific name' GROUP BY taxid)"


@query(_TREE + f", {_NAMED}, u AS (SELECT taxid, unnest(above) AS a, unnest(range(1, depth + 1)) AS i FROM walk) SELECT u.taxid, string_agg(coalesce(sn.name, CAST(a AS VARCHAR)), ';' ORDER BY i) AS lineage FROM u LEFT JOIN sn ON sn.taxid = u.a GROUP BY u.taxid")
def t_lineage(spark, sf):
    return _lines(spark, sf).select("taxid", taxonomy.lineage_text(F.col("lineage")).alias("lineage"))


@query(_TREE + "SELECT w.taxid, t.taxid AS target FROM walk w, (SELECT taxid FROM last WHERE lower(trim(rank)) = 'genus') t WHERE list_contains(w.above, t.taxid)")
def t_subtree(spark, sf):
    """Members of every genus."""
    lines = _lines(spark, sf)
    return taxonomy.members(lines, lines.where("lower(trim(rank)) = 'genus'"))


@query(_WALK + "SELECT a.rank AS above, b.rank AS below, count(*) AS n FROM up u JOIN last a ON a.taxid = u.anc JOIN last b ON b.taxid = u.taxid WHERE u.i > 0 GROUP BY ALL".replace("a.rank AS above", "nullif(a.rank, chr(0)) AS above").replace("b.rank AS below", "nullif(b.rank, chr(0)) AS below"))
def t_rank_pairs(spark, sf):
    return taxonomy.rank_pairs(_lines(spark, sf))


# counts over taxa and levels -----------------------------------------------------------------------------------------

_RANKED = _LINES + ", rk AS (SELECT taxid, " + _RANK.format(r="rank") + " AS r FROM last), an AS (SELECT a.taxid, a.anc, a.depth - a.d AS i, rk.r FROM (SELECT taxid, depth, unnest(above) AS anc, unnest(range(1, depth + 1)) AS d FROM walk) a JOIN rk ON rk.taxid = a.anc), ge AS (SELECT taxid, arg_min(anc, i) AS anc FROM an WHERE r = 8 GROUP BY taxid), rt AS (SELECT taxid, above[1] AS root FROM walk) "


@query(_RANKED + "SELECT label, CAST(coalesce(ge.anc, t.value) AS VARCHAR) AS value, count(*) AS n FROM t LEFT JOIN ge ON ge.taxid = t.value WHERE t.value IS NOT NULL GROUP BY ALL")
def x_rollup_rank(spark, sf):
    """Taxa counted at their genus, where they have one."""
    genus = _lines(spark, sf).select("taxid", taxonomy.ancestor_at_rank(F.col("lineage"), "genus").alias("g")).where("g is not null")
    n = counts.count_values(_taxa(spark, sf).where("value is not null").withColumn("value", F.col("value").cast("string")))
    return counts.roll_up(n, genus.select(F.col("taxid").cast("string").alias("value"), F.col("g").cast("string").alias("level_value")))


@query(_RANKED + """, n AS (SELECT label, value, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT label, sum(n) AS total FROM n GROUP BY label),
keep AS (SELECT value, bool_or(n > total * 0.002) AS keep FROM n JOIN k USING (label) GROUP BY value)
SELECT label, CASE WHEN keep THEN value ELSE root END AS value, CAST(sum(n) AS BIGINT) AS n FROM n JOIN keep USING (value) LEFT JOIN rt ON rt.taxid = value GROUP BY 1, 2""")
def x_rollup_cutoff(spark, sf):
    """Taxa of no more than 0.2 % in every label are counted at their root."""
    roots = _lines(spark, sf).select(F.col("taxid").alias("tid"), F.col("lineage")[0]["taxid"].alias("root"))
    n = counts.count_values(_taxa(spark, sf).where("value is not null"))
    return counts.fold_below_cutoff(n.join(roots, n["value"] == roots["tid"], "left"), 0.002, F.col("root"))


def _links(spark, sf) -> DataFrame:
    """(key, value): ids of the packed cells, and the kind of protein in the description."""
    genes = load(spark, sf, "gene_kos")
    items = split_packed(genes, "row_id", "ko_column")
    kind = genes.select("row_id", F.split_part("description", F.lit(" "), F.lit(2)).alias("value"))
    return items.join(kind, "row_id").where("value <> ''").select(F.lower(F.regexp_replace("item", "^ko:", "")).alias("key"), "value").distinct()


_LINKS = f"i AS ({PROBLEM_SQL['p5_found']}), lk AS (SELECT DISTINCT lower(regexp_replace(item, '^ko:', '')) AS key, split_part(description, ' ', 2) AS value FROM i JOIN gene_kos USING (row_id) WHERE split_part(description, ' ', 2) <> '')"


@query(f"WITH {_V}, {_LINKS} SELECT label, coalesce(lk.value, v.value) AS value, count(*) AS n FROM v LEFT JOIN lk ON lk.key = v.value GROUP BY ALL")
def x_level_multi(spark, sf):
    """Ids counted under every kind of protein that has them."""
    links = _links(spark, sf).select(F.col("key").alias("value"), F.col("value").alias("level_value"))
    return counts.roll_up(counts.count_values(_values(spark, sf)), links)


_CAND = """c AS (SELECT label, read, org, min(hit) AS hit, max(hit_row) AS pos FROM h GROUP BY label, read, org), k AS (SELECT *, count(*) OVER (PARTITION BY label, read) AS k FROM c),
n AS (SELECT org, count(*) AS n FROM k WHERE k = 1 GROUP BY org), """
_TOP = "s AS (SELECT c.*, coalesce(n, 0.5) AS n FROM c LEFT JOIN n ON c.org IS NOT DISTINCT FROM n.org) SELECT label, read, org, hit FROM s QUALIFY row_number() OVER (PARTITION BY label, read ORDER BY n DESC, org NULLS FIRST) = 1"
_BY_HIT = "h AS (SELECT label, read, hit AS org, hit, hit_row FROM hits), "
#: The pattern of translate.PATTERNS without looking ahead, which the SQL engine can't.
ORG = r"\[([^|\[\]]*(?:\[[^|\[\]]+\])?[^|\[\]]*)\]?\s*(?:[a-z]{2,3}\||$)"
_BY_ORG = f"h AS (SELECT label, read, nullif(lower(regexp_extract(hit_desc, '{ORG}', 1)), '') AS org, hit, hit_row FROM hits), "


def _orgs(spark, sf) -> DataFrame:
    return _hits(spark, sf).withColumn("org", F.nullif(F.lower(F.regexp_extract("hit_desc", translate.PATTERNS["organism"], 1)), F.lit("")))


@query("WITH " + _BY_HIT + _CAND + _TOP)
def x_tophit(spark, sf):
    return tophit.top_hit(_hits(spark, sf), "hit")


@query("WITH " + _BY_ORG + _CAND + _TOP)
def x_toporg(spark, sf):
    return tophit.top_hit(_orgs(spark, sf), "org")


@query("WITH " + _BY_ORG + _CAND + """g AS (SELECT label, read, list(org ORDER BY org) FILTER (WHERE org IS NOT NULL) AS orgs, max(pos) AS pos FROM c GROUP BY label, read),
dbt AS (SELECT *, row_number() OVER (PARTITION BY orgs ORDER BY pos DESC) AS rn FROM g WHERE len(orgs) > 1), st AS (SELECT orgs, count(*) AS reads FROM dbt GROUP BY orgs),
e AS (SELECT orgs, reads, unnest(orgs) AS org, unnest(range(0, len(orgs))) AS i FROM st), q AS (SELECT e.*, coalesce(n, 0.5) AS n FROM e LEFT JOIN n USING (org)),
x AS (SELECT *, n * reads / sum(n) OVER (PARTITION BY orgs) AS x FROM q), y AS (SELECT *, floor(x + 1e-12) AS whole FROM x),
z AS (SELECT *, sum(whole) OVER (PARTITION BY orgs ORDER BY x DESC, i ROWS UNBOUNDED PRECEDING) AS hi, sum(whole) OVER (PARTITION BY orgs) AS dealt, row_number() OVER (PARTITION BY orgs ORDER BY round(x - whole, 9) DESC, i DESC) AS k FROM y)
SELECT label, read, z.org FROM dbt JOIN z ON dbt.orgs = z.orgs AND (rn > hi - whole AND rn <= hi OR rn = dealt + k) UNION ALL SELECT label, read, orgs[1] FROM g WHERE coalesce(len(orgs), 0) <= 1""")
def x_tophit_prop(spark, sf):
    return tophit.top_hit_proportional(_orgs(spark, sf), "org")


@query("WITH " + _BY_HIT + "c AS (SELECT label, read, org, min(hit) AS hit, max(hit_row) AS pos FROM h GROUP BY label, read, org), n AS (SELECT hit AS org, count(*) AS n FROM hits GROUP BY hit), " + _TOP)
def x_given_counts(spark, sf):
    given = load(spark, sf, "hits").groupBy(F.col("hit").alias("org")).agg(F.count("*").alias("n"))
    return tophit.top_hit(_hits(spark, sf), "hit", counts=given)


_SIDES = f"{_V}, l AS (SELECT read, value FROM v WHERE regexp_full_match(value, 'k[0-9]{{5}}')), r AS (SELECT read, value FROM v WHERE NOT regexp_full_match(value, 'k[0-9]{{5}}'))"
_PAIRS = "p AS (SELECT read, coalesce(l.value, 'Unknown') AS value1, coalesce(r.value, 'Unknown') AS value2 FROM l FULL JOIN r USING (read))"


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = _values(spark, sf).where("value is not null")
    ko = F.col("value").rlike("^k[0-9]{5}$")
    return v.where(ko), v.where(~ko)


@query(f"WITH {_SIDES}, {_PAIRS} SELECT value1, value2, count(*) AS n, count(*) AS weighted FROM p GROUP BY ALL")
def x_crosstab(spark, sf):
    return counts.crosstab(*_sides(spark, sf)).withColumn("weighted", F.col("weighted").cast("long"))


@query(f"WITH {_SIDES}, {_PAIRS}, {_W} SELECT value1, value2, count(*) AS n, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS weighted FROM p LEFT JOIN w USING (read) GROUP BY value1, value2")
def x_crosstab_weighted(spark, sf):
    return counts.crosstab(*_sides(spark, sf), weights=_weights(spark, sf))


@query(f"WITH {_SIDES}, {_PAIRS} SELECT value1, value2, count(*) AS n, count(*) AS weighted FROM p WHERE NOT (value1 = 'Unknown' AND value2 = 'Unknown') GROUP BY ALL UNION ALL SELECT 'Unknown', 'Unknown', 1000000 - count(DISTINCT read), 1000000 - count(DISTINCT read) FROM p")
def x_crosstab_total(spark, sf):
    return counts.crosstab(*_sides(spark, sf), total_reads=1_000_000).withColumn("weighted", F.col("weighted").cast("long"))


@query(f"PIVOT (WITH {_V} SELECT CASE WHEN regexp_full_match(value, 'k[0-9]{{5}}') THEN 'KO' ELSE 'taxon' END AS value, label FROM v WHERE value IS NOT NULL) ON label USING CAST(count(*) AS BIGINT) GROUP BY value")
def x_pivot(spark, sf):
    """Wide table of all samples that occur."""
    v = _values(spark, sf).where("value is not null").withColumn("value", F.when(F.col("value").rlike("^k[0-9]{5}$"), "KO").otherwise("taxon"))
    return counts.wide(counts.count_values(v))


# merging, assembly ---------------------------------------------------------------------------------------------------

@query("SELECT label || '/' || read AS contig, round(avg(mlen), 6) AS mean, min(mlen) AS min, max(mlen) AS max, CAST(median(mlen) AS DOUBLE) AS median FROM hits GROUP BY ALL")
def a_depth(spark, sf):
    x = _hits(spark, sf).select(F.concat_ws("/", "label", "read").alias("contig"), F.col("mlen").alias("depth"))
    return assembly.depth_stats(x).withColumn("mean", F.round("mean", 6))


@query("""WITH d AS (SELECT n_chars AS length, sum(n_chars) OVER (ORDER BY n_chars DESC RANGE UNBOUNDED PRECEDING) AS run, sum(n_chars) OVER () AS total FROM documents WHERE n_chars IS NOT NULL)
SELECT share, max(length) AS length FROM d, (VALUES (50), (75), (90)) s(share) WHERE run >= total * share / 100 GROUP BY share""")
def a_n50(spark, sf):
    return counts.n_statistics(load(spark, sf, "documents"), "n_chars")


_STATS = "SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, CAST(median({c}) AS DOUBLE) AS median, round(stddev_samp({c}), 6) AS std FROM hits"


@query(" UNION ALL ".join(_STATS.format(c=c) for c in ("score", "pctid", "mlen")))
def a_colstats(spark, sf):
    return assembly.column_stats(load(spark, sf, "hits"), ["score", "pctid", "mlen"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH e AS (SELECT min(score) AS lo, max(score) AS hi FROM hits), b AS (SELECT least(CAST(floor((score - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, count(*) AS n FROM hits, e WHERE score IS NOT NULL GROUP BY 1)
SELECT CAST(r.i AS INT) AS bin, round(lo + (hi - lo) / 20 * r.i, 6) AS low, round(lo + (hi - lo) / 20 * (r.i + 1), 6) AS high, coalesce(n, 0) AS n FROM range(20) r(i), e LEFT JOIN b ON b.bin = r.i""")
def a_hist(spark, sf):
    return assembly.histogram(load(spark, sf, "hits"), "score", 20).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


_EDGES = [0, 500, 1000, 2000, 4000, 8000, 16000]
_EDGE_BIN = "(n_chars >= 0)::INT + (n_chars >= 500)::INT + (n_chars >= 1000)::INT + (n_chars >= 2000)::INT + (n_chars >= 4000)::INT + (n_chars >= 8000)::INT + (n_chars >= 16000)::INT"


@query(f"""WITH d AS (SELECT {_EDGE_BIN} AS bin, count(*) AS sequences, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM subject_labels)) AS hits FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(sequences, 0) AS sequences, coalesce(hits, 0) AS hits, coalesce(round(hits / sequences, 9), 0) AS rate FROM range(8) r(i) LEFT JOIN d ON d.bin = r.i""")
def a_hitrate(spark, sf):
    docs, labels = load(spark, sf, "documents", "subject_labels")
    x = assembly.hit_rate_by_length(docs.where("n_chars is not null").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")), labels.select(F.col("doc_id").alias("id")), _EDGES)
    return x.withColumn("rate", F.round("rate", 9))


@query(f"""WITH s AS (SELECT label || '/' || read AS id, max(greatest(qstart, qend)) AS n_chars, max(abs(qend - qstart) + 1) AS span FROM hits GROUP BY 1),
d AS (SELECT {_EDGE_BIN} AS bin, CAST(sum(n_chars) AS BIGINT) AS bases, CAST(sum(span) AS BIGINT) AS covered FROM s WHERE n_chars IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(bases, 0) AS bases, coalesce(covered, 0) AS covered, coalesce(round(covered / bases, 9), 0) AS coverage FROM range(8) r(i) LEFT JOIN d ON d.bin = r.i""")
def a_coverage(spark, sf):
    h = _hits(spark, sf).select(F.concat_ws("/", "label", "read").alias("id"), F.col("qstart").alias("start"), F.col("qend").alias("stop"))
    seqs = h.groupBy("id").agg(F.max(F.greatest("start", "stop")).alias("length")).where("length is not null")
    return assembly.coverage_by_length(seqs, h, _EDGES).withColumn("coverage", F.round("coverage", 9))


# sequences -----------------------------------------------------------------------------------------------------------

def _seqs(spark, sf) -> DataFrame:
    """The letters A, C, G and T of the documents, as sequences."""
    return load(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


_SEQ = "q AS (SELECT doc_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_SEQ} SELECT id, round(CASE WHEN seq = '' THEN 0 ELSE 100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END, 9) AS gc FROM q")
def s_gc(spark, sf):
    return _seqs(spark, sf).select("id", F.round(sequences.gc_percent(F.col("seq")), 9).alias("gc"))


@query(f"WITH {_SEQ} SELECT id, translate(reverse(seq), 'ACGT', 'TGCA') AS seq FROM q")
def s_revcomp(spark, sf):
    return _seqs(spark, sf).select("id", sequences.reverse_complement(F.col("seq")).alias("seq"))


_CODON_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sequences.CODONS.items()) + "}"


@query(f"WITH {_SEQ} SELECT id, coalesce(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: {_CODON_SQL}[seq[i * 3 + 1:i * 3 + 3]]), ''), '') AS protein FROM q")
def s_translate(spark, sf):
    return _seqs(spark, sf).select("id", sequences.translated(F.col("seq")).alias("protein"))


@query(f"WITH {_SEQ} SELECT id, concat_ws('_', id, 11, 40) AS region_id, seq[11:40] AS seq FROM q UNION ALL SELECT id, concat_ws('_', id, 90, 51), translate(reverse(seq[51:90]), 'ACGT', 'TGCA') FROM q")
def s_extract(spark, sf):
    s = _seqs(spark, sf)
    two = s.select("id", F.explode(F.array(F.struct(F.lit(11).alias("start"), F.lit(40).alias("stop")), F.struct(F.lit(90).alias("start"), F.lit(51).alias("stop")))).alias("r")).select("id", "r.start", "r.stop")
    return sequences.extract_regions(s, two)


@query("""WITH x AS (SELECT label || '/' || read AS id, least(qstart, qend) AS s, greatest(qstart, qend) AS e FROM hits WHERE qstart IS NOT NULL AND qend IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(e) OVER (PARTITION BY id) + 100 AS n FROM x),
g AS (SELECT id, coalesce(before, 0) + 1 AS s, s - 1 AS e FROM y WHERE s > coalesce(before, 0) + 1 UNION ALL SELECT DISTINCT id, n - 99, n FROM y) SELECT id, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM g WHERE e - s + 1 >= 50""")
def s_mask(spark, sf):
    """Stretches of the reads, taken as 100 bases longer than their hits reach, that no hit covers."""
    h = _hits(spark, sf).where("qstart is not null and qend is not null").select(F.concat_ws("/", "label", "read").alias("id"), F.col("qstart").alias("s"), F.col("qend").alias("e"))
    return intervals.uncovered(h, h.groupBy("id").agg((F.max(F.greatest("s", "e")) + 100).alias("n")), 50)


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS INT) AS fragment FROM documents")
def s_fragment(spark, sf):
    return sequences.fragments_by_count(load(spark, sf, "documents"), 100, "doc_id").select("doc_id", "fragment")


@query()
def s_sample_n(spark, sf):
    """A sample of 200 records (its size is the feature)."""
    return sampling.sample_n(load(spark, sf, "documents"), 200, "doc_id", keep_order=True).select("doc_id", "source")


# columns, identification, trees --------------------------------------------------------------------------------------

@query(f"WITH {_V}, {_NAMES} SELECT v.pos, coalesce(CAST(nm.value AS VARCHAR), 'none') AS translated, v.value FROM v LEFT JOIN nm ON v.value = nm.key")
def p_translate_col(spark, sf):
    """The translation behind the fourth column, then without the first two."""
    m = _name_map(spark, sf).withColumn("value", F.col("value").cast("string"))
    return translate.translate_column(_values(spark, sf).select("label", "read", "pos", "value"), "value", m, "none", 3, (1, 2))


@query(f"WITH {_LINKS}, x AS (SELECT row_id, coalesce(lk.value, 'none') AS value FROM i LEFT JOIN lk ON lk.key = lower(regexp_replace(item, '^ko:', ''))) SELECT g.row_id, coalesce(array_to_string(list_sort(list_distinct(list(x.value))), ';'), '') AS \"values\" FROM gene_kos g LEFT JOIN x USING (row_id) GROUP BY g.row_id")
def p_translate_packed(spark, sf):
    genes = load(spark, sf, "gene_kos")
    items = split_packed(genes, "row_id", "ko_column").withColumn("item", F.lower(F.regexp_replace("item", "^ko:", "")))
    return translate.translate_packed(genes, "row_id", items, _links(spark, sf), "none").withColumn("values", F.array_join("values", ";"))


def _identify(every: bool):
    def f(spark, sf):
        lines = cut(_lines(spark, sf), "lineages")
        hits = translate.lookup(_orgs(spark, sf), "org", _name_map(spark, sf), "taxid")
        target = lines.where("rank = 'phylum'").agg(F.min("taxid")).collect()[0][0]
        outer = lines.where(F.col("taxid") == target).select(F.col("lineage")[0]["taxid"]).collect()[0][0]
        return _rows(identify.identify(hits, lines, target, outer, 10, every))

    return f


_ID = _TREE.rstrip().replace("WITH RECURSIVE", f"WITH RECURSIVE {_NAMES}, h AS (SELECT label, read, score, hit_row, nullif(lower(regexp_extract(hit_desc, '{ORG}', 1)), '') AS org FROM hits), ", 1) + """, tg AS (SELECT min(w.taxid) AS target FROM walk w JOIN last USING (taxid) WHERE last.rank = 'phylum'), ou AS (SELECT w.above[1] AS outr FROM walk w, tg WHERE w.taxid = target),
x AS (SELECT h.*, coalesce(list_contains(w.above, target), false) AS t, coalesce(list_contains(w.above, outr), false) AS o FROM h CROSS JOIN tg CROSS JOIN ou LEFT JOIN nm ON nm.key = h.org LEFT JOIN walk w ON w.taxid = nm.value),
b AS (SELECT *, max(score) OVER (PARTITION BY label, read) AS best, bool_and(o) OVER (PARTITION BY label, read) AS ao FROM x),
r AS (SELECT label, read FROM b WHERE ao AND score >= best * (1 - 10 / 100) GROUP BY label, read HAVING {f}(t)) SELECT hit_row FROM x SEMI JOIN r USING (label, read) WHERE t"""
for _n, _e, _f in (("i_identify_all", True, "bool_and"), ("i_identify_any", False, "bool_or")):
    QUERIES[_n] = _identify(_e)
    SQL[_n] = _ID.replace("{f}", _f)


@query(_TREE + f""", {_NAMED}, u AS (SELECT w.taxid, list(coalesce(trim(sn.name), CAST(w.a AS VARCHAR)) ORDER BY i) AS l FROM (SELECT taxid, unnest(above) AS a, unnest(range(1, depth + 1)) AS i FROM walk) w LEFT JOIN sn ON sn.taxid = w.a GROUP BY w.taxid),
p AS (SELECT DISTINCT array_to_string(l[1:d], ';') AS path, array_to_string(l[1:d - 1], ';') AS up, l[d] AS name FROM (SELECT l, unnest(range(1, len(l) + 1)) AS d FROM u)), n AS (SELECT *, CAST(row_number() OVER (ORDER BY path) AS INT) AS id FROM p)
SELECT n.id AS taxid, q.id AS parent, n.name, n.path FROM n LEFT JOIN n q ON n.up = q.path""")
def g_build_tree(spark, sf):
    """A tree from the lineages of all nodes, by names, or ids where they have none."""
    lines = _lines(spark, sf).select(F.transform("lineage", lambda x: F.coalesce(x["name"], x["taxid"].cast("string"))).alias("lineage"))
    return taxonomy.build_tree(lines).select("taxid", "parent", "name", "path")


@query(_LINES + "SELECT DISTINCT node_row FROM taxnodes WHERE taxid IN (SELECT unnest(above) FROM walk WHERE taxid IN (SELECT value FROM t))")
def g_prune(spark, sf):
    """Nodes of the assigned taxa and their ancestors."""
    return taxonomy.prune(_nodes(spark, sf), _lines(spark, sf), _taxa(spark, sf).select(F.col("value").alias("taxid"))).select("node_row")


@query("""WITH l AS (SELECT taxid, arg_max(coalesce(parentid, -1), node_row) AS parent, arg_max(db, node_row) AS db FROM taxnodes GROUP BY taxid), f AS (SELECT * FROM l WHERE db = 'namedtree'), s AS (SELECT * FROM l WHERE db <> 'namedtree'),
m AS (SELECT taxid AS old, (SELECT max(taxid) FROM f) + row_number() OVER (ORDER BY taxid) AS new FROM s)
SELECT taxid, nullif(parent, -1) AS parent FROM f UNION ALL SELECT CAST(m.new AS INT), CAST(p.new AS INT) FROM s JOIN m ON m.old = s.taxid LEFT JOIN m p ON p.old = s.parent""")
def g_merge_tax(spark, sf):
    """The other trees under new ids above those of the named tree."""
    x = _nodes(spark, sf)
    last = x.groupBy("taxid").agg(F.max(F.struct("node_row", "parent", "db")).alias("m")).select("taxid", "m.parent", "m.db")
    return taxonomy.merge_trees(last.where("db = 'namedtree'").select("taxid", "parent"), last.where("db <> 'namedtree'").select("taxid", "parent"))[0]


@query("WITH x AS (SELECT *, CASE WHEN read IS DISTINCT FROM lag(read) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY label ORDER BY hit_row)) SELECT hit_row, sum(new) OVER (PARTITION BY label ORDER BY hit_row ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM x")
def z_islands(spark, sf):
    """Runs of a read in the file order of its sample."""
    return sequences.islands(_hits(spark, sf), "read", "hit_row", "label").select("hit_row", "island")
