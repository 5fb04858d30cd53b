"""Queries of whole tasks, as a user starts them, and of operators that need more than one step, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave import commands
from hitweave.operators import assembly, counts, dimensions, sequences, taxonomy, tophit, translate
from hitweave.operators.filters import FilterParams
from hitweave.plans.hits import _BEST, _LINKS, _NAMES, _TREE, _V, _hits, _lines, _links, _taxa, _values, ORG
from hitweave.plans.hits import _LINES as _LINES_SQL
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


def nearest_sql(rank: str) -> str:
    """Tables last, walk, up and near (taxid, near): the ancestor closest to a rank, of trees in _TREE."""
    at = RANKS.index(rank) + 1
    ranks = ", ".join(f"'{r}'" for r in RANKS if r != "domain")
    return f""", rk AS (SELECT taxid, CASE WHEN lower(trim(rank)) = 'domain' THEN {RANKS.index("superkingdom") + 1} ELSE coalesce(nullif(list_position([{ranks}], lower(trim(rank))), 0), CASE WHEN taxid IN {FAMILY_TAXIDS} THEN {RANKS.index("family") + 1} END) END AS r FROM last),
up AS (SELECT a.taxid, a.anc, a.depth - a.d AS i, rk.r FROM (SELECT taxid, depth, unnest(above) AS anc, unnest(range(1, depth + 1)) AS d FROM walk) a JOIN rk ON rk.taxid = a.anc),
nf AS (SELECT taxid, min(i) FILTER (WHERE r >= {at}) AS i FROM up GROUP BY taxid), ng AS (SELECT nf.taxid, nf.i, max(u.i) FILTER (WHERE u.r IS NOT NULL AND u.i < nf.i) AS j FROM nf JOIN up u USING (taxid) GROUP BY ALL),
nh AS (SELECT ng.*, a.r AS ri, b.r AS rj, a.anc AS ai, c.anc AS below FROM ng LEFT JOIN up a ON a.taxid = ng.taxid AND a.i = ng.i LEFT JOIN up b ON b.taxid = ng.taxid AND b.i = ng.j LEFT JOIN up c ON c.taxid = ng.taxid AND c.i = ng.i - 1),
near AS (SELECT nh.taxid, CASE WHEN nh.i IS NULL THEN nh.taxid WHEN ri = {at} THEN ai WHEN j IS NULL THEN coalesce(below, nh.taxid) ELSE m.anc END AS near FROM nh LEFT JOIN up m ON m.taxid = nh.taxid AND m.i = floor(nh.i - (ri - {at}) / (ri - rj) * (nh.i - j))) """


def _mapping(spark, sf) -> DataFrame:
    return load(spark, sf, "taxon_names").groupBy(F.col("name").alias("key")).agg(F.min("taxid").alias("value"))


_TOP5 = FilterParams(top_pct=5, bits=50)
_ORGS = f"""m AS (SELECT name AS key, min(taxid) AS v FROM taxon_names GROUP BY name),
h AS (SELECT label, read, hit_row, CASE WHEN regexp_matches(hit_desc, '{ORG}') THEN regexp_extract(hit_desc, '{ORG}', 1) ELSE hit_desc END AS k FROM ({_BEST}) WHERE score >= best - 5.0 * best / 100 AND score >= 50),
f AS (SELECT label, read, nullif(arg_min(coalesce(v, -1), hit_row), -1) AS value FROM h LEFT JOIN m ON m.key = h.k GROUP BY label, read) """


@query("WITH " + _ORGS + "SELECT label, read, value FROM f")
def w_assign_taxa(spark, sf):
    """The first taxon that a read's best hits name."""
    return commands.assign_taxa(_hits(spark, sf), _TOP5, _mapping(spark, sf), _lines(spark, sf), "first", "organism").select("label", "read", "value")


@query(_TREE.rstrip().replace("WITH RECURSIVE", "WITH RECURSIVE " + _ORGS + ", ", 1) + nearest_sql("order") + "SELECT f.label, f.read, coalesce(near.near, f.value) AS value FROM f LEFT JOIN near ON near.taxid = f.value")
def w_assign_taxa_rank(spark, sf):
    """The same, at the ancestor nearest to the order."""
    return commands.assign_taxa(_hits(spark, sf), _TOP5, _mapping(spark, sf), cut(_lines(spark, sf), "lineages"), "first", "organism", "order").select("label", "read", "value")


@query(_TREE.rstrip().replace("WITH RECURSIVE", "WITH RECURSIVE " + _ORGS + ", ", 1) + nearest_sql("phylum") + "SELECT f.label, coalesce(near.near, f.value) AS value, count(*) AS n FROM f LEFT JOIN near ON near.taxid = f.value GROUP BY ALL")
def w_count_taxa(spark, sf):
    """Reads of each phylum, or what is nearest to one."""
    return commands.count_taxa(_hits(spark, sf), _TOP5, _mapping(spark, sf), cut(_lines(spark, sf), "lineages"), ["phylum"], "first", "organism")["phylum"].select("label", "value", "n")


def _gene_links(spark, sf) -> DataFrame:
    """Hit ids to kinds of protein: the second word of their descriptions."""
    kind = F.split_part(F.coalesce("hit_desc", F.lit("")), F.lit(" "), F.lit(2))
    return load(spark, sf, "hits").select(F.col("hit").alias("key"), kind.alias("value")).where("key is not null and value <> ''").distinct()


_GENES = "gl AS (SELECT DISTINCT hit AS key, split_part(coalesce(hit_desc, ''), ' ', 2) AS value FROM hits WHERE hit IS NOT NULL AND split_part(coalesce(hit_desc, ''), ' ', 2) <> ''), lv AS (SELECT DISTINCT value, substr(value, 1, 1) AS level_value FROM gl) "


def _letters(links: DataFrame) -> DataFrame:
    return links.select("value", F.substring("value", 1, 1).alias("level_value")).distinct()


@query(f"""WITH {_GENES}, b AS (SELECT label, read, hit FROM hits), a AS (SELECT DISTINCT b.label, b.read, gl.value AS gene FROM b LEFT JOIN gl ON gl.key = b.hit)
SELECT a.label, a.read, a.gene, coalesce(lv.level_value, a.gene) AS letter FROM a LEFT JOIN lv ON lv.value = a.gene""")
def w_assign_paths(spark, sf):
    """Every kind of protein of a read's hits, with the level above it."""
    links = cut(_gene_links(spark, sf), "links")
    return commands.assign_paths(_hits(spark, sf), FilterParams(), links, {"gene": None, "letter": _letters(links)}, "all").select("label", "read", "gene", "letter")


@query(f"""WITH {_GENES}, a AS (SELECT DISTINCT h.label, h.read, gl.value AS value FROM hits h LEFT JOIN gl ON gl.key = h.hit), n AS (SELECT label, value, count(*) AS n FROM a GROUP BY ALL)
SELECT n.label, coalesce(lv.level_value, n.value) AS value, CAST(sum(n.n) AS BIGINT) AS n FROM n LEFT JOIN lv USING (value) GROUP BY 1, 2""")
def w_count_paths(spark, sf):
    """Reads of each level, all kinds of a read counted."""
    links = cut(_gene_links(spark, sf), "links")
    return commands.count_paths(_hits(spark, sf), FilterParams(), links, {"letter": _letters(links)}, "all")["letter"].select("label", "value", "n")


@query(f"""WITH {_V}, k AS (SELECT CAST(count(*) AS DOUBLE) AS reads FROM (SELECT DISTINCT label, read FROM v)), n AS (SELECT value, count(*) AS n FROM v GROUP BY value),
f AS (SELECT CASE WHEN n < 0.005 * reads THEN 'Other' ELSE value END AS value, n FROM n, k UNION ALL SELECT 'Other', 0)
SELECT value, CAST(sum(n) AS DOUBLE) AS n FROM f GROUP BY value UNION ALL SELECT 'Total', reads FROM k""")
def w_count_hits(spark, sf):
    """Values of an assignment table, those of less than 0.5 % as Other, with a total."""
    return commands.count_hits(_values(spark, sf), cutoff=0.005, total=True)


_NEW = "x AS (SELECT hit_row, label || '/' || read AS read, qstart, qend, least(qstart, qend) AS s, greatest(qstart, qend) AS e, hit_desc LIKE 'ribosome%' AS rna FROM hits WHERE qstart IS NOT NULL AND qend IS NOT NULL)"


@query(f"""WITH {_NEW}, far AS (SELECT x.read, x.e AS at, max(r.e) AS reach FROM (SELECT DISTINCT read, e FROM x WHERE NOT coalesce(rna, false)) x JOIN (SELECT read, s, max(e) AS e FROM x WHERE rna GROUP BY ALL) r ON r.read = x.read AND r.s < x.e GROUP BY ALL),
k AS (SELECT x.* FROM x LEFT JOIN far ON far.read = x.read AND far.at = x.e WHERE NOT coalesce(rna, false) AND NOT coalesce(reach > s, false) UNION ALL SELECT * FROM x WHERE rna)
SELECT read, s, e, count(*) AS n, min(number) AS first, max(number) AS last FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY s, e) AS number FROM k) GROUP BY ALL""")
def w_merge_annotations(spark, sf):
    """Regions that overlap no RNA region, with these, numbered along each read; equal ones together, as their order is
    open."""
    x = _hits(spark, sf).where("qstart is not null and qend is not null").select(F.concat_ws("/", "label", "read").alias("read"), "hit", "qstart", "qend", F.coalesce(F.col("hit_desc").startswith("ribosome"), F.lit(False)).alias("rna"))
    got = commands.merge_annotations(x.where("not rna").drop("rna"), x.where("rna").drop("rna"))
    return got.groupBy("read", F.least("qstart", "qend").alias("s"), F.greatest("qstart", "qend").alias("e")).agg(F.count("*").alias("n"), F.min("number").cast("long").alias("first"), F.max("number").cast("long").alias("last"))


@query("""WITH c AS (SELECT label || '/' || read AS contig, max(greatest(qstart, qend)) AS length FROM hits GROUP BY 1), k AS (SELECT * FROM c WHERE length >= 100),
d AS (SELECT label || '/' || read AS contig, round(avg(mlen), 6) AS mean, count(*) AS reads FROM hits GROUP BY 1), r AS (SELECT length, CAST(sum(sum(length)) OVER (ORDER BY length DESC) AS BIGINT) AS cumulative FROM k GROUP BY length)
SELECT contig, k.length, d.reads, coalesce(d.mean, 0) AS mean, r.cumulative FROM k LEFT JOIN d USING (contig) JOIN r USING (length)""")
def w_contig_table(spark, sf):
    """Reads as contigs as long as their hits reach: reads, depth and bases cumulated by length."""
    h = _hits(spark, sf).withColumn("contig", F.concat_ws("/", "label", "read"))
    contigs = h.groupBy("contig").agg(F.max(F.greatest("qstart", "qend")).alias("length"))
    n = h.groupBy("contig").agg(F.count("*").alias("reads"))
    got = assembly.contig_table(contigs, n, h.select("contig", F.col("mlen").alias("depth")), 100)
    return got.select("contig", "length", "reads", F.round("mean", 6).alias("mean"), "cumulative")


_APART = "len(list_filter(a, lambda r: NOT (b[1].{s} >= r.{e} OR b[1].{e} <= r.{s}))) = 0"
_CHOOSE = "list_reduce(list_transform({l}, lambda x: [x]), lambda a, b: CASE WHEN " + _APART + " THEN list_concat(a, b) ELSE a END)"


@query(f"""WITH l AS (SELECT label, read, hit, list({{'hs': hstart, 'he': hend, 'qs': least(qstart, qend), 'qe': greatest(qstart, qend), 'm': mlen, 'sc': score, 'p': pctid}} ORDER BY hit_row) AS rows FROM hits
  WHERE qstart IS NOT NULL AND qend IS NOT NULL AND hstart IS NOT NULL AND hend IS NOT NULL GROUP BY label, read, hit),
a AS (SELECT label, read, hit, {_CHOOSE.format(l="rows", s="hs", e="he")} AS rows FROM l), b AS (SELECT label, read, hit, {_CHOOSE.format(l="rows", s="qs", e="qe")} AS rows FROM a), u AS (SELECT label, read, hit, unnest(rows) AS r FROM b)
SELECT label, read, hit, CAST(count(*) AS INT) AS n, CAST(sum(coalesce(r.m, 0)) AS BIGINT) AS mlen, round(sum(r.sc), 6) AS score, round(sum(r.p * r.m) FILTER (WHERE r.m <> 0) / sum(r.m) FILTER (WHERE r.m <> 0 AND r.p IS NOT NULL), 6) AS pctid,
min(r.qs) AS qstart, max(r.qe) AS qend, min(least(r.hs, r.he)) AS hstart, max(greatest(r.hs, r.he)) AS hend FROM u GROUP BY label, read, hit""")
def m_merge_hsps(spark, sf):
    from hitweave.operators.intervals import merge_hsps

    return merge_hsps(_hits(spark, sf)).withColumns({"score": F.round("score", 6), "pctid": F.round("pctid", 6)})


@query("""WITH l AS (SELECT source, list({'o': doc_id, 's': CAST(coalesce(n_chars, 0) AS DOUBLE), 'at': 0, 't': CAST(coalesce(n_chars, 0) AS DOUBLE)} ORDER BY doc_id) AS rows FROM documents GROUP BY source),
r AS (SELECT source, list_reduce(list_transform(rows, lambda x: [x]), lambda a, b: list_append(a, CASE WHEN a[-1].t > 0 AND a[-1].t + b[1].s > 100000 THEN {'o': b[1].o, 's': b[1].s, 'at': a[-1].at + 1, 't': b[1].s} ELSE {'o': b[1].o, 's': b[1].s, 'at': a[-1].at, 't': a[-1].t + b[1].s} END)) AS rows FROM l)
SELECT source, u.o AS doc_id, CAST(u.at AS INT) AS fragment FROM (SELECT source, unnest(rows) AS u FROM r)""")
def s_fragment_by_size(spark, sf):
    return sequences.fragments_by_size(load(spark, sf, "documents"), 100_000, "source", "doc_id", F.col("n_chars"))


# joins of dimensions -------------------------------------------------------------------------------------------------

@query(f"WITH {_V}, {_LINKS}, l AS (SELECT DISTINCT read, value FROM v WHERE value IS NOT NULL), p AS (SELECT l.value AS value1, coalesce(lk.value, 'None') AS value2, l.read FROM l JOIN lk ON lk.key = l.value) SELECT value1, value2, count(DISTINCT read) AS n FROM p GROUP BY ALL")
def x_crosstab_inner(spark, sf):
    """Pairs that two translations give to the same read, only of reads that both know."""
    v = _values(spark, sf).where("value is not null").select("read", "value").distinct()
    second = v.join(_links(spark, sf).select(F.col("key").alias("value"), F.col("value").alias("to")), "value").select("read", F.col("value").alias("of"), F.col("to").alias("value"))
    return counts.crosstab_inner(v, second, "of")


@query(_LINES_SQL + """, o AS (SELECT DISTINCT value FROM t WHERE value IS NOT NULL), k AS (SELECT taxid FROM walk)
SELECT o.value AS taxid, CASE WHEN k.taxid IS NULL THEN 1 ELSE o.value END AS mended FROM o LEFT JOIN k ON k.taxid = o.value""")
def g_mend_taxids(spark, sf):
    """Taxids that the tree doesn't hold, or only on a cycle, under the root."""
    return taxonomy.mend_taxids(_taxa(spark, sf).select(F.col("value").alias("taxid")).where("taxid is not null").distinct(), _lines(spark, sf), 1)


@query("""WITH b AS (SELECT CASE WHEN score IS NULL THEN NULL WHEN score < 50 THEN 0 WHEN score < 100 THEN 1 WHEN score < 200 THEN 2 ELSE 3 END AS bin, label FROM hits) SELECT label, CAST(bin AS INT) AS bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL""")
def a_bin_hits(spark, sf):
    """Hits of each sample in ranges of the score."""
    return counts.bin_hits(_hits(spark, sf), "score", [50.0, 100.0, 200.0])


@query("""WITH x AS (SELECT hit AS id, least(hstart, hend) AS s, greatest(hstart, hend) AS e FROM hits WHERE hit IS NOT NULL AND hstart IS NOT NULL AND hend IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
SELECT id, max(e) AS length, CAST(sum(greatest(e - greatest(coalesce(before, 0), s - 1), 0)) AS BIGINT) AS covered FROM y GROUP BY id""")
def a_reference_coverage(spark, sf):
    """Bases of each reference that any hit covers."""
    x = _hits(spark, sf).where("hit is not null").select(F.col("hit").alias("id"), F.col("hstart").alias("s"), F.col("hend").alias("e"))
    return assembly.reference_coverage(x, x.where("s is not null and e is not null").groupBy("id").agg(F.max(F.greatest("s", "e")).alias("length"))).select("id", "length", "covered")


@query("""WITH b AS (SELECT label, read, hit, hit_row, score FROM hits), k AS (SELECT label, read FROM b GROUP BY ALL HAVING count(DISTINCT coalesce(hit, chr(0))) = 1) SELECT max(hit_row) AS hit_row FROM b SEMI JOIN k USING (label, read) GROUP BY b.label, b.read""")
def x_clear_last(spark, sf):
    """The last hit line of the reads that have but one hit."""
    return tophit.clear_rows(_hits(spark, sf), "hit").select("hit_row")


@query("WITH x AS (SELECT hit_row, label || '_' || read AS id FROM hits) SELECT hit_row, CASE WHEN contains(id, '_') THEN left(id, length(id) - position('_' IN reverse(id))) ELSE id END AS name, CASE WHEN contains(id, '_') THEN right(id, position('_' IN reverse(id)) - 1) END AS tag FROM x")
def p_split_tag(spark, sf):
    """Ids in two parts around their last underscore."""
    name, tag = translate.read_and_sample(F.concat_ws("_", "label", "read"))
    return _hits(spark, sf).select("hit_row", name.alias("name"), tag.alias("tag"))


_NAMED_UP = """, sn AS (SELECT taxid, min(name) AS name FROM taxon_names WHERE name_class = 'scientific name' GROUP BY taxid), u AS (SELECT w.taxid, list(coalesce(sn.name, CAST(w.a AS VARCHAR)) ORDER BY i) AS l FROM (SELECT taxid, unnest(above) AS a, unnest(range(1, depth + 1)) AS i FROM walk) w LEFT JOIN sn ON sn.taxid = w.a GROUP BY w.taxid)"""


@query(_TREE + _NAMED_UP + """, p AS (SELECT DISTINCT 'root;' || array_to_string(l[1:d], ';') AS path, CASE WHEN d > 1 THEN 'root;' || array_to_string(l[1:d - 1], ';') ELSE 'root' END AS up FROM (SELECT l, unnest(range(1, len(l) + 1)) AS d FROM u) UNION ALL SELECT 'root', NULL),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY path) AS INT) AS id FROM p) SELECT n.id AS taxid, q.id AS parent, n.path FROM n LEFT JOIN n q ON n.up = q.path""")
def g_tree_of_lineages(spark, sf):
    """The tree that the lineages of all nodes span under a root."""
    step = lambda x: F.struct(F.coalesce(x["name"], x["taxid"].cast("string")).alias("name"), x["rank"].alias("rank"))
    lines = cut(_lines(spark, sf), "lineages").select(F.col("taxid").alias("acc"), F.transform("lineage", step).alias("l"))
    return dimensions.tree_of_lineages(lines, "acc", "l")[0].select("taxid", "parent", "path")


@query(_TREE + """, k AS (SELECT DISTINCT regexp_replace(lower(n), '[\\s.]', '', 'g') AS key, taxid FROM (SELECT name AS n, taxid FROM taxon_names UNION ALL SELECT unique_name, taxid FROM taxon_names) WHERE n IS NOT NULL),
d AS (SELECT key, k.taxid, w.above FROM k JOIN walk w USING (taxid) WHERE key <> ''), u AS (SELECT key, unnest(above) AS anc, unnest(range(1, len(above) + 1)) AS depth FROM d), s AS (SELECT key, anc, depth, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT key, count(*) AS total FROM d GROUP BY key)
SELECT key, arg_max(anc, depth) AS taxid FROM s JOIN t USING (key) WHERE n = total GROUP BY key""")
def g_name_map(spark, sf):
    """Names with their taxids, those of several with the lowest common ancestor."""
    return dimensions.name_map(load(spark, sf, "taxon_names"), cut(_lines(spark, sf), "lineages"))


@query("SELECT label || '/' || read AS read, CASE WHEN hstart > hend THEN qend ELSE qstart END AS start, CASE WHEN hstart > hend THEN qstart ELSE qend END AS stop FROM hits WHERE abs(qstart - qend) + 1 >= 100")
def s_hit_regions(spark, sf):
    """Regions of hits of 100 bases or more, turned where the hit lies backwards."""
    return dimensions.hit_regions(_hits(spark, sf).withColumn("read", F.concat_ws("/", "label", "read")), 100).select("read", "start", "stop")


@query("WITH l AS (SELECT taxid, arg_max(db, node_row) AS db FROM taxnodes WHERE taxid IS NOT NULL GROUP BY taxid), a AS (SELECT taxid FROM l WHERE db = 'namedtree'), b AS (SELECT DISTINCT taxid FROM taxon_names WHERE taxid IS NOT NULL) SELECT taxid, CASE WHEN a.taxid IS NULL THEN 'second' WHEN b.taxid IS NULL THEN 'first' ELSE 'both' END AS side FROM a FULL JOIN b USING (taxid)")
def g_compared(spark, sf):
    """Taxids of the named tree and of the names: which side has them."""
    last = load(spark, sf, "taxnodes").where("taxid is not null").groupBy("taxid").agg(F.max_by("db", "node_row").alias("db"))
    return taxonomy.compared(last.where("db = 'namedtree'"), load(spark, sf, "taxon_names").where("taxid is not null"))


_GIVEN = f"""{_V}, {_NAMES}, t AS (SELECT nm.value AS taxid, CAST(count(*) AS DOUBLE) AS n FROM v JOIN nm ON v.value = nm.key GROUP BY 1)"""


@query(_TREE.rstrip().replace("WITH RECURSIVE", f"WITH RECURSIVE {_GIVEN}, ", 1) + """, o AS (SELECT t.taxid, t.n, w.above FROM t JOIN walk w USING (taxid)), s AS (SELECT a AS taxid, sum(n) AS s FROM (SELECT unnest(above) AS a, n FROM o) GROUP BY a),
b AS (SELECT s.taxid, s.s, w.above[-2] AS up, w.above, coalesce(o.n, 0) AS own FROM s JOIN walk w USING (taxid) LEFT JOIN o USING (taxid)), k AS (SELECT up, sum(s) AS below FROM b WHERE up IS NOT NULL GROUP BY up),
r AS (SELECT b.taxid, b.own, coalesce(b.s / k.below, 1.0) AS rate FROM b LEFT JOIN k ON b.up = k.up), e AS (SELECT b.taxid, b.above FROM b WHERE b.taxid NOT IN (SELECT up FROM k)),
p AS (SELECT e.taxid, list({'own': r.own, 'rate': r.rate} ORDER BY i) AS l FROM (SELECT taxid, unnest(above) AS a, unnest(range(1, len(above) + 1)) AS i FROM e) e JOIN r ON r.taxid = e.a GROUP BY e.taxid)
SELECT taxid, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(l, lambda x: x.own)), lambda a, b, i: a * l[i - 1].rate + b), 6) AS n FROM p""")
def x_redistribute(spark, sf):
    """Counts of inner nodes handed down the tree."""
    got = taxonomy.redistribute(counts.count_values(_taxa(spark, sf).where("value is not null").withColumn("all_", F.lit(1)), by=("all_",)).select(F.col("value").alias("taxid"), "n"), cut(_lines(spark, sf), "lineages"))
    return got.select("taxid", F.round("n", 6).alias("n"))


_BY_FILE = """WITH c AS (SELECT label, read, hit AS org, max(hit_row) AS pos FROM hits GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY label, read) AS k FROM c), n AS (SELECT label, org, count(*) AS n FROM k WHERE k = 1 GROUP BY ALL) """


@query(_BY_FILE + "SELECT c.label, c.read, c.org FROM c LEFT JOIN n ON c.label = n.label AND c.org IS NOT DISTINCT FROM n.org QUALIFY row_number() OVER (PARTITION BY c.label, c.read ORDER BY coalesce(n, 0.5) DESC, c.org NULLS FIRST) = 1")
def x_tophit_by_file(spark, sf):
    """Top hits by the abundance in their own sample."""
    return tophit.top_hit(_hits(spark, sf), "hit", by=("label",)).select("label", "read", "org")


@query(_BY_FILE + """, g AS (SELECT label, read, list(org ORDER BY org) FILTER (WHERE org IS NOT NULL) AS orgs, max(pos) AS pos FROM c GROUP BY label, read),
dbt AS (SELECT *, row_number() OVER (PARTITION BY label, orgs ORDER BY pos DESC) AS rn FROM g WHERE len(orgs) > 1), st AS (SELECT label, orgs, count(*) AS reads FROM dbt GROUP BY ALL),
e AS (SELECT label, orgs, reads, unnest(orgs) AS org, unnest(range(0, len(orgs))) AS i FROM st), q AS (SELECT e.*, coalesce(n, 0.5) AS n FROM e LEFT JOIN n USING (label, org)),
x AS (SELECT *, n * reads / sum(n) OVER (PARTITION BY label, orgs) AS x FROM q), y AS (SELECT *, floor(x + 1e-12) AS whole FROM x),
z AS (SELECT *, sum(whole) OVER (PARTITION BY label, orgs ORDER BY x DESC, i ROWS UNBOUNDED PRECEDING) AS hi, sum(whole) OVER (PARTITION BY label, orgs) AS dealt, row_number() OVER (PARTITION BY label, orgs ORDER BY round(x - whole, 9) DESC, i DESC) AS k FROM y)
SELECT dbt.label, read, z.org FROM dbt JOIN z ON dbt.label = z.label AND dbt.orgs = z.orgs AND (rn > hi - whole AND rn <= hi OR rn = dealt + k) UNION ALL SELECT label, read, orgs[1] FROM g WHERE coalesce(len(orgs), 0) <= 1""")
def x_tophit_prop_by_file(spark, sf):
    """Proportional top hits, each sample by itself."""
    return tophit.top_hit_proportional(_hits(spark, sf), "hit", by=("label",))


@query("SELECT label, hit AS value, count(*) AS n FROM (SELECT *, greatest(max(score) OVER (PARTITION BY label, read), 0) AS best FROM hits) WHERE score >= best GROUP BY ALL")
def w_count_best(spark, sf):
    """Best hits of each read counted by sample, in one call."""
    return counts.count_values(commands.values_of(commands.filter_hits(_hits(spark, sf), FilterParams(top_pct=0))), "all")


@query()
def x_collapse(spark, sf):
    """Counts gathered towards the root until a node holds 20."""
    n = counts.count_values(_taxa(spark, sf).where("value is not null").withColumn("all_", F.lit(1)), by=("all_",)).select(F.col("value").alias("taxid"), "n")
    return taxonomy.collapse(n, cut(_lines(spark, sf), "lineages"), 20)
