"""Building dimensions: trees from lineages with ranks, maps of names and of accessions, joins of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.places import running
from hitweave.operators.reduce import lca
from hitweave.operators.taxonomy import numbered, repaired_links
from hitweave.operators.translate import name_cascade, simplify

#: Ranks by the letter before a name, and by place.
RANK_LETTERS = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}
PLACE_RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
BAR_RANKS = ("domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")

#: Names of a marker gene's list without blanks, what they are called in the taxonomy, and simplified names
#: that are passed over.
MARKER_NAMES = {
    "RoseobactercladeNAC11-7lineage": "uncultured Roseobacter NAC11-7",
    "OCS116clade": "uncultured OCS116 cluster bacterium",
    "OrderIIIIncertaeSedis": "Bacteroidetes Order III. Incertae sedis",
    "mitochondria": "Eukaryota",
    "Mitochondria": "Eukaryota",
    "chloroplast": "Eukaryota",
    "Chloroplast": "Eukaryota",
    "Cosenzaeamyxofaciens": "Proteus myxofaciens",
    "Escherichiablattae": "Escherichia blattae",
    "Psychrobacillusinsolitus": "Bacillus insolitus",
    "Psychrobacilluspsychrotolerans": "Bacillus psychrotolerans",
    "Psychrobacilluspsychrodurans": "Bacillus psychrodurans",
    "Kandleriavitulina": "Lactobacillus vitulinus",
    "Eggerthiacatenaformis": "Lactobacillus catenaformis",
}
MARKER_IGNORED = ("marinemetagenome", "uncultured", "incertaesedis")

_STEP = "array<struct<name:string,rank:string>>"


def lettered(lineage: Column) -> Column:
    """Names and ranks of a lineage like d__Aa;p__Bb, from the root down. An unknown letter is an error."""
    ranks = F.create_map(*[F.lit(x) for kv in RANK_LETTERS.items() for x in kv])

    def step(part: Column) -> Column:
        letter = F.regexp_extract(part, r"^_?(.*?)__", 1)
        wrong = F.raise_error(F.concat(F.lit("no rank in lineage: "), lineage)).cast("string")
        return F.struct(F.regexp_extract(part, r"__(.*)$", 1).alias("name"), F.coalesce(ranks[letter], wrong).alias("rank"))

    return F.transform(F.split(lineage, ";"), step)


def placed(lineage: Column) -> Column:
    """Names and ranks of a lineage of seven names; those that begin with Euk have one more, unranked, behind the first."""
    parts = F.split(lineage, ";")
    plain, extra = F.array(*[F.lit(r) for r in PLACE_RANKS]), F.array(F.lit(PLACE_RANKS[0]), F.lit(None).cast("string"), *[F.lit(r) for r in PLACE_RANKS[1:]])
    ranks = F.when(lineage.startswith("Euk"), extra).otherwise(plain)
    return F.transform(F.slice(parts, F.lit(1), F.least(F.size(parts), F.size(ranks))), lambda x, i: F.struct(x.alias("name"), F.get(ranks, i).alias("rank")))


def unranked(lineage: Column, sep: str = ";+") -> Column:
    return F.transform(F.filter(F.transform(F.split(lineage, sep), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("rank")))


def tree_of_lineages(rows: DataFrame, acc: str, lineage: str, ranks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (taxid, parent, rank, name, path) of the tree that lineages (arrays of name and rank) span under a root, and
    the map (acc, taxid) of where each ends.

    A node is a distinct path of names; of several ranks of a path the least holds. ids go by the order of paths, the root
    first. ranks: (path, rank), names joined by ';', for paths whose rank isn't in the lineage, which are nodes too."""
    x = rows.select(F.col(acc).alias("acc"), F.filter(F.col(lineage).cast(_STEP), lambda s: s["name"].isNotNull() & (s["name"] != "")).alias("l")).where("size(l) > 0")
    path = lambda l: F.concat_ws(";", F.lit("root"), F.array_join(F.transform(l, lambda s: s["name"]), ";"))
    spans = lambda d: d.select("l").distinct().select(F.explode(F.expr("transform(sequence(1, size(l)), n -> slice(l, 1, n))")).alias("p"))
    steps = spans(x).select(path(F.col("p")).alias("path"), F.element_at("p", -1)["name"].alias("name"), F.element_at("p", -1)["rank"].alias("rank"), F.when(F.size("p") > 1, path(F.slice("p", F.lit(1), F.size("p") - 1))).otherwise("root").alias("up"))
    if ranks is not None:
        named = ranks.select(unranked(F.col("path")).alias("l"), F.col("rank").alias("given")).where("size(l) > 0")
        more = spans(named).select(path(F.col("p")).alias("path"), F.element_at("p", -1)["name"].alias("name"), F.lit(None).cast("string").alias("rank"), F.when(F.size("p") > 1, path(F.slice("p", F.lit(1), F.size("p") - 1))).otherwise("root").alias("up"))
        given = named.groupBy(path(F.col("l")).alias("path")).agg(F.min("given").alias("given"))
        steps = steps.unionByName(more).join(given, "path", "left").withColumn("rank", F.coalesce("given", "rank")).drop("given")
    nodes = steps.groupBy("path").agg(F.min("name").alias("name"), F.min("rank").alias("rank"), F.min("up").alias("up"))
    root = rows.sparkSession.createDataFrame([("root", "root", None, None)], "path string, name string, rank string, up string")
    # the root sorts before all: paths begin with it
    ids = numbered(nodes.unionByName(root), "path").withColumn("taxid", F.col("n").cast("int")).drop("n")
    above = ids.select(F.col("path").alias("up"), F.col("taxid").alias("parent"))
    tree = ids.join(above, "up", "left").select("taxid", "parent", F.coalesce("rank", F.lit("no rank")).alias("rank"), "name", "path")
    ends = x.select("acc", path(F.col("l")).alias("path")).join(ids.select("path", "taxid"), "path").select("acc", "taxid")
    return tree, ends


def tree_with_ids(ranked: DataFrame, rows: DataFrame, acc: str, lineage: str) -> tuple[DataFrame, DataFrame]:
    """The tree of ranked (lineage, taxid, rank), with the nodes that other lineages (rows: acc and a text of names) add
    below, whose ids go on from the highest. Also the map (acc, taxid)."""
    named = ranked.select(F.trim(F.col("lineage")).alias("path"), "rank", F.col("taxid").alias("own"))
    tree, ends = tree_of_lineages(rows.select(F.col(acc).alias("acc"), unranked(F.col(lineage)).alias("l")), "acc", "l", named)
    own = named.select(F.concat_ws(";", F.lit("root"), F.array_join(F.transform(unranked(F.col("path")), lambda s: s["name"]), ";")).alias("path"), "own").groupBy("path").agg(F.min("own").alias("own"))
    x = tree.join(own, "path", "left")
    top = ranked.agg(F.coalesce(F.max("taxid"), F.lit(0)).alias("top"))  # one row
    new = running(x.where("own is null"), [], ["taxid"], F.lit(1), "k").crossJoin(F.broadcast(top)).select("taxid", (F.col("top") + F.col("k")).cast("int").alias("id"))
    ids = x.where("own is not null").select("taxid", F.col("own").cast("int").alias("id")).unionByName(new)
    up = ids.select(F.col("taxid").alias("parent"), F.col("id").alias("up"))
    nodes = x.join(ids, "taxid").join(up, "parent", "left").select(F.col("id").alias("taxid"), F.col("up").alias("parent"), "rank", "name", "path")
    return nodes, ends.join(ids, "taxid").select("acc", F.col("id").alias("taxid"))


def tree_by_rank_and_name(rows: DataFrame, acc: str, names: str, pos: str, ranks: tuple[str, ...] = BAR_RANKS, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (taxid, parent, rank, name) keyed by rank and name, of arrays of names of fixed ranks, and the map (acc,
    taxid). A node that comes under several parents stays under the first, in the order of pos; ids go by the order of
    ranks and names."""
    all_ranks = F.array(*[F.lit(r) for r in ranks])
    x = rows.select(F.col(acc).alias("acc"), F.slice(F.col(names), 1, len(ranks)).alias("l"), F.col(pos).alias("pos"))
    steps = x.select("acc", "pos", "l", F.posexplode("l").alias("i", "name"))
    up = F.when(F.col("i") > 0, F.struct((F.col("i") - 1).alias("i"), F.get("l", F.col("i") - 1).alias("name")))
    nodes = steps.groupBy("i", "name").agg(F.min_by(up, "pos").alias("up"))
    ids = running(nodes, [], ["i", "name"], F.lit(1), "n").withColumn("taxid", (F.col("n") + (first_id - 1)).cast("int"))
    above = ids.select(F.col("i").alias("ui"), F.col("name").alias("un"), F.col("taxid").alias("parent"))
    tree = ids.join(above, (F.col("up.i") == F.col("ui")) & (F.col("up.name") == F.col("un")), "left").select("taxid", "parent", F.get(all_ranks, F.col("i")).alias("rank"), "name")
    last = x.where("size(l) > 0").select("acc", (F.size("l") - 1).alias("i"), F.element_at("l", -1).alias("name")).join(ids, ["i", "name"]).select("acc", "taxid")
    return tree, last


def name_map(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, taxid): names (taxid, name, unique_name) in small letters without blanks and dots, each with its taxid; one of
    several taxids stands for their lowest common ancestor. A name has its unique name as a second one."""
    both = names.select("taxid", F.explode(F.array("name", "unique_name")).alias("name")).select(simplify(F.col("name")).alias("key"), "taxid").where("key <> ''").distinct()
    got = lca(both.select("key", F.col("taxid").alias("value")), lines, ("key",))
    return got.select("key", F.col("value").alias("taxid"))


def preferred_names(names: DataFrame) -> DataFrame:
    """(taxid, name) of the scientific names, the unique name where there is one; of several the least."""
    return names.where("name_class = 'scientific name'").groupBy("taxid").agg(F.min(F.coalesce(F.nullif(F.trim("unique_name"), F.lit("")), "name")).alias("name"))


def marker_names(rows: DataFrame, column: str, real: DataFrame, names: DataFrame, translations: dict[str, str] = MARKER_NAMES, ignored: tuple[str, ...] = MARKER_IGNORED, out: str = "taxid") -> DataFrame:
    """rows with the taxid of a name of a marker gene's list: translated by a table, null if ignored or uncultured, then by
    the scientific names (name, taxid), then by all names in the steps of name_cascade() without beginnings.

    Keys of translations have no blanks; ignored names are simplified ones."""
    bare = F.regexp_replace(F.col(column), r"\s", "")
    said = F.col(column)
    for was, now in translations.items():
        said = F.when(bare == was, F.lit(now)).otherwise(said)
    x = rows.withColumn("said_", said).withColumn("key_", simplify(F.col("said_")))
    passed = F.col("key_").isin(*ignored) if ignored else F.lit(False)
    passed = F.coalesce(passed | (F.length("key_") > 10) & F.col("key_").startswith("uncultured"), F.lit(False))
    exact = real.select(simplify(F.col("name")).alias("real_key"), F.col("taxid").alias("real_taxid")).groupBy("real_key").agg(F.min("real_taxid").alias("real_taxid"))
    y = x.withColumn("said_", F.when(~passed, F.col("said_"))).join(exact, F.col("key_") == F.col("real_key"), "left")
    got = name_cascade(y, "said_", names, out, beginnings=False)
    return got.withColumn(out, F.when(F.col("said_").isNotNull(), F.coalesce("real_taxid", out))).select(*rows.columns, out)


def organism_of(column: Column) -> Column:
    """An id without the number behind its last underscore."""
    return F.regexp_replace(column, r"_\d+$", "")


def contig_taxids(contigs: DataFrame, genes: DataFrame) -> DataFrame:
    """(contig, taxid): contigs get the taxid of the genes (gene, taxid) of their organism; without one they are left out."""
    of = genes.groupBy(organism_of(F.col("gene")).alias("org")).agg(F.max("taxid").alias("taxid"))
    return contigs.select("contig", organism_of(F.col("contig")).alias("org")).join(of, "org").select("contig", "taxid")


def annotated_headers(genes: DataFrame, lineages: DataFrame, functions: DataFrame) -> DataFrame:
    """genes (id, org, seq) with ``description``: id, lineage (org, lineage) and function (id, function), between tabs. Genes
    that lack either are left out."""
    x = genes.join(lineages.select("org", "lineage"), "org").join(functions.select("id", "function"), "id")
    return x.withColumn("description", F.concat_ws("\t", "id", "lineage", "function"))


def accession_taxids(catalog: DataFrame, lines: DataFrame, moved: DataFrame) -> DataFrame:
    """(acc, taxid) of a catalogue (acc, taxid), with taxids that the tree has: replaced ones (old, new) are followed."""
    return repaired_links(catalog.select("acc", "taxid"), lines, moved)


def contig_info(description: Column) -> Column:
    """What a contig's description tells of it, as attributes: length and coverage of one assembler, length of another."""
    a, cov = F.regexp_extract(description, r"length_(\d+)_cov_([0-9.]+)", 1), F.regexp_extract(description, r"length_(\d+)_cov_([0-9.]+)", 2)
    b = F.regexp_extract(description, r"\blen=(\d+)\b", 1)
    return F.when(a != "", F.concat(F.lit("contig_length="), a, F.lit(";contig_cov="), cov)).when(b != "", F.concat(F.lit("contig_length="), b)).otherwise("")


def hit_regions(hits: DataFrame, least: int = 0, annotation: bool = False) -> DataFrame:
    """(read, start, stop, annot) of hits of at least least bases; start > stop where the hit lies backwards: by the order
    of its ends on the reference, or in annotations (annotation) by the strand."""
    text = F.concat(F.lit("# "), "qstart", F.lit(" # "), "qend", F.lit(" # "), "strand", F.lit(" # "), F.coalesce("hit_desc", F.lit("")), F.lit(";evalue="), F.coalesce(F.col("evalue").cast("string"), F.lit(""))) if annotation else None
    if not annotation:
        place = F.concat("hit", F.lit(" ["), "hstart", F.lit(","), "hend", F.lit("] "))
        bits = F.floor("score").cast("string")
        text = F.concat(place, F.when(F.col("pctid").isNotNull(), F.concat(F.format_string("%.1f", F.col("pctid")), F.lit("% "), bits, F.lit(" bits"))).otherwise(F.concat(F.lit("score: "), bits)))
    back = F.col("strand") != "+" if annotation else F.col("hstart") > F.col("hend")
    x = hits.where(F.abs(F.col("qstart") - F.col("qend")) + 1 >= least)
    return x.select("read", F.when(back, F.col("qend")).otherwise(F.col("qstart")).alias("start"), F.when(back, F.col("qstart")).otherwise(F.col("qend")).alias("stop"), text.alias("annot"))


def unordered_pairs(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, a, b): pairs a < b of the distinct values of each group; pairs are the result, of as many as they are."""
    x = rows.where(F.col(column).isNotNull()).select(F.col(group).alias("g"), F.col(column).alias("v")).distinct()
    y = x.select(F.col("g").alias("h"), F.col("v").alias("b"))
    return x.join(y, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") < F.col("b"))).select(F.col("g").alias(group), F.col("v").alias("a"), "b")


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def verified(parts: DataFrame, count: str, expected: int) -> DataFrame:
    """parts, if their counts add up to what is expected; else the job fails."""
    total = F.coalesce(F.sum(count).over(Window.partitionBy()), F.lit(0))  # one row for each part
    wrong = F.raise_error(F.concat(F.lit(f"{expected} were expected, found "), total.cast("string"))).cast("boolean")
    return parts.withColumn("ok_", F.when(total == expected, F.lit(True)).otherwise(wrong)).where("ok_").drop("ok_")
