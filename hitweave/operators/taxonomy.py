"""Trees of ranked nodes: lineages, ancestors at ranks, membership, pruning, merging, building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.names import free_name
from hitweave.operators.folds import fold
from hitweave.operators.hierarchy import hierarchy
from hitweave.operators.places import running
from hitweave.schema import FAMILY_TAXIDS, RANKS, rank_index


def lineages(nodes: DataFrame, names: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """(taxid, rank, name, depth, lineage) of each node of nodes (taxid, parent, rank); lineage holds (taxid, rank, name,
    depth) from the root down. Nodes that never reach a root are left out. names: (taxid, name), the least name of a
    taxid holds. order: of several rows of a taxid the one with the highest value of this column holds."""
    paths = hierarchy(nodes, "taxid", "parent", order).where("path is not null").select(F.col("id").cast("int").alias("taxid"), "path")
    last = nodes.where("taxid is not null").groupBy("taxid").agg(F.max(F.struct(F.col(order) if order else F.lit(0), "parent", "rank")).alias("m")).select("taxid", "m.rank")
    if names is not None:
        last = last.join(names.groupBy("taxid").agg(F.min("name").alias("name")), "taxid", "left")
    else:
        last = last.withColumn("name", F.col("taxid").cast("string"))
    up = paths.select("taxid", F.posexplode(F.split("path", "/")).alias("depth", "a")).withColumn("a", F.col("a").cast("int"))
    about = last.select(F.col("taxid").alias("a"), "rank", "name")
    item = F.struct("depth", F.col("a").alias("taxid"), "rank", "name")
    line = up.join(about, "a").groupBy("taxid").agg(F.sort_array(F.collect_list(item)).alias("lineage"))
    own = F.element_at("lineage", -1)
    return line.select("taxid", own["rank"].alias("rank"), own["name"].alias("name"), own["depth"].alias("depth"), "lineage")


def ancestor_at_rank(lineage: Column, rank: str) -> Column:
    """Taxid of the ancestor (or node) of exactly this rank, the one next to the node; null if there is none."""
    same = F.filter(F.reverse(lineage), lambda x: rank_index(x["rank"]) == F.lit(_rank(rank)))
    return F.try_element_at(same, F.lit(1))["taxid"]


def _rank(rank: str) -> int:
    name = "superkingdom" if rank == "domain" else rank
    if name not in RANKS:
        raise ValueError(f"{rank} is no rank")
    return RANKS.index(name)


def ancestor_closest_to_rank(lineage: Column, rank: str, use_child: bool = True) -> Column:
    """Taxid of the ancestor nearest to a rank.

    Of the lineage from the node up, the first ranked member at or above the rank decides: it is taken if its rank is the
    wanted one. If no ranked member lies below it, the member just below it is taken, or without use_child the node
    itself. Else the place between the two ranked members is interpolated by their ranks. No member at or above: the
    node. Some unranked taxa count as families (FAMILY_TAXIDS)."""
    def place(x: Column) -> Column:
        as_family = F.when(x["taxid"].isin(*FAMILY_TAXIDS), F.lit(RANKS.index("family")))
        return F.coalesce(rank_index(x["rank"]), as_family, F.lit(-1))

    up = F.transform(F.reverse(lineage), lambda x: F.struct(x["taxid"].alias("t"), place(x).alias("r")))
    target = F.lit(_rank(rank))
    at = F.array_position(F.transform(up, lambda x: x["r"] >= target), True).cast("int")  # from 1, 0 for none
    below = F.slice(up, F.lit(1), F.greatest(at - 1, F.lit(0)))
    j = F.coalesce(F.array_max(F.transform(below, lambda x, i: F.when(x["r"] >= 0, i))), F.lit(-1))  # from 0
    i = at - 1
    ri, rj = F.try_element_at(up, at)["r"], F.try_element_at(up, j + 1)["r"]
    between = F.floor(i - (ri - target) / (ri - rj) * (i - j)).cast("int")
    own = F.try_element_at(up, F.lit(1))["t"]
    child = F.when(i > 0, F.try_element_at(up, i)["t"]).otherwise(own) if use_child else own
    return F.when(at == 0, own).when(ri == target, F.try_element_at(up, at)["t"]).when(j < 0, child).otherwise(F.try_element_at(up, between + 1)["t"])


def lineage_text(lineage: Column, sep: str = ";") -> Column:
    """Names from the root down."""
    return F.array_join(F.transform(lineage, lambda x: F.coalesce(x["name"], x["taxid"].cast("string"))), sep)


def is_generic(name: Column) -> Column:
    """Names that say nothing of the organism."""
    return F.lower(name).rlike("^(uncultured|environmental|endosymbiont)|metagenome")


def readable_name(lineage: Column) -> Column:
    """A node's name; a generic one is followed by that of its parent in brackets, and so on up; the id if unnamed."""
    up = F.reverse(lineage)
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("close"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        name = F.coalesce(x["name"], x["taxid"].cast("string"))
        more = F.struct(F.concat(acc["text"], F.when(acc["text"] == "", name).otherwise(F.concat(F.lit(" ("), name))).alias("text"), F.when(acc["text"] == "", "").otherwise(F.concat(acc["close"], F.lit(")"))).alias("close"), (~is_generic(name)).alias("done"))
        return F.when(acc["done"], acc).otherwise(more)

    return F.aggregate(up, start, step, lambda a: F.concat(a["text"], a["close"]))


def members(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Taxids in the subtrees of targets (taxid), with themselves: (taxid, target). A node in several has several rows."""
    up = lines.select("taxid", F.explode("lineage").alias("a")).select("taxid", F.col("a.taxid").alias("target"))
    return up.join(targets.select(F.col("taxid").alias("target")).distinct(), "target", "left_semi")


def prune(nodes: DataFrame, lines: DataFrame, keep: DataFrame) -> DataFrame:
    """The nodes of keep (taxid) and all their ancestors."""
    kept = lines.join(keep.select("taxid").distinct(), "taxid", "left_semi").select(F.explode("lineage.taxid").alias("taxid")).distinct()
    return nodes.join(kept, "taxid", "left_semi")


def mend_taxids(taxa: DataFrame, lines: DataFrame, root: int) -> DataFrame:
    """taxa (taxid, ...) with ``mended``: the taxid if the tree has it, else root. A null taxid is mended too."""
    known = lines.select(F.col("taxid").alias("known_taxid")).distinct()
    x = taxa.join(known, F.col("taxid") == F.col("known_taxid"), "left")
    return x.withColumn("mended", F.coalesce("known_taxid", F.lit(root))).drop("known_taxid")


def repaired_links(links: DataFrame, lines: DataFrame, moved: DataFrame) -> DataFrame:
    """links (key, taxid) with taxids that the tree has: an old one is replaced by its successor in moved (old, new), as
    often as it takes until one is known; links of which none is known are dropped."""
    known = lines.select(F.col("taxid").alias("known_taxid")).distinct()
    # successors form chains: those of a chain are the nodes below its end
    ends = hierarchy(moved.select(F.col("old").alias("taxid"), F.col("new").alias("parent")), "taxid", "parent").where("path is not null")
    last = ends.select(F.col("id").cast("int").alias("old"), F.col("root").cast("int").alias("top")).join(moved.select(F.col("old").alias("top"), "new"), "top").select("old", "new")
    x = links.join(last, F.col("taxid") == F.col("old"), "left").withColumn("taxid", F.coalesce("new", "taxid")).select(*links.columns)
    return x.join(known, F.col("taxid") == F.col("known_taxid"), "left_semi")


def remap_ids(rows: DataFrame, column: str, mapped: DataFrame) -> DataFrame:
    """rows with the new ids of mapped (old, new) in a column; ids that it doesn't name stay."""
    old, new = free_name("old_id", rows.columns), free_name("new_id", rows.columns)
    m = mapped.select(F.col("old").alias(old), F.col("new").alias(new))
    return rows.join(m, F.col(column) == F.col(old), "left").withColumn(column, F.coalesce(new, column)).select(*rows.columns)


def taxids_of(lines: DataFrame) -> DataFrame:
    return lines.select("taxid").distinct()


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(taxid, side) of the taxids of two trees: first, second or both."""
    a, b = taxids_of(first).withColumn("in_first", F.lit(True)), taxids_of(second).withColumn("in_second", F.lit(True))
    side = F.when(F.col("in_first").isNull(), "second").when(F.col("in_second").isNull(), "first").otherwise("both")
    return a.join(b, "taxid", "full_outer").select("taxid", side.alias("side"))


def add_lineages(nodes: DataFrame, lineage_rows: DataFrame, column: str = "lineage") -> DataFrame:
    """nodes (taxid, parent, rank, name) with the nodes that lineages (arrays of names from the root down) need and the
    tree lacks; a lineage hangs from the deepest of its names that the tree has, by name, and new ids go on from the
    highest one. Names compare in small letters; of several nodes of a name the lowest id holds."""
    named = nodes.where("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("taxid").alias("at"))
    x = lineage_rows.select(F.filter(F.col(column), lambda y: F.trim(y) != "").alias("l")).where("size(l) > 0").distinct()
    x = x.withColumn("row", F.xxhash64("l"))
    steps = x.select("row", "l", F.posexplode("l").alias("i", "name")).join(named, F.lower("name") == F.col("key"), "left")
    anchor = steps.where("at is not null").groupBy("row", "l").agg(F.max(F.struct("i", "at")).alias("a"))
    need = x.join(anchor, ["row", "l"], "left").select("l", F.coalesce(F.col("a.i") + 1, F.lit(0)).alias("from"), F.col("a.at").alias("at"))
    # a new node is told apart by where it hangs and the names between
    made = need.where("from < size(l)").select("at", F.explode(F.expr("transform(sequence(1, size(l) - from), n -> slice(l, from + 1, n))")).alias("path")).distinct()
    made = made.withColumn("key", F.concat_ws(";", F.coalesce(F.col("at").cast("string"), F.lit("")), F.lower(F.array_join("path", ";"))))
    made = made.groupBy("key").agg(F.min("at").alias("at"), F.min("path").alias("path"))
    top = nodes.agg(F.coalesce(F.max("taxid"), F.lit(0)).alias("top"))  # one row
    ids = numbered(made, "key").crossJoin(F.broadcast(top)).withColumn("taxid", (F.col("top") + F.col("n")).cast("int"))
    up = ids.select(F.col("key").alias("up_key"), F.col("taxid").alias("up"))
    above = F.concat_ws(";", F.coalesce(F.col("at").cast("string"), F.lit("")), F.lower(F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), ";")))
    new = ids.withColumn("above", F.when(F.size("path") > 1, above)).join(up, F.col("above") == F.col("up_key"), "left")
    new = new.select("taxid", F.coalesce("up", "at").cast("int").alias("parent"), F.lit("no rank").alias("rank"), F.element_at("path", -1).alias("name"))
    return nodes.select("taxid", "parent", "rank", "name").unionByName(new)


def merge_trees(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (taxid, parent, rank, name) of two trees as one: those of second get new ids above the highest of first, in
    the order of their old ones; its roots hang from nothing. Also the map (old, new)."""
    top = first.agg(F.coalesce(F.max("taxid"), F.lit(0)).alias("top"))  # one row
    mapped = numbered(second.select(F.col("taxid").alias("old")).where("old is not null").distinct(), "old").crossJoin(F.broadcast(top))
    mapped = mapped.select("old", (F.col("top") + F.col("n")).cast("int").alias("new"))
    x = second.join(mapped, F.col("taxid") == F.col("old")).drop("old").withColumnRenamed("new", "id")
    up = mapped.select(F.col("old").alias("parent"), F.col("new").alias("up"))
    moved = x.join(up, "parent", "left").select(F.col("id").alias("taxid"), F.col("up").alias("parent"), *[c for c in second.columns if c not in ("taxid", "parent")])
    return first.unionByName(moved), mapped


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with n, their place from 1 in the order of a unique column."""
    return running(rows, [], [column], F.lit(1), "n")


def build_tree(lineage_rows: DataFrame, column: str = "lineage", ranks: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes of the tree that lineages (arrays of names from the root down) span: (taxid, parent, rank, name, path). A
    node is a distinct path; ids go by the order of paths, from 1. Null and empty names end a lineage."""
    names = F.transform(F.col(column), lambda x: F.nullif(F.trim(x), F.lit("")))
    end = F.array_position(F.transform(names, lambda x: x.isNull()), True).cast("int")
    whole = F.when(end > 0, F.slice(names, F.lit(1), end - 1)).otherwise(names)
    x = lineage_rows.select(whole.alias("l")).where("size(l) > 0").distinct()
    nodes = x.select("l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("d")).select(F.slice("l", F.lit(1), F.col("d")).alias("p"), "d").distinct()
    nodes = nodes.withColumn("path", F.array_join("p", ";"))
    ids = numbered(nodes, "path")
    up = ids.select(F.col("path").alias("up_path"), F.col("n").alias("parent"))
    rank = F.coalesce(F.try_element_at(F.array(*[F.lit(r) for r in ranks]), F.col("d")), F.lit("no rank")) if ranks else F.lit("no rank")
    parent_path = F.array_join(F.slice("p", F.lit(1), F.col("d") - 1), ";")
    return ids.withColumn("up_path", parent_path).join(up, "up_path", "left").select(F.col("n").cast("int").alias("taxid"), F.col("parent").cast("int"), rank.alias("rank"), F.element_at("p", -1).alias("name"), "path")


def collapse(counts: DataFrame, lines: DataFrame, cutoff: float) -> DataFrame:
    """Counts (taxid, n) gathered towards the root until a node of a telling name holds cutoff or more: (taxid, n).

    From the deepest nodes up, a sum below the cutoff, or one at a generic name, moves on to the parent; a node that
    reaches the cutoff keeps all that is pending below it. A root keeps what arrives. Counted nodes and their ancestors
    are read in the falling order of their paths, in which every node follows all below it; a tree is one task's work, as
    sums pass through all of it, but of no more rows than it has nodes. Taxa without a lineage are left out."""
    own = counts.groupBy("taxid").agg(F.sum("n").cast("double").alias("n"))
    known = lines.select("taxid", F.col("lineage.taxid").alias("line"), is_generic(F.col("name")).alias("generic"))
    up = own.join(known, "taxid").select(F.explode("line").alias("taxid")).distinct()
    path = F.concat(F.array_join(F.transform("line", lambda x: x.cast("string")), "/"), F.lit("/"))
    x = up.join(known, "taxid").join(own, "taxid", "left").select(F.get("line", F.lit(0)).alias("root"), path.alias("path"), "taxid", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("generic", F.lit(False)).alias("generic"))

    def gather(key: tuple, rows):
        pending: list[tuple[str, float]] = []
        for root, at, taxid, n, generic in rows:
            while pending and pending[-1][0].startswith(at):
                n += pending.pop()[1]
            if taxid == root or (n >= cutoff and not generic):
                yield (taxid, n)
            else:
                pending.append((at, n))

    return fold(x, 1, [F.desc("path")], gather, "taxid int, n double").where("n <> 0")


def rank_pairs(lines: DataFrame) -> DataFrame:
    """How often a rank lies above another: (above, below, n)."""
    x = lines.select(F.col("rank").alias("below"), F.explode(F.slice("lineage", F.lit(1), F.size("lineage") - 1)).alias("a"))
    return x.groupBy(F.col("a.rank").alias("above"), "below").agg(F.count("*").alias("n"))


def display_text(lineage: Column, ranks: tuple[str, ...]) -> Column:
    """Names of the ancestors at some ranks, and of the node, joined by ';'."""
    wanted = F.array(*[F.lit(_rank(r)) for r in ranks])
    last = F.size(lineage) - 1
    kept = F.filter(lineage, lambda x, i: F.array_contains(wanted, rank_index(x["rank"])) | (i == last))
    return F.array_join(F.transform(kept, lambda x: F.coalesce(x["name"], x["taxid"].cast("string"))), ";")


def transmogrify(lineage: Column, rank: str, listed: list[str]) -> Column:
    """Name for a node on a list or at a rank: from the root down, a name on the list holds; else what holds above, if
    that is on the list; else the name at the rank; else what holds above, the root's name at first."""
    names = F.array(*[F.lit(x) for x in listed]) if listed else F.array().cast("array<string>")
    target = F.lit(_rank(rank))

    def step(acc: Column, x: Column) -> Column:
        on = F.array_contains(names, x["name"])
        return F.when(acc.isNull() | on, x["name"]).when(F.array_contains(names, acc), acc).when(rank_index(x["rank"]) == target, x["name"]).otherwise(acc)

    return F.aggregate(lineage, F.lit(None).cast("string"), step)


def redistribute(counts: DataFrame, lines: DataFrame) -> DataFrame:
    """Counts (taxid, n) of inner nodes handed down the tree, in parts: (taxid, n), of nodes below which nothing is counted.

    What a node has, with what came from above, goes to those of its children under which something is counted, by their
    sums. Along the path to a node this is one fold; totals are kept. Taxa without a lineage are left out."""
    own = counts.groupBy("taxid").agg(F.sum("n").cast("double").alias("own"))
    up = own.join(lines.select("taxid", "lineage"), "taxid").select("own", F.col("taxid").alias("leaf"), F.posexplode("lineage.taxid").alias("d", "taxid"))
    sums = up.groupBy("taxid").agg(F.sum("own").alias("s"))
    about = sums.join(lines.select("taxid", F.try_element_at(F.col("lineage.taxid"), F.lit(-2)).alias("up")), "taxid").join(own, "taxid", "left").na.fill(0.0, ["own"])
    below = about.where("up is not null").groupBy("up").agg(F.sum("s").alias("below")).withColumnRenamed("up", "parent")
    rated = about.join(below, F.col("up") == F.col("parent"), "left").select(F.col("taxid").alias("a"), F.col("own").alias("a_own"), F.coalesce(F.try_divide("s", "below"), F.lit(1.0)).alias("rate"))
    ends = about.select("taxid").join(below, F.col("taxid") == F.col("parent"), "left_anti")
    path = ends.join(lines.select("taxid", "lineage"), "taxid").select("taxid", F.posexplode("lineage.taxid").alias("d", "a")).join(rated, "a")
    steps = path.groupBy("taxid").agg(F.sort_array(F.collect_list(F.struct("d", "a_own", "rate"))).alias("p"))
    return steps.select("taxid", F.aggregate("p", F.lit(0.0), lambda t, x: t * x["rate"] + x["a_own"]).alias("n"))
