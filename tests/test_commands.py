import pytest
from pyspark.sql import functions as F

from hitweave import commands
from hitweave.operators import taxonomy
from hitweave.operators.filters import FilterParams
from hitweave.sources import tables


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame([(1, None, ""), (2, 1, "superkingdom"), (3, 2, "phylum"), (4, 3, "genus"), (5, 3, "genus"), (6, 2, "phylum")], "taxid int, parent int, rank string")
    return taxonomy.lineages(nodes)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [("s1", "r1", "AB_1001.1", 9.0), ("s1", "r1", "AB_1002.1", 9.0), ("s1", "r2", "AB_1001.1", 8.0), ("s2", "r1", "AB_1003.1", 7.0), ("s2", "r3", "AB_9999.1", 7.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label string, read string, hit string, score double, pos long")
    return df.withColumn("hit_desc", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame([("AB_1001", 4), ("AB_1002", 5), ("AB_1003", 6)], "key string, value int")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_taxa(hits, mapping, tree):
    got = commands.assign_taxa(hits, FilterParams(), mapping, tree, "LCA")
    assert rows(got.select("label", "read", "value")) == {("s1", "r1", 3), ("s1", "r2", 4), ("s2", "r1", 6)}
    counted = commands.count_taxa(hits, FilterParams(), mapping, tree, ["phylum", "domain"], "first")
    assert list(counted) == ["superkingdom", "phylum"]
    assert rows(counted["phylum"].select("label", "value", "n")) == {("s1", 3, 2), ("s2", 6, 1), ("s2", None, 1)}
    for method in ("tophit", "toporg"):
        top = commands.count_taxa(hits, FilterParams(), mapping, tree, ["genus"], method)["genus"]
        assert rows(top.select("label", "value", "n")) == {("s1", 4, 2), ("s2", 6, 1), ("s2", None, 1)}
    with pytest.raises(ValueError):
        commands.clean_ranks(["nonsense"])


def test_paths_and_counts(spark, hits):
    links = spark.createDataFrame([("AB_1001.1", "K1"), ("AB_1002.1", "K2"), ("AB_1003.1", "K2")], "key string, value string")
    level = spark.createDataFrame([("K1", "P"), ("K1", "Q"), ("K2", "P")], "value string, level_value string")
    got = commands.count_paths(hits, FilterParams(), links, {"gene": None, "path": level})
    assert rows(got["path"].select("label", "value", "n")) == {("s1", "P", 2), ("s1", "Q", 2), ("s2", "P", 1), ("s2", None, 1)}
    split = commands.assign_paths(hits, FilterParams(), links, {"gene": None, "path": level})
    assert rows(split.where("label = 's1'").select("read", "gene", "path")) == {("r1", "K1", "P"), ("r1", "K1", "Q"), ("r2", "K1", "P"), ("r2", "K1", "Q")}
    values = spark.createDataFrame([("f", "r1", "a", 0), ("f", "r2", "a", 1), ("f", "r3", "b", 2)], "label string, read string, value string, pos int")
    assert rows(commands.count_hits(values, cutoff=0.5, total=True)) == {("a", 2.0), ("Other", 1.0), ("Total", 3.0)}


def test_annotations(spark):
    cds = spark.createDataFrame([("c", "g1", 1, 9), ("c", "g2", 30, 21), ("c", "g3", 5, 25)], "read string, hit string, qstart int, qend int")
    rna = spark.createDataFrame([("c", "t", 9, 20)], "read string, hit string, qstart int, qend int")
    seqs = spark.createDataFrame([("c", "ACGT" * 10)], "id string, seq string")
    assert rows(commands.merge_annotations(cds, rna, seqs).select("hit", "number", "bases")) == {("g1", 1, "ACGTACGTA"), ("t", 2, "ACGTACGTACGT"), ("g2", 3, "GTACGTACGT")}


def test_redistribute(spark, tree):
    got = taxonomy.redistribute(spark.createDataFrame([(3, 4.0), (4, 3.0), (5, 1.0), (2, 8.0)], "taxid int, n double"), tree)
    assert {r.taxid: r.n for r in got.collect()} == {4: 12.0, 5: 4.0}


def test_files(spark, tmp_path):
    for n in ("a.x.txt", "b.y.txt", "a.a.txt"):
        (tmp_path / n).write_text("#A\n##B\ni1\tn1\n#C\ni2\tn2\n")
    assert rows(tables.match_files(spark, f"{tmp_path}/{{s}}.{{t}}.txt", {"t": "[xa]"}).select("s", "t")) == {("a", "x"), ("a", "a")}
    assert rows(tables.match_files(spark, f"{tmp_path}/{{s}}.{{s}}.txt").select("s")) == {("a",)}
    got = tables.read_ranked_list(spark, f"{tmp_path}/b.y.txt")
    assert {(r.id, r.name, tuple(r.lineage)) for r in got.collect()} == {("i1", "n1", ("A", "B")), ("i2", "n2", ("C",))}
