"""Trees, maps and joins of dimensions, ranges and regions, on written rows."""

import random

import pytest
from pyspark.sql import functions as F

from hitweave import sinks
from hitweave.operators import dimensions as d
from hitweave.operators import filters, intervals, taxonomy, translate
from hitweave.operators.places import running
from hitweave.sources import records, tables


def rows(df, *cols):
    return {tuple(r) for r in (df.select(*cols) if cols else df).collect()}


def test_trees_of_lineages(spark):
    x = spark.createDataFrame([("a1", "d__Aa;p__Bb"), ("a2", "d__Aa;p__Cc"), ("a3", "d__Aa")], "acc string, l string")
    tree, ends = d.tree_of_lineages(x.withColumn("l", d.lettered(F.col("l"))), "acc", "l")
    assert rows(tree, "taxid", "parent", "rank", "name") == {(1, None, "no rank", "root"), (2, 1, "domain", "Aa"), (3, 2, "phylum", "Bb"), (4, 2, "phylum", "Cc")}
    assert rows(ends) == {("a1", 3), ("a2", 4), ("a3", 2)}
    with pytest.raises(Exception, match="no rank"):
        x.select(d.lettered(F.lit("z__Aa"))).collect()
    two = spark.createDataFrame([("Euk;Extra;Ph",), ("Bac;Ph",)], "l string").select(d.placed(F.col("l")).alias("p"))
    assert {tuple(s["rank"] for s in r.p) for r in two.collect()} == {("domain", None, "phylum"), ("domain", "phylum")}


def test_tree_with_ids_of_its_own(spark):
    ranked = spark.createDataFrame([("Aa;", 10, "domain"), ("Aa;Bb;", 20, "phylum")], "lineage string, taxid int, rank string")
    leaves = spark.createDataFrame([("s1", "Aa;Bb;Leaf x"), ("s2", "Aa;Bb")], "acc string, l string")
    nodes, ends = d.tree_with_ids(ranked, leaves, "acc", "l")
    assert rows(nodes, "taxid", "parent", "rank", "name") == {(21, None, "no rank", "root"), (10, 21, "domain", "Aa"), (20, 10, "phylum", "Bb"), (22, 20, "no rank", "Leaf x")}
    assert rows(ends) == {("s1", 22), ("s2", 20)}


def test_tree_by_rank_and_name(spark, tmp_path):
    (tmp_path / "f").write_text(">x|Euk|Kk|Pp\nACGT\n>y|Euk|Ll|Pp\n>z|Euk\n")
    tree, ends = d.tree_by_rank_and_name(tables.read_bar_headers(spark, str(tmp_path / "f")), "acc", "names", "pos")
    assert rows(tree, "taxid", "parent", "rank", "name") == {(1, None, "domain", "Euk"), (2, 1, "kingdom", "Kk"), (3, 1, "kingdom", "Ll"), (4, 2, "phylum", "Pp")}
    assert rows(ends) == {("x", 4), ("y", 4), ("z", 1)}


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame([(1, None, ""), (2, 1, "superkingdom"), (3, 2, "phylum"), (4, 3, "genus"), (5, 3, "genus")], "taxid int, parent int, rank string")
    return taxonomy.lineages(nodes)


def test_names(spark, tree):
    names = spark.createDataFrame([(4, "Ab", None, "scientific name"), (5, "Ab", "Ab <two>", "scientific name"), (5, "Old b.", None, "synonym")], "taxid int, name string, unique_name string, name_class string")
    assert rows(d.name_map(names, tree)) == {("ab", 3), ("ab<two>", 5), ("oldb", 5)}
    assert rows(d.preferred_names(names)) == {(4, "Ab"), (5, "Ab <two>")}
    asked = spark.createDataFrame([("Old b",), ("Other",), ("uncultured thing",), ("Skip it",), ("Ab (x)",), (None,), ("Ab longer",)], "n string")
    listed = names.select("name", "taxid").withColumn("pos", F.monotonically_increasing_id())
    got = d.marker_names(asked, "n", names.where("taxid = 4").select("name", "taxid"), listed, {"Other": "Old b"}, ("skipit",))
    assert rows(got) == {("Old b", 5), ("Other", 5), ("uncultured thing", None), ("Skip it", None), ("Ab (x)", 4), (None, None), ("Ab longer", None)}


def test_taxids_mended_moved_compared_added(spark, tree):
    x = spark.createDataFrame([("a", 4), ("b", 90), ("c", 91), ("e", 77)], "acc string, taxid int")
    moved = spark.createDataFrame([(90, 91), (91, 5)], "old int, new int")
    assert rows(d.accession_taxids(x, tree, moved)) == {("a", 4), ("b", 5), ("c", 5)}
    assert rows(taxonomy.mend_taxids(x, tree, 1), "acc", "mended") == {("a", 4), ("b", 1), ("c", 1), ("e", 1)}
    assert rows(taxonomy.remap_ids(x, "taxid", moved), "acc", "taxid") == {("a", 4), ("b", 91), ("c", 5), ("e", 77)}
    assert rows(taxonomy.compared(tree, spark.createDataFrame([(5,), (9,)], "taxid int"))) == {(1, "first"), (2, "first"), (3, "first"), (4, "first"), (5, "both"), (9, "second")}
    nodes = spark.createDataFrame([(1, None, "r", "Aa"), (2, 1, "r", "Bb")], "taxid int, parent int, rank string, name string")
    more = spark.createDataFrame([(["aa", "Bb", "Cc", "Dd"],), (["Aa", "Bb", "cc"],), (["Xx", "Yy"],)], "lineage array<string>")
    got = {r.name.lower(): (r.taxid, r.parent) for r in taxonomy.add_lineages(nodes, more).collect()}
    ids = {k: v[0] for k, v in got.items()}
    assert got["cc"][1] == 2 and got["dd"][1] == ids["cc"] and got["xx"][1] is None and got["yy"][1] == ids["xx"]
    assert sorted(ids.values()) == [1, 2, 3, 4, 5, 6]


def test_joins_and_texts(spark):
    genes = spark.createDataFrame([("g_1_1", 7), ("g_1_2", 7)], "gene string, taxid int")
    contigs = spark.createDataFrame([("g_1_0001",), ("h_1",)], "contig string")
    assert rows(d.contig_taxids(contigs, genes)) == {("g_1_0001", 7)}
    a = spark.createDataFrame([("i", "o", "AC"), ("j", "p", "GG")], "id string, org string, seq string")
    got = d.annotated_headers(a, spark.createDataFrame([("o", "Aa;Bb")], "org string, lineage string"), spark.createDataFrame([("i", "does")], "id string, function string"))
    assert [r.description for r in got.collect()] == ["i\tAa;Bb\tdoes"]
    t = spark.createDataFrame([("NODE_1_length_20_cov_3.5",), ("k1 flag=1 len=300",), ("other",)], "x string")
    assert [r.y for r in t.select(d.contig_info(F.col("x")).alias("y")).collect()] == ["contig_length=20;contig_cov=3.5", "contig_length=300", ""]
    h = spark.createDataFrame([("r", "h", 1, 50, 9, 2, 90.04, 60.7, "+", "x", 0.1), ("r", "h", 1, 5, 1, 5, 90.0, 1.0, "-", "x", 0.1)], "read string, hit string, qstart int, qend int, hstart int, hend int, pctid double, score double, strand string, hit_desc string, evalue double")
    assert rows(d.hit_regions(h, 10)) == {("r", 50, 1, "h [9,2] 90.0% 60 bits")}
    assert rows(d.hit_regions(h, annotation=True), "start", "stop") == {(1, 50), (5, 1)}
    assert rows(d.unordered_pairs(t.withColumn("g", F.lit(1)), "g", "x").select("g")) == {(1,)} and d.unordered_pairs(t.withColumn("g", F.lit(1)), "g", "x").count() == 3
    assert d.union_all(t, contigs).count() == 5
    parts = spark.createDataFrame([(1,), (2,)], "n int")
    assert d.verified(parts, "n", 3).count() == 2
    with pytest.raises(Exception, match="expected"):
        d.verified(parts, "n", 4).collect()
    assert list(sinks.byte_stream(contigs.withColumnRenamed("contig", "line"))) == [b"g_1_0001\n", b"h_1\n"]
    assert sinks.none_option("None") is None and sinks.none_option("x") == "x"
    assert rows(sinks.matching_lines(contigs, "^h", "contig")) == {("h_1",)} and rows(sinks.head(contigs, "contig", 1)) == {("g_1_0001",)}


def test_ortholog_levels(spark, tmp_path):
    text = "ENTRY       K00001                      KO\nNAME        n1\nDEFINITION  d1\nPATHWAY     ko00010  Gly\n            ko00020  Cit\nBRITE       Orthology [BR:ko00001]\n             Metabolism\n              Carbo\n               00010 Gly\n                K00001 n1\n            Enzymes [BR:ko01000]\n             1. Oxi\n              1.1 On\n               1.1.1 With\n                1.1.1.1 alc\nGENES       HSA: 1\n///\nENTRY       K00002                      KO\nNAME        n2\n///\n"
    (tmp_path / "ko").write_text(text)
    at = lambda level: rows(tables.read_kegg(spark, str(tmp_path / "ko"), level))
    assert at("NAME") == {("K00001", "n1"), ("K00002", "n2")} and at("DESCRIPTION") == {("K00001", "d1")}
    assert at("PATH") == {("K00001", "ko00010  Gly"), ("K00001", "ko00020  Cit")}
    assert at(1) == {("K00001", "Metabolism")} and at("2") == {("K00001", "Carbo")} and at("EC") == {("K00001", "1.1.1.1 alc")}
    with pytest.raises(ValueError):
        at("nonsense")


def test_locations(spark):
    assert records._spans("complement(join(1..3,5..9))") == [(5, 9, True), (1, 3, True)]
    assert records._spans("join(complement(<1..3),5..>9)") == [(1, 3, True), (5, 9, False)]
    assert records._spans("join(J00194.1:100..202,1..5)") is None and records._spans("7") == [(7, 7, False)]


def test_forms_of_ids(spark):
    t = spark.createDataFrame([("gb|AB_12.1|",), ("AB_12.1",), ("ref||XY.12|",), ("x [Ab cd",), ("x [a [b] c]",), ("gi|55|gb|",), ("PF0001.2 COG12.1",)], "x string")
    got = lambda s: [r.y for r in t.select(translate.extract(F.col("x"), s).alias("y")).collect()]
    assert got("accession")[:3] == [["AB_12"], ["AB_12"], ["XY"]]
    assert got("organism")[3:5] == [["Ab cd"], ["a [b] c"]] and got("gi")[5] == ["55"] and got("pfam")[6] == ["PF0001", "COG12"]
    name, tag = translate.read_and_sample(F.col("x"))
    assert rows(spark.createDataFrame([("r_1_s",), ("none",)], "x string").select(name, tag)) == {("r_1", "s"), ("none", None)}


def test_running_sums_over_ranges(spark):
    rng = random.Random(0)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = {(r.k, r.o): r.s for r in running(df, ["k"], ["o"], F.col("v"), "s").collect()}
    assert got == {(k, o): sum(v for j, p, v in data if j == k and p <= o) for k, o, _ in data}
    total = {r.o: r.s for r in running(df, [], [F.desc("o")], F.lit(1), "s").collect()}
    assert total == {o: sum(p >= o for _, p, _ in data) for _, o, _ in data}
    assert running(df.limit(0), ["k"], ["o"], F.lit(1), "s").collect() == []


def test_overlaps_and_gaps(spark):
    rng = random.Random(1)
    mk = lambda n: [(rng.choice(["x", "y", None]), (s := rng.randrange(60)), s + rng.randrange(12), i) for i in range(n)]
    a, b = mk(120), mk(25)
    A, B = (spark.createDataFrame(t, "k string, start int, stop int, i int") for t in (a, b))
    for buffer in (0, 3):
        met = lambda p, q: p[0] is not None and p[0] == q[0] and not (p[1] + buffer >= q[2] or p[2] - buffer <= q[1])
        want = {p[3] for p in a if any(met(p, q) for q in b)}
        assert sorted(r.i for r in intervals.overlap_join(A, B, "k", "left_semi", buffer).collect()) == sorted(want)
        assert sorted(r.i for r in intervals.overlap_join(A, B, "k", "left_anti", buffer).collect()) == sorted({p[3] for p in a} - want)
        pairs = [(r.i, r.b_i) for r in intervals.overlap_join(A, B, "k", "inner", buffer, 7).collect()]
        assert sorted(pairs) == sorted((p[3], q[3]) for p in a for q in b if met(p, q))
    spans = spark.createDataFrame([("r", 5, 9), ("r", 20, 12), ("r", 7, 8), ("s", None, 3)], "id string, s int, e int")
    lengths = spark.createDataFrame([("r", 25), ("s", 4), ("t", 0)], "id string, n int")
    assert rows(intervals.uncovered(spans, lengths)) == {("r", 1, 4), ("r", 10, 11), ("r", 21, 25), ("s", 1, 4)}


def test_limits_of_a_hot_read(spark):
    rng = random.Random(2)
    data = [("f", "hot" if rng.random() < 0.7 else None, rng.choice([None, *"abcdefgh"]), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(300)]
    df = spark.createDataFrame(data, "label string, read string, hit string, score double, pos long")
    for sort in (None, "score"):
        want = set()
        for g in {r[1] for r in data}:
            mine = sorted((r for r in data if r[1] == g), key=lambda r: (0, 0, 0, r[4]) if sort is None else (r[3] is None, -(r[3] or 0), (r[2] is not None, r[2] or ""), r[4]))
            first = list(dict.fromkeys(r[2] for r in mine))[:3]
            want |= {r[4] for r in mine if r[2] in first}
        assert {r.pos for r in filters.limit_hits(df, 3, sort=sort).collect()} == want


def test_islands_over_ranges(spark):
    from hitweave.operators.sequences import islands

    rng = random.Random(3)
    data = [(rng.choice(["f", "g", None]), i, rng.choice([None, "a", "b"])) for i in rng.sample(range(500), 300)]
    df = spark.createDataFrame(data, "file string, o int, v string")
    for file in ("file", None):
        want, state = {}, {}
        for f, o, v in sorted(data, key=lambda r: r[1]):
            k = f if file else 0
            last, n = state.get(k, ("none yet", 0))
            state[k] = (v, n + (v != last))
            want[o] = state[k][1]
        assert {r.o: r.island for r in islands(df, "v", "o", file).collect()} == want
    assert islands(df.limit(0), "v", "o").collect() == []


def test_sample_of_a_stream(spark, tmp_path):
    from hitweave.operators.sampling import sample_n
    from hitweave.streaming.hits import sample_stream

    for part in range(3):
        spark.range(part * 100, part * 100 + 100).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        sample_stream(stream, 12, "id", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    last = max((p for p in (tmp_path / "out").glob("sample=*")), key=lambda p: int(p.name[7:]))
    assert rows(spark.read.parquet(str(last)), "id") == rows(sample_n(spark.range(300).toDF("id"), 12, "id"), "id")


def test_counts_of_files(spark, tmp_path):
    from hitweave import commands

    (tmp_path / "s").write_text("r1\th1\t90\t30\t2\t1\t1\t30\t5\t34\t1e-9\t60\nr1\th2\t90\t30\t2\t1\t1\t30\t5\t34\t1e-9\t50\nr2\th2\t90\t30\t2\t1\t1\t30\t5\t34\t1e-9\t50\n")
    got = commands.count_hit_files(spark, str(tmp_path / "s"), "blast")
    assert rows(got, "value", "n") == {("h1", 1), ("h2", 1)}
    assert commands.clean_levels(["3", None, "PATH", "3", "none"]) == ["3", "gene", "PATH"]


def test_tables_and_writers(spark, tmp_path):
    (tmp_path / "a").write_text("r1\tx; y\nr2\nr3\tz\n")
    assert rows(tables.read_assignments(spark, str(tmp_path / "a"), split=";"), "read", "value") == {("r1", "x"), ("r1", "y"), ("r3", "z")}
    assert rows(tables.short_rows(spark, str(tmp_path / "a"), 2), "line") == {("r2",)}
    assert rows(tables.read_list(spark, str(tmp_path / "a"), 1, first=1)) == {("r1",), ("r2",), ("r3",)}
    counts = spark.createDataFrame([("s", "b", 2), ("t", "a", 3)], "label string, value string, n long")
    sinks.write_counts(counts, str(tmp_path / "w"), about=spark.createDataFrame([("a", "first")], "value string, note string"))
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "w")).collect()
    assert [(r.value, r.note, r.s, r.t) for r in got] == [("a", "first", "0", "3"), ("b", None, "2", "0")]
    region = spark.createDataFrame([("c", "g", 1, 6, 1, "ATGTAA")], "read string, hit string, qstart int, qend int, number int, bases string")
    sinks.write_annotations(region, str(tmp_path / "t"))
    text = lambda k: [r.value for r in spark.read.text(str(tmp_path / "t" / k)).collect()]
    assert text("gff")[0].startswith("c\thitweave\tmatch\t1\t6") and "ATGTAA" in text("fna") and "M*" in text("faa")


def test_collapse_equals_walk(spark):
    rng = random.Random(5)
    parent = {i: (None if i < 3 else rng.randrange(i)) for i in range(120)}
    name = {i: rng.choice(["Aa", "Bb", "uncultured x"]) for i in parent}
    nodes = spark.createDataFrame([(i, p, "") for i, p in parent.items()], "taxid int, parent int, rank string")
    lines = taxonomy.lineages(nodes, spark.createDataFrame(list(name.items()), "taxid int, name string"))
    n = {i: float(rng.randrange(1, 9)) for i in rng.sample(sorted(parent), 50)}
    pending, want = dict(n), {}
    for i in sorted(parent, reverse=True):  # children have higher numbers
        v = pending.get(i, 0.0)
        if not v:
            continue
        if parent[i] is None or (v >= 12 and not name[i].startswith("unc")):
            want[i] = v
        else:
            pending[parent[i]] = pending.get(parent[i], 0.0) + v
    got = taxonomy.collapse(spark.createDataFrame([*n.items(), (999, 5.0)], "taxid int, n double"), lines, 12)
    assert {r.taxid: r.n for r in got.collect()} == want
