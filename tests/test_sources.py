import pytest
from pyspark.sql import functions as F

from hitweave import sinks
from hitweave.operators import filters, intervals, sequences, taxonomy, translate
from hitweave.operators.filters import FilterParams
from hitweave.sources import hits, records, tables

LINES = {
    "gene": ("r1\td1\th1\tx y\t90.5\t30\t1\t30\t5\t34\t60.1\te-10\t0.9", {"read": "r1", "hit": "h1", "pctid": 90.5, "mlen": 30, "score": 60.1, "evalue": 1e-10, "aln": 0.9}),
    "liz": ("r1\th1\tx y\tNA\t30\t1\t30\t5\t34\t60\t1e-9\t0.9", {"hit": "h1", "pctid": None, "score": 60.0}),
    "blast": ("r1\th1\t90\t30\t2\t1\t1\t30\t5\t34\t1e-9\t2.6e+03", {"hit": "h1", "mismatch": 2, "gaps": 1, "score": 2600.0}),
    "yanmei": ("r1\th1\t90\t30\t2\t1\t1\t30\t5\t34\t1e-9\t26\tabout", {"hit_desc": "about", "hend": 34}),
    "last": ("57\th1\t9\t20\t+\t100\tr1\t5\t60\t-\t80\t10,1:2,8\tEG2=1\tE=3e-5", {"read": "r1", "hstart": 10, "hend": 29, "qstart": 75, "qend": 16, "strand": "-", "mlen": 20, "evalue": 3e-5}),
    "sam": ("r1\t16\th1\t11\t9\t5S10M2I3M\t*\t0\t0\tACGT\t*\tAS:i:40\tMD:Z:6A6", {"qstart": 20, "qend": 6, "hstart": 11, "hend": 23, "score": 40.0, "mlen": 15, "pctid": pytest.approx(1200 / 13)}),
    "paf": ("r1\t100\t0\t50\t-\th1\t900\t10\t60\t45\t50\t60\tAS:i:80", {"qstart": 50, "qend": 1, "pctid": 90.0, "aln": 0.5, "score": 80.0}),
    "gff": ("r1\tsrc\tCDS\t5\t9\t7.5\t-\t0\tName=n1;product=a thing;", {"hit": "n1", "hit_desc": "a thing", "qstart": 9, "qend": 5, "mlen": 5, "score": 7.5}),
    "hmmsearchdom": ("r1 - 100 COG1 acc 50 9.3E-14 47.9 0.0 1 1 1e-5 1e-6 40 0 3 40 11 60 10 61 0.9 some text", {"read": "r1", "hit": "COG1", "score": 47.9, "hstart": 3, "qstart": 11, "qend": 60, "aln": 0.5, "read_desc": "some text"}),
    "hmmscandom": ("COG1 acc 50 r1 - 100 9.3E-14 47.9 0.0 1 1 1e-5 1e-6 40 0 3 40 11 60 10 61 0.9 some text", {"read": "r1", "hit": "COG1", "aln": 0.5, "hit_desc": "some text"}),
    "hmmsearch": ("r1 - COG1 acc 1e-5 40 0 1e-5 40 0 1 1 0 1 1 1 1 1 some text", {"read": "r1", "hit": "COG1", "evalue": 1e-5, "mlen": None}),
    "hmmscan": ("COG1 acc r1 - 1e-5 40 0 1e-5 40 0 1 1 0 1 1 1 1 1 some text", {"read": "r1", "hit": "COG1", "hit_desc": "some text"}),
    "cmsearch": ("r1 - RF1 acc cm 1 90 300 211 - no 1 0.5 0 61 1e-9 ! about", {"read": "r1", "hit": "RF1", "hstart": 1, "qstart": 300, "mlen": 90, "score": 61.0}),
    "cmscan": ("RF1 acc r1 - cm 1 90 300 211 - no 1 0.5 0 61 1e-9 ! about", {"read": "r1", "hit": "RF1"}),
    "frhit": ("r1\t80nt\t1e-5\t60\t1\t60\t75\t+\t95.5%\th1\t5\t64", None),
}


@pytest.mark.parametrize("fmt", [f for f, (_, w) in LINES.items() if w])
def test_formats(spark, fmt):
    text, want = LINES[fmt]
    df = spark.createDataFrame([("l", text), ("l", ""), ("l", "@x" if fmt == "sam" else "# note")], "label string, line string")
    row = hits.parse_hits(df, fmt).collect()
    assert len(row) == 1 and not row[0].malformed
    assert {k: row[0][k] for k in want} == want


def test_modes_and_files(spark, tmp_path):
    f = tmp_path / "s1.txt"
    f.write_text(LINES["blast"][0] + "\r\nbroken\n" + LINES["blast"][0] + "\n")
    got = hits.read_hits(spark, str(f), "blast", r"/([^/]*)\.txt").orderBy("pos").collect()
    assert [r.malformed for r in got] == [False, True, False] and got[0].label == "s1"
    assert hits.read_hits(spark, str(f), "blast", mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="malformed"):
        hits.read_hits(spark, str(f), "blast", mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        hits.column_of("blast", "desc")


def test_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 one\nACG\nT\n>s2\nGG\n")
    assert {(r.id, r.description, r.seq) for r in records.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("s1", "one", "ACGT"), ("s2", "", "GG")}
    (tmp_path / "a.fq").write_text("@q1 d\nAC\n+\nII\n@q2\nG\n+\nI\n")
    assert {(r.id, r.seq, r.quality) for r in records.read_fastq(spark, str(tmp_path / "a.fq")).collect()} == {("q1", "AC", "II"), ("q2", "G", "I")}
    (tmp_path / "a.gbk").write_text('LOCUS       X 12 bp\nACCESSION   X1\nVERSION     X1.2\n  ORGANISM  Ab cd\nFEATURES             Location/Qualifiers\n     source          1..12\n     CDS             complement(1..6)\n                     /protein_id="P1"\n                     /product="a\n                     thing"\nORIGIN\n        1 acgtac gtacgt\n//\n')
    r = records.read_genbank(spark, str(tmp_path / "a.gbk")).collect()
    assert [(x.id, x.description, x.strand, x.seq) for x in r] == [("P1", "a thing [Ab cd]", "-", "GTACGT")]
    assert records.kind_of("x.fna.gz") == "fasta" and records.kind_of("x", lines=3) == "lines"
    with pytest.raises(ValueError):
        records.kind_of("x", pattern="^>", lines=2)


def test_tables(spark, tmp_path):
    (tmp_path / "m").write_text("head\nk\t1\nk\t2\nshort\nj\t3\n")
    assert {(r.key, r.value) for r in tables.read_map(spark, str(tmp_path / "m"), skip=1, value_type="int").collect()} == {("k", 2), ("j", 3)}
    (tmp_path / "c").write_text(">Cluster 0\n0 9aa, >a1... *\n1 9aa, >a2... at 99%\n>Cluster 1\n0 9aa, >b1... *\n")
    assert {(r.name, r.size) for r in tables.read_clusters(spark, str(tmp_path / "c")).collect()} == {("a1", 2), ("b1", 1)}
    (tmp_path / "k").write_text("A<b>Top</b>\nB  Mid\nC    Low [PATH:ko1]\nD      K00001  x; y\nC    Other\nD      K00002  z\nA<b>Next</b>\nD      K00003  q\n")
    at = lambda level: {(r.ko, r.name) for r in tables.read_brite(spark, str(tmp_path / "k"), level).collect()}
    assert at("1") == {("K00001", "Top"), ("K00002", "Top"), ("K00003", "Next")} and at("2") == {("K00001", "Mid"), ("K00002", "Mid")}
    assert at("PATH") == {("K00001", "Low [PATH:ko1]")}
    (tmp_path / "ko").write_text("ENTRY       K00001      KO\nNAME        n1\nPATHWAY     ko1  p\nGENES       HSA: 1(A) 2\n            ECO: b1\n///\nENTRY       K00002      KO\nNAME        n2\n///\n")
    assert {(r.ko, r.field, r.value) for r in tables.read_ko_flat(spark, str(tmp_path / "ko")).collect()} >= {("K00001", "GENES", "hsa:2"), ("K00001", "GENES", "eco:b1"), ("K00002", "NAME", "n2")}


def test_taxdump_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, None, "no rank", "root"), (2, 1, "domain", "Aa"), (3, 2, None, "Bb")], "taxid int, parent int, rank string, name string")
    sinks.write_taxdump(nodes, str(tmp_path / "d"))
    n, m = tables.read_taxdump(spark, str(tmp_path / "d/nodes.dmp"), str(tmp_path / "d/names.dmp"))
    assert {(r.taxid, r.parent, r.rank) for r in n.collect()} == {(1, 1, "no rank"), (2, 1, "superkingdom"), (3, 2, "no rank")}
    lines = taxonomy.lineages(n, m.select("taxid", "name"))
    assert {r.taxid: r.t for r in lines.select("taxid", taxonomy.lineage_text(F.col("lineage")).alias("t")).collect()} == {1: "root", 2: "root;Aa", 3: "root;Aa;Bb"}


def test_collapse_and_names(spark):
    nodes = spark.createDataFrame([(1, None, ""), (2, 1, ""), (3, 1, ""), (4, 2, ""), (5, 2, ""), (6, 3, "")], "taxid int, parent int, rank string")
    names = spark.createDataFrame([(1, "root"), (2, "Aa"), (3, "Bb"), (4, "Cc"), (5, "uncultured x"), (6, "Dd")], "taxid int, name string")
    lines = taxonomy.lineages(nodes, names)
    got = taxonomy.collapse(spark.createDataFrame([(4, 2.0), (5, 9.0), (6, 1.0), (3, 1.0)], "taxid int, n double"), lines, 2.7)
    assert {(r.taxid, r.n) for r in got.collect()} == {(2, 11.0), (1, 2.0)}
    texts = {r.taxid: r.t for r in lines.select("taxid", taxonomy.readable_name(F.col("lineage")).alias("t")).collect()}
    assert texts[5] == "uncultured x (Aa)" and texts[6] == "Dd"


def test_filters_small(spark):
    rows = [("f", "r", h, s, 10, 1 + i, 20 + i, i) for i, (h, s) in enumerate([("a", 9.0), ("a", 9.0), ("b", 5.0), (None, None), ("c", 8.5)])]
    df = spark.createDataFrame(rows, "label string, read string, hit string, score double, mlen int, qstart int, qend int, pos long")
    kept = lambda p: [r.pos for r in filters.filter_hits(df, p).orderBy("pos").collect()]
    assert kept(FilterParams()) == [0, 1, 2, 3, 4]
    assert kept(FilterParams(top_pct=10)) == [0, 1, 4] and kept(FilterParams(hits_per_read=1, bits=1)) == [0, 1]
    assert kept(FilterParams(nonoverlapping=0, bits=1)) == [0] and kept(FilterParams(nonoverlapping=17, bits=1)) == [0, 2, 4]
    assert FilterParams(pctid=80, length=100, bits=50, hsps_per_hit=10, hits_per_read=1).name("x") == "x.I80.L100.B50.P10.H1"
    with pytest.raises(ValueError):
        filters.filter_hits(df, FilterParams(pctid=5))


def test_merge_overlap_and_sequences(spark):
    rows = [("f", "r", "h", 10, 5.0, 50.0, 1, 10, 101, 110, 0), ("f", "r", "h", 30, 7.0, 90.0, 20, 49, 200, 229, 1), ("f", "r", "h", 5, 1.0, 10.0, 3, 8, 300, 305, 2)]
    df = spark.createDataFrame(rows, "label string, read string, hit string, mlen int, score double, pctid double, qstart int, qend int, hstart int, hend int, pos long")
    r = intervals.merge_hsps(df).collect()
    assert [(x.n, x.mlen, x.score, x.pctid, x.qstart, x.hend) for x in r] == [(2, 40, 12.0, 80.0, 1, 229)]
    assert sequences.chunk_size(100, 10, 3) == 40 and sequences.even_chunk(100, 30) == 25
    s = spark.createDataFrame([("ATGGCNTAAG",)], "s string").select(sequences.translated(F.col("s")).alias("p"), sequences.reverse_complement(F.col("s")).alias("r")).collect()[0]
    assert (s.p, s.r) == ("MX*", "CTTANGCCAT")
    t = spark.createDataFrame([("a",), (None,), ("z",)], "x string")
    m = spark.createDataFrame([("a", "1")], "key string, value string")
    assert [[r.translated for r in translate.translate_column(t, "x", m, miss).collect()] for miss in (None, "", "-")] == [["1"], ["1", None, "z"], ["1", "-", "-"]]


def test_stream(spark, tmp_path):
    from hitweave.streaming.hits import each_batch, filter_rows, stream_hits

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(LINES["blast"][0] + "\n")
    s = stream_hits(spark, str(tmp_path / "in"), "blast")
    q = each_batch(filter_rows(s, FilterParams(bits=10)), lambda b: b.groupBy("hit").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r.hit, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("h1", 1)]
    with pytest.raises(ValueError):
        filter_rows(s, FilterParams(top_pct=1))
