import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hitweave.llm import terms


def frame(spark, rows):
    return spark.createDataFrame(rows, "field string, record string, term string, delta long")


def brute(rows):
    pairs = Counter()
    for f, r, t, d in rows:
        pairs[f, r, t] += d
    n, records = Counter(), defaultdict(set)
    for (f, r, t), d in pairs.items():
        if d:
            n[f, t] += d
            records[f, t].add(r)
    return {(f, t): (k, len(records[f, t])) for (f, t), k in n.items()}


def test_batches_equal_recount(spark, tmp_path):
    rng = random.Random(2)
    store = terms.TermCounts(spark, str(tmp_path / "s"), 3)
    live, log = [], []
    for _ in range(3):
        batch = [("f", rng.choice([None, "r1", "r2", "r3"]), rng.choice("abc"), 1) for _ in range(15)] + [("g", "r1", "hot", 1)] * 5
        gone = rng.sample(live, len(live) // 2)
        for x in gone:
            live.remove(x)
        live += batch
        log += batch + [(f, r, t, -1) for f, r, t, _ in gone]
        store.apply(frame(spark, batch + [(f, r, t, -1) for f, r, t, _ in gone]))
        assert {(r.field, r.term): (r.n_rows, r.n_records) for r in store.counts().collect()} == brute(log)
    store.compact()
    assert {(r.field, r.term): (r.n_rows, r.n_records) for r in terms.TermCounts(spark, str(tmp_path / "s"), 3).counts().collect()} == brute(log)


def test_removing_what_was_not_added_fails_and_changes_nothing(spark, tmp_path):
    store = terms.TermCounts(spark, str(tmp_path / "s"), 2)
    store.apply(frame(spark, [("f", "r", "a", 2)]))
    with pytest.raises(Exception, match="never added"):
        store.apply(frame(spark, [("f", "r", "a", -3)]))
    again = terms.TermCounts(spark, str(tmp_path / "s"), 2)
    assert [(r.term, r.n_rows) for r in again.counts().collect()] == [("a", 2)]
    store.apply(frame(spark, [("f", "r2", "a", 1)]))  # the store that has refused a batch takes the next
    again = terms.TermCounts(spark, str(tmp_path / "s"))
    again.apply(frame(spark, [("f", "r3", "b", 1)]))
    assert sorted((r.term, r.n_rows, r.n_records) for r in again.counts().collect()) == [("a", 3, 2), ("b", 1, 1)]


def test_runs_are_merged_and_old_ones_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(terms, "MOST_RUNS", 3)
    store = terms.TermCounts(spark, str(tmp_path / "s"), 4)
    for i in range(4):
        store.apply(frame(spark, [("f", f"r{i}", "a", 1), ("f", "r0", "b", 1)]))
    assert len(store.runs) == 2 and len(list((tmp_path / "s").glob("run-*"))) == 2
    assert sorted((r.term, r.n_rows, r.n_records) for r in store.counts().collect()) == [("a", 4, 4), ("b", 4, 1)]


def test_one_row_reads_one_bucket(spark, tmp_path):
    store = terms.TermCounts(spark, str(tmp_path / "s"), 8)
    store.apply(frame(spark, [("f", f"r{i}", "a", 1) for i in range(200)]))
    delta = frame(spark, [("f", "r7", "a", 1)]).selectExpr("field", "record", "term", "delta as d", f"cast(pmod(xxhash64(field, record), {store.buckets}) as int) as bucket")
    files = store._moved(delta).inputFiles()
    assert 0 < len(store._read("pairs", terms._PAIRS).inputFiles()) and all("bucket=" in f for f in files)
    plan = store._moved(delta)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_marks(spark):
    rows = [("f", f"r{i}", "all", 1) for i in range(10)] + [("f", "r1", "one", 3)] + [("g", "r1", "x", 1)]
    store = terms.TermCounts(spark)
    store.apply(frame(spark, rows))
    got = {(r.field, r.term): r.mark for r in store.marked(3, {"f": 0.5}).collect()}
    assert got == {("f", "all"): "common", ("f", "one"): "rare", ("g", "x"): "rare"}


def test_cleaning_and_empty(spark):
    df = spark.createDataFrame([("r", v) for v in ["  A b\t", " 　X ", "", "  ", None, "z" * 20000]], "record string, v string")
    got = [r.term for r in terms.changes(df, "f", "record", terms.clean_term(F.col("v"))).collect()]
    assert sorted(got) == ["a b", "x", "z" * 20000]
    store = terms.TermCounts(spark)
    store.apply(frame(spark, []))
    assert store.counts().collect() == [] and store.marked(3, {"f": 0.5}).collect() == []


def test_corrections(spark):
    df = spark.createDataFrame([("r1", "a ", "a"), ("r2", "b", "b"), (None, None, "c"), ("r3", "d", None), ("r3", "d", None)], "record string, old string, new string")
    got = sorted((r.record, r.term, r.delta) for r in terms.corrections(df, "f", "record", F.col("old"), F.col("new")).collect() if r.record)
    assert got == [("r1", "a", 1), ("r1", "a ", -1), ("r3", "d", -1), ("r3", "d", -1)]
    assert [(r.term, r.delta) for r in terms.corrections(df, "f", "record", F.col("old"), F.col("new")).collect() if r.record is None] == [("c", 1)]
