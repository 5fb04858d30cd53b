from collections import Counter

import numpy as np
import pytest

from hitweave.llm import mixing, tokens


def test_permutation_is_one():
    for size in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(size), size, 9).tolist()) == list(range(size))
        assert mixing.permute(mixing.permute(np.arange(size), size, 9), size, 9, back=True).tolist() == list(range(size))
    both = mixing.permute(np.array([5, 5]), np.array([10, 100]), np.array([1, 2]))
    assert both[0] == mixing.permute(np.array([5]), 10, 1)[0] and both[1] == mixing.permute(np.array([5]), 100, 2)[0]
    assert mixing.permute(np.arange(1000), 1000, 1).tolist() != mixing.permute(np.arange(1000), 1000, 2).tolist()


def test_quotas_reach_weights_or_caps():
    sources = [("a", 0.5, 1, 100, 10_000), ("b", 0.3, 2, 100, 10_000), ("c", 0.2, 1, 0, 0)]
    got, total = mixing.quotas(sources, exact=True)
    assert total == pytest.approx(16_000) and got == {"a": 100, "b": 60}
    got, total = mixing.quotas(sources)
    assert total == 20_000 and got == {"a": 100, "b": 100}
    got, _ = mixing.quotas([("large", 0.9, 1, 10**6, 256 * 10**6), ("tiny", 0.1, 1, 1, 20)])
    assert got == {"large": 10**6, "tiny": 1}
    got, _ = mixing.quotas(sources, 24_000)
    assert got == {"a": 100, "b": 140}
    got, _ = mixing.quotas(sources, 10**9)
    assert got == {"a": 100, "b": 200}
    assert mixing.quotas([]) == ({}, 0.0)


def test_deal_gives_every_slot_once():
    counts = {"a": 5000, "b": 17, "c": 1}
    plan = mixing.deal(counts, 3)
    for s, n in counts.items():
        slots = [k for _, t, first, m in plan if t == s for k in range(first, first + m)]
        assert sorted(slots) == list(range(n))


@pytest.fixture(scope="module")
def drawn(spark):
    docs = [(i, "a" if i % 3 else "b", f"words of document {i} " * (5 + i % 7)) for i in range(200)]
    docs += [(900, "a", None), (901, None, "no source"), (902, "b", ""), (903, "other", "not wanted"), (5, "a", "words of document 5 again"), (5, "a", "words of document 5 again"), (None, "a", "no id at all " * 9), (904, "b", "a very long text without an end " * 700)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("shard", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.7, 3), ("empty", 0.1, 2)], "source string, weight double, max_repeats int")
    out = mixing.mixture(df, targets, block_tokens=16, exact=True).cache()
    return docs, targets, out


def test_mixture(spark, drawn):
    docs, targets, out = drawn
    rows = out.collect()
    enc = tokens.encoder(tokens.tokenizer_path())
    ids = {}
    for d, _, t in docs:
        ids.setdefault(d, []).append(enc.ids(t or ""))
    most = {"a": 1, "b": 3}
    uses = Counter((r.source, r.no) for r in rows)
    assert all(n <= most[s] for (s, _), n in uses.items())
    last = {s: max(r.no for r in rows if r.source == s) for s in most}
    assert all(r.n_tokens == 16 or r.no == last[r.source] for r in rows)
    for shard in {r.shard for r in rows}:
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    for r in rows:
        assert len(r.ids) == r.n_tokens <= 16
        at = 0
        for d in r.docs:
            assert any(r.ids[at : at + d.n] == x[d.start : d.start + d.n] for x in ids[d.doc_id])
            at += d.n
        assert at == r.n_tokens
    share = {r.source: r for r in mixing.shares(out, targets).collect()}
    assert share["empty"].n_tokens == 0
    assert share["a"].share == pytest.approx(2 / 9, abs=0.02) and share["b"].share == pytest.approx(7 / 9, abs=0.02)
    assert sum(x.share for x in share.values()) == pytest.approx(1)
    assert all(r.uses <= most[r.source] for r in mixing.usage(out).collect())


def test_empty(spark, drawn):
    _, targets, _ = drawn
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    out = mixing.mixture(docs, targets)
    assert out.collect() == [] and {r.share for r in mixing.shares(out, targets).collect()} == {0.0}
    with pytest.raises(ValueError):
        mixing.mixture(docs, targets.union(targets))


def test_the_same_mixture_however_documents_lie(spark, drawn):
    docs, targets, _ = drawn
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts, rows in ((2, df), (7, df.repartition(5)), (16, df.orderBy("text"))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = mixing.mixture(rows, targets, block_tokens=16)
            got.append(sorted((r.shard, r.slot, r.source, r.repeat, r.no, tuple(r.ids), tuple(r.docs)) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] and got[0] == got[1] == got[2]
