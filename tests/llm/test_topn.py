import random

import pytest

from hitweave.llm.topn import histogram_floor, score_bin, top_rows

PARAMS = [(1, 1, 1, -1.0, 0.0), (2, 3, 2, 10.0, 50.0), (3, 0, 1, 2.5, 0.0), (4, 2, 0, -1.0, 20.0), (5, 0, 0, -1.0, 0.0), (6, None, None, None, None)]


def brute(rows, params=PARAMS):
    groups = {}
    for r in rows:
        if r[3] is not None and r[3] == r[3]:
            groups.setdefault(r[:2], []).append(r)
    out = []
    for p, n_items, n_rows, pct, bits in params:
        n_items, n_rows, pct, bits = n_items or 0, n_rows or 0, -1.0 if pct is None else pct, bits or 0.0
        for g in groups.values():
            best = max(0.0, *(r[3] for r in g))
            cut = max(best - pct * best / 100, bits) if pct >= 0 else bits
            if cut != cut:  # an infinite best score has no band below it
                continue
            items = {}
            for r in sorted(g, key=lambda r: (-r[3], r[2] is not None, r[2] or "", r[4])):
                if r[3] < cut or (n_items and r[2] not in items and len(items) >= n_items):
                    continue
                items[r[2]] = items.get(r[2], 0) + 1
                if not n_rows or items[r[2]] <= n_rows:
                    out.append((p, r[4]))
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(700):
        big = rng.random() < 0.4
        out.append((rng.choice("ab") if not big else "hot", None if rng.random() < 0.02 else f"r{0 if big else rng.randrange(40)}", rng.choice([None, "A", "B", "a", *map(str, range(12))]) if not big or rng.random() < 0.5 else "same", rng.choice([None, float("nan"), -5.0, 0.0, 20.0, 50.0, 50.0, 300.0, 299.9, rng.uniform(0, 400), float("inf") if rng.random() < 0.05 else 1.0]), i))
    return out


@pytest.mark.parametrize("seed,drop", [(1, []), (2, [3, 5, 6]), (3, [1, 2, 4]), (4, [4, 5, 6]), (5, [1, 2, 3])])
def test_equals_brute_force(spark, seed, drop):
    data = rows(seed)
    params = [p for p in PARAMS if p[0] not in drop]
    df = spark.createDataFrame(data, "label string, read string, hit string, score double, n long").selectExpr("*", "'x' as best", "1 as param_id", "2 as item")
    p = spark.createDataFrame(params, "param_id int, hits_per_read int, hsps_per_hit int, top_pct double, bits double")
    got = top_rows(df, p, ("label", "read"), "hit", "score", "n")
    assert sorted(map(tuple, got.collect())) == brute(data, params)
    assert top_rows(df.limit(0), p, ("label", "read"), "hit", "score", "n").collect() == []
    assert top_rows(df, p.limit(0), ("label", "read"), "hit", "score", "n").collect() == []


def test_bins_and_floor(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    v = sorted(rng.uniform(-500, 5000) for _ in range(500))
    df = spark.createDataFrame([("k", x) for x in v], "k string, s double")
    b = [r.b for r in df.orderBy("s").select(score_bin(F.col("s")).alias("b")).collect()]
    assert b == sorted(b)
    floor = histogram_floor(df, ["k"], "s", 10).collect()[0].floor
    assert 10 <= sum(x >= floor for x in b) < 60
