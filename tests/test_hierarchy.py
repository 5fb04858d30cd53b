import random

import pytest

from hitweave.operators.hierarchy import descendants, hierarchy, subtree_sizes


def brute(rows):
    last = {}
    for i, p, o in rows:
        if i is not None and (i not in last or (o, p is not None, p or 0) >= last[i][0]):
            last[i] = ((o, p is not None, p or 0), p)
    parent = {i: v[1] for i, v in last.items()}
    out = {}
    for i in parent:
        path, seen, x = [], set(), i
        while True:
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
            p = parent[x]
            if p is None or p == x or p not in parent:
                break
            x = p
        out[i] = "/".join(map(str, reversed(path))) if path else None
    return out


def solve(spark, rows, **k):
    df = spark.createDataFrame(rows, "id long, parent long, o long")
    return {r.id: r for r in hierarchy(df, "id", "parent", "o", **k).collect()}


def forest(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.02:
            p = None
        elif kind < 0.03:
            p = i
        elif kind < 0.05:
            p = n + rng.randrange(50)  # no such node
        elif kind < 0.4:
            p = rng.randrange(n)  # may close cycles
        elif kind < 0.7:
            p = 7  # a parent of a third of all nodes
        else:
            p = i - 1  # long chains
        rows.append((i * 3, None if p is None else p * 3, rng.randrange(3)))
    return rows + [(r[0], rng.choice([None, 3, r[1]]), 1) for r in rows[:40]] + [(None, 3, 1), (None, None, None)]


@pytest.mark.parametrize("seed,n,block", [(1, 60, 10), (2, 400, 40), (3, 400, 10_000)])
def test_equals_walk(spark, seed, n, block):
    rows = forest(seed, n)
    got = solve(spark, rows, block_rows=block)
    want = brute(rows)
    assert {i: r.path for i, r in got.items()} == want
    for i, r in got.items():
        if r.path is None:
            assert r.depth is None and r.root is None
        else:
            ids = r.path.split("/")
            assert r.depth == len(ids) and r.root == int(ids[0]) and int(ids[-1]) == i


def test_long_chain_and_ring_over_many_blocks(spark):
    rows = [(i, i - 1, 0) for i in range(1, 300)] + [(0, None, 0)] + [(1000 + i, 1000 + (i + 1) % 90, 0) for i in range(90)]
    got = solve(spark, rows, block_rows=40)
    assert got[299].depth == 300 and got[299].root == 0
    assert all(got[1000 + i].path is None for i in range(90))


def test_empty_and_clashing_columns(spark):
    assert solve(spark, []) == {}
    df = spark.createDataFrame([(1, None, "x", 5), (2, 1, "y", 6)], "node long, up long, pid string, path int")
    assert {r.id: r.path for r in hierarchy(df, "node", "up").collect()} == {1: "1", 2: "1/2"}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 6), (6, 5)], "id long, parent long")
    paths = hierarchy(df, "id", "parent")
    assert {(r.id, r.descendant, r.distance) for r in descendants(paths).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}
    assert {r.id: r.n_descendants for r in subtree_sizes(paths).collect()} == {1: 3, 2: 1, 3: 0, 4: 0}
