"""Descendants of nodes on and below cycles."""

from collections import Counter

import pytest

from hitweave.operators.hierarchy import all_descendants, all_subtree_sizes, opened_hierarchy
from tests.test_hierarchy import forest


def below(rows):
    last = {}
    for i, p, o in rows:
        if i is not None and (i not in last or (o, p is not None, p or 0) >= last[i][0]):
            last[i] = ((o, p is not None, p or 0), p)
    parent = {i: v[1] for i, v in last.items()}
    out = set()
    for i in parent:
        seen, x, d = {i}, parent[i], 1
        while x in parent and x not in seen:
            out.add((x, i, d))
            seen.add(x)
            x, d = parent[x], d + 1
    return out, set(parent)


RING = [(i, (i + 1) % 90, 0) for i in range(90)] + [(100 + i, 99 + i if i else 7, 0) for i in range(40)] + [(500, 501, 0), (501, 500, 0), (502, 500, 0), (503, 502, 0), (600, None, 0), (601, 600, 0)]


@pytest.mark.parametrize("rows,block", [(RING, 20), (RING, 1000), (forest(1, 60), 10), (forest(2, 400), 40)])
def test_equals_walk(spark, rows, block):
    want, ids = below(rows)
    paths = opened_hierarchy(spark.createDataFrame(rows, "id long, parent long, o long"), "id", "parent", "o", block_rows=block)
    got = [(r.id, r.descendant, r.distance) for r in all_descendants(paths).collect()]
    assert len(got) == len(want) and set(got) == want
    n = Counter(a for a, _, _ in want)
    assert {r.id: r.n_descendants for r in all_subtree_sizes(paths).collect()} == {i: n[i] for i in ids}
