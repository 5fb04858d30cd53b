"""Queries over all rows of hits, whatever their score, on written rows."""

import random

import pytest

from hitweave.plans.hits import QUERIES


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(300):
        s = rng.randrange(1, 900)
        out.append((i, "a", f"r{rng.randrange(6)}", f"h{rng.randrange(9)}", rng.choice([None, *map(float, range(20, 99))]), s, s + rng.randrange(1, 200), rng.choice(["ribosome x", "pump"])))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("hits"))
    spark.createDataFrame(rows, "hit_row long, label string, read string, hit string, score double, qstart int, qend int, hit_desc string").write.parquet(f"{at}/hits.parquet")
    return at


def apart(a, b, buffer=0):
    return a[5] + buffer >= b[6] or a[6] - buffer <= b[5]


@pytest.mark.parametrize("name,buffer", [("f_nonoverlap", 0), ("f_nonoverlap_buffer", 50)])
def test_greedy(spark, rows, folder, name, buffer):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4] is None, -(r[4] or 0), r[3], r[0])):
        if all(k[2] != r[2] or apart(r, k, buffer) for k in kept):
            kept.append(r)
    assert sorted(r.hit_row for r in QUERIES[name](spark, folder).collect()) == sorted(k[0] for k in kept)


def test_overlaps(spark, rows, folder):
    pairs = {(a[0], b[0]) for a in rows for b in rows if b[7] == "ribosome x" and a[2] == b[2] and not apart(a, b)}
    got = [tuple(r) for r in QUERIES["j_overlap_pairs"](spark, folder).collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    assert {r.hit_row for r in QUERIES["j_overlap_anti"](spark, folder).collect()} == {r[0] for r in rows} - {a for a, _ in pairs}


@pytest.mark.parametrize("name", ["x_tophit", "x_toporg", "x_tophit_prop", "x_given_counts"])
def test_every_read_has_a_top_hit(spark, rows, folder, name):
    assert sorted(r.read for r in QUERIES[name](spark, folder).collect()) == sorted({r[2] for r in rows})


def test_pivot_of_all_labels(spark, tmp_path):
    rows = [(i, f"cast00x{i % 12:02}", f"r{i}", "K00001" if i % 5 else "Bos") for i in range(60)]
    spark.createDataFrame(rows, "assign_id long, label string, read string, hit string").write.parquet(f"{tmp_path}/read_assignments.parquet")
    got = {r.value: r.asDict() for r in QUERIES["x_pivot"](spark, str(tmp_path)).collect()}
    labels = {r[1] for r in rows}
    assert set(got["KO"]) == labels | {"value"}
    for x in labels:
        assert [got[v][x] for v in ("KO", "taxon")] == [sum(r[1] == x and (r[3] == "K00001") == k for r in rows) for k in (True, False)]
