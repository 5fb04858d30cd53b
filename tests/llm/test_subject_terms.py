"""Which terms have a weight, and which seeds a centroid."""

import numpy as np

from hitweave.llm.subjects import Settings, _gather, _orthonormal, _Sums, _trusted, _vocabulary, _words


def vocabulary(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return dict(_vocabulary(_words(docs, "doc_id", "text", "lang", lambda t: t or ""), Settings()))


def test_terms_of_small_and_unnamed_groups(spark):
    rows = [(i, f"plain{'abcdefghij'[i % 10]}", "en") for i in range(3000)] + [(5000 + i, "torwart" if i < 4 else f"filler{'ab'[i % 2]}", "de" if i % 2 else None) for i in range(40)]
    assert "torwart" in vocabulary(spark, rows)


def test_small_centroids_stay():
    z = np.vstack([np.tile([1.0, 0.0, 0.0], (400, 1)), [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]])
    sums, n = _gather(z, 0.5)
    assert len(sums) == 3 and sorted(n) == [1, 1, 400]


def test_common_terms_keep_a_small_weight(spark):
    rows = [(i, " . ".join(["hello", "compiler" if i % 4 == 0 else "quiet", f"rare{'abcdefghijklmnopqrst'[i % 20]}"]), "en") for i in range(200)]
    w = vocabulary(spark, rows)
    assert 0 < w["compiler"] < w["rarea"] and "hello" not in w


def test_an_odd_seed_amid_another_subject_makes_no_centroid():
    z = np.array([[1.0, 0.02 * i, 0.0] for i in range(9)] + [[0.0, 0.0, 1.0]])
    truth = np.array([[True, False]] * 8 + [[False, True]] * 2)
    c = np.array([[1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]])
    assert _trusted(c, np.array([0, 1, 1]), z, truth, 0.5).tolist() == [True, False, True]


def test_sums_of_rows_in_use():
    sums = _Sums(10_000, 3)
    for at in ([1, 5000], [5000, 9999], [0, 1]):
        sums.add(np.array(at), np.ones((2, 3), np.float32))
    for _ in range(2):
        out = np.zeros((10_000, 3))
        for r in sums.flush().to_pylist():
            out[r["block"] * 2048 + np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["data"], np.float32).reshape(-1, 3)
        assert out.sum() in (18, 3) and out[9999].tolist() == [1, 1, 1]
        sums.add(np.array([9999]), np.ones((1, 3), np.float32))


def test_orthonormal_columns():
    y = np.random.default_rng(0).standard_normal((500, 6)).astype(np.float32) * 10.0 ** np.arange(6, dtype=np.float32)
    y[:, 3] = y[:, 2]
    q = _orthonormal(y)
    g = q.T @ q
    assert np.allclose(np.sort(np.diag(g)), [0, 1, 1, 1, 1, 1], atol=1e-4) and np.allclose(g - np.diag(np.diag(g)), 0, atol=1e-3)
