"""Recall against brute force: unclustered, clustered, of unequal length, with common vectors."""

import numpy as np
import pytest

from lodestack.llm import ann


def tables():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centres = rng.standard_normal((40, 32)) * rng.lognormal(0, 0.8, 40)[:, None]
    clustered = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 32))
    dense = rng.standard_normal(48) + 0.05 * rng.standard_normal((3000, 48))
    return {"unclustered": unit, "clustered": clustered, "lengths": unit[:3000] * rng.lognormal(0, 0.5, 3000)[:, None], "dense": dense}


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(ann, "CELL_MEAN", 100)


@pytest.mark.parametrize("name", ["unclustered", "clustered", "lengths", "dense"])
def test_recall(spark, name):
    x = tables()[name].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recalls = []
    for i in range(0, len(x), 20):
        scores = x.astype(float) @ x[i].astype(float)
        scores[i] = -np.inf
        recalls.append(len(got[i] & set(np.argsort(-scores)[:20].tolist())) / 20)
    print("recall", name, np.mean(recalls), "least", min(recalls))
    assert np.mean(recalls) > 0.93


def test_few_cells_are_enough_where_vectors_cluster():
    x = tables()["clustered"]
    c = ann.centroids(x, 27)
    assert ann.measured_probes(x, c, 20) <= 9


def test_common_vectors(spark):
    """A vector that a third of rows has, as candidate and as query: the smallest other ids come first."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).round(3)
    x[::3] = x[0] * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for i in range(0, 900, 20):
        scores = (x * x[i]).sum(axis=1)
        want = sorted((j for j in range(900) if j != i), key=lambda j: (-scores[j], j))[:20]
        hits += len({j for j, _ in got[i]} & set(want))
        assert all(abs(s - scores[j]) < 1e-9 for j, s in got[i]) and len(got[i]) == 20
        if i % 3 == 0:
            assert [j for j, _ in got[i]] == want
    assert hits / 900 > 0.93


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((2000, 70)), rng.standard_normal((50, 70))
    turn, centre = ann.rotation(70), x.mean(axis=0)
    assert np.allclose(turn.T @ turn, np.eye(70))
    estimate, width = ann.Codes(*ann.encode(x, centre, turn), centre, turn).bounds(q)
    assert np.mean(np.abs(estimate - q @ x.T) <= width) > 0.97 and abs(np.mean(estimate - q @ x.T)) < 0.1
