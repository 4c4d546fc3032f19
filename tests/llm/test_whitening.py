"""Whitening against a dense eigensolver and exact sums."""

import math

import numpy as np
import pytest

from pulsegrid.llm import whitening


def by_hand(rows, k=16):
    """Distinct x, their number, deviations by id, components by a dense solver."""
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows}
    own = sorted(set(x.values()))
    n, sums = len(own), [sum(c) for c in zip(*own)]
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in own])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    values, vectors = values[::-1], vectors[:, ::-1]
    scores = {i: np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ vectors[:, :k] / np.sqrt(values[:k]) for i, v in x.items()}
    return n, deviation, values, scores


@pytest.mark.parametrize("tasks", [256, 1])
def test_whitening_equals_dense_solver(spark, sf_dir, tasks, monkeypatch):
    monkeypatch.setattr(whitening, "SUMS", tasks)
    monkeypatch.setattr(whitening, "BLOCK", 100)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(3)
    n, deviation, values, scores = by_hand([(r.vec_id, r.embedding) for r in df.collect()])
    rows = whitening.whiten(df).collect()
    assert len(rows) == 16 * df.count() and {r.n for r in rows} == {n}
    found = {i: np.zeros(16) for i in scores}
    for r in rows:
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10
        assert r.identity_error < 1e-12
        found[r.vec_id][r.component - 1] = r.whitened
    a, b = np.array([found[i] for i in sorted(scores)]), np.array([scores[i] for i in sorted(scores)])
    assert np.abs(a - b * np.sign((a * b).sum(0))).max() < 1e-9


def test_solver_locks_all_to_rounding_error():
    rng = np.random.default_rng(0)
    for d, n in ((1, 5), (3, 50), (64, 500), (200, 150)):
        m = rng.standard_normal((n, d)) * np.linspace(1, 3, d)
        m = np.hstack([m[:, : d // 2], m[:, : d - d // 2]])  # eigenvalues in pairs, or zero
        v = m.T @ m / n
        values, vectors = whitening.leading(lambda t: v @ t, d, 16)
        assert len(values) == min(16, d) and (np.diff(values) <= 1e-12 * values[0]).all()
        assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * values[0] * d
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:16]).max() < 1e-12 * values[0] * d


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 7.0]), (1, [0.5, 1.0, 7.0]), (2, [1.5, -1.0, 7.0]), (None, [2.5, 0.25, 7.0]), (3, None), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 1.0]), (6, [None, 0.0, 1.0]), (7, []), (8, [1.0]), (9, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, component string, n int")
    got = whitening.whiten(df).collect()
    # one entry never changes, so two components have variance
    assert sorted({(r.vec_id, r.component) for r in got}, key=str) == sorted([(i, c) for i in (1, 2, None) for c in (1, 2)], key=str) and len(got) == 8
    n, deviation, values, _ = by_hand([(i, v) for i, v in ((1, rows[0][1]), (2, rows[2][1]), (None, rows[3][1]))], 2)
    assert all(r.n == n == 3 and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-12 for r in got)
    assert abs(sum(r.explained for r in got if r.vec_id == 2) - 1) < 1e-12
    large = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect()} == {None}
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 3")):
        out = whitening.whiten(few)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
