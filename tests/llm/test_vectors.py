"""Whitening and hard negatives against dense linear algebra and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadgauge.llm import negatives, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, n int, component int, score string"


def clustered(rng, n=400, dims=10, spread=0.02):
    centres = rng.normal(size=(6, dims))
    return [(int(i), [float(np.float32(c)) for c in centres[i % 6] + spread * rng.normal(size=dims)], int(i // 6 % 3), 0, 0, "") for i in range(n)]


def odd_rows(dims):
    bad = [[None, *[0.5] * (dims - 1)], [float("nan"), *[0.5] * (dims - 1)], [float("inf"), *[0.5] * (dims - 1)], None, []]
    return [(9000 + i, v, 1, 0, 0, "") for i, v in enumerate(bad)]


def scaled(vector):
    return np.floor(256 * np.array(vector, dtype=np.float64)).astype(np.int64)


def test_solver_finds_the_leading_pairs_of_any_spectrum():
    rng = np.random.default_rng(3)
    for dims, k, spectrum in ((40, 4, np.linspace(1, 2, 40)), (30, 3, np.r_[np.ones(25), 5, 5, 5, 9, 9]), (3, 4, [3.0, 2.0, 0.0]), (64, 4, np.full(64, 7.0)), (1, 4, [2.0])):
        turned = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        matrix = turned @ np.diag(spectrum) @ turned.T
        values, vectors = whitening.jacobi_davidson(lambda x, m=matrix: m @ x, dims, k)
        want = np.sort(spectrum)[::-1][: min(k, dims)]
        assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * want[0])
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * want[0]
        assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert (whitening.jacobi_davidson(lambda x: 0 * x, 5, 2)[0] == 0).all()


def test_correction_solves_the_projected_equation():
    rng = np.random.default_rng(4)
    matrix = np.diag(np.arange(1.0, 13))
    kept = np.eye(12)[:, -2:]
    rest = rng.normal(size=(12, 2))
    rest[-2:] = 0
    theta = np.array([12.0, 11.0])
    got = whitening.corrections(lambda x: matrix @ x, theta, kept, rest, 12, 1e-14)
    assert np.allclose(np.diag(matrix)[:, None] * got - theta * got, -rest, atol=1e-10)


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) * np.arange(1, 9)], 0, 0, 0, "") for i in range(300)]
    rows += [(i + 1000, rows[i][1], 0, 0, 0, "") for i in range(40)] + [rows[7], (None, rows[8][1], 0, 0, 0, ""), (8000, [1.0, 2.0], 0, 0, 0, "")]
    got = whitening.whiten(spark.createDataFrame(rows + odd_rows(8), VECTORS)).collect()
    used = [r for r in rows if len(r[1]) == 8]
    x = np.stack([scaled(r[1]) for r in used])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert len(got) == 4 * len(used) and {r["n"] for r in got} == {n}
    white = (x - s / n) @ u / np.sqrt(e)
    for j in range(4):
        mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["whitened"], r["deviation"]) for r in got if r["component"] == j + 1)
        order = sorted(range(len(used)), key=lambda i: (used[i][0] is None, used[i][0] or 0))
        want = white[order, j]
        values = np.array([m[2] for m in mine])
        assert min(np.abs(values - want).max(), np.abs(values + want).max()) < 1e-9
        assert [m[3] for m in mine] == ((n * x - s) ** 2).sum(axis=1)[order].tolist()
        assert np.isclose([r["explained"] for r in got if r["component"] == j + 1][0], e[j] / np.trace(cov), rtol=1e-12)
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_whitening_without_rows_or_variance(spark):
    one = [(i, [0.5, 0.25], 0, 0, 0, "") for i in range(5)]
    for rows in ([], odd_rows(2), one):
        got = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert got.count() == 0 and got.columns[:2] == ["vec_id", "component"]
    line = [(i, [float(i), 0.0, 1.0], 0, 0, 0, "") for i in range(5)]
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()} == {1}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**30 + i), float(-(2**28) * i)], 0, 0, 0, "") for i in range(6)]
    centre = whitening.FitList(spark.createDataFrame(rows, VECTORS).select(whitening.scaled(F.col("embedding").cast("array<double>")).alias("x")), 2).centre
    x = np.stack([scaled([float(np.float32(c)) for c in r[1]]) for r in rows]).astype(object)
    assert centre.wide and list(centre.sums) == list(x.sum(axis=0)) and (centre.offsets(x) == x * 6 - x.sum(axis=0)).all()


def brute_negatives(rows, every):
    """By definition, over (id, label, x) rows."""
    out = set()
    for q, label, x in rows:
        if q % every:
            continue
        scored = sorted(((int(x @ y), i, m) for i, m, y in rows if i != q and len(y) == len(x)), key=lambda t: (-t[0], t[1]))
        for score, positive, _ in [t for t in scored if t[2] == label][:5]:
            window = [t for t in scored if t[2] != label and 80 * score <= 100 * t[0] <= 100 * score][:5]
            out |= {(q, positive, r, i, score, s) for r, (s, i, _) in enumerate(window, 1)}
    return out


def usable(rows):
    best = {}
    for i, v, m, *_ in rows:
        if i is None or m is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = scaled(v)
        if i not in best or (m, x.tolist()) < (best[i][0], best[i][1].tolist()):
            best[i] = (m, x)
    return [(i, m, x) for i, (m, x) in best.items()]


@pytest.mark.parametrize(("shard", "block", "spread"), [(8192, 512, 0.02), (37, 5, 0.3), (64, 3, 0.0)])
def test_negatives_equal_brute_force(spark, shard, block, spread):
    rng = np.random.default_rng(6)
    rows = clustered(rng, spread=spread)
    rows += [rows[5], (None, rows[6][1], 1, 0, 0, ""), (501, rows[7][1], None, 0, 0, ""), (6, rows[9][1], 0, 0, 0, ""), (510, [1.0, 2.0], 1, 0, 0, ""), (511, [2.0, 2.0], 2, 0, 0, ""), (512, [1.0, 1.0], 1, 0, 0, "")]
    frame = spark.createDataFrame(rows + odd_rows(10), VECTORS)
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"), shard=shard, block=block)
    want = brute_negatives(usable(rows), 10)
    assert len(want) > 50 and {tuple(r) for r in got.collect()} == want


def test_negatives_without_rows_anchors_or_partners(spark):
    rng = np.random.default_rng(7)
    for rows in ([], clustered(rng, 3), [(0, [1.0], 1, 0, 0, "")], [(0, [0.0], 1, 0, 0, ""), (1, [0.0], 1, 0, 0, ""), (2, [0.0], 2, 0, 0, "")]):
        got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, F.col("label"))
        assert {tuple(r) for r in got.collect()} == brute_negatives(usable(rows), 100)


def test_bounds_spare_scores_and_large_values_stay_exact():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, size=(20, 16))
    anchors = np.repeat(centres, 5, axis=0) + rng.integers(-3, 4, size=(100, 16))
    points = np.repeat(centres, 50, axis=0) + rng.integers(-3, 4, size=(1000, 16))
    scorer = negatives.Scorer(anchors, points)
    for at, rows, scores in scorer.run(lambda at, low, high: negatives._at_most(low, high, 5)):
        exact = points @ anchors[at]
        assert (exact[rows] == scores).all() and set(np.argsort(-exact, kind="stable")[:5]) <= set(rows)
    assert scorer.scored < 0.5 * len(anchors) * len(points)
    big = negatives.Scorer(anchors.astype(object) * 2**40, points)
    for at, rows, scores in big.run(lambda at, low, high: high >= -np.inf):
        assert all(int(s) == sum(int(a) * 2**40 * int(b) for a, b in zip(anchors[at], points[r], strict=True)) for r, s in list(zip(rows, scores, strict=True))[:3])
        break
