import numpy as np
import pytest

from cisweave.functions import boosting, solver


def problem(n=80, m=30, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, m)).astype(float)
    y = 0.8 * x[:, 3] - 0.6 * x[:, 11] + rng.normal(0, 0.3, n)
    return x, y


@pytest.mark.parametrize("alpha, l1", [(0.05, 0.5), (0.2, 0.9), (0.01, 0.1), (1.0, 1.0)])
def test_enet_meets_the_optimality_conditions(alpha, l1):
    x, y = problem()
    b, b0 = solver.enet(solver.Gram.of(x), y, alpha, l1, tol=1e-10)
    r = y - x @ b - b0
    grad = (x - x.mean(0)).T @ r / len(y) - alpha * (1 - l1) * b
    lam = alpha * l1
    assert abs(r.mean()) < 1e-8
    assert np.allclose(grad[b != 0], lam * np.sign(b[b != 0]), atol=1e-6)
    assert (np.abs(grad[b == 0]) <= lam + 1e-6).all()


def test_enet_agrees_with_spark_ml(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    x, y = problem(m=12)
    alpha, l1 = 0.1, 0.5
    sd = y.std(ddof=1)
    lam1, lam2 = alpha * l1, alpha * (1 - l1)
    reg = lam1 + lam2 * sd
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "label"])
    m = LinearRegression(regParam=reg, elasticNetParam=lam1 / reg, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=500).fit(df)
    b, b0 = solver.enet(solver.Gram.of(x), y, alpha, l1, tol=1e-10)
    assert np.allclose(m.coefficients.toArray(), b, atol=1e-5) and abs(m.intercept - b0) < 1e-4


def test_ridge_both_forms():
    x, y = problem()
    b, _ = solver.ridge(x, y, 2.0)
    c = x - x.mean(0)
    assert np.allclose(b, np.linalg.solve(c.T @ c + 2 * np.eye(30), c.T @ (y - y.mean())))
    wide, _ = solver.ridge(x[:10], y[:10], 2.0)
    c = x[:10] - x[:10].mean(0)
    assert np.allclose(wide, np.linalg.solve(c.T @ c + 2 * np.eye(30), c.T @ (y[:10] - y[:10].mean())))


def test_r2_guards():
    assert solver.r2(np.array([1.0]), np.array([1.0])) == 0
    assert solver.r2(np.array([1.0, 1.0]), np.array([1.0, 2.0])) == 0
    assert solver.r2(np.array([1.0, 2.0, np.nan]), np.array([1.0, 2.0, 3.0])) == 1
    assert solver.r2(np.array([1.0, 2.0]), np.array([9.0, -9.0])) == 0


def test_folds_cover_all_rows_once():
    seen = np.concatenate([t for _, t in solver.folds(23, 5)])
    assert sorted(seen) == list(range(23))


def test_ridge_tuning_takes_the_best_of_the_grid():
    x, y = problem(n=40, m=35)
    grid = (1e-3, 1.0, 10.0, 1e5)
    best = solver.tune_ridge(x, y, grid, 3, 1.0)
    err = {}
    for a in grid:
        e = []
        for tr, te in solver.folds(40, 3):
            b, b0 = solver.ridge(x[tr], y[tr], a)
            e.append(((y[te] - x[te] @ b - b0) ** 2).mean())
        err[a] = np.mean(e)
    assert best == min(err, key=err.get)


def test_boost_finds_the_planted_columns_and_stops():
    x, y = problem(n=200)
    f = boosting.boost(x, y, boosting.Settings(n_iter=100, n_trials=5))
    assert {3, 11} <= set(f.kept) and f.final_r2 > 0.7 and 0 <= f.h2_val <= 1 and f.n_iter <= 100 and f.best is not None
    assert len(f.h2_estimates) == f.n_iter
    assert np.array_equal(boosting.boost(x, y, boosting.Settings(n_iter=100, n_trials=5)).betas, f.betas)


def test_boost_on_noise_explains_little():
    rng = np.random.default_rng(2)
    f = boosting.boost(rng.integers(0, 3, (300, 20)).astype(float), rng.normal(size=300), boosting.Settings(n_iter=30, fixed_alpha=0.3, fixed_l1_ratio=0.9))
    assert f.h2_val < 0.05


def test_fixed_and_half_fixed_penalties():
    x, y = problem()
    s = boosting.Settings(fixed_alpha=0.3, fixed_l1_ratio=0.4)
    assert boosting.choose_penalty(x, y, s) == (0.3, 0.4)
    a, l1 = boosting.choose_penalty(x, y, boosting.Settings(fixed_alpha=0.3))
    assert a == pytest.approx(0.3) and 0.1 <= l1 <= 0.9
    f = boosting.boost(x, y, boosting.Settings(refit_each_iter=True, n_iter=3, n_trials=3, search="grid"))
    assert f.n_iter == 3


def test_split_sizes():
    tr, va = boosting.split(100, 0.2, 13)
    assert len(va) == 20 and len(set(tr) | set(va)) == 100
    assert len(boosting.split(24, 0.2, 13)[1]) == 0 and len(boosting.split(26, 0.1, 13)[1]) == 5


def test_empty_locus():
    f = boosting.boost(np.zeros((30, 0)), np.arange(30.0))
    assert f.n_iter == 0 and f.final_r2 == 0 and f.best is None
