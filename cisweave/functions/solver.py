"""Elastic net, ridge and scores on NumPy arrays, for use inside grouped UDFs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Gram:
    """Centred cross products of predictors: all that repeated fits on the same columns need."""

    x: np.ndarray
    mean: np.ndarray
    gram: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Gram:
        mean = x.mean(0)
        c = x - mean
        return Gram(c, mean, c.T @ c / len(x))


def enet(g: Gram, y: np.ndarray, alpha: float, l1_ratio: float, max_iter: int = 5000, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) minimising 1/(2n) |y - Xb - b0|^2 + alpha l1 |b|_1 + alpha (1 - l1) / 2 |b|^2.

    Coordinate descent on the covariance form: sweeps run over the active coordinates only, and a vectorised check of
    the optimality conditions admits others until none violates them.
    """
    n, m = g.x.shape
    lam1, lam2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    y_mean = float(y.mean()) if n else 0.0
    b = np.zeros(m)
    if not m:
        return b, y_mean
    grad = g.x.T @ (y - y_mean) / n  # x'(y - Xb)/n
    diag = np.diag(g.gram)
    scale = max(float(np.sqrt(np.mean((y - y_mean) ** 2))), 1e-12)
    active = np.zeros(m, bool)
    for _ in range(max_iter):
        new = ~active & (np.abs(grad) > lam1 * (1 + 1e-12) + 1e-15) & (diag > 0)
        if not new.any():
            break
        # the strongest violators first keep the active set small
        worst = np.flatnonzero(new)
        active[worst[np.argsort(-np.abs(grad[worst]), kind="stable")[: max(10, int(active.sum()))]]] = True
        at = np.flatnonzero(active)
        for _ in range(max_iter):
            biggest = 0.0
            for j in at:
                rho = grad[j] + diag[j] * b[j]
                value = np.sign(rho) * max(abs(rho) - lam1, 0.0) / (diag[j] + lam2)
                step = value - b[j]
                if step:
                    b[j] = value
                    grad -= step * g.gram[:, j]
                    biggest = max(biggest, abs(step) * np.sqrt(diag[j]))
            if biggest <= tol * scale:
                break
    return b, y_mean - float(g.mean @ b)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) minimising |y - Xb - b0|^2 + alpha |b|^2; in the smaller of the two dimensions."""
    xm, ym = x.mean(0), float(y.mean())
    c = x - xm
    n, m = c.shape
    if m <= n:
        b = np.linalg.solve(c.T @ c + alpha * np.eye(m), c.T @ (y - ym))
    else:
        b = c.T @ np.linalg.solve(c @ c.T + alpha * np.eye(n), y - ym)
    return b, ym - float(xm @ b)


def r2(y: np.ndarray, p: np.ndarray) -> float:
    """1 - sse/sst in [0, 1] over the pairs that are numbers; 0 below two pairs or without variance."""
    ok = np.isfinite(y) & np.isfinite(p)
    if ok.sum() < 2:
        return 0.0
    y, p = y[ok], p[ok]
    sst = float(((y - y.mean()) ** 2).sum())
    return float(np.clip(1.0 - ((y - p) ** 2).sum() / sst, 0.0, 1.0)) if sst > 0 else 0.0


def folds(n: int, k: int, seed: int = 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(train, test) rows of k shuffled folds of nearly equal size."""
    order = np.random.default_rng(seed).permutation(n)
    parts = np.array_split(order, max(2, min(k, n)))
    for i, test in enumerate(parts):
        yield np.concatenate(parts[:i] + parts[i + 1 :]), test


def some_rows(n: int, share: float, seed: int) -> np.ndarray:
    """A seeded share of the rows, without replacement."""
    take = max(2, int(n * share)) if share < 1 else n
    return np.sort(np.random.default_rng(seed).permutation(n)[: min(n, take)])


def ridge_errors(x: np.ndarray, y: np.ndarray, grid: Sequence[float], parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean over the (train, test) parts of the mean squared error of each penalty."""
    errors = np.zeros(len(grid))
    for train, test in parts:
        xm, ym = x[train].mean(0), y[train].mean()
        u, s, vt = np.linalg.svd(x[train] - xm, full_matrices=False)
        uy, xt = u.T @ (y[train] - ym), (x[test] - xm) @ vt.T
        for i, a in enumerate(grid):
            errors[i] += ((y[test] - ym - xt @ (s / (s**2 + a) * uy)) ** 2).mean() / len(parts)
    return errors


def tune_ridge(x: np.ndarray, y: np.ndarray, grid: Sequence[float], cv: int = 3, share: float = 0.7, seed: int = 13) -> float:
    """The penalty of the grid with the least mean error over folds; the first of equals."""
    rows = some_rows(len(y), share, seed)
    x, y = x[rows], y[rows]
    return float(grid[int(np.argmin(ridge_errors(x, y, grid, list(folds(len(y), cv, seed)))))])


def cv_error(x: np.ndarray, y: np.ndarray, settings: Sequence[tuple[float, float]], cv: int = 5, share: float = 0.7, seed: int = 13) -> np.ndarray:
    """Mean squared error over folds of each (alpha, l1_ratio); a fold's cross products serve all settings."""
    rows = some_rows(len(y), share, seed)
    x, y = x[rows], y[rows]
    error = np.zeros(len(settings))
    parts = list(folds(len(y), cv, seed))
    for train, test in parts:
        g = Gram.of(x[train])
        for i, (a, l1) in enumerate(settings):
            b, b0 = enet(g, y[train], a, l1, tol=1e-5)
            error[i] += ((y[test] - x[test] @ b - b0) ** 2).mean() / len(parts)
    return error


def random_settings(trials: int, alphas: tuple[float, float], l1_ratios: tuple[float, float], seed: int = 13) -> list[tuple[float, float]]:
    """Seeded search points: alpha log-uniform, l1_ratio uniform."""
    rng = np.random.default_rng(seed)
    a = np.exp(rng.uniform(np.log(alphas[0]), np.log(alphas[1]), trials))
    return list(zip(a.tolist(), rng.uniform(l1_ratios[0], l1_ratios[1], trials).tolist()))


def grid_settings(alphas: Sequence[float], l1_ratios: Sequence[float]) -> list[tuple[float, float]]:
    return [(a, l1) for a in alphas for l1 in l1_ratios]


def tune_enet(x: np.ndarray, y: np.ndarray, settings: Sequence[tuple[float, float]], cv: int = 5, share: float = 0.7, seed: int = 13) -> tuple[float, float]:
    """The setting of least error, the first of equals."""
    return settings[int(np.argmin(cv_error(x, y, settings, cv, share, seed)))]
