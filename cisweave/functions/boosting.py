"""Boosted elastic net with a ridge refit for one locus, on NumPy arrays.

Each round fits an elastic net to the residuals on the columns that correlate most with them, adds its coefficients, and
stops when the held-out score no longer rises. The columns that end with a coefficient are refitted by ridge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from cisweave.functions.penalties import auto_trials_number
from cisweave.functions.solver import Gram, enet, grid_settings, r2, random_settings, ridge, tune_enet, tune_ridge


@dataclass(frozen=True)
class Settings:
    n_iter: int = 100
    batch_size: int = 8192
    n_trials: int = 20
    #: fixed values: the search ranges and the ridge grid
    alphas: tuple[float, float] = (0.1, 1.0)
    l1_ratios: tuple[float, float] = (0.1, 0.9)
    search: str = "random"
    subsample_frac: float = 0.7
    ridge_grid: tuple[float, ...] = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
    cv: int = 5
    refit_each_iter: bool = False
    standardize: bool = True
    val_frac: float = 0.2
    random_state: int = 13
    patience: int = 5
    min_delta: float = 1e-4
    warmup: int = 5
    adaptive_trials: bool = True
    working_set: int | None = None
    refresh: int | None = None
    fixed_alpha: float | None = None
    fixed_l1_ratio: float | None = None
    early_stop: bool = True
    #: name of the score that stops: auto is val_r2 with validation rows, h2 without
    early_stop_metric: str = "auto"
    #: ridge penalty from training rows only; by default from all rows
    strict_split: bool = False


@dataclass
class Fit:
    betas: np.ndarray
    ridge_betas: np.ndarray
    kept: np.ndarray
    final_r2: float
    h2_diag: float
    h2_ld: float
    h2_val: float
    h2_estimates: list[float]
    n_iter: int
    alpha: float
    l1_ratio: float
    ridge_alpha: float | None
    variances: np.ndarray
    best: float | None = None
    history: list[float] = field(default_factory=list)
    metric: str = "h2"


def split(n: int, val_frac: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(training, validation) rows: the first of a seeded permutation are validation; none of fewer than 25 rows."""
    if not 0 < val_frac < 0.9 or n < 25:
        return np.arange(n), np.arange(0)
    order = np.random.default_rng(seed).permutation(n)
    n_val = max(5, int(n * val_frac))
    return order[n_val:], order[:n_val]


def choose_penalty(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, float]:
    """Both penalties fixed: as they are. One fixed: a search over the other, of at least 3 trials. None: a full search."""
    if s.fixed_alpha is not None and s.fixed_l1_ratio is not None:
        return s.fixed_alpha, s.fixed_l1_ratio
    m = x.shape[1]
    trials = auto_trials_number(min(m, s.batch_size) if s.adaptive_trials else m, s.n_trials)
    one = s.fixed_alpha is not None or s.fixed_l1_ratio is not None
    if one:
        trials = max(3, trials)
    alphas = s.alphas if s.fixed_alpha is None else (s.fixed_alpha, s.fixed_alpha)
    l1s = s.l1_ratios if s.fixed_l1_ratio is None else (s.fixed_l1_ratio, s.fixed_l1_ratio)
    settings = grid_settings(alphas, l1s) if s.search == "grid" else random_settings(trials, alphas, l1s, s.random_state)
    return tune_enet(x, y, settings, s.cv, s.subsample_frac, s.random_state)


def clip01(v: float) -> float:
    return float(np.clip(v, 0.0, 1.0)) if np.isfinite(v) else float("nan")


def h2_of_variances(x: np.ndarray, coef: np.ndarray) -> float:
    """Heritability as the sum of the variants' own variances, in [0, 1]."""
    return clip01(float((coef**2 * x.var(0)).sum()))


def h2_of_scores(x: np.ndarray, coef: np.ndarray, y: np.ndarray) -> float:
    """b' S b / var(y), as the variance of the samples' scores, in [0, 1]; 0 without variance."""
    var_y = float(y.var())
    return clip01(float((x @ coef).var(ddof=1)) / var_y) if var_y > 0 and len(y) > 1 else 0.0


def boost(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Fit:
    """x: samples x variants without missing values; y: one number per sample."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape
    tr, va = split(n, s.val_frac, s.random_state)
    if s.standardize:
        x = (x - x[tr].mean(0)) / (x[tr].std(0) + 1e-6)
        y = (y - y[tr].mean()) / (y[tr].std() + 1e-6)
    k = min(max(1, s.working_set or s.batch_size), m)
    refresh = (s.refresh or 10) if s.working_set else (s.refresh or 1)
    alpha, l1 = choose_penalty(x[tr], y[tr], s) if m and not s.refit_each_iter else (s.fixed_alpha or 0.0, s.fixed_l1_ratio or 0.0)
    residual, total, betas = y.copy(), np.zeros(n), np.zeros(m)
    centred = x[tr] - x[tr].mean(0)
    norms = np.sqrt((centred**2).sum(0))
    use, gram = np.arange(0), None
    history: list[float] = []
    best, bad = -np.inf, 0
    for it in range(s.n_iter if m else 0):
        if it % refresh == 0:
            r = residual[tr] - residual[tr].mean()
            screen = np.abs(centred.T @ r) / (norms * (np.sqrt(r @ r) + 1e-12) + 1e-12)
            chosen = np.sort(np.argsort(-screen, kind="stable")[:k])
            if gram is None or not np.array_equal(chosen, use):
                use = chosen
                gram = Gram.of(x[np.ix_(tr, use)])
        if s.refit_each_iter:
            alpha, l1 = choose_penalty(x[np.ix_(tr, use)], residual[tr], s)
        b, b0 = enet(gram, residual[tr], alpha, l1)
        step = x[:, use] @ b + b0
        residual -= step
        total += step
        betas[use] += b
        rows = va if len(va) else tr
        history.append(r2(y[rows], total[rows]))
        if it >= s.warmup:
            if history[-1] > best + s.min_delta:
                best, bad = history[-1], 0
            else:
                bad += 1
                if s.early_stop and bad >= s.patience:
                    break
    kept = np.flatnonzero(betas != 0)
    ridge_betas, final, h2_val, penalty = np.zeros(m), 0.0, float("nan"), None
    h2_diag = h2_ld = 0.0
    if len(kept):
        rows = tr if s.strict_split else np.arange(n)
        penalty = tune_ridge(x[np.ix_(rows, kept)], y[rows], s.ridge_grid, min(3, s.cv), s.subsample_frac, s.random_state)
        coef, b0 = ridge(x[np.ix_(tr, kept)], y[tr], penalty)
        ridge_betas[kept] = coef
        final = r2(y[tr], x[np.ix_(tr, kept)] @ coef + b0)
        if len(va):
            h2_val = r2(y[va], x[np.ix_(va, kept)] @ coef + b0)
        h2_diag = h2_of_variances(x[np.ix_(tr, kept)], coef)
        h2_ld = h2_of_scores(x[np.ix_(tr, kept)], coef, y[tr])
    return Fit(
        betas, ridge_betas, kept, final, h2_diag, h2_ld, h2_val if np.isfinite(h2_val) else final, history, len(history), float(alpha), float(l1), penalty,
        x[tr].var(0) if m else np.zeros(0), None if best == -np.inf else best,
        metric=("val_r2" if len(va) else "h2") if s.early_stop_metric == "auto" else s.early_stop_metric,
    )
