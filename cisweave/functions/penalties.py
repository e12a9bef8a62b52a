"""Penalty and sizing formulas as column expressions; each takes columns or numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def alpha_l1_from_lambda(lam1, lam2, eps: float = 1e-8) -> tuple[Column, Column]:
    """(alpha, l1_ratio) of an L1 penalty lam1 and an L2 penalty lam2."""
    alpha = _c(lam1) + _c(lam2)
    return alpha, _c(lam1) / (alpha + F.lit(eps))


def enet_from_targets(m, n, c_lambda=1.0, c_ridge=1.0, eps: float = 1e-8) -> tuple[Column, Column]:
    """(alpha, l1_ratio) for m predictors and n samples, both at least 2: lam1 = c_lambda * sqrt(2 ln m / n)."""
    m, n = F.greatest(_c(m).cast("double"), F.lit(2.0)), F.greatest(_c(n).cast("double"), F.lit(2.0))
    lam1 = _c(c_lambda) * F.sqrt(F.lit(2.0) * F.ln(m) / n)
    return alpha_l1_from_lambda(lam1, _c(c_ridge) * lam1, eps)


def enet_numbers(m: float, n: float, c_lambda: float = 1.0, c_ridge: float = 1.0, eps: float = 1e-8) -> tuple[float, float]:
    """enet_from_targets for plain numbers."""
    lam1 = c_lambda * math.sqrt(2.0 * math.log(max(m, 2.0)) / max(n, 2.0))
    alpha = lam1 * (1.0 + c_ridge)
    return alpha, lam1 / (alpha + eps)


def ld_window_bp(r2) -> Column:
    """Distance in base pairs within which a pair of variants is compared, for a threshold of r2."""
    return (F.lit(100.0) / _c(r2)).cast("int")


def auto_trials(m, most, least: int = 5) -> Column:
    """Number of search trials for m predictors."""
    return F.greatest(F.lit(least), F.least(_c(most), F.ceil(F.sqrt(F.greatest(F.lit(1), _c(m))) / 2))).cast("int")


def auto_trials_number(m: int, most: int, least: int = 5) -> int:
    return max(least, min(most, math.ceil(math.sqrt(max(1, m)) / 2)))


def clip01(x) -> Column:
    """Clipped to [0, 1]; NaN and null stay null."""
    return F.when(_c(x).isNotNull() & ~F.isnan(_c(x)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x))))


def validation_size(n, share: float = 0.2) -> Column:
    """Rows held out of n: none below 25 rows or for a share outside (0, 0.9)."""
    size = F.greatest(F.lit(5), F.floor(_c(n) * share))
    return F.when((_c(n) >= 25) & F.lit(0 < share < 0.9), size).otherwise(0).cast("int")


def h2_reported(h2_val, h2_ld, h2_diag) -> Column:
    """The first of held-out, LD-aware and diagonal heritability that is a number, clipped to [0, 1]."""
    first = F.coalesce(*[F.when(~F.isnan(_c(x)), _c(x)) for x in (h2_val, h2_ld, h2_diag)])
    return clip01(first)


def r2_from_sums(n, sse, sst) -> Column:
    """1 - sse/sst in [0, 1]; 0 below two pairs or without variance."""
    return F.when((_c(n) < 2) | (_c(sst) <= 0), 0.0).otherwise(clip01(F.lit(1.0) - F.try_divide(_c(sse), _c(sst))))
