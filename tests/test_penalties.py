import math

import pytest
from pyspark.sql import functions as F

from cisweave.functions import penalties as p


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_clip_keeps_what_is_missing(spark):
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    assert one(spark, p.clip01(nan), p.clip01(null), p.clip01(F.lit(-2.0)), p.clip01(F.lit(0.3)), p.clip01(F.lit(7.0))) == (None, None, 0.0, 0.3, 1.0)
    assert one(spark, p.h2_reported(nan, null, F.lit(0.4)), p.h2_reported(nan, null, null), p.h2_reported(F.lit(2.0), nan, nan)) == (0.4, None, 1.0)


def test_penalty_formulas(spark):
    alpha, l1 = one(spark, *p.enet_from_targets(F.lit(100), 400, 1.4, 0.5))
    lam = 1.4 * math.sqrt(2 * math.log(100) / 400)
    assert alpha == pytest.approx(1.5 * lam) and l1 == pytest.approx(lam / (1.5 * lam + 1e-8))
    assert (alpha, l1) == pytest.approx(p.enet_numbers(100, 400, 1.4, 0.5))
    assert one(spark, *p.enet_from_targets(F.lit(0), 0)) == pytest.approx(p.enet_numbers(2, 2))
    assert one(spark, *p.alpha_l1_from_lambda(0.2, 0.3)) == pytest.approx((0.5, 0.2 / (0.5 + 1e-8)))


def test_sizes(spark):
    assert one(spark, p.ld_window_bp(0.2), p.ld_window_bp(0.1)) == (500, 1000)
    assert one(spark, p.auto_trials(F.lit(0), 20), p.auto_trials(F.lit(400), 20), p.auto_trials(F.lit(10**6), 20)) == (5, 10, 20)
    assert [p.auto_trials_number(m, 20) for m in (0, 400, 10**6)] == [5, 10, 20]
    assert one(spark, *[p.validation_size(F.lit(n), 0.2) for n in (24, 25, 1000)]) == (0, 5, 200)
    assert one(spark, p.r2_from_sums(F.lit(1), F.lit(0.0), F.lit(1.0)), p.r2_from_sums(F.lit(9), F.lit(1.0), F.lit(0.0)), p.r2_from_sums(F.lit(9), F.lit(1.0), F.lit(4.0))) == (0.0, 0.0, 0.75)
