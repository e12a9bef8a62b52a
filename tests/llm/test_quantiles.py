import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cisweave.llm import quantiles as q


def off(values, value, p):
    v = np.sort(values)
    r = min(len(v), max(1, math.ceil(p * len(v) - 1e-9)))
    first, last = np.searchsorted(v, value, "left") + 1, np.searchsorted(v, value, "right")
    return max(first - r, r - last, 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 40), min_size=1, max_size=120), min_size=1, max_size=9), st.sampled_from([0.0, 0.02, 0.1]))
def test_merged_summaries_keep_their_promise(parts, eps):
    arrays = [np.array(p, float) for p in parts]
    s = q.fold([q.compress(q.summarise(a), int(eps / 2 * len(a))) for a in arrays], eps)
    all_values = np.concatenate(arrays)
    n, v, lo, hi = s
    assert n == len(all_values) and (np.diff(v) >= 0).all() and v[0] == all_values.min() and v[-1] == all_values.max()
    for x, a, b in zip(v, lo, hi):  # some copy of the value has a rank within the bounds
        assert np.searchsorted(np.sort(all_values), x, "left") + 1 <= b and np.searchsorted(np.sort(all_values), x, "right") >= a
    assert q.rank_error(s) <= max(eps * n, 0) + 1e-9
    for p in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0):
        assert off(all_values, q.query(s, p)[0], p) <= q.rank_error(s)


def test_point_mass_costs_nothing():
    values = np.r_[np.zeros(100_000), np.random.default_rng(0).normal(size=50_000)]
    s = q.compress(q.summarise(values), 75)
    assert len(s[1]) < 1_000 and q.rank_error(s) <= 75 and q.query(s, 0.5)[0] == 0


@pytest.mark.parametrize("parts", [1, 37])
def test_in_spark_any_partitioning(spark, parts):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else "cold", float(x), float(round(x, 1))) for i, x in enumerate(rng.normal(size=6000))]
    rows += [("hot", None, float("nan")), (None, 5.0, float("inf")), ("only", float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, a double, metric double").repartition(parts)
    s = q.summaries(df, ["g"], ["a", "metric"], 0.01).cache()
    got = q.quantiles(q.merged(s, ["g"], 0.01), ["g"], [0.1, 0.5, 0.99]).collect()
    for r in got:
        own = np.array([x[1 if r.metric == "a" else 2] for x in rows if x[0] == r.g], dtype=float)
        own = own[np.isfinite(own)]
        assert r.n == len(own) and off(own, r.value, r.q) <= r.rank_error <= 0.01 * r.n
    assert {(r.g, r.metric) for r in got} == {("hot", "a"), ("hot", "metric"), ("cold", "a"), ("cold", "metric"), (None, "a")}


def test_flushes_within_a_partition(spark, monkeypatch):
    monkeypatch.setattr(q, "BUFFER", 500)
    df = spark.range(5000).selectExpr("cast(id AS double) AS x").coalesce(1)
    s = q.summaries(df, [], ["x"], 0.01).cache()
    m = q.merged(s, [], 0.01)
    r = q.quantiles(m, [], [0.5]).first()
    assert r.n == 5000 and abs(r.value - 2499) <= 50


def test_empty(spark):
    s = q.summaries(spark.createDataFrame([], "g string, x double"), ["g"], ["x"])
    assert q.quantiles(q.merged(s, ["g"]), ["g"], [0.5]).count() == 0
