import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cisweave.llm import proportional as p

CATS = "plan_id int, chrom string, bin_no int, m_low int, m_high int, target_share double, min_rows int, sample_rows int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 8), st.integers(0, 60), st.integers(0, 3)), min_size=1, max_size=20), st.integers(0, 200))
def test_allocation_uses_the_pool_and_no_more(leaves, size):
    share, least, pool, parent = (np.array(x) for x in zip(*leaves))
    got = p.allocate(share, least, pool, parent.astype(str), size)
    assert (got["drawn"] <= pool).all() and (got["drawn"] >= 0).all()
    if share.sum() > 0 or least.sum() > 0:
        assert got["drawn"].sum() == min(size, pool.sum())
        assert got["quota"].sum() == size
    if size >= least.sum() and (pool >= size).all():
        assert (got["drawn"] >= least).all()


def test_unmet_goes_to_siblings_then_cousins():
    share, least = np.full(4, 0.25), np.zeros(4)
    parent = np.array(["a", "a", "b", "b"])
    got = p.allocate(share, least, np.array([5, 100, 100, 100]), parent, 100)
    assert list(got["drawn"]) == [5, 45, 25, 25] and list(got["from_siblings"]) == [0, 20, 0, 0] and got["from_cousins"].sum() == 0
    got = p.allocate(share, least, np.array([5, 30, 100, 100]), parent, 100)
    assert list(got["drawn"]) == [5, 30, 33, 32] and got["from_cousins"].sum() == 15


def test_minimum_of_small_categories():
    got = p.allocate(np.array([0.98, 0.01, 0.01]), np.array([0, 10, 10]), np.array([1000, 50, 50]), np.array(["a", "a", "b"]), 100)
    assert list(got["quota"]) == [80, 10, 10]


def _tables(spark, items, cats):
    return spark.createDataFrame(items, "key string, chrom string, value int, rank int"), spark.createDataFrame(cats, CATS)


def test_sample_is_stable_and_reports_shortage(spark):
    items = [(f"k{i}", "1" if i % 3 else "2", i % 50, 7) for i in range(600)] + [("n", None, 3, 0), ("m", "1", None, 0)]
    cats = [(1, "1", 1, 0, 9, 0.5, 5, 100), (1, "1", 2, 10, None, 0.1, 5, 100), (1, "2", 1, None, 49, 0.4, 5, 100), (2, "9", 1, 0, 9, 1.0, 0, 10)]
    i, c = _tables(spark, items, cats)
    out = []
    for parts in (1, 6):
        m = p.category_members(i.repartition(parts), c)
        a = p.allocation(m, c)
        out.append((sorted(map(tuple, a.collect())), sorted(map(tuple, p.draw(m, a, 13).collect()))))
    assert out[0] == out[1]
    drawn = {(r[0], r[1], r[2]): r[5] for r in out[0][0]}
    assert drawn == {(1, "1", 1): 50, (1, "1", 2): 10, (1, "2", 1): 40, (2, "9", 1): 0}
    assert len(out[0][1]) == 100 and len(set(out[0][1])) == 100
    assert [r[:3] for r in out[0][0] if r[-1]] == [(2, "9", 1)]


def test_empty_and_null(spark):
    i, c = _tables(spark, [], [(1, "1", 1, 0, 9, None, None, None)])
    m = p.category_members(i, c)
    assert [(r.drawn, r.is_short) for r in p.allocation(m, c).collect()] == [(0, False)]
    assert p.draw(m, p.allocation(m, c), 1).count() == 0
    assert p.allocation(m, c.limit(0)).count() == 0


def test_extra_columns_with_names_in_use(spark):
    from pyspark.sql import functions as F

    i, c = _tables(spark, [("k", "1", 3, 0), ("l", "1", 4, 0)], [(1, "1", 1, 0, 9, 1.0, 0, 1)])
    m = p.category_members(i.withColumns({"plan_id": F.lit(9), "bin_no": F.lit(9), "_chrom": F.lit("z")}), c)
    a = p.allocation(m, c.withColumn("pool", F.lit(5)))
    assert p.draw(m.withColumns({"rank": F.lit(0), "drawn": F.lit(7), "_p": F.lit("")}), a, 1).count() == 1


def test_latest_usable(spark):
    rows = spark.createDataFrame([("a", 5, 1, 1), ("a", -9, 2, 2), ("a", 7, 1, 3), ("b", None, 1, 4), ("c", 0, 1, 5), (None, 3, 1, 6)], "k string, v int, t int, no int")
    assert [tuple(r) for r in p.latest_usable(rows, "k", "v", ["t", "no"]).collect()] == [("a", 7)]
