import random
from datetime import datetime, timedelta

from cisweave.operators.orphans import orphan_references

REFS = "kind int, src int, key string, t timestamp_ntz, row_id long"
PARENTS = "kind int, key string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def brute(refs, parents):
    return sorted(
        (k, s, i) for k, s, key, t, i in refs
        if key is not None and not any(pk == k and p == key and a is not None and t is not None and a <= t and (z is None or z > t) for pk, p, a, z in parents)
    )


def found(spark, refs, parents, **kw):
    return sorted(tuple(r) for r in orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), **kw).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    start = datetime(2023, 1, 1)

    def at():
        return start + timedelta(days=rng.randrange(500), seconds=rng.choice([0, 0, 7]))

    parents = []
    for _ in range(150):
        a = at()
        parents.append((rng.randrange(2), f"k{rng.randrange(60)}", a if rng.random() > 0.05 else None, a + timedelta(days=rng.randrange(200)) if rng.random() < 0.6 else None))
    # a hot key with a third of the references, nulls, repeated rows
    refs = [(rng.randrange(2), rng.randrange(3), rng.choice(["k1", f"k{rng.randrange(80)}", f"k{rng.randrange(80)}", None]), at() if rng.random() > 0.05 else None, i) for i in range(900)]
    refs += refs[:5]
    for ranges in (1, 16):
        assert found(spark, refs, parents, ranges=ranges) == brute(refs, parents)


def test_more_than_one_word_of_keys(spark):
    t = datetime(2023, 5, 5)
    parents = [(0, f"k{i}", datetime(2023, 1, 1), None) for i in range(300)]
    refs = [(0, 0, f"k{i}", t, i) for i in range(400)]
    assert found(spark, refs, parents, ranges=1) == [(0, 0, i) for i in range(300, 400)]


def test_extra_columns_with_names_in_use(spark):
    t = datetime(2023, 5, 1)
    refs = spark.createDataFrame([(0, 0, "a", t, 1, "x", 2, 3)], REFS + ", period string, mask int, code int")
    parents = spark.createDataFrame([(0, "b", t, None, 7)], PARENTS + ", rng int")
    assert [tuple(r) for r in orphan_references(refs, parents).collect()] == [(0, 0, 1)]


def test_edges_and_empty(spark):
    t = datetime(2023, 5, 1)
    parents = [(0, "a", t, datetime(2023, 6, 1))]
    refs = [(0, 0, "a", t, 1), (0, 0, "a", datetime(2023, 6, 1), 2), (0, 0, "a", datetime(2023, 4, 30, 23, 59, 59), 3), (1, 0, "a", t, 4)]
    assert found(spark, refs, parents) == [(0, 0, 2), (0, 0, 3), (1, 0, 4)]
    assert found(spark, [], parents) == []
    assert found(spark, refs[:1], []) == [(0, 0, 1)]


def test_odd_dates_do_not_multiply_parents(spark):
    years = [datetime(y, 3, 4) for y in (1900, 2023, 9998)]
    refs = [(0, 0, k, t, i) for i, (k, t) in enumerate((k, t) for k in ("a", "b", "c") for t in years)]
    parents = [(0, "a", datetime(1900, 1, 1), None), (0, "b", datetime(1900, 3, 1), datetime(2023, 3, 2)), (0, "c", datetime(2023, 3, 1), datetime(2023, 4, 1))]
    assert found(spark, refs, parents) == brute(refs, parents)
