import random

from pyspark.sql import functions as F

from cisweave.operators.ranking import bounded_broadcast, priority, spread_rank


def test_ranks_equal_a_plain_sort_and_ignore_partitioning(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("p", priority(1, "k"))
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r["p"], r["k"]) for r in df.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        want |= {k: i + 1 for i, (_, k) in enumerate(own)}
    for parts in (1, 7):
        got = {r["k"]: r["rank"] for r in spread_rank(df.repartition(parts), ["g"], "p", "k", digits=1).collect()}
        assert got == want


def test_broadcast_only_when_small(spark):
    df = spark.range(10)
    assert "broadcast" in bounded_broadcast(df, 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in bounded_broadcast(df, 9)._jdf.queryExecution().toString().lower()
