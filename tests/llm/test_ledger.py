import hashlib
import math

from cisweave.llm import ledger, sampling


def pri(seed, k):
    return hashlib.md5(f"{seed}|{k}".encode()).hexdigest()


def brute(rows, seed, share, least):
    first = {}
    for k, g, b in rows:
        if k is not None:
            x = first.setdefault(k, [g, b])
            x[1] = min(x[1], b)
    held = set()
    for b in sorted({v[1] for v in first.values()}):
        groups = {}
        for k, (g, fb) in first.items():
            if fb <= b:
                groups.setdefault(g, []).append(k)
        for g, ks in groups.items():
            need = max(math.ceil(len(ks) * share), least) - len(held & set(ks))
            held |= set(sorted((k for k in ks if k not in held), key=lambda k: (pri(seed, k), k))[: max(0, need)])
    return held


ROWS = [(f"s{i % 230}", ("a", "a", "b", None)[i % 230 % 4], 1 + (i % 230) // 80) for i in range(300)] + [(None, "a", 1)]


def sample(spark, rows, path, parts=3):
    df = spark.createDataFrame(rows, "key string, grp string, batch int").repartition(parts)
    return ledger.grow(ledger.members(df, 7), path, 0.1, 2)


def test_same_on_every_partitioning_and_as_brute_force(spark, tmp_path):
    want = brute(ROWS, 7, 0.1, 2)
    for parts in (1, 5):
        got = sample(spark, ROWS, f"{tmp_path}/{parts}", parts).collect()
        assert {r.key for r in got} == want and len(got) == len(want)


def test_growth_keeps_what_was_selected(spark, tmp_path):
    path = f"{tmp_path}/l"
    early = {r.key for r in sample(spark, [r for r in ROWS if r[2] == 1], path).collect()}
    rerun = sample(spark, [r for r in ROWS if r[2] == 1], path)
    assert {r.key for r in rerun.collect()} == early
    grown = {r.key for r in sample(spark, ROWS, path).collect()}
    assert early < grown == brute(ROWS, 7, 0.1, 2)
    late = sample(spark, [*ROWS, *[(f"late{i}", "a", 1) for i in range(100)]], path)
    keys = [r.key for r in late.collect()]
    assert grown < set(keys) and len(keys) == len(set(keys)) and len(keys) >= len(grown) + 9


def test_broken_round_is_written_again(spark, tmp_path):
    path = f"{tmp_path}/l"
    want = {r.key for r in sample(spark, ROWS, path).collect()}
    (tmp_path / "l/batch=3/_SUCCESS").unlink()
    assert {r.key for r in sample(spark, ROWS, path).collect()} == want


def test_empty_population(spark, tmp_path):
    assert sample(spark, [], f"{tmp_path}/e").count() == 0
    assert sample(spark, [(None, "a", 1)], f"{tmp_path}/e").count() == 0
    assert [r.key for r in sample(spark, [("x", None, None)], f"{tmp_path}/e").collect()] == ["x"]


def test_query_keeps_earlier_sites_as_tables_grow(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "cpg_id string, chrom string, batch_no int").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/sites.parquet")
        return {r.site for r in sampling.p4_sample(spark, str(tmp_path)).collect()}

    rows = [(f"1_{1000 + i}", "1", 1) for i in range(100)]
    early = write(rows)
    assert write(rows) == early and len(early) == 10
    late = write([*rows, *[(f"1_{5000 + i}", "1", 1) for i in range(300)]])  # under the old batch
    assert early < late and len(late) == 40
