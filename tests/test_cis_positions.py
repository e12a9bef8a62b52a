"""Pairs of windows and positions: the same as tested one by one, and stored in few bytes."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from cisweave.operators import cis


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [(i, str(rng.integers(1, 4)), f"rs{i}", int(p)) for i, p in enumerate(rng.integers(-2_000, 20_000, 3_000))]
    v += [(i, "2", "same", 7_777) for i in range(700)] + [(0, None, "none", 5), (0, "1", "none", None)]
    w = [(f"w{i}", str(rng.integers(1, 5)), int(s), None if i % 5 == 0 else int(s + rng.integers(-200, 9_000)), "p") for i, s in enumerate(rng.integers(-3_000, 22_000, 60))]
    w += [("at", "2", 7_777, 7_777, "p"), ("at", "2", 7_777, 7_777, "p"), ("none", None, 0, 9, "p"), ("none", "1", None, 9, "p")]
    windows, variants = spark.createDataFrame(w, "window_id string, chrom string, start long, `end` long, pheno_id string"), spark.createDataFrame(v, "snp_idx long, chrom string, snp string, pos long")
    for size, use, width in ((500, True, 1_000), (500, False, 1_000), (500, True, None), (30, True, 100_000)):
        h = size if use else 0
        want = sorted((a[0], a[1], b[3]) for a in w for b in v if None not in (a[1], a[2], b[3]) and a[1] == b[1] and a[2] - h <= b[3] <= (a[2] if a[3] is None else a[3]) + h)
        got = sorted(map(tuple, cis.cis_positions(windows, variants, size, use, width).collect()))
        assert len(want) > 1_000 and got == want


def test_query_is_stored_small(spark, tmp_path):
    """Many variants and sites on little of a few chromosomes: 1.7 million pairs, as SQL has them, in few bytes."""
    rng = np.random.default_rng(0)
    n, m, at = 8_000, 2_000, np.arange(10_000_000)
    near = at[(at * 7919) % 10_000_000 < 200_000]
    part = near[near % 22 < 4][:m]
    line = {"l_orderkey": np.arange(n), "l_linenumber": np.ones(n, "int32"), "l_partkey": np.arange(n), "l_suppkey": rng.integers(0, 4, n) + 22 * rng.integers(0, 9, n), "l_extendedprice": rng.integers(90_000, 290_000, n) / 100, "l_shipdate": np.zeros(n, "datetime64[us]")}
    pq.write_table(pa.table(line), f"{tmp_path}/lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": part}), f"{tmp_path}/part.parquet")
    entry.queries()["cis_range_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = f"SELECT window_id, chrom, pos, count(*) FROM '{tmp_path}/out/*.parquet' GROUP BY ALL", f"SELECT window_id, chrom, pos, count(*) FROM ({entry.oracle_sql()['cis_range_join']}) GROUP BY ALL"
    assert con.sql(f"SELECT count(*) FROM (({got} EXCEPT {want}) UNION ALL ({want} EXCEPT {got}))").fetchall() == [(0,)]
    rows, size = con.sql(f"SELECT count(*) FROM '{tmp_path}/out/*.parquet'").fetchall()[0][0], sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet")))
    assert rows > 500_000 and size < 0.4 * rows
