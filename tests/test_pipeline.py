import numpy as np
import pytest
from pyspark.sql import functions as F

from cisweave.functions.boosting import Settings
from cisweave.operators import cis, ld, qc
from cisweave.plans import fit, pipeline, tuning

FAST = Settings(n_iter=10, n_trials=3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n, m = 50, 100
    x = rng.integers(0, 3, (m, n)).astype(float)
    y = {f"1_{150000 + 20000 * i}": (x[45 + i] * 0.9 + rng.normal(0, 0.5, n)) for i in range(3)}
    geno = spark.createDataFrame([(j, "1", f"rs{j}", 100000 + 1000 * j, x[j].tolist()) for j in range(m)], "snp_idx long, chrom string, snp string, pos long, dosages array<float>").cache()
    pheno = spark.createDataFrame([(k, i, float(v)) for k, ys in y.items() for i, v in enumerate(ys)], "pheno_id string, sample_idx int, y double").cache()
    sites = spark.createDataFrame([(k, "1", int(k[2:])) for k in y] + [("1_9000000", "1", 9000000)], "cpg_id string, chrom string, cpg_pos long")
    return geno, pheno, sites, x, y


def test_summary_of_sites(spark, data):
    geno, pheno, sites, *_ = data
    rows = {r.cpg_id: r for r in pipeline.run_sites(sites, geno, pheno, window_size=20_000, settings=FAST).collect()}
    assert rows["1_9000000"].status in ("no_snps", "no_phenotype") and len(rows) == 4
    for k, r in rows.items():
        if r.status == "ok":
            assert r.num_snps > 0 and r.n == 50 and 0 <= r.h2 <= 1 and 0 <= r.final_r2 <= 1 and r.n_iter <= 10
    assert rows["1_150000"].final_r2 > 0.3


def test_does_not_depend_on_partitions_or_tiles(spark, data):
    geno, pheno, sites, *_ = data
    w = cis.windows_of_sites(sites)
    a = fit.summary(fit.fit_windows(w, geno, pheno, window_size=20_000, settings=FAST)).orderBy("window_id").collect()
    b = fit.summary(fit.fit_windows(w.repartition(7), geno.repartition(5), pheno.repartition(3), window_size=20_000, settings=FAST, tile_width=1_000_000, windows_per_task=1)).orderBy("window_id").collect()
    assert a == b


def test_error_is_isolated(spark, data):
    geno, pheno, sites, *_ = data

    def broken(spec):
        if spec["window_id"] == "1_150000":
            raise ValueError("no")
        return {"fixed_alpha": 0.1, "fixed_l1_ratio": 0.5}

    rows = {r.cpg_id: r for r in pipeline.run_sites(sites, geno, pheno, window_size=20_000, settings=FAST, fixed_params=broken).collect()}
    assert rows["1_150000"].status == "error" and "no" in rows["1_150000"].error and rows["1_170000"].alpha == 0.1


def test_resume_equals_uninterrupted_run(spark, data, tmp_path):
    geno, pheno, sites, *_ = data
    full = pipeline.run_sites(sites, geno, pheno, f"{tmp_path}/a", window_size=20_000, settings=FAST, checkpoint_interval=2, save_full=True)
    pipeline.run_sites(sites.limit(2), geno, pheno, f"{tmp_path}/b", window_size=20_000, settings=FAST)
    again = pipeline.run_sites(sites, geno, pheno, f"{tmp_path}/b", window_size=20_000, settings=FAST, checkpoint_interval=1)
    assert full.orderBy("window_id").collect() == again.orderBy("window_id").collect()
    batches = len(list((tmp_path / "b/cpg_checkpoint").glob("batch-*")))
    pipeline.run_sites(sites, geno, pheno, f"{tmp_path}/b", window_size=20_000, settings=FAST)
    assert len(list((tmp_path / "b/cpg_checkpoint").glob("batch-*"))) == batches
    pipeline.run_sites(sites, geno, pheno, f"{tmp_path}/b", window_size=20_000, settings=FAST, resume=False)
    assert len(list((tmp_path / "b/cpg_checkpoint").glob("batch-*"))) == 1
    assert spark.read.parquet(f"{tmp_path}/a/cpg.betas.parquet").where("beta = 0").count() == 0
    assert {"iteration", "h2"} <= set(spark.read.parquet(f"{tmp_path}/a/cpg.h2.parquet").columns)


def test_blacklists(spark, data):
    geno, pheno, sites, *_ = data
    by_id = spark.createDataFrame([("1_150000",)], "cpg_id string")
    by_pos = spark.createDataFrame([(1, 150000)], "Chrom int, Pos long")
    by_range = spark.createDataFrame([("1", 150000, 150000), ("1", 1, 2)], "Chrom string, Start long, End long")
    for regions in (by_id, by_pos, by_range):
        r = {x.cpg_id: x.status for x in pipeline.run_sites(sites, geno, pheno, regions=regions, window_size=20_000, settings=FAST).collect()}
        assert r["1_150000"] == "blacklisted" and len(r) == 4


def test_empty_windows_and_single(spark, data):
    geno, pheno, sites, *_ = data
    assert pipeline.run_sites(sites.limit(0), geno, pheno).count() == 0
    one = pipeline.run_single(spark, geno, pheno, 1, 150000, pheno_id="1_150000", window_size=20_000, settings=FAST)
    assert one["num_snps"] == len(one["snp_ids"]) == len(one["betas"]) and set(one["kept_snps"]) <= set(one["snp_ids"])
    assert pipeline.run_single(spark, geno, pheno, "1", 9_000_000, pheno_id="1_150000", window_size=50_000) is None


def test_missing_phenotypes_and_calls(spark, data):
    geno, pheno, sites, x, y = data
    gaps = pheno.withColumn("y", F.when(F.col("sample_idx") % 10 == 0, float("nan")).otherwise(F.col("y")))
    r = pipeline.run_sites(sites.limit(1), geno, gaps, window_size=20_000, settings=FAST).first()
    assert r.status == "ok" and r.n == 45
    holes = geno.withColumn("dosages", F.transform("dosages", lambda d, i: F.when((F.col("snp_idx") == 45) & (i == 3), None).otherwise(d)))
    strict, first = (fit.fit_windows(cis.windows_of_sites(sites.limit(1)), holes, pheno, window_size=20_000, settings=FAST, impute_first=f).first() for f in (False, True))
    assert "rs45" not in strict.snp_ids and "rs45" in first.snp_ids


def test_by_chromosome(spark, data, tmp_path):
    geno, pheno, sites, x, y = data
    sites.toPandas().to_parquet(f"{tmp_path}/m_1.parquet")
    import pandas as pd

    pd.DataFrame(y).to_parquet(f"{tmp_path}/p_1.parquet")
    out = pipeline.run_by_chromosome(spark, [1, 2], geno, f"{tmp_path}/m_{{chrom}}.parquet", f"{tmp_path}/p_{{chrom}}.parquet", f"{tmp_path}/out", window_size=20_000, settings=FAST)
    direct = pipeline.run_sites(sites, geno, pheno, window_size=20_000, settings=FAST)
    cols = ["cpg_id", "final_r2", "num_snps", "status"]
    assert sorted(out.select(cols).collect()) == sorted(direct.select(cols).collect())
    pipeline.write_statistics(out, f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").first()["total"] == 3


def test_clumping_by_hand():
    x = np.array([[0, 0, 2, 1], [1, 1, 0, 1], [2, 2, 1, 1], [0, 0, 0, 1]], float)
    pos = np.array([100, 200, 300, 400])
    assert ld.clump(x, pos, np.array([0.5, 0.9, 0.3, np.nan]), 0.9) == [1, 2, 3]
    assert ld.clump(x, np.array([100, 900, 1000, 1100]), np.array([0.5, 0.9, 0.3, 0.1]), 0.9) == [1, 0, 2, 3]
    assert ld.clump(np.zeros((4, 0)), np.zeros(0), np.zeros(0)) == []


def test_cis_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = [(int(i), str(rng.integers(1, 3)), f"rs{i}", int(rng.integers(0, 100_000))) for i in range(400)]
    w = [(f"w{i}", str(rng.integers(1, 3)), int(s), int(s + rng.integers(0, 9000)), "p") for i, s in enumerate(rng.integers(0, 100_000, 60))]
    got = cis.cis_join(spark.createDataFrame(w, "window_id string, chrom string, start long, `end` long, pheno_id string"), spark.createDataFrame(v, "snp_idx long, chrom string, snp string, pos long"), 500, True, 1000)
    want = sorted((a[0], b[0]) for a in w for b in v if a[1] == b[1] and a[2] - 500 <= b[3] <= a[3] + 500)
    assert sorted((r.window_id, r.snp_idx) for r in got.collect()) == want


def test_constant_and_missing_in_statistics(spark):
    rows = [(i, s, float(d) if d is not None else None) for s, ds in {0: [1, 1, 1], 1: [0, 1, 2], 2: [0, None, 2], 3: [float("nan"), 0, 1]}.items() for i, d in enumerate(ds)]
    g = spark.createDataFrame(rows, "sample_idx int, snp_idx long, dosage double")
    assert [r[0] for r in qc.zero_variance_filter(g).select("snp_idx").distinct().collect()] == [1]
    assert qc.zero_variance_filter(g, impute_first=True).select("snp_idx").distinct().count() == 3
    y = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0)], "sample_idx int, y double")
    r = {x.snp_idx: x.abs_r for x in qc.abs_corr_with(g.where("snp_idx < 2"), y).collect()}
    assert r[0] == 0 and abs(r[1] - 1) < 1e-9
    filled = {(x.snp_idx, x.sample_idx): x.dosage for x in qc.impute(g).collect()}
    assert filled[(2, 1)] == 0 and filled[(3, 0)] == 0


def test_tuning(spark, data):
    geno, pheno, sites, *_ = data
    w = cis.windows_of_sites(sites)
    chosen = tuning.select_loci(w, geno, 0.5, 2, 10, window_size=20_000)
    assert chosen.count() == 2 and chosen.where("m_raw > 0").count() == 2
    assert tuning.select_loci(w, geno, 1.0, 1, 10, window_size=20_000, exclude_failed=chosen).join(chosen, "window_id").count() == 0
    with pytest.raises(ValueError, match="No windows"):
        tuning.select_loci(w.where("start > 8000000"), geno, window_size=20_000)
    grid = {"c_lambda": (0.5, 1.0), "c_ridge": (1.0,), "subsample_frac": (0.7,), "batch_size": (64,)}
    best = tuning.global_tune(chosen, geno, pheno, grid, settings=FAST, window_size=20_000)
    assert best["c_lambda"] in (0.5, 1.0) and np.isfinite(best["score"])
    two = w.withColumn("chrom", F.lit("1"))
    with pytest.raises(ValueError):
        tuning.leave_chromosomes_out(two, [2], geno, pheno, grid=grid, settings=FAST, window_size=20_000)
    assert tuning.infer_n(genotypes=geno) == 50 and tuning.target_size(1000, 0.0025, 1, 9) == 2
    assert tuning.odd_even([1, 2, 3]) == ([1, 3], [2]) and tuning.odd_even([1, 3]) == ([1, 3], [1, 3])


def test_arriving_manifests(spark, data, tmp_path):
    from cisweave.streaming.arrivals import fit_arrivals

    geno, pheno, sites, *_ = data
    for n in (2, 4):
        sites.orderBy("cpg_pos").limit(n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = fit_arrivals(spark, f"{tmp_path}/in", geno, pheno, f"{tmp_path}/out", window_size=20_000, settings=FAST)
        q.awaitTermination(120)
        assert q.exception() is None
        done = pipeline.completed(spark, f"{tmp_path}/out/cpg_checkpoint")
        assert done.count() == n
    assert len(list((tmp_path / "out/cpg_checkpoint").glob("batch-*"))) == 2


def test_repeated_phenotype_rows(spark, data):
    geno, pheno, sites, *_ = data
    again = pheno.unionByName(pheno.limit(70)).unionByName(pheno.limit(5).withColumn("y", F.lit(float("nan"))))
    a, b = (pipeline.run_sites(sites, geno, p, window_size=20_000, settings=FAST).orderBy("window_id").select("window_id", "n", F.round("final_r2", 9)).collect() for p in (pheno, again))
    assert a == b


def test_failed_window_gets_its_new_record(spark, data, tmp_path):
    geno, pheno, sites, *_ = data

    def broken(spec):
        raise ValueError("no")

    out = f"{tmp_path}/out"
    first = pipeline.run_sites(sites, geno, pheno, out, window_size=20_000, settings=FAST, fixed_params=broken)
    first = spark.createDataFrame(first.collect(), first.schema)
    assert first.where("status = 'error'").count() == 3
    for _ in range(2):
        again = pipeline.run_sites(sites, geno, pheno, out, window_size=20_000, settings=FAST)
        assert again.where("status = 'error'").count() == 0 and again.count() == 4
    assert pipeline._one_each(first.unionByName(again), "window_id").where("status = 'error'").count() == 0
    ids = [r[0] for r in pipeline.completed_ids(spark, f"{out}/cpg_checkpoint").collect()]
    assert ids == sorted(ids) and len(ids) == 4


def test_batches_are_neighbours(spark):
    rows = [(f"{c}_{i}", c, 1_000 * i, 1_000 * i) for c in ("1", "2") for i in range(200)] + [("x", None, 5, 5), ("y", "1", None, None)]
    w = spark.createDataFrame(rows, "window_id string, chrom string, start long, end long")
    got = pipeline.batches_of(w, 50, 10_000)
    assert got.count() == len(rows)
    ends = got.where("start IS NOT NULL").groupBy("_chrom", "_batch").agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.count("*").alias("n")).orderBy("_chrom", "lo").collect()
    assert max(r.n for r in ends) <= 60 and len([r for r in ends if r["_chrom"] == "1"]) >= 4
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]) if a["_chrom"] == b["_chrom"])
    assert sum(r.hi - r.lo for r in ends) <= 2 * 199_000  # together about one pass over the positions


def test_arrays_as_inputs(spark):
    import pandas as pd

    from cisweave.sources import readers

    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (40, 6)).astype(float)
    variants = pd.DataFrame({"chrom": 1, "snp": [f"rs{i}" for i in range(6)], "pos": range(100, 700, 100)})
    g = readers.genotypes_of_arrays(spark, x, variants)
    y = readers.phenotypes_of_arrays(spark, pd.DataFrame({"1_300": x[:, 2] + 0.1 * rng.normal(size=40), "name": "a"}))
    assert y.select("pheno_id").distinct().count() == 1 and y.count() == 40
    assert pipeline.run_single(spark, g, y, 1, 300, pheno_id="1_300", window_size=1_000, settings=FAST, by_hand=True)["final_r2"] > 0.5
    assert readers.phenotypes_of_arrays(spark, np.ones(3)).count() == 3
    v = g.select("chrom", "snp", "pos")
    assert readers.union_variants([v, v]).count() == 6 and readers.preview(v).count() == 5


def test_selection_of_sites(spark):
    rows = spark.range(2_000).selectExpr("concat('1_', id) AS window_id", "'1' AS chrom", "id AS start", "id AS `end`", "CAST(id % 7 AS int) AS m_raw")
    assert tuning.select_sites(rows, None).count() == 50
    with pytest.raises(ValueError, match="No CpGs with SNPs"):
        tuning.select_sites(rows.where("m_raw = 0"), None)


def test_prepared_once_for_all_penalties(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (40, 12)).astype(np.float32)
    y, pos, snp = (x[:, 3] + 0.2 * rng.normal(size=40)).astype(float), np.arange(12) * 1_000, np.array([f"rs{i}" for i in range(12)], object)
    calls = []
    inner = fit.prepare
    monkeypatch.setattr(fit, "prepare", lambda *a, **k: calls.append(1) or inner(*a, **k))
    windows = [{"window_id": f"w{n}#{c}", "pheno_id": "p", "chrom": "1", "start": 0, "end": 0, "lo": n, "hi": 99_000, "y": y, "fixed_alpha": 0.05 * (c + 1), "fixed_l1_ratio": 0.5} for n in range(2) for c in range(4)]
    ready = {}
    got = [fit.fit_one(w, snp, pos, x, FAST, {}, None, ready) for w in windows]
    assert len(calls) == 2
    assert [g["final_r2"] for g in got] == [fit.fit_one(w, snp, pos, x, FAST, {})["final_r2"] for w in windows] and {g["status"] for g in got} == {"ok"}
