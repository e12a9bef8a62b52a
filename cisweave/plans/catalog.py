"""Queries of the regression engine's operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cisweave.functions import ids, penalties, solver
from cisweave.functions.boosting import Settings, boost, h2_of_scores, h2_of_variances
from cisweave.operators import cis, ld, qc
from cisweave.plans import fit, pipeline, prep, tuning
from cisweave.plans import fixtures as fx
from cisweave.sources import readers
from cisweave.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(c, digits: int = DIGITS):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _clean_geno(spark, folder):
    return qc.zero_variance_filter(fx.genotypes_long(spark, folder))


CLEAN = f"{fx.SQL_GENO}, ok AS (SELECT snp_idx FROM g GROUP BY 1 HAVING var_pop(dosage) > 1e-8 AND count(*) = count(dosage)), c AS (SELECT g.* FROM g JOIN ok USING (snp_idx))"
CORR = """r AS (SELECT snp_idx, any_value(chrom) AS chrom, any_value(pos) AS pos, abs(covar_pop(dosage, y))*count(*) / (stddev_pop(dosage)*sqrt(count(*))*(stddev_pop(y)*sqrt(count(*))+1e-12)+1e-12) AS abs_r FROM c JOIN ph USING (sample_idx) GROUP BY snp_idx)"""


# Range joins


@query(f"WITH {fx.SQL_BIG} SELECT s.window_id, s.chrom, v.pos FROM s JOIN v ON v.chrom = s.chrom AND v.pos BETWEEN s.start-50000 AND s.start+50000")
def cis_range_join(spark, folder):
    return cis.cis_positions(fx.big_sites(spark, folder), fx.big_variants(spark, folder), 50_000, True)


@query(f"WITH {fx.SQL_BIG} SELECT s.window_id, CAST(count(v.pos) AS INTEGER) AS m_raw FROM s LEFT JOIN v ON v.chrom = s.chrom AND v.pos BETWEEN s.start-50000 AND s.start+50000 GROUP BY 1")
def cis_snp_count(spark, folder):
    return cis.snp_counts(fx.big_sites(spark, folder), fx.big_variants(spark, folder), 50_000, True).select("window_id", "m_raw")


@query(f"""WITH {CLEAN}, {fx.SQL_PHENO['planted']}, {fx.SQL_SITES}, {CORR}
SELECT cpg_id AS window_id, snp_idx, round(abs_r, 6) AS abs_r, n_snps FROM (SELECT cpg_id, snp_idx, abs_r, count(*) OVER (PARTITION BY cpg_id) AS n_snps, row_number() OVER (PARTITION BY cpg_id ORDER BY round(abs_r, 10) DESC, snp_idx) AS k
 FROM st JOIN r ON r.chrom = st.chrom AND r.pos BETWEEN st.cpg_pos-1600 AND st.cpg_pos+1600) WHERE k = 1""")
def top_snp_per_site(spark, folder):
    """The flagship: range join, variance filter, |r| with y, best variant of each site."""
    r = qc.abs_corr_with(_clean_geno(spark, folder), fx.phenotype(spark, folder, "planted"), ("snp_idx", "snp", "chrom", "pos"))
    hits = cis.cis_join(cis.windows_of_sites(fx.sites(spark)), r, fx.HALF, True)
    n = F.count("*").over(Window.partitionBy("window_id")).cast("long")
    best = qc.top_k(hits.withColumn("n_snps", n).withColumn("_s", F.round("abs_r", 10)), 1, ["window_id"], "_s")
    return best.select("window_id", "snp_idx", rounded("abs_r").alias("abs_r"), "n_snps")


# Statistics per variant


@query(f"WITH {fx.SQL_GENO} SELECT snp_idx, count(dosage) AS n, round(var_pop(dosage), 6) AS var FROM g GROUP BY 1 HAVING var_pop(dosage) > 1e-8 AND count(*) = count(dosage)")
def zero_variance_filter(spark, folder):
    return qc.variant_stats(_clean_geno(spark, folder)).select("snp_idx", "n", rounded("var").alias("var"))


@query(f"WITH {fx.SQL_GENO}, q AS (SELECT snp_idx, dosage, row_number() OVER (PARTITION BY snp_idx ORDER BY count(*) DESC, dosage) AS k FROM g WHERE dosage IS NOT NULL GROUP BY 1, 2) SELECT g.sample_idx, g.snp_idx, coalesce(g.dosage, q.dosage) AS dosage FROM g JOIN q ON q.snp_idx = g.snp_idx AND k = 1")
def impute_most_frequent(spark, folder):
    return qc.impute(fx.genotypes_long(spark, folder)).select("sample_idx", "snp_idx", "dosage")


@query(f"WITH {fx.SQL_GENO} SELECT sample_idx, snp_idx, round(coalesce(dosage, avg(dosage) OVER (PARTITION BY snp_idx)), 6) AS dosage FROM g")
def impute_mean(spark, folder):
    return qc.impute(fx.genotypes_long(spark, folder), "mean").select("sample_idx", "snp_idx", rounded("dosage").alias("dosage"))


@query(f"WITH {CLEAN}, {fx.SQL_PHENO['label']}, {CORR} SELECT snp_idx, round(abs_r, 6) AS abs_r FROM r")
def corr_with_y(spark, folder):
    return qc.abs_corr_with(_clean_geno(spark, folder), fx.phenotype(spark, folder, "label")).select("snp_idx", rounded("abs_r").alias("abs_r"))


@query(f"WITH {CLEAN}, {fx.SQL_PHENO['planted']}, {CORR} SELECT chrom, snp_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY round(abs_r, 10) DESC, snp_idx) AS rank FROM r) WHERE rank <= 8")
def topk_working_set(spark, folder):
    r = qc.abs_corr_with(_clean_geno(spark, folder), fx.phenotype(spark, folder, "planted"), ("snp_idx", "chrom"))
    return qc.top_k(r.withColumn("abs_r", F.round("abs_r", 10)), 8, ["chrom"]).select("chrom", "snp_idx", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CLEAN} SELECT sample_idx, snp_idx, round((dosage - avg(dosage) FILTER (sample_idx % 5 <> 0) OVER w) / (stddev_pop(dosage) FILTER (sample_idx % 5 <> 0) OVER w + 1e-6), 6) + 0.0 AS z FROM c WINDOW w AS (PARTITION BY snp_idx)")
def train_standardize(spark, folder):
    return qc.standardise(_clean_geno(spark, folder), F.col("sample_idx") % 5 != 0).select("sample_idx", "snp_idx", rounded("z").alias("z"))


# Linkage

PAIRS = "p AS (SELECT a.chrom, a.snp_idx AS i, b.snp_idx AS j, pow(covar_pop(a.dosage, b.dosage), 2) / nullif(var_pop(a.dosage)*var_pop(b.dosage), 0) AS r2 FROM c a JOIN c b ON a.sample_idx = b.sample_idx AND a.chrom = b.chrom AND a.snp_idx < b.snp_idx AND abs(a.pos-b.pos) <= 500 GROUP BY ALL)"


@query(f"WITH {CLEAN}, {PAIRS} SELECT chrom, i, j, round(r2, 6) AS r2 FROM p")
def ld_r2_pairs(spark, folder):
    return ld.ld_pairs(_clean_geno(spark, folder), ld.window_bp(0.2)).select("chrom", "i", "j", rounded("r2").alias("r2"))


def _recursive_clump(ranked: str, group: str) -> str:
    return f"""nb AS (SELECT k.{group} AS grp, k.snp_idx, k.rank, coalesce(list(o.snp_idx) FILTER (o.snp_idx IS NOT NULL), []) AS partners FROM {ranked} k
 LEFT JOIN (SELECT i, j FROM p WHERE r2 >= 0.2 UNION ALL SELECT j, i FROM p WHERE r2 >= 0.2) e ON e.i = k.snp_idx LEFT JOIN {ranked} o ON o.{group} = k.{group} AND o.snp_idx = e.j GROUP BY 1, 2, 3),
walk AS (SELECT grp, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM (SELECT DISTINCT grp FROM nb)
 UNION ALL SELECT w.grp, nb.rank, CASE WHEN list_has_any(w.kept, nb.partners) THEN w.kept ELSE list_append(w.kept, nb.snp_idx) END FROM walk w JOIN nb ON nb.grp = w.grp AND nb.rank = w.rank + 1),
fin AS (SELECT grp, kept FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank DESC) AS last FROM walk) WHERE last = 1)
SELECT grp AS {group}, unnest(kept) AS snp_idx, CAST(generate_subscripts(kept, 1) AS INTEGER) AS clump_rank FROM fin"""


def _stat_rows(spark, folder, name):
    geno = _clean_geno(spark, folder)
    r = qc.abs_corr_with(geno, fx.phenotype(spark, folder, name)).select("snp_idx", F.round("abs_r", 10).alias("stat"))
    return qc.transpose(geno).join(r, "snp_idx")


@query(f"WITH RECURSIVE {CLEAN}, {fx.SQL_PHENO['label']}, {CORR}, {PAIRS}, rk AS (SELECT chrom, snp_idx, row_number() OVER (PARTITION BY chrom ORDER BY round(abs_r, 10) DESC, snp_idx) AS rank FROM r), " + _recursive_clump("rk", "chrom"))
def ld_clump(spark, folder):
    return ld.clump_groups(_stat_rows(spark, folder, "label"), "chrom", 0.2)


@query(f"""WITH RECURSIVE {CLEAN}, {fx.SQL_PHENO['planted']}, {fx.SQL_SITES}, {CORR}, {PAIRS}, rk AS (SELECT cpg_id AS window_id, snp_idx, row_number() OVER (PARTITION BY cpg_id ORDER BY round(abs_r, 10) DESC, snp_idx) AS rank
 FROM st JOIN r ON r.chrom = st.chrom AND r.pos BETWEEN st.cpg_pos-1600 AND st.cpg_pos+1600), """ + _recursive_clump("rk", "window_id"))
def preprocess_genotypes(spark, folder):
    """Variance filter, imputation, |r| and clumping within each site's window, as a fit prepares it."""
    rows = cis.cis_join(cis.windows_of_sites(fx.sites(spark)), qc.transpose(_clean_geno(spark, folder)), fx.HALF, True)
    y = fit.phenotype_vectors(fx.phenotype(spark, folder, "planted")).select("y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "snp_idx"])
        x, y = np.stack(pdf["dosages"].to_list()).astype(float).T, np.asarray(pdf["y"].iloc[0], float)
        _, kept = fit.prepare(x, pdf["pos"].to_numpy(), y[: len(x)])
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "snp_idx": pdf["snp_idx"].to_numpy()[kept], "clump_rank": range(1, len(kept) + 1)})

    return rows.join(F.broadcast(y.limit(1))).groupBy("window_id").applyInPandas(run, "window_id string, snp_idx long, clump_rank int")


# Scores and one-variable fits


@query(f"WITH {fx.SQL_GENO}, {fx.SQL_PHENO['planted']}, q AS (SELECT y, CAST(0.5 AS DOUBLE)*a.dosage AS p FROM ph JOIN g a ON a.sample_idx = ph.sample_idx AND a.snp_idx = 10) SELECT count(*) AS n, round(avg((p-y)*(p-y)), 6) AS mse, round(greatest(0.0, least(1.0, 1 - sum((y-p)*(y-p)) / (var_pop(y)*count(*)))), 6) AS r2 FROM q")
def r2_clipped(spark, folder):
    y = fx.phenotype(spark, folder, "planted")
    p = fx.genotypes_long(spark, folder).where("snp_idx = 10").select("sample_idx", (0.5 * F.col("dosage")).alias("p"))
    q = y.join(p, "sample_idx").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("mse"), F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    return q.select("n", rounded("mse").alias("mse"), rounded(penalties.r2_from_sums(F.col("n"), F.col("sse"), F.col("sst"))).alias("r2"))


def _per_variant(spark, folder, f: Callable[[np.ndarray, np.ndarray], tuple], schema: str, rows: DataFrame | None = None):
    """f of each variant's dosages, one column, and the planted phenotype; schema: of what f returns, after snp_idx."""
    y = fit.phenotype_vectors(fx.phenotype(spark, folder, "planted")).select("y")
    rows = (qc.transpose(_clean_geno(spark, folder)) if rows is None else rows).select("snp_idx", "dosages").join(F.broadcast(y.limit(1)))
    names = ["snp_idx", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *f(np.asarray(x, float)[:, None], np.asarray(y, float)[: len(x)])) for i, x, y in zip(pdf["snp_idx"], pdf["dosages"], pdf["y"])], columns=names)

    return rows.mapInPandas(run, f"snp_idx long, {schema}")


@query(f"WITH {CLEAN}, {fx.SQL_PHENO['planted']} SELECT snp_idx, round(covar_pop(dosage, y) / (var_pop(dosage) + 10.0 / count(*)), 6) + 0.0 AS beta FROM c JOIN ph USING (sample_idx) GROUP BY 1")
def ridge_univariate(spark, folder):
    return _per_variant(spark, folder, lambda x, y: solver.ridge(x, y, 10.0)[0], "beta double").select("snp_idx", rounded("beta").alias("beta"))


@query(f"WITH {CLEAN}, {fx.SQL_PHENO['planted']} SELECT snp_idx, round(sign(cv) * greatest(abs(cv) - 0.02, 0) / (vr + 0.02), 6) + 0.0 AS beta FROM (SELECT snp_idx, covar_pop(dosage, y) AS cv, var_pop(dosage) AS vr FROM c JOIN ph USING (sample_idx) GROUP BY 1)")
def enet_univariate(spark, folder):
    return _per_variant(spark, folder, lambda x, y: solver.enet(solver.Gram.of(x), y, 0.04, 0.5)[0], "beta double").select("snp_idx", rounded("beta").alias("beta"))


def _boost_sql(rounds: int = 3, lam1: float = 0.02, lam2: float = 0.02) -> str:
    out = f"WITH {CLEAN}, {fx.SQL_PHENO['planted']}, r0 AS (SELECT sample_idx, y AS r FROM ph)"
    for i in range(rounds):
        out += f""", s{i} AS (SELECT snp_idx, covar_pop(dosage, r) AS cv, var_pop(dosage) AS vr, avg(dosage) AS mx, avg(r) AS mr FROM c JOIN r{i} USING (sample_idx) GROUP BY 1),
 b{i} AS (SELECT snp_idx, mx, mr, sign(cv)*greatest(abs(cv)-{lam1}, 0)/(vr+{lam2}) AS b FROM s{i} ORDER BY round(abs(cv)/sqrt(vr), 10) DESC, snp_idx LIMIT 1),
 r{i + 1} AS (SELECT r{i}.sample_idx, r - (mr + b*(dosage-mx)) AS r FROM r{i} JOIN b{i} ON true JOIN c ON c.sample_idx = r{i}.sample_idx AND c.snp_idx = b{i}.snp_idx)"""
    return out + " SELECT snp_idx, round(sum(b), 6) AS beta FROM (" + " UNION ALL ".join(f"SELECT snp_idx, b FROM b{i}" for i in range(rounds)) + ") GROUP BY 1 HAVING sum(b) <> 0"


@query(_boost_sql())
def boost_k1_3iter(spark, folder):
    """Three rounds of componentwise boosting over all variants in one group."""
    s = Settings(n_iter=3, working_set=1, refresh=1, standardize=False, val_frac=0.0, fixed_alpha=0.04, fixed_l1_ratio=0.5, early_stop=False)
    y = fit.phenotype_vectors(fx.phenotype(spark, folder, "planted"))
    rows = qc.transpose(_clean_geno(spark, folder)).withColumn("pheno_id", F.lit("planted")).join(y, "pheno_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("snp_idx")
        f = boost(np.stack(pdf["dosages"].to_list()).T, np.asarray(pdf["y"].iloc[0], float), s)
        return pd.DataFrame({"snp_idx": pdf["snp_idx"], "beta": f.betas})

    return rows.groupBy("pheno_id").applyInPandas(run, "snp_idx long, beta double").where("beta <> 0").select("snp_idx", rounded("beta").alias("beta"))


PLANTED = "bt AS (SELECT * FROM (VALUES (10::BIGINT, 0.5::DOUBLE), (11::BIGINT, 0.1::DOUBLE), (40::BIGINT, -0.4::DOUBLE)) t(snp_idx, beta))"


def _planted(spark):
    return spark.createDataFrame([(10, 0.5), (11, 0.1), (40, -0.4)], "snp_idx long, beta double")


def _planted_matrix(spark, folder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples x the three planted variants, their coefficients, the phenotype): a fixed number of columns, as in one fit."""
    rows = qc.transpose(fx.genotypes_long(spark, folder).join(_planted(spark).select("snp_idx"), "snp_idx")).join(_planted(spark), "snp_idx").orderBy("snp_idx").collect()
    y = fit.phenotype_vectors(fx.phenotype(spark, folder, "planted")).first()["y"]
    return np.array([r["dosages"] for r in rows], float).T, np.array([r["beta"] for r in rows]), np.array(y)


@query(f"WITH {fx.SQL_GENO}, {PLANTED} SELECT round(greatest(0.0, least(1.0, sum(v))), 6) AS h2_diag FROM (SELECT any_value(beta)*any_value(beta)*var_pop(dosage) AS v FROM g JOIN bt USING (snp_idx) GROUP BY snp_idx)")
def h2_diag(spark, folder):
    x, b, _ = _planted_matrix(spark, folder)
    return spark.createDataFrame([(round(h2_of_variances(x, b), DIGITS),)], "h2_diag double")


@query(f"WITH {fx.SQL_GENO}, {PLANTED}, {fx.SQL_PHENO['planted']}, q AS (SELECT a.beta*b.beta*covar_samp(x.dosage, z.dosage) AS v FROM bt a, bt b, g x, g z WHERE x.snp_idx = a.snp_idx AND z.snp_idx = b.snp_idx AND x.sample_idx = z.sample_idx GROUP BY a.snp_idx, b.snp_idx, a.beta, b.beta) SELECT round(greatest(0.0, least(1.0, (SELECT sum(v) FROM q) / (SELECT var_pop(y) FROM ph))), 6) AS h2_ld")
def h2_ld(spark, folder):
    """b' S b / var(y) as the variance of the samples' scores, which needs no pairs of variants."""
    return spark.createDataFrame([(round(h2_of_scores(*_planted_matrix(spark, folder)), DIGITS),)], "h2_ld double")


# Penalties and selection

COUNTS = f"{fx.SQL_BIG}, m AS (SELECT s.window_id, s.chrom, CAST(count(v.pos) AS INTEGER) AS m_raw FROM s LEFT JOIN v ON v.chrom = s.chrom AND v.pos BETWEEN s.start-50000 AND s.start+50000 GROUP BY 1, 2)"


def _counts(spark, folder):
    return cis.snp_counts(fx.big_sites(spark, folder), fx.big_variants(spark, folder), 50_000, True)


@query(f"WITH {COUNTS}, q AS (SELECT window_id, 1.4*sqrt(2*ln(greatest(m_raw, 2))/500.0) AS l FROM m WHERE m_raw > 1) SELECT window_id, round(l + 0.5*l, 6) AS alpha, round(l/(l + 0.5*l + 1e-8), 6) AS l1_ratio FROM q")
def enet_from_targets(spark, folder):
    alpha, l1 = penalties.enet_from_targets(F.col("m_raw"), 500, 1.4, 0.5)
    return _counts(spark, folder).where("m_raw > 1").select("window_id", rounded(alpha).alias("alpha"), rounded(l1).alias("l1_ratio"))


@query(f"WITH {COUNTS} SELECT window_id, CAST(greatest(5, least(20, ceil(sqrt(greatest(1, m_raw))/2))) AS INTEGER) AS trials FROM m")
def auto_trials(spark, folder):
    return _counts(spark, folder).select("window_id", penalties.auto_trials(F.col("m_raw"), 20).alias("trials"))


EDGES = "pool AS (SELECT *, md5('13|' || window_id) AS pri FROM m WHERE m_raw > 0), e AS (SELECT quantile_cont(m_raw, CAST(1 AS DOUBLE)/3) AS a, quantile_cont(m_raw, CAST(2 AS DOUBLE)/3) AS b, min(m_raw) AS lo, max(m_raw) AS hi FROM pool), bn AS (SELECT pool.*, CAST((CASE WHEN a > lo AND a < hi AND m_raw > a THEN 1 ELSE 0 END) + (CASE WHEN b > a AND b > lo AND b < hi AND m_raw > b THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM pool, e)"


@query(f"WITH {COUNTS}, {EDGES} SELECT bin, count(*) AS n, min(m_raw) AS lowest, max(m_raw) AS highest FROM bn GROUP BY 1")
def qcut_bins(spark, folder):
    pool = _counts(spark, folder).where("m_raw > 0")
    cuts = pool.agg(F.percentile("m_raw", F.array(F.lit(0.0), F.lit(1 / 3), F.lit(2 / 3), F.lit(1.0)))).first()[0]
    inner = sorted(set(cuts))[1:-1]
    return pool.withColumn("bin", tuning.quantile_bin("m_raw", inner)).groupBy("bin").agg(F.count("*").alias("n"), F.min("m_raw").alias("lowest"), F.max("m_raw").alias("highest"))


@query(f"""WITH {COUNTS}, {EDGES}, t AS (SELECT CAST(least(greatest(round_even(0.1*count(*), 0), 50), 500) AS BIGINT) AS target FROM bn),
f AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pri, window_id) <= 1 AS first FROM bn), need AS (SELECT greatest(0, target - (SELECT count(*) FROM f WHERE first)) AS need FROM t),
o AS (SELECT bin, row_number() OVER (ORDER BY bin) - 1 AS i, count(*) OVER () AS b FROM (SELECT DISTINCT bin FROM f WHERE NOT first)),
k AS (SELECT f.*, row_number() OVER (PARTITION BY f.bin ORDER BY pri, window_id) AS rk FROM f WHERE NOT first),
taken AS (SELECT window_id, m_raw FROM f WHERE first UNION ALL SELECT window_id, m_raw FROM k JOIN o USING (bin), need WHERE rk <= need // b + CASE WHEN i < need % b THEN 1 ELSE 0 END),
fill AS (SELECT window_id, m_raw, row_number() OVER (ORDER BY m_raw DESC, window_id) AS z FROM bn WHERE window_id NOT IN (SELECT window_id FROM taken))
SELECT window_id, m_raw FROM taken UNION ALL SELECT window_id, m_raw FROM fill, t WHERE z <= target - (SELECT count(*) FROM taken)""")
def select_tuning_stratified(spark, folder):
    from cisweave import storage

    counted = storage.materialise(_counts(spark, folder), "counts")
    return tuning.select_loci(counted, None, 0.1, 50, 500, per_chrom_min=1).select("window_id", "m_raw")


_GRID = "gr AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS combo, * FROM (SELECT CAST(a AS DOUBLE) AS c_lambda, CAST(b AS DOUBLE) AS c_ridge FROM (SELECT unnest([0.5, 1.0, 2.0]) AS a), (SELECT unnest([0.5, 1.0, 2.0]) AS b)))"


@query(f"WITH {fx.SQL_SITES}, {_GRID} SELECT cpg_id, c_lambda, c_ridge FROM st, gr")
def grid_cross_join(spark, folder):
    combos = tuning.grid_of(spark, {"c_lambda": (0.5, 1.0, 2.0), "c_ridge": (0.5, 1.0, 2.0), "subsample_frac": (0.7,), "batch_size": (4096,)})
    return fx.sites(spark).join(F.broadcast(combos)).select("cpg_id", "c_lambda", "c_ridge")


@query("WITH q AS (SELECT run_id, median(final_r2) AS score FROM cpg_summary WHERE final_r2 IS NOT NULL AND NOT isnan(final_r2) AND abs(final_r2) < 1e300 GROUP BY 1) SELECT run_id, round(score, 9) AS score FROM q ORDER BY score DESC, run_id LIMIT 1")
def median_score_argmax(spark, folder):
    best = tuning.best_combo(tuning.median_scores(table(spark, folder, "cpg_summary"), "run_id"), key="run_id")
    return spark.createDataFrame([(best["run_id"], round(best["score"], 9))], "run_id int, score double")


# Anti-joins and set operations

_S, _E = ids.sql_site("cpg_id"), ids.sql_site("cpg_id")


def _site_windows(spark, folder):
    return table(spark, folder, "sites").select(ids.site_key("cpg_id").alias("window_id")).where("window_id IS NOT NULL").distinct()


@query(f"SELECT DISTINCT {_S} AS window_id FROM sites WHERE {_S} IS NOT NULL AND {_S} NOT IN (SELECT {_E} FROM error_regions WHERE {_E} IS NOT NULL)")
def blacklist_anti_join(spark, folder):
    return cis.skip_blacklisted(_site_windows(spark, folder), table(spark, folder, "error_regions").select(ids.site_key("cpg_id").alias("cpg_id")))


@query(f"SELECT DISTINCT {_S} AS window_id FROM sites WHERE {_S} IS NOT NULL AND {_S} NOT IN (SELECT {_E} FROM cpg_summary WHERE status = 'ok' AND {_E} IS NOT NULL)")
def pending_anti_join(spark, folder):
    return cis.pending(_site_windows(spark, folder), table(spark, folder, "cpg_summary").where("status = 'ok'").select(ids.site_key("cpg_id").alias("window_id")))


@query(f"SELECT DISTINCT {ids.sql_site('cpg_id')} AS site, {ids.sql_site_chrom(ids.sql_site('cpg_id'), 'chrom')} AS chrom FROM sites WHERE {ids.sql_site_chrom(ids.sql_site('cpg_id'), 'chrom')} IN ('1','2','3','4','5','X')")
def chromosome_subset(spark, folder):
    k = ids.site_key("cpg_id")
    rows = table(spark, folder, "sites").select(k.alias("site"), ids.site_chrom(k, "chrom").alias("chrom"))
    return prep.chromosome_subset(rows, readers.chromosomes("1-5,X")).distinct()


@query(f"WITH a AS (SELECT DISTINCT {ids.sql_sample('iid')} AS iid FROM samples), b AS (SELECT DISTINCT {ids.sql_sample('iid')} AS iid FROM phenotypes WHERE {ids.sql_sample('iid')} IS NOT NULL) SELECT coalesce(a.iid, b.iid) AS iid, CASE WHEN b.iid IS NULL THEN 'only_a' WHEN a.iid IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.iid = b.iid")
def sample_alignment(spark, folder):
    a = table(spark, folder, "samples").groupBy(ids.sample_key("iid").alias("iid")).agg(F.min("sample_idx").alias("idx"))
    b = table(spark, folder, "phenotypes").where(ids.sample_key("iid").isNotNull()).groupBy(ids.sample_key("iid").alias("iid")).agg(F.min("pheno_row").alias("idx"))
    return prep.align_samples(a, b).select("iid", "side")


@query(f"SELECT 'both' AS what, count(*) AS n FROM (SELECT {ids.sql_sample('iid')} FROM samples INTERSECT SELECT {ids.sql_sample('iid')} FROM phenotypes) UNION ALL SELECT 'unused', count(*) FROM (SELECT {ids.sql_sample('iid')} FROM samples EXCEPT SELECT {ids.sql_sample('iid')} FROM phenotypes)")
def sample_set_operations(spark, folder):
    a, b = (table(spark, folder, t).groupBy(ids.sample_key("iid").alias("iid")).agg(F.min(i).alias("idx")) for t, i in (("samples", "sample_idx"), ("phenotypes", "pheno_row")))
    sides = prep.align_samples(a.where("iid IS NOT NULL"), b.where("iid IS NOT NULL"))
    n = sides.agg(F.count_if(F.col("side") == "both").alias("both"), F.count_if(F.col("side") == "only_a").alias("unused"))
    return n.unpivot([], ["both", "unused"], "what", "n")


@query(f"SELECT s, n FROM (SELECT {_S} AS s, count(*) AS n FROM (SELECT cpg_id FROM cpg_summary UNION ALL SELECT cpg_id FROM tuning_selection) GROUP BY 1)")
def union_dedupe_results(spark, folder):
    """Union of two result sets, one row per site with how often it came."""
    u = table(spark, folder, "cpg_summary").select("cpg_id").unionByName(table(spark, folder, "tuning_selection").select("cpg_id"))
    return u.groupBy(ids.site_key("cpg_id").alias("s")).agg(F.count("*").alias("n"))


@query("SELECT chrom % 2 = 1 AS train, count(*) AS n FROM (SELECT CAST(split_part(k, '_', 1) AS INTEGER) AS chrom FROM (SELECT DISTINCT " + _S + " AS k FROM sites) WHERE regexp_matches(k, '^[0-9]+_')) GROUP BY 1")
def odd_even_split(spark, folder):
    k = table(spark, folder, "sites").select(ids.site_key("cpg_id").alias("k")).distinct().where(F.col("k").rlike("^[0-9]+_")).withColumn("chrom", F.substring_index("k", "_", 1))
    odd, even = tuning.odd_even([r[0] for r in k.select("chrom").distinct().sort("chrom").collect()])  # chromosomes
    parts = [k.where(F.col("chrom").isin(own)).select(F.lit(train).alias("train")) for train, own in ((True, odd), (False, even))]
    return parts[0].unionByName(parts[1]).groupBy("train").agg(F.count("*").alias("n"))


# Phenotypes and methylation


@query(f"WITH {fx.SQL_GENO}, {fx.SQL_PHENO['planted']} SELECT 'planted' AS pheno_id, sample_idx, round(y, 6) AS y FROM ph UNION ALL SELECT 'label', CAST(vec_id AS INTEGER), CAST(label AS DOUBLE) FROM embeddings")
def phenotype_unpivot(spark, folder):
    wide = fx.phenotype(spark, folder, "planted").select("sample_idx", F.col("y").alias("planted")).join(fx.phenotype(spark, folder, "label").select("sample_idx", F.col("y").alias("label")), "sample_idx")
    return readers.wide_to_long(wide, ["planted", "label"]).select("pheno_id", "sample_idx", rounded("y").alias("y"))


@query(f"WITH {fx.SQL_METH} SELECT cpg_id, count(*) AS n, round(median(cov), 6) AS median_cov FROM m GROUP BY 1 HAVING median(cov) >= 80")
def median_coverage_filter(spark, folder):
    kept = prep.median_coverage_filter(fx.methylation(spark, folder).withColumn("cpg_id", prep.site_id()), 80)
    return kept.groupBy("cpg_id").agg(F.count("*").alias("n"), rounded(F.median("cov")).alias("median_cov"))


@query(f"WITH {fx.SQL_METH}, a AS (SELECT DISTINCT cpg_id FROM m), b AS (SELECT DISTINCT sample_id FROM m) SELECT a.cpg_id AS pheno_id, CAST(b.sample_id AS INTEGER) AS sample_idx, round(coalesce(meth, avg(meth) OVER (PARTITION BY a.cpg_id)), 10) AS y FROM a CROSS JOIN b LEFT JOIN m ON m.cpg_id = a.cpg_id AND m.sample_id = b.sample_id")
def pheno_mean_impute(spark, folder):
    m = fx.methylation(spark, folder)
    samples = m.select("sample_id", F.col("sample_id").cast("int").alias("sample_idx")).distinct()
    _, pheno = prep.prepare_sites(m, samples, None, None, 0)
    return pheno.select("pheno_id", "sample_idx", rounded("y", 10).alias("y"))


@query(f"WITH {fx.SQL_METH} SELECT DISTINCT cpg_id, '1' AS chrom, pos AS cpg_pos FROM m")
def cpg_id_build(spark, folder):
    m = fx.methylation(spark, folder)
    return prep.prepare_sites(m, m.select("sample_id", F.col("sample_id").cast("int").alias("sample_idx")).distinct(), None, None, 0)[0]


@query(f"WITH {fx.SQL_METH} SELECT sample_id, pos, round(sum(meth*cov) OVER w / nullif(sum(cov) OVER w, 0), 6) AS meth FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY pos RANGE BETWEEN 1500 PRECEDING AND 1500 FOLLOWING)")
def methylation_smooth(spark, folder):
    return prep.smooth(fx.methylation(spark, folder), 1_500).select("sample_id", "pos", rounded("meth").alias("meth"))


@query(f"WITH {fx.SQL_GENO} SELECT snp_idx, len(list(dosage)) AS n, round(sum(dosage), 6) AS total FROM g GROUP BY 1")
def genotype_transpose(spark, folder):
    t = qc.transpose(fx.genotypes_long(spark, folder))
    total = F.aggregate("dosages", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return t.select("snp_idx", F.size("dosages").cast("long").alias("n"), rounded(total).alias("total"))


# Results


@query("SELECT file_id, line_no, snp, beta, 'cpg' AS prefix FROM betas WHERE abs(beta) > CAST(0.01 AS DOUBLE)")
def betas_nonzero_projection(spark, folder):
    one = table(spark, folder, "betas").select(F.struct("file_id", "line_no").alias("window_id"), F.lit("ok").alias("status"), F.array("snp").alias("snp_ids"), F.array("beta").alias("ridge_betas"))
    return fit.betas(one, 0.01, meta={"prefix": "cpg"}).select("window_id.file_id", "window_id.line_no", "snp", "beta", "prefix")


@query("""WITH q AS (SELECT file_id, line_no, iteration, h2, max(h2) OVER (PARTITION BY file_id ORDER BY iteration, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h2_trajectory)
SELECT file_id, line_no, iteration, round(greatest(h2, coalesce(best, h2)), 9) AS running_best, coalesce(h2 > best + 1e-4, true) AS improved FROM q""")
def h2_trajectory(spark, folder):
    """Best score so far and whether the round improved on it."""
    w = Window.partitionBy("file_id").orderBy("iteration", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    q = table(spark, folder, "h2_trajectory").withColumn("best", F.max("h2").over(w))
    return q.select("file_id", "line_no", "iteration", F.round(F.greatest("h2", F.coalesce("best", "h2")), 9).alias("running_best"), F.coalesce(F.col("h2") > F.col("best") + 1e-4, F.lit(True)).alias("improved"))


@query("SELECT count(*) AS total, round(median(h2), 9) AS median_h2, round(avg(h2), 9) AS mean_h2, round(median(r2), 9) AS median_r2, round(avg(num_snps), 6) AS mean_num_snps FROM (SELECT num_snps, CASE WHEN NOT isnan(h2_unscaled) THEN h2_unscaled END AS h2, CASE WHEN NOT isnan(final_r2) THEN final_r2 END AS r2 FROM cpg_summary WHERE status = 'ok')")
def run_summary_stats(spark, folder):
    s = table(spark, folder, "cpg_summary").select("status", "num_snps", F.when(~F.isnan("h2_unscaled"), F.col("h2_unscaled")).alias("h2"), F.when(~F.isnan("final_r2"), F.col("final_r2")).alias("final_r2"))
    r = pipeline.run_statistics(s)
    return r.select("total", *[F.round(c, 9).alias(c) for c in ("median_h2", "mean_h2", "median_r2")], F.round("mean_num_snps", 6).alias("mean_num_snps"))


@query("SELECT count(*) AS n, count(*) FILTER (y IS NULL OR isnan(y)) AS n_missing, count(*) FILTER (NOT (y IS NULL OR isnan(y))) AS n_kept FROM phenotypes")
def na_counts(spark, folder):
    missing = F.col("y").isNull() | F.isnan("y")
    return table(spark, folder, "phenotypes").agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(~missing).alias("n_kept"))


@query(f"WITH {COUNTS} SELECT chrom, count(DISTINCT m_raw) AS n_distinct, CAST(greatest(5, floor(count(*)*0.2)) * CASE WHEN count(*) >= 25 THEN 1 ELSE 0 END AS INTEGER) AS n_val FROM m GROUP BY 1")
def group_sizes(spark, folder):
    """Distinct counts and validation sizes per chromosome."""
    return _counts(spark, folder).groupBy("chrom").agg(F.count_distinct("m_raw").alias("n_distinct"), F.count("*").alias("_n")).select("chrom", "n_distinct", penalties.validation_size(F.col("_n"), 0.2).alias("n_val"))


@query("WITH q AS (SELECT summary_id, CASE WHEN NOT isnan(final_r2) THEN final_r2 END AS a, CASE WHEN NOT isnan(h2_unscaled) THEN h2_unscaled END AS b FROM cpg_summary) SELECT summary_id, round(greatest(0.0, least(1.0, coalesce(a, b))), 9) + 0.0 AS h2 FROM q WHERE coalesce(a, b) IS NOT NULL")
def h2_fallback(spark, folder):
    """The first of two estimates that is a number, clipped."""
    h2 = penalties.h2_reported(F.col("final_r2"), F.col("h2_unscaled"), F.lit(None).cast("double"))
    return table(spark, folder, "cpg_summary").select("summary_id", rounded(h2, 9).alias("h2")).where("h2 IS NOT NULL")


@query("SELECT region_row, coalesce(pos, -1) AS pos FROM error_regions ORDER BY region_row LIMIT 10")
def first_windows(spark, folder):
    return table(spark, folder, "error_regions").orderBy("region_row").limit(10).select("region_row", F.coalesce("pos", F.lit(-1)).alias("pos"))


@query(f"SELECT chrom IN ('1', '2') AS held_out, count(*) AS n FROM (SELECT DISTINCT {ids.sql_site_chrom(_S)} AS chrom, {_S} AS k FROM sites) WHERE chrom IS NOT NULL GROUP BY 1")
def leave_chromosomes_out_split(spark, folder):
    k = table(spark, folder, "sites").select(ids.site_key("cpg_id").alias("k")).distinct().withColumn("chrom", ids.site_chrom("k")).where("chrom IS NOT NULL")
    train, val = tuning.split_by_chromosome(k, ["1", "2"])
    return train.select(F.lit(False).alias("held_out")).unionByName(val.select(F.lit(True).alias("held_out"))).groupBy("held_out").agg(F.count("*").alias("n"))


@query(f"""WITH {CLEAN}, {fx.SQL_PHENO['planted']}, fo AS (SELECT f.f, c.snp_idx, c.sample_idx % 3 = f.f AS test, dosage AS x, y FROM c JOIN ph USING (sample_idx), range(3) f(f)),
tr AS (SELECT f, snp_idx, covar_pop(x, y) AS cv, var_pop(x) AS vr, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM fo WHERE NOT test GROUP BY 1, 2),
e AS (SELECT snp_idx, a, avg(pow(y - my - cv/(vr + a/n)*(x - mx), 2)) AS mse FROM fo JOIN tr USING (f, snp_idx), (SELECT unnest([CAST(0.1 AS DOUBLE), 10.0, 1000.0]) AS a) WHERE test GROUP BY 1, 2)
SELECT snp_idx, a AS alpha, round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY snp_idx ORDER BY round(mse, 10), a) AS k FROM e) WHERE k = 1""")
def ridge_grid_argmin(spark, folder):
    """Least mean error over three folds and a grid of penalties, per variant."""
    grid = (0.1, 10.0, 1000.0)

    def best(x: np.ndarray, y: np.ndarray) -> tuple:
        own = np.arange(len(y)) % 3
        parts = [(np.flatnonzero(own != f), np.flatnonzero(own == f)) for f in range(3)]
        # folds of unequal size weigh by their rows, as in the SQL
        each = np.array([solver.ridge_errors(x, y, grid, [p]) for p in parts])
        mse = np.average(each, axis=0, weights=[len(p[1]) for p in parts])
        i = int(np.argmin(np.round(mse, 10)))
        return grid[i], mse[i]

    return _per_variant(spark, folder, best, "alpha double, mse double").select("snp_idx", "alpha", rounded("mse").alias("mse"))


# Fits

def _inputs(spark, folder):
    from cisweave import storage

    geno = storage.materialise(fx.genotypes(spark, folder), "genotypes")
    return geno, fx.phenotype(spark, folder, "planted")


@query()
def run_windows(spark, folder):
    """Two windows that span a chromosome's variants, with searched penalties."""
    geno, y = _inputs(spark, folder)
    w = spark.createDataFrame([("w1", "1", 100000, 106200, "planted"), ("w2", "2", 100000, 106200, "planted")], "window_id string, chrom string, start long, `end` long, pheno_id string")
    return fit.summary(fit.fit_windows(w, geno, y, window_size=500_000))


@query()
def run_cpgs(spark, folder):
    """All sites with penalties by formula; blacklisted and empty ones keep a status."""
    geno, y = _inputs(spark, folder)
    w = cis.windows_of_sites(fx.sites(spark)).withColumn("pheno_id", F.lit("planted"))
    w = fit.with_fixed_penalties(w, geno.select("chrom", "pos", "snp_idx", "snp"), tuning.infer_n(genotypes=geno), window_size=fx.HALF)
    regions = spark.createDataFrame([("1_101600",)], "cpg_id string")
    return pipeline.run_windows(w, geno, y, regions=regions, window_size=fx.HALF)


@query()
def global_tune(spark, folder):
    """The combination of the default grid with the best median score over the sites."""
    geno, y = _inputs(spark, folder)
    w = cis.windows_of_sites(fx.sites(spark)).withColumn("pheno_id", F.lit("planted"))
    best = tuning.global_tune(w, geno, y, window_size=fx.HALF)
    return spark.createDataFrame([best], "c_lambda double, c_ridge double, subsample_frac double, batch_size int, score double")


_CLUMPED, _ = _recursive_clump("rk", "window_id").rsplit("\nSELECT", 1)


@query(f"""WITH RECURSIVE {CLEAN}, {fx.SQL_PHENO['planted']}, {fx.SQL_SITES}, {CORR}, {PAIRS}, rk AS (SELECT cpg_id AS window_id, snp_idx, row_number() OVER (PARTITION BY cpg_id ORDER BY round(abs_r, 10) DESC, snp_idx) AS rank
 FROM st JOIN r ON r.chrom = st.chrom AND r.pos BETWEEN st.cpg_pos-1600 AND st.cpg_pos+1600), {_CLUMPED}
SELECT cpg_id AS window_id, CASE WHEN cpg_id = '1_101600' THEN 'blacklisted' WHEN kept IS NULL THEN 'no_snps' ELSE 'ok' END AS status,
 CAST(CASE WHEN cpg_id = '1_101600' OR kept IS NULL THEN 0 ELSE len(kept) END AS INTEGER) AS num_snps FROM st LEFT JOIN fin ON grp = cpg_id""")
def run_cpgs_outcomes(spark, folder):
    """Status and number of variants used of every site, as the whole run of run_cpgs leaves them."""
    return run_cpgs(spark, folder).select("window_id", "status", "num_snps")
