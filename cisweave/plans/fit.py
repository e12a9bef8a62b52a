"""The per-locus fit as one distributed job over tiles of loci.

Neighbouring windows share most of their variants. Windows are therefore gathered into tiles: a tile's variants travel
once for all of its windows (cogrouped by tile), not once for each. Tiles with very many windows are divided, so no task
holds more than `windows_per_task` of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cisweave import schemas
from cisweave.functions.boosting import Settings, boost, clip01
from cisweave.functions.penalties import enet_from_targets
from cisweave.operators.cis import WINDOW_RUNNER, bounds, cis_join, skip_blacklisted, snp_counts
from cisweave.operators.ld import clump, window_bp

COLUMNS = [c.strip().split(" ")[0].strip("`") for c in schemas.MODEL.split(", ")]
#: columns of windows that override the settings: of the search, of the share of rows it uses, of the working set
GIVEN = ("fixed_alpha", "fixed_l1_ratio", "fixed_subsample_frac", "fixed_batch_size")
Fixed = dict | Callable[[dict], dict | None] | None


def phenotype_vectors(pheno: DataFrame) -> DataFrame:
    """(pheno_id, y array<double>) by sample_idx, from long phenotypes; a sample without a row is NaN by its index. Of
    several rows of one sample the mean of the numbers counts."""
    pheno = pheno.where("sample_idx IS NOT NULL").groupBy("pheno_id", "sample_idx").agg(F.avg(F.when(~F.isnan("y"), F.col("y"))).alias("y"))
    cells = F.map_from_entries(F.collect_list(F.struct("sample_idx", F.coalesce("y", F.lit(float("nan"))).alias("y"))))
    last = F.max("sample_idx")
    vec = pheno.groupBy("pheno_id").agg(cells.alias("m"), last.alias("last"))
    return vec.select("pheno_id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(float("nan")))).alias("y"))


def with_fixed_penalties(windows: DataFrame, variants: DataFrame, n: int, c_lambda: float = 1.0, c_ridge: float = 1.0, window_size: int = WINDOW_RUNNER, use_window: bool = True) -> DataFrame:
    """windows with m_raw and, where it is above 1, fixed_alpha and fixed_l1_ratio by the penalty formula. A column m_raw
    that is there already is not counted again."""
    counted = windows if "m_raw" in windows.columns else snp_counts(windows, variants, window_size, use_window)
    alpha, l1 = enet_from_targets(F.col("m_raw"), n, c_lambda, c_ridge)
    return counted.withColumn("fixed_alpha", F.when(F.col("m_raw") > 1, alpha)).withColumn("fixed_l1_ratio", F.when(F.col("m_raw") > 1, l1))


def prepare(x: np.ndarray, pos: np.ndarray, y: np.ndarray, var_thresh: float = 1e-8, impute_strategy: str = "most_frequent", r2_thresh: float = 0.2, distance=window_bp, impute_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, columns kept, strongest first): variance filter, imputation, |r| with y, clumping. A column with a
    missing value has no variance and is dropped, unless impute_first."""
    if impute_first:
        x = impute_matrix(x, impute_strategy)
    with np.errstate(invalid="ignore"):
        ok = x.var(0) > var_thresh
    cols = np.flatnonzero(ok)
    x = impute_matrix(x[:, cols], impute_strategy)
    c, yc = x - x.mean(0), y - y.mean()
    r = np.abs(c.T @ yc) / (np.sqrt((c**2).sum(0)) * (np.sqrt(yc @ yc) + 1e-12) + 1e-12)
    kept = clump(x, pos[cols], r, r2_thresh, distance)
    return x[:, kept], cols[kept]


def impute_matrix(x: np.ndarray, strategy: str = "most_frequent") -> np.ndarray:
    """Missing values by column: most frequent (least of equals), mean, median or 0; a column without values gets 0."""
    bad = ~np.isfinite(x)
    if not bad.any():
        return x
    x = x.copy()
    for j in np.flatnonzero(bad.any(0)):
        v = x[~bad[:, j], j]
        if strategy == "constant" or not len(v):
            fill = 0.0
        elif strategy == "mean":
            fill = v.mean()
        elif strategy == "median":
            fill = np.median(v)
        else:
            values, counts = np.unique(v, return_counts=True)
            fill = values[np.argmax(counts)]
        x[bad[:, j], j] = fill
    return x


def fit_one(w: dict, snp: np.ndarray, pos: np.ndarray, x: np.ndarray, settings: Settings, prep: dict, fixed: Fixed = None, ready: dict | None = None) -> dict:
    """The record of one window; x: samples x its variants. Errors become a status, never a lost record. ready: keeps the
    last prepared matrix, so that the same range and phenotype with other penalties is not prepared again."""
    out = dict.fromkeys(COLUMNS)
    out |= {k: w[k] for k in ("window_id", "pheno_id", "chrom", "start", "end")} | {"m_raw": len(pos), "num_snps": 0, "status": "ok"}
    try:
        y = None if w.get("y") is None else np.asarray(w["y"], float)
        if y is None or not len(y):
            return out | {"status": "no_phenotype"}
        if not len(pos):
            return out | {"status": "no_snps", "n": int(np.isfinite(y).sum())}
        n = min(len(y), len(x))
        rows = np.flatnonzero(np.isfinite(y[:n]))
        y = y[rows]
        out["n"] = len(y)
        if len(y) < 2:
            return out | {"status": "no_phenotype"}
        place = (w.get("lo"), w.get("hi"), w["pheno_id"])
        if ready and ready["place"] == place:
            x, cols = ready["matrix"]
        else:
            x, cols = prepare(x[rows].astype(float), pos, y, **prep)
            if ready is not None:
                ready.update(place=place, matrix=(x, cols))
        if not len(cols):
            return out | {"status": "no_snps"}
        given = fixed(w | {"m_raw": len(pos), "n": len(y)}) if callable(fixed) else fixed
        given = {k: w[k] for k in GIVEN if w.get(k) is not None and np.isfinite(w[k])} | {k: v for k, v in dict(given or {}).items() if v is not None}
        s = replace(
            settings, fixed_alpha=given.get("fixed_alpha", settings.fixed_alpha), fixed_l1_ratio=given.get("fixed_l1_ratio", settings.fixed_l1_ratio),
            subsample_frac=given.get("fixed_subsample_frac", settings.subsample_frac), batch_size=int(min(given.get("fixed_batch_size", settings.batch_size), len(cols))),
        )
        f = boost(x, y, s)
        names = [str(v) for v in snp[cols]]
        h2 = next((v for v in (f.h2_val, f.h2_ld, f.h2_diag) if np.isfinite(v)), float("nan"))
        return out | {
            "num_snps": len(cols), "final_r2": f.final_r2, "h2": clip01(h2), "h2_unscaled": clip01(h2), "h2_diag": f.h2_diag, "h2_ld": f.h2_ld, "h2_val": f.h2_val,
            "n_iter": f.n_iter, "alpha": f.alpha, "l1_ratio": f.l1_ratio, "ridge_alpha": f.ridge_alpha, "snp_ids": names, "betas": f.betas, "ridge_betas": f.ridge_betas,
            "kept_snps": [names[i] for i in f.kept], "snp_variances": f.variances, "h2_estimates": f.h2_estimates, "early_stop_best": f.best,
        }
    except Exception as e:  # noqa: BLE001 - one locus must not end the job
        return out | {"status": "error", "error": f"{type(e).__name__}: {e}"[:500]}


def fit_windows(
    windows: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, *, window_size: int = WINDOW_RUNNER, use_window: bool = True, settings: Settings = Settings(),
    fixed_params: Fixed = None, regions: DataFrame | None = None, r2_thresh: float = 0.2, var_thresh: float = 1e-8, impute_strategy: str = "most_frequent",
    impute_first: bool = False, distance: Callable[[float], int] = window_bp, by_hand: bool = False, tile_width: int | None = None, windows_per_task: int = 256,
) -> DataFrame:
    """One record (schemas.MODEL) per window. genotypes: one row per variant with its dosages by sample_idx; phenotypes:
    long (pheno_id, sample_idx, y) or vectors (pheno_id, y array). Windows of `regions` are left out. by_hand prepares with
    the default thresholds, whatever is given."""
    width = tile_width or max(1_000, 2 * window_size)
    if regions is not None:
        windows = skip_blacklisted(windows, regions)
    vectors = phenotypes if "sample_idx" not in phenotypes.columns else phenotype_vectors(phenotypes)
    w = bounds(windows, window_size, use_window).withColumn("chrom", F.col("chrom").cast("string"))
    w = w.withColumn("_place", F.floor((F.col("lo") + F.col("hi")) / (2 * width)))
    # a salt divides places with more windows than one task should have
    crowd = w.groupBy("chrom", "_place").agg(F.ceil(F.count(F.lit(1)) / windows_per_task).alias("_parts"))
    w = w.join(crowd, ["chrom", "_place"]).withColumn("tile", F.concat_ws("|", "chrom", "_place", F.pmod(F.xxhash64("window_id"), F.col("_parts"))))
    keep = ["tile", "window_id", "pheno_id", "chrom", "start", "end", "lo", "hi", *[c for c in GIVEN if c in w.columns]]
    tiles = w.groupBy("tile", "chrom").agg(F.min("lo").alias("start"), F.max("hi").alias("end")).withColumnRenamed("tile", "window_id")
    g = cis_join(tiles, genotypes.select("chrom", "snp_idx", "snp", "pos", "dosages"), 0, False, width)
    prep = {"var_thresh": var_thresh, "impute_strategy": impute_strategy, "r2_thresh": r2_thresh, "distance": distance, "impute_first": impute_first}
    prep = {} if by_hand else prep

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["pos", "snp_idx"], kind="stable")
        pos, snp = right["pos"].to_numpy(np.int64), right["snp"].to_numpy(object)
        x = np.stack(right["dosages"].to_list()).astype(np.float32).T if len(right) else np.zeros((0, 0), np.float32)
        rows, ready = [], {}
        for one in left.sort_values("window_id").to_dict("records"):
            a, b = np.searchsorted(pos, one["lo"], "left"), np.searchsorted(pos, one["hi"], "right")
            rows.append(fit_one(one, snp[a:b], pos[a:b], x[:, a:b], settings, prep, fixed_params, ready))
        return pd.DataFrame(rows, columns=COLUMNS)

    full = w.select(*keep).join(vectors.select("pheno_id", "y"), "pheno_id", "left")
    return full.groupBy("tile").cogroup(g.groupBy("window_id")).applyInPandas(_only_windows(run), schemas.MODEL)


def _only_windows(run):
    """A tile without windows (variants only) has no rows."""

    def guarded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right) if len(left) else pd.DataFrame(columns=COLUMNS)

    return guarded


def summary(model: DataFrame) -> DataFrame:
    return model.select(*[c.strip().split(" ")[0] for c in schemas.SUMMARY.split(", ")])


def betas(model: DataFrame, zero_tol: float = 0.0, column: str = "ridge_betas", meta: dict | None = None) -> DataFrame:
    """(window_id, snp, beta) with |beta| above zero_tol, and constant meta columns."""
    rows = model.where("status = 'ok'").select("window_id", F.explode(F.arrays_zip(F.col("snp_ids").alias("snp"), F.col(column).alias("beta"))).alias("b"))
    out = rows.select("window_id", F.col("b.snp").alias("snp"), F.col("b.beta").alias("beta")).where(F.abs("beta") > zero_tol)
    return out.withColumns({k: F.lit(v) for k, v in (meta or {}).items()})


def trajectory(model: DataFrame, meta: dict | None = None) -> DataFrame:
    """(window_id, iteration from 0, h2), and constant meta columns."""
    out = model.where("status = 'ok'").select("window_id", F.posexplode("h2_estimates").alias("iteration", "h2"))
    return out.withColumns({k: F.lit(v) for k, v in (meta or {}).items()})
