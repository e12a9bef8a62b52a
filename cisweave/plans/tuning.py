"""Choice of loci for tuning, and grid search over the penalties' constants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.functions.boosting import Settings
from cisweave.functions.penalties import enet_from_targets
from cisweave.operators.cis import WINDOW_RUNNER, snp_counts
from cisweave.operators.ranking import bounded_broadcast, priority, spread_rank
from cisweave.plans.fit import fit_windows

#: fixed values: the default grids
GRID_WINDOWS = {"c_lambda": (0.7, 1.0, 1.4), "c_ridge": (0.5, 1.0, 2.0), "subsample_frac": (0.5, 0.7, 0.9), "batch_size": (2048, 4096, 8192)}
GRID_SITES = {"c_lambda": (0.5, 0.7, 1.0, 1.4, 2.0), "c_ridge": (0.5, 1.0, 2.0), "subsample_frac": (0.6, 0.7, 0.8), "batch_size": (4096, 8192)}


def target_size(n: int, frac: float, n_min: int, n_max: int) -> int:
    """frac * n rounded half to even, within [n_min, n_max]."""
    return int(min(max(round(frac * n), n_min), n_max))


def quantile_bin(value: str, edges: Sequence[float]):
    """Right-closed quantile bin from 0: the number of inner edges below the value."""
    return sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def select_loci(
    windows: DataFrame, variants: DataFrame | None, frac: float = 0.02, n_min: int = 150, n_max: int = 1000, *, window_size: int = WINDOW_RUNNER, use_window: bool = True,
    n_bins: int = 3, per_chrom_min: int = 0, seed: int = 13, exclude_failed: DataFrame | None = None, kind: str = "windows",
) -> DataFrame:
    """A stratified selection of windows with variants, with their m_raw: per_chrom_min of each chromosome, the rest evenly
    over quantile bins of m_raw, what is short filled up by the largest m_raw. Draws are by seeded hash, so a selection
    does not depend on partitioning. Raises ValueError if no window has variants."""
    w = windows if exclude_failed is None else windows.join(exclude_failed.select("window_id").distinct(), "window_id", "left_anti")
    counted = w if "m_raw" in w.columns else snp_counts(w, variants, window_size, use_window)
    pool = counted.where("m_raw > 0").withColumn("_p", priority(seed, "window_id"))
    n, unique = pool.agg(F.count("*"), F.count_distinct("m_raw")).first()
    if not n:
        raise ValueError(f"No {kind} with SNPs: nothing to select")
    target, bins = target_size(n, frac, n_min, n_max), min(n_bins, unique)
    edges: list[float] = []
    if bins > 1:
        cuts = pool.agg(F.percentile("m_raw", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]
        inner = sorted(set(cuts))
        edges = [e for e in inner[1:-1]] if len(inner) > 2 else []
    pool = pool.withColumn("_bin", quantile_bin("m_raw", edges))
    by_chrom = spread_rank(pool, ["chrom"], "_p", "window_id", "_c")
    picked = storage.materialise(by_chrom.withColumn("_first", F.col("_c") <= per_chrom_min), "picked")
    got = picked.where("_first").count() if per_chrom_min > 0 else 0
    need = max(0, target - got)
    rest = spread_rank(picked.where("NOT _first"), ["_bin"], "_p", "window_id", "_r")
    present = [r[0] for r in picked.where("NOT _first").select("_bin").distinct().sort("_bin").collect()]  # at most n_bins
    base, extra = divmod(need, max(1, len(present)))
    quota = F.create_map(*[x for i, b in enumerate(present) for x in (F.lit(b), F.lit(base + (i < extra)))]) if present else None
    rest = rest.withColumn("_take", F.col("_r") <= quota[F.col("_bin")]) if present else rest.withColumn("_take", F.lit(False))
    all_rows = storage.materialise(picked.where("_first").withColumn("_r", F.lit(0).cast("long")).withColumn("_take", F.lit(True)).unionByName(rest), "ranked")
    short = target - all_rows.where("_take").count()
    chosen = all_rows.where("_take")
    if short > 0:
        chosen = chosen.unionByName(all_rows.where("NOT _take").orderBy(F.desc("m_raw"), "window_id").limit(short))
    return chosen.select(*counted.columns)


def select_sites(sites: DataFrame, variants: DataFrame | None, frac: float = 0.001, n_min: int = 50, n_max: int = 500, **options) -> DataFrame:
    """select_loci with the defaults for sites."""
    return select_loci(sites, variants, frac, n_min, n_max, kind="CpGs", **options)


def grid_of(spark, grid: dict[str, Sequence]) -> DataFrame:
    """The grid's combinations, numbered in order from 0."""
    rows = [(i, *map(float, c[:3]), int(c[3])) for i, c in enumerate(product(*(grid[k] for k in ("c_lambda", "c_ridge", "subsample_frac", "batch_size"))))]
    return spark.createDataFrame(rows, "combo int, c_lambda double, c_ridge double, subsample_frac double, batch_size int")


def median_scores(rows: DataFrame, by: str) -> DataFrame:
    """(by, score): the median of the final_r2 that are finite numbers."""
    return rows.where("final_r2 IS NOT NULL AND NOT isnan(final_r2) AND abs(final_r2) < double('inf')").groupBy(by).agg(F.median("final_r2").alias("score"))


def score_combos(loci: DataFrame, grid: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, n: int, settings: Settings = Settings(), **options) -> DataFrame:
    """(combo, its constants, score): the median of final_r2 over the loci; -infinity if none has a score. All fits of all
    combinations are one job: a locus and a combination is a window of its own."""
    pairs = loci.where("m_raw > 1").join(bounded_broadcast(grid, 10_000))
    alpha, l1 = enet_from_targets(F.col("m_raw"), n, F.col("c_lambda"), F.col("c_ridge"))
    windows = pairs.withColumn("window_id", F.concat_ws("#", "window_id", "combo")).withColumn("fixed_alpha", alpha).withColumn("fixed_l1_ratio", l1)
    windows = windows.withColumnsRenamed({"subsample_frac": "fixed_subsample_frac", "batch_size": "fixed_batch_size"})
    fitted = fit_windows(windows, genotypes, phenotypes, settings=replace(settings, n_trials=1), **options)
    r2 = fitted.where("status = 'ok'").select(F.substring_index("window_id", "#", -1).cast("int").alias("combo"), "final_r2")
    return bounded_broadcast(grid, 10_000).join(median_scores(r2, "combo"), "combo", "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def best_combo(scores: DataFrame, by: str = "score", key: str = "combo") -> dict:
    """The combination of highest score, the first of equals. Raises RuntimeError if none has a score."""
    row = scores.where(F.col(by) > float("-inf")).orderBy(F.desc(by), key).first()
    if row is None:
        raise RuntimeError("no combination has a score")
    return row.asDict()


def global_tune(loci: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, grid: dict | None = None, n: int | None = None, settings: Settings = Settings(), *, variants: DataFrame | None = None, window_size: int = WINDOW_RUNNER, use_window: bool = True, **options) -> dict:
    """c_lambda, c_ridge, subsample_frac, batch_size and score of the best combination over the loci."""
    size = n if n is not None else infer_n(genotypes=genotypes)
    counted = loci if "m_raw" in loci.columns else snp_counts(loci, variants if variants is not None else genotypes, window_size, use_window)
    combos = grid_of(loci.sparkSession, GRID_WINDOWS if grid is None else grid)
    best = best_combo(score_combos(counted, combos, genotypes, phenotypes, size, settings, window_size=window_size, use_window=use_window, **options))
    best.pop("combo")
    return best


def tune_across(train: DataFrame, val: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, grid: dict | None = None, n: int | None = None, frac: float = 0.05, n_min: int = 50, n_max: int = 200, settings: Settings = Settings(), *, variants: DataFrame | None = None, **options) -> dict:
    """Like global_tune, scored on training (seed 13) and validation loci (seed 42); the validation score decides. With
    `variants` given, counting needs no dosages."""
    size = n if n is not None else infer_n(genotypes=genotypes)
    combos = grid_of(train.sparkSession, GRID_SITES if grid is None else grid)
    window = {k: options[k] for k in ("window_size", "use_window") if k in options}
    scored = None
    for name, loci, seed in (("train_score", train, 13), ("val_score", val, 42)):
        chosen = select_loci(loci, genotypes if variants is None else variants, frac, n_min, n_max, seed=seed, **window)
        s = score_combos(chosen, combos, genotypes, phenotypes, size, settings, **options).withColumnRenamed("score", name)
        scored = s if scored is None else scored.join(s.select("combo", name), "combo")
    best = best_combo(scored, "val_score")
    best.pop("combo")
    return best


def split_by_chromosome(loci: DataFrame, val_chromosomes: Sequence) -> tuple[DataFrame, DataFrame]:
    """(training, validation) loci: those of val_chromosomes validate."""
    held = F.col("chrom").cast("string").isin([str(c) for c in val_chromosomes])
    return loci.where(~held), loci.where(held)


def leave_chromosomes_out(loci: DataFrame, val_chromosomes: Sequence, genotypes: DataFrame, phenotypes: DataFrame, **options) -> dict:
    """tune_across with the loci of val_chromosomes as validation and all others as training."""
    train, val = split_by_chromosome(loci, val_chromosomes)
    return tune_across(train, val, genotypes, phenotypes, **options)


def odd_even(chromosomes: Sequence) -> tuple[list, list]:
    """(odd, even) chromosomes; if one kind is missing, both are all of them."""
    odd, even = [c for c in chromosomes if int(c) % 2], [c for c in chromosomes if not int(c) % 2]
    return (odd, even) if odd and even else (list(chromosomes), list(chromosomes))


def infer_n(samples: DataFrame | None = None, genotypes: DataFrame | None = None, phenotypes: DataFrame | None = None) -> int:
    """Number of samples: of the sample table, else of a variant's dosages, else of phenotypes; 0 if unknown."""
    if samples is not None:
        return samples.count()
    if genotypes is not None:
        row = genotypes.select(F.size("dosages")).first()
        return row[0] if row else 0
    return phenotypes.select("sample_idx").distinct().count() if phenotypes is not None else 0
