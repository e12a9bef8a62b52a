"""Runs over many loci with results on disk, batches that survive an interruption, and single-locus calls."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.operators.cis import WINDOW_RUNNER, pending, skip_blacklisted, windows_of_sites
from cisweave.plans import fit
from cisweave.sources import readers

log = logging.getLogger(__name__)
DONE = ("ok", "no_snps", "no_phenotype", "blacklisted")


def completed(spark: SparkSession, path: str) -> DataFrame | None:
    """Records that earlier batches under `path` left, one per window: one that is done rather than an error, so a window
    that failed and was fitted again has its new record; None if there are none."""
    fs, p = storage.filesystem(spark, path)
    if not fs.exists(p):
        return None
    parts = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch-")]
    return _one_each(spark.read.parquet(*parts), "window_id") if parts else None


def _one_each(model: DataFrame, key: str) -> DataFrame:
    """One row per key, one that is done before one that is not."""
    row = F.max_by(F.struct(*model.columns), F.coalesce(F.col("status").isin(*DONE), F.lit(False)))
    return model.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def completed_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """window_id of the windows that are done, in order."""
    before = completed(spark, path)
    return None if before is None else before.where(F.col("status").isin(*DONE)).select("window_id").orderBy("window_id")


def batches_of(windows: DataFrame, size: int, strip: int) -> DataFrame:
    """windows with `_batch`: neighbouring strips of positions of a chromosome, together about `size` windows. A batch then
    needs the variants of its own stretch only, not all of them. Only the small table of strip sizes is summed."""
    placed = windows.withColumn("_strip", F.floor(F.col("start") / strip)).withColumn("_chrom", F.coalesce(F.col("chrom").cast("string"), F.lit("")))
    sizes = placed.groupBy("_chrom", "_strip").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_chrom").orderBy("_strip")) - F.col("_n")
    sizes = sizes.select(F.col("_chrom").alias("_c"), F.col("_strip").alias("_s"), F.floor(before / size).alias("_batch"))
    on = (F.col("_chrom") == F.col("_c")) & F.col("_strip").eqNullSafe(F.col("_s"))
    return placed.join(sizes, on).drop("_strip", "_c", "_s")


def run_windows(
    windows: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, outdir: str | None = None, prefix: str = "vmr", *, regions: DataFrame | None = None,
    checkpoint_interval: int = 10_000, resume: bool = True, save: bool = True, save_full: bool = False, progress: Callable[[int, int], None] | None = None, **options,
) -> DataFrame:
    """Summaries (schemas.SUMMARY) of all windows, including skipped ones with their status.

    With an outdir, windows are fitted in batches of about checkpoint_interval neighbours on a chromosome; a batch is written to a staging folder and
    renamed, so an interrupted batch leaves nothing behind and a resumed run fits only windows without a record. The
    summary goes to {prefix}.summary.parquet, with save_full betas and trajectories to {prefix}.betas.parquet and
    {prefix}.h2.parquet. resume=False starts anew. An empty set of windows gives an empty table.
    """
    spark = windows.sparkSession
    listed = None
    if regions is not None:
        allowed = skip_blacklisted(windows, regions)
        listed = windows.join(allowed.select("window_id"), "window_id", "left_anti")
        windows = allowed
    if outdir is None:
        model = fit.fit_windows(windows, genotypes, phenotypes, **options)
        return fit.summary(_with_listed(model, listed))
    at = f"{outdir}/{prefix}_checkpoint"
    if not resume:
        storage.remove(spark, at)
    before = completed(spark, at)
    todo = windows if before is None else pending(windows, before.where(F.col("status").isin(*DONE)))
    reach = options.get("window_size", WINDOW_RUNNER) if options.get("use_window", True) else 0
    todo = storage.materialise(batches_of(todo, checkpoint_interval, options.get("tile_width") or max(1_000, 2 * reach)), "pending")
    ends = [F.min("start").alias("lo"), F.max(F.coalesce("end", "start")).alias("hi"), F.count("*").alias("n")]
    plan = todo.groupBy("_chrom", "_batch").agg(*ends).orderBy("_chrom", "_batch").collect()  # a row for each job to come
    began, fitted, count = time.monotonic(), 0, sum(r["n"] for r in plan)
    for b, r in enumerate(plan):
        part = todo.where((F.col("_chrom") == r["_chrom"]) & F.col("_batch").eqNullSafe(F.lit(r["_batch"]))).drop("_chrom", "_batch")
        near = genotypes.where(F.col("chrom").cast("string") == r["_chrom"])
        if r["lo"] is not None and r["hi"] is not None:
            near = near.where((F.col("pos") >= r["lo"] - reach) & (F.col("pos") <= r["hi"] + reach))
        staged = storage.scratch_path(spark, "batch")
        fit.fit_windows(part, near, phenotypes, **options).write.parquet(staged)
        fs, new = storage.filesystem(spark, staged)
        fs.mkdirs(storage.filesystem(spark, at)[1])
        if not fs.rename(new, storage.filesystem(spark, f"{at}/batch-{new.getName()}")[1]):
            raise OSError(f"batch {staged} could not be moved to {at}")
        fitted += r["n"]
        rate = fitted / max(time.monotonic() - began, 1e-3)
        log.info("batch %d of %d: %d of %d loci, %.1f a second, %.0f s to go", b + 1, len(plan), fitted, count, rate, (count - fitted) / rate)
        if progress:
            progress(b + 1, len(plan))
    storage.remove(spark, todo.inputFiles()[0].rsplit("/", 1)[0]) if plan else None
    model = completed(spark, at)
    if model is None:
        model = fit.fit_windows(windows.limit(0), genotypes, phenotypes, **options)
    model = _with_listed(model.join(windows.select("window_id").distinct(), "window_id", "left_semi"), listed)
    if save:
        fit.summary(model).write.mode("overwrite").parquet(f"{outdir}/{prefix}.summary.parquet")
        if save_full:
            fit.betas(model).write.mode("overwrite").parquet(f"{outdir}/{prefix}.betas.parquet")
            fit.trajectory(model).write.mode("overwrite").parquet(f"{outdir}/{prefix}.h2.parquet")
        return spark.read.parquet(f"{outdir}/{prefix}.summary.parquet")
    return fit.summary(model)


def _with_listed(model: DataFrame, listed: DataFrame | None) -> DataFrame:
    if listed is None:
        return model
    return model.unionByName(listed.select("window_id", "pheno_id", F.col("chrom").cast("string").alias("chrom"), "start", "end", F.lit(0).alias("num_snps"), F.lit("blacklisted").alias("status")), allowMissingColumns=True)


def run_sites(sites: DataFrame, genotypes: DataFrame, phenotypes: DataFrame, outdir: str | None = None, prefix: str = "cpg", **options) -> DataFrame:
    """run_windows for sites (cpg_id, chrom, cpg_pos)."""
    keep = [c for c in ("fixed_alpha", "fixed_l1_ratio", "m_raw") if c in sites.columns]
    windows = windows_of_sites(sites) if not keep else sites.select(F.col("cpg_id").alias("window_id"), F.col("chrom").cast("string").alias("chrom"), F.col("cpg_pos").alias("start"), F.col("cpg_pos").alias("end"), F.col("cpg_id").alias("pheno_id"), *keep)
    out = run_windows(windows.dropDuplicates(["window_id"]), genotypes, phenotypes, outdir, prefix, **options)
    return out.withColumn("cpg_id", F.col("window_id")).withColumn("cpg_pos", F.col("start"))


def run_by_chromosome(
    spark: SparkSession, chromosomes: Sequence, genotypes: DataFrame, manifest_template: str, pheno_template: str, outdir: str, prefix: str = "cpg", **options
) -> DataFrame:
    """Sites of one manifest and phenotype file per chromosome ({chrom} in the templates), combined in
    {prefix}.summary_all.parquet without duplicates. A chromosome without a manifest is skipped with a warning; one whose
    sites all have results costs no read of its phenotypes."""
    out = None
    for chrom in chromosomes:
        manifest = readers.manifest(spark, manifest_template, [chrom])
        if manifest is None:
            log.warning("chromosome %s: no manifest, skipped", chrom)
            continue
        path = pheno_template.format(chrom=chrom)
        if not readers.exists(spark, path):
            log.warning("chromosome %s: no phenotypes, skipped", chrom)
            continue
        done = run_sites(manifest, genotypes, readers.wide_to_long(readers.phenotypes(spark, path)), outdir, f"{prefix}_chr{chrom}", **options)
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], "cpg_id string, chrom string, cpg_pos long, num_snps int, n int, final_r2 double, h2_unscaled double, n_iter int, status string")
    _one_each(out, "cpg_id").write.mode("overwrite").parquet(f"{outdir}/{prefix}.summary_all.parquet")
    return spark.read.parquet(f"{outdir}/{prefix}.summary_all.parquet")


def run_single(spark: SparkSession, genotypes: DataFrame, phenotypes: DataFrame, chrom, start: int, end: int | None = None, pheno_id: str | None = None, **options) -> dict | None:
    """The record of one window or site; None if it was skipped or had no variants."""
    name = pheno_id or f"{chrom}_{start}"
    one = spark.createDataFrame([(name, str(chrom), int(start), int(start if end is None else end), name)], "window_id string, chrom string, start long, `end` long, pheno_id string")
    row = fit.fit_windows(one, genotypes, phenotypes, **options).first()
    if row is None or row["status"] in ("no_snps", "no_phenotype"):
        return None
    if row["status"] == "error":
        raise RuntimeError(row["error"])
    return row.asDict(recursive=True)


def run_statistics(summary: DataFrame) -> DataFrame:
    """One row: loci fitted, median and mean h2, median R2, mean number of variants."""
    ok = summary.where("status = 'ok'")
    return ok.agg(
        F.count("*").alias("total"), F.median("h2").alias("median_h2"), F.avg("h2").alias("mean_h2"), F.median("final_r2").alias("median_r2"), F.avg("num_snps").alias("mean_num_snps")
    )


def write_statistics(summary: DataFrame, path: str) -> None:
    """run_statistics as one JSON line."""
    run_statistics(summary).coalesce(1).write.mode("overwrite").json(path)
