"""Methylation input in long form (chrom, pos, sample_id, meth, cov) to manifests and phenotypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cisweave.functions.ids import chrom_key


def site_id(chrom="chrom", pos="pos"):
    """{chrom without chr}_{pos}."""
    return F.concat_ws("_", F.regexp_replace(F.col(chrom).cast("string"), "chr", ""), F.col(pos).cast("string"))


def chromosome_subset(df: DataFrame, chromosomes: Sequence | None) -> DataFrame:
    return df if chromosomes is None else df.where(chrom_key("chrom").isin([str(c) for c in chromosomes]))


def median_coverage_filter(df: DataFrame, min_cov: float = 1, key: str = "cpg_id") -> DataFrame:
    """Rows of sites whose median coverage reaches min_cov; nulls are left out of the median; min_cov <= 0 keeps all."""
    if min_cov <= 0:
        return df
    keep = df.groupBy(key).agg(F.median("cov").alias("m")).where(F.col("m") >= min_cov).select(key)
    return df.join(keep, key, "left_semi")


def mean_impute(df: DataFrame, key: str = "pheno_id", value: str = "y") -> DataFrame:
    """Missing values as the mean of the key's other values."""
    v = F.when(~F.isnan(value), F.col(value))
    means = df.groupBy(key).agg(F.avg(v).alias("_mean"))
    return df.join(means, key).withColumn(value, F.coalesce(v, "_mean")).drop("_mean")


def complete(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Every phenotype with every sample; cells without a row are null. (pheno_id, sample_idx, y)"""
    every = samples.agg(F.collect_set("sample_idx").alias("s"))  # as many as there are people
    ids = df.select("pheno_id").distinct().join(F.broadcast(every)).select("pheno_id", F.explode("s").alias("sample_idx"))
    return ids.join(df.select("pheno_id", "sample_idx", "y"), ["pheno_id", "sample_idx"], "left")


def smooth(df: DataFrame, half_width: int = 1_000, least: int = 1) -> DataFrame:
    """meth as its coverage-weighted mean over sites of the same sample and chromosome within half_width base pairs: a
    local-constant stand-in for local-likelihood smoothing. Fewer than `least` sites in reach leave the value alone."""
    w = Window.partitionBy("sample_id", "chrom").orderBy("pos").rangeBetween(-half_width, half_width)
    mean = F.try_divide(F.sum(F.col("meth") * F.col("cov")).over(w), F.sum("cov").over(w))
    return df.withColumn("meth", F.when(F.count("*").over(w) >= least, F.coalesce(mean, "meth")).otherwise(F.col("meth")))


def prepare_sites(df: DataFrame, samples: DataFrame, chromosomes: Sequence | None = None, smoothing: int | None = None, min_cov: float = 1) -> tuple[DataFrame, DataFrame]:
    """(manifest (cpg_id, chrom, cpg_pos), phenotypes (pheno_id, sample_idx, y)). samples: (sample_id, sample_idx)."""
    rows = chromosome_subset(df, chromosomes)
    rows = smooth(rows, smoothing) if smoothing else rows
    rows = median_coverage_filter(rows.withColumn("cpg_id", site_id()), min_cov)
    manifest = rows.select("cpg_id", chrom_key("chrom").alias("chrom"), F.col("pos").cast("long").alias("cpg_pos")).distinct()
    y = rows.join(F.broadcast(samples.select("sample_id", "sample_idx")) if samples.limit(100_001).count() <= 100_000 else samples, "sample_id")
    pheno = y.select(F.col("cpg_id").alias("pheno_id"), "sample_idx", F.col("meth").alias("y"))
    return manifest, mean_impute(complete(pheno, samples))


def write_prepared(manifest: DataFrame, phenotypes: DataFrame, outdir: str) -> None:
    manifest.write.mode("overwrite").partitionBy("chrom").parquet(f"{outdir}/manifest")
    phenotypes.write.mode("overwrite").parquet(f"{outdir}/phenotypes")


def align_samples(a: DataFrame, b: DataFrame, key: str = "iid") -> DataFrame:
    """(key, a_idx, b_idx, side, in_order): samples in both or only one input by their index (idx), and for common ones
    whether b's order follows a's. Raises if none is common."""
    j = a.select(key, F.col("idx").alias("a_idx")).join(b.select(key, F.col("idx").alias("b_idx")), key, "full")
    side = F.when(F.col("b_idx").isNull(), "only_a").when(F.col("a_idx").isNull(), "only_b").otherwise("both")
    j = j.withColumn("side", side)
    if not j.where("side = 'both'").limit(1).count():
        raise ValueError("no common samples")
    before = F.lag("b_idx").over(Window.partitionBy("side").orderBy("a_idx"))
    return j.withColumn("in_order", F.when(F.col("side") == "both", F.coalesce(F.col("b_idx") > before, F.lit(True))))
