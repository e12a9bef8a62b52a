"""Per-variant statistics over genotypes in long form (sample_idx, snp_idx, dosage): filters, imputation, association.

NaN is missing, as null is. Sums are taken once per variant with map-side combining; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(c: str = "dosage") -> Column:
    return F.when(~F.isnan(c), F.col(c))


def variant_stats(geno: DataFrame, keys: Sequence[str] = ("snp_idx",)) -> DataFrame:
    """Per variant: n, n_missing, mean, sd and var (of the population)."""
    d = present()
    return geno.groupBy(*keys).agg(
        F.count(d).alias("n"), F.count_if(d.isNull()).alias("n_missing"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.var_pop(d).alias("var")
    )


def zero_variance_filter(geno: DataFrame, threshold: float = 1e-8, keys: Sequence[str] = ("snp_idx",), impute_first: bool = False) -> DataFrame:
    """Rows of variants whose population variance is above the threshold. A variant with any missing call has no
    variance and is dropped, unless impute_first."""
    stats = variant_stats(geno, keys)
    keep = stats.where((F.col("var") > threshold) & (F.lit(impute_first) | (F.col("n_missing") == 0)))
    return geno.join(keep.select(*keys), list(keys), "left_semi")


def impute(geno: DataFrame, strategy: str = "most_frequent", keys: Sequence[str] = ("snp_idx",)) -> DataFrame:
    """geno with missing dosages replaced by the variant's most frequent call (the least of equals), mean, median, or a
    constant 0. A variant without any call stays missing."""
    d = present()
    value = {"most_frequent": F.mode(d, True), "mean": F.avg(d), "median": F.median(d), "constant": F.lit(0.0)}[strategy]
    fill = value if strategy == "constant" else value.over(Window.partitionBy(*keys)) if strategy != "most_frequent" else None
    if fill is None:  # mode(deterministic) is an aggregate, not a window function
        modes = geno.groupBy(*keys).agg(value.alias("_fill"))
        return geno.join(modes, list(keys)).withColumn("dosage", F.coalesce(d, "_fill")).drop("_fill")
    return geno.withColumn("dosage", F.coalesce(d, fill))


def abs_corr_with(geno: DataFrame, pheno: DataFrame, keys: Sequence[str] = ("snp_idx",), eps: float = 1e-12) -> DataFrame:
    """|r| of each variant with y: |sum(xc yc)| / (norm(xc) * (norm(yc) + eps) + eps); 0 for a constant variant, null if
    a y is missing. pheno: (sample_idx, y)."""
    j = geno.join(pheno.select("sample_idx", "y"), "sample_idx")
    x, y = present(), F.when(~F.isnan("y"), F.col("y"))
    n = F.count(x)
    num = F.abs(F.covar_pop(x, y)) * n
    den = F.stddev_pop(x) * F.sqrt(n) * (F.stddev_pop(y) * F.sqrt(n) + eps) + eps
    return j.groupBy(*keys).agg(F.when(F.count_if(y.isNull()) == 0, num / den).alias("abs_r"))


def top_k(scores: DataFrame, k: int, group: Sequence[str], score: str = "abs_r", tie: str = "snp_idx") -> DataFrame:
    """The working set: per group the k rows of highest |score|, with their rank from 1."""
    order = F.abs(score).desc_nulls_last()
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(order, F.col(tie))))
    return ranked.where(F.col("rank") <= k)


def standardise(geno: DataFrame, train: Column, keys: Sequence[str] = ("snp_idx",), eps: float = 1e-6) -> DataFrame:
    """geno with z = (x - mean) / (sd + eps), mean and sd being those of the training rows."""
    w = Window.partitionBy(*keys)
    t = F.when(train, F.col("dosage"))
    return geno.withColumn("z", (F.col("dosage") - F.avg(t).over(w)) / (F.stddev_pop(t).over(w) + eps))


def transpose(geno: DataFrame) -> DataFrame:
    """Long genotypes as one row per variant: dosages ordered by sample_idx, which counts from 0 without gaps."""
    cells = F.sort_array(F.collect_list(F.struct("sample_idx", present().cast("float").alias("d"))))
    return geno.groupBy("snp_idx", "chrom", "snp", "pos").agg(F.transform(cells, lambda c: c["d"]).alias("dosages"))


def to_long(genotypes: DataFrame) -> DataFrame:
    """One row per variant as long genotypes."""
    return genotypes.select("snp_idx", "chrom", "snp", "pos", F.posexplode("dosages").alias("sample_idx", "dosage")).withColumn("dosage", F.col("dosage").cast("double"))
