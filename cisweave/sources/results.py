"""Sinks of one locus' coefficients and trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(spark: SparkSession, betas: Sequence[float], h2_estimates: Sequence[float], out_prefix: str, snp_ids: Sequence[str] | None = None, meta: dict | None = None, zero_tol: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Write {prefix}_betas.tsv (|beta| above zero_tol) and {prefix}_h2.tsv (all iterations) as tab-separated datasets
    with the constant meta columns; ids default to 0, 1, ..."""
    ids = [str(s) for s in (snp_ids if snp_ids is not None else range(len(betas)))]
    extra = {k: F.lit(v) for k, v in (meta or {}).items()}
    b = spark.createDataFrame(list(zip(ids, map(float, betas))), "snp string, beta double").where(F.abs("beta") > zero_tol).withColumns(extra)
    h = spark.createDataFrame(list(enumerate(map(float, h2_estimates))), "iteration int, h2 double").withColumns(extra)
    for df, name in ((b, "betas"), (h, "h2")):
        df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{out_prefix}_{name}.tsv")
    return b, h
