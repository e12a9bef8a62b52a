"""Linkage disequilibrium: r2 of nearby pairs of variants, and greedy clumping."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cisweave.operators.qc import present


def window_bp(r2: float) -> int:
    """Base pairs within which pairs are compared for a threshold of r2."""
    return int(100 / r2)


def ld_pairs(geno: DataFrame, within: int) -> DataFrame:
    """(chrom, i, j, r2) of variants i < j at most `within` base pairs apart, over samples that have both calls. Pairs
    with a constant variant have a null r2. Position bins keep the self-join to neighbours."""
    g = geno.select("sample_idx", "snp_idx", "chrom", "pos", present().alias("x")).withColumn("bin", F.floor(F.col("pos") / max(1, within)))
    a = g.select("sample_idx", "chrom", F.col("snp_idx").alias("i"), F.col("pos").alias("pi"), F.col("x").alias("xi"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    b = g.select("sample_idx", "chrom", F.col("snp_idx").alias("j"), F.col("pos").alias("pj"), F.col("x").alias("xj"), "bin")
    pairs = a.join(b, ["chrom", "bin", "sample_idx"]).where((F.col("i") < F.col("j")) & (F.abs(F.col("pi") - F.col("pj")) <= within))
    both = pairs.where("xi IS NOT NULL AND xj IS NOT NULL")
    r2 = F.try_divide(F.pow(F.covar_pop("xi", "xj"), 2), F.var_pop("xi") * F.var_pop("xj"))
    return both.groupBy("chrom", "i", "j").agg(r2.alias("r2"))


def clump(x: np.ndarray, pos: np.ndarray, stat: np.ndarray, r2_thresh: float = 0.1, distance: Callable[[float], int] = window_bp) -> list[int]:
    """Columns kept, strongest |stat| first: the best that is left is kept and prunes those within the distance whose r2
    reaches the threshold. Equal stats go by column; missing stats last; a constant column prunes nothing."""
    m = x.shape[1]
    if not m:
        return []
    strength = np.where(np.isfinite(stat), np.abs(stat), -1.0)
    reach = distance(r2_thresh)
    c = x - x.mean(0)
    norm = np.sqrt((c**2).sum(0))
    by_pos = np.argsort(pos, kind="stable")
    sorted_pos = pos[by_pos]
    alive = np.ones(m, bool)
    kept: list[int] = []
    for k in np.lexsort((np.arange(m), -strength)):
        if not alive[k]:
            continue
        alive[k] = False
        kept.append(int(k))
        near = by_pos[np.searchsorted(sorted_pos, pos[k] - reach) : np.searchsorted(sorted_pos, pos[k] + reach, side="right")]
        near = near[alive[near]]
        if len(near) and norm[k] > 0:
            some = norm[near] > 0
            r2 = np.zeros(len(near))
            r2[some] = ((c[:, k] @ c[:, near[some]]) / (norm[k] * norm[near[some]])) ** 2
            alive[near[r2 >= r2_thresh]] = False
    return kept


def clump_groups(rows: DataFrame, group: str, r2_thresh: float = 0.1, distance: Callable[[float], int] = window_bp) -> DataFrame:
    """(group, snp_idx, clump_rank from 1) of the variants kept in each group. rows: (group, snp_idx, pos, stat,
    dosages array): one row per variant, so a group is a matrix of its variants and samples, not rows of calls."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("snp_idx", kind="stable").reset_index(drop=True)
        x = np.vstack(pdf["dosages"].to_list()).astype(float).T
        kept = clump(x, pdf["pos"].to_numpy(), pdf["stat"].to_numpy(float), r2_thresh, distance)
        return pd.DataFrame({group: pdf[group].iloc[0], "snp_idx": pdf["snp_idx"].to_numpy()[kept], "clump_rank": np.arange(1, len(kept) + 1)})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "snp_idx", "pos", "stat", "dosages").groupBy(group).applyInPandas(run, f"`{group}` {kind}, snp_idx long, clump_rank int")


