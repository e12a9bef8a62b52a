"""A sample whose shares by category match given targets, over a tree plan -> parent -> leaf.

Allocation is top-down: the rows of a plan are divided over the parents and each parent's over its leaves, in
proportion to the targets and with the minimum of small leaves set aside first. What a leaf cannot fill passes first to
its siblings (leaves of the same parent) and then, through the root, to its cousins. At the leaves rows are drawn by the
dense rank of a seeded permutation of their keys, so a sample does not depend on partitioning or row order.

Defined results: a null bound of a range is open; an item in no category is not drawn; an item counts once in each
category of a plan; a plan whose pool is smaller than its size draws all of it. A leaf is short when its pool has fewer
items than min_rows or than target_share * sample_rows (not rounded). Null shares and minima count as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cisweave.operators.ranking import bounded_broadcast, priority, spread_rank

#: categories up to which the table of categories is broadcast; beyond, the pool is shuffled to it
BROADCAST_CATEGORIES = 100_000

ALLOCATION = "plan_id int, chrom string, bin_no int, pool long, quota long, drawn long, from_siblings long, from_cousins long, unmet long, is_short boolean"


def whole(parts: np.ndarray, total: int) -> np.ndarray:
    """Integers of the given total next to `parts` (scaled to it): largest remainders, the first of equals."""
    parts = np.asarray(parts, float)
    if total <= 0 or parts.sum() <= 0:
        return np.zeros(len(parts), np.int64)
    exact = parts * (total / parts.sum())
    low = np.floor(exact + 1e-9).astype(np.int64)
    left = int(total - low.sum())
    if left > 0:
        low[np.argsort(-(exact - low), kind="stable")[:left]] += 1
    return low


def pour(amount: int, weight: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Share `amount` out by weight, never above the room of each; what no room holds stays unshared."""
    got = np.zeros(len(room), np.int64)
    amount = int(min(amount, room.sum()))
    while amount > 0:
        free = room - got
        w = np.where(free > 0, np.maximum(weight, 1e-12), 0.0)
        add = np.minimum(whole(w, amount), free)
        got += add
        amount -= int(add.sum())
    return got


def allocate(share: np.ndarray, least: np.ndarray, pool: np.ndarray, parent: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Quotas of one plan's leaves and how many are drawn, with what came from siblings and from cousins. A minimum counts
    as far as the pool reaches; where the sample has room for all of these, each leaf has its own."""
    share, least = np.nan_to_num(share.astype(float)), np.minimum(np.nan_to_num(least.astype(float)).astype(np.int64), pool)
    want = share / share.sum() * size if share.sum() > 0 else np.zeros(len(share))
    fixed = want < least
    for _ in range(len(share)):  # minima first; the others share the rest, which can put more of them below their minimum
        rest = max(0, size - int(least[fixed].sum()))
        scaled = np.where(fixed, least, want / max(want[~fixed].sum(), 1e-300) * rest if (~fixed).any() else 0)
        below = ~fixed & (scaled < least)
        if not below.any():
            break
        fixed |= below
    names, at = np.unique(parent, return_inverse=True)
    of_parent = whole(np.bincount(at, scaled), size)
    quota = np.zeros(len(share), np.int64)
    for p in range(len(names)):
        own = at == p
        floor = np.where(fixed[own], least[own], 0)
        quota[own] = floor + whole(np.where(fixed[own], 0, scaled[own]), of_parent[p] - floor.sum()) if floor.sum() <= of_parent[p] and (~fixed[own]).any() else whole(np.maximum(scaled[own], 1e-12), of_parent[p])
    drawn = np.minimum(quota, pool)
    siblings, cousins = np.zeros_like(quota), np.zeros_like(quota)
    unmet = np.zeros(len(names), np.int64)
    for p in range(len(names)):
        own = at == p
        short = int((quota[own] - drawn[own]).sum())
        siblings[own] = pour(short, scaled[own], pool[own] - drawn[own])
        unmet[p] = short - siblings[own].sum()
    drawn = drawn + siblings
    room = np.bincount(at, pool - drawn).astype(np.int64)
    passed = pour(int(unmet.sum()), np.bincount(at, scaled), room)
    for p in range(len(names)):
        own = at == p
        cousins[own] = pour(int(passed[p]), scaled[own], pool[own] - drawn[own])
    return {"quota": quota, "drawn": drawn + cousins, "from_siblings": siblings, "from_cousins": cousins, "unmet": np.maximum(0, quota - np.minimum(quota, pool))}


def _allocate_plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["chrom", "bin_no"], kind="stable").reset_index(drop=True)
    share, least, pool = pdf["target_share"].fillna(0).to_numpy(float), pdf["min_rows"].fillna(0).to_numpy(float), pdf["pool"].to_numpy(np.int64)
    rows = pdf["sample_rows"].fillna(0)
    got = allocate(share, least, pool, pdf["chrom"].fillna("").to_numpy(str), int(rows.max()))
    short = (pool < least) | (pool < share * rows.to_numpy(float))
    return pdf[["plan_id", "chrom", "bin_no", "pool"]].assign(**got, is_short=short)


def category_members(items: DataFrame, categories: DataFrame) -> DataFrame:
    """(plan_id, chrom, bin_no, key): the items (key, chrom, value) in each category's chromosome and range of values."""
    c = bounded_broadcast(categories.select("plan_id", F.col("chrom").alias("_chrom"), "bin_no", "m_low", "m_high"), BROADCAST_CATEGORIES)
    within = (F.col("chrom") == F.col("_chrom")) & (F.col("m_low").isNull() | (F.col("value") >= F.col("m_low"))) & (F.col("m_high").isNull() | (F.col("value") <= F.col("m_high")))
    return items.select("key", "chrom", "value").join(c, within).select("plan_id", "chrom", "bin_no", "key")


def allocation(members: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per category: its pool, quota, rows drawn and where they came from. members: see category_members."""
    pool = members.groupBy("plan_id", "chrom", "bin_no").agg(F.count(F.lit(1)).alias("pool"))
    cats = categories.select("plan_id", "chrom", "bin_no", "target_share", "min_rows", "sample_rows")
    full = cats.join(pool, ["plan_id", "chrom", "bin_no"], "left").fillna(0, ["pool"])
    return full.groupBy("plan_id").applyInPandas(_allocate_plan, ALLOCATION)


def draw(members: DataFrame, allocated: DataFrame, seed: int) -> DataFrame:
    """(plan_id, chrom, bin_no, key): the rows with the lowest permuted ranks of each leaf, as many as it draws."""
    leaf = ["plan_id", "chrom", "bin_no"]
    ranked = spread_rank(members.select(*leaf, "key").withColumn("_p", priority(seed, "plan_id", "key")), leaf, "_p", "key")
    quota = bounded_broadcast(allocated.select(*leaf, "drawn"), BROADCAST_CATEGORIES)
    return ranked.join(quota, leaf).where("rank <= drawn").select(*leaf, "key")


def latest_usable(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value) of each key's last row by `order` among those with a value above 0."""
    return rows.where((F.col(value) > 0) & F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
