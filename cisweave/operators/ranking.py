"""Exact ranks within groups of any size, without one task per group.

A window over a hot group sorts the whole group in one task. Here the rows of a group are spread over buckets by the
leading digits of a uniform hexadecimal priority; a row's rank is its rank within its bucket plus the rows in the
buckets before it. Only the small table of bucket sizes is summed per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(seed: int | str, *key: Column | str) -> Column:
    """A uniform hexadecimal priority that depends on seed and key only, not on partitioning or order."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def spread_rank(df: DataFrame, groups: Sequence[str], by: str, tie: str, rank: str = "rank", digits: int = 3) -> DataFrame:
    """df with `rank`, from 1, by the hexadecimal string `by` and then `tie` within the groups.

    (by, tie) must be unique within a group for ranks to be stable. A null in a group column is a group of its own.
    """
    # names of our own, so that no column of df is in the way
    bucket, within, before = "__rank_bucket", "__rank_within", "__rank_before"
    b = df.withColumn(bucket, F.substring(by, 1, digits))
    rows = b.withColumn(within, F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(by, tie)))
    sizes = b.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(before))
    sizes = sizes.withColumn(before, F.sum(before).over(Window.partitionBy(*groups).orderBy(bucket)) - F.col(before))
    keys = [*groups, bucket]
    named = sizes.select(*[F.col(k).alias(f"__rank_key{i}") for i, k in enumerate(keys)], before)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__rank_key{i}"))
    out = rows.join(named, on).withColumn(rank, (F.col(before) + F.col(within)).cast("long"))
    return out.drop(bucket, within, before, *[f"__rank_key{i}" for i in range(len(keys))])


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows (checked), unmarked otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
