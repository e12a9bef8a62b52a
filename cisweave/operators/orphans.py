"""References to records that do not exist at the referring row's time.

Keys are dictionary-encoded as dense integers within key ranges. For every key range and period one compressed bitmap
holds the keys referred to and one the keys whose parent record is valid through the whole period; a bitmap is kept as
its non-zero 64-bit words, so it is an ordinary relation ``(range, period, word) -> bits`` that Spark builds with
``bit_or`` and map-side combining. ``reference AND NOT parent`` leaves the (key, period) pairs that can hold orphans;
the bits are decoded through the dictionary and only the rows of those pairs are held against the exact validity
intervals.

Defined results: a null key is no reference. A row without a time has no moment at which its parent exists, so it is an
orphan. A parent row without a start never begins. Repeated rows count each. Empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cisweave import storage

NO_PERIOD = -1


def month_no(t: Column) -> Column:
    """Months since year 0 as an integer."""
    return F.year(t) * 12 + F.month(t) - 1


def dictionary(keys: DataFrame, ranges: int) -> DataFrame:
    """(kind, key) -> (rng, code): codes are dense from 0 within each of `ranges` hash ranges of the keys."""
    k = keys.distinct().withColumn("rng", F.pmod(F.xxhash64("kind", "key"), F.lit(ranges)).cast("int"))
    return k.withColumn("code", F.row_number().over(Window.partitionBy("kind", "rng").orderBy("key")) - 1)


def orphan_references(refs: DataFrame, parents: DataFrame, ranges: int = 1024) -> DataFrame:
    """Rows of refs whose key has no parent record valid at the row's time.

    refs: (kind int, src int from 0 to 61, key string, t timestamp, row_id long). parents: (kind int, key string,
    valid_from timestamp, valid_to timestamp or null). Returns (kind, src, row_id), one row for each orphan row.
    """
    refs = refs.select("kind", "src", "key", "t", "row_id").where(F.col("key").isNotNull()).withColumn("period", F.coalesce(month_no(F.col("t")), F.lit(NO_PERIOD)))
    parents = parents.where("key IS NOT NULL AND valid_from IS NOT NULL").select("kind", "key", "valid_from", "valid_to").distinct()

    # One row for each key and period; src as a bit mask. Hot keys shrink before the shuffle.
    pairs = storage.materialise(
        refs.groupBy("kind", "key", "period").agg(F.bit_or(F.expr("shiftleft(1L, src + 1)")).alias("mask")), "orphan-pairs"
    )
    # the months that references have, not all between the first and the last: one odd date adds one month
    dated = pairs.where(F.col("period") != NO_PERIOD).groupBy("period").agg(F.bit_or("mask").alias("mask")).sort("period").collect()
    months = F.array(*[F.lit(r["period"]) for r in dated]) if dated else F.array().cast(f"array<{pairs.schema['period'].dataType.simpleString()}>")
    held = reduce(or_, [r["mask"] for r in dated], 0)
    codes = storage.materialise(dictionary(pairs.select("kind", "key").union(parents.select("kind", "key")), ranges), "orphan-codes")

    first = month_no(F.col("valid_from")) + F.when(F.date_trunc("month", "valid_from") == F.col("valid_from"), 0).otherwise(1)
    last = F.when(F.col("valid_to").isNotNull(), month_no(F.col("valid_to")) - 1)
    whole = (
        parents.select("kind", "key", first.alias("p0"), last.alias("p1"))
        .select("kind", "key", F.explode(F.filter(months, lambda m: (m >= F.col("p0")) & (F.col("p1").isNull() | (m <= F.col("p1"))))).alias("period"), F.lit(1).cast("long").alias("mask"))
    )
    bit = F.expr("shiftleft(1L, code & 63)")
    encoded = pairs.unionByName(whole).join(codes, ["kind", "key"])
    sources = [s for s in range(62) if held >> (s + 1) & 1] or [0]
    none = pairs.where(F.col("period") == NO_PERIOD)
    words = encoded.groupBy("kind", "rng", "period", F.shiftright("code", 6).alias("word")).agg(
        F.bit_or(F.when(F.col("mask") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("parent"),
        *[F.bit_or(F.when(F.col("mask").bitwiseAND(1 << (s + 1)) != 0, bit).otherwise(F.lit(0).cast("long"))).alias(f"ref_{s}") for s in sources],
    )
    left = words.select(
        "kind", "rng", "period", "word", *[F.col(f"ref_{s}").bitwiseAND(F.bitwise_not("parent")).alias(f"left_{s}") for s in sources]
    )
    any_left = F.lit(0).cast("long")
    for s in sources:
        any_left = any_left.bitwiseOR(F.col(f"left_{s}"))
    decoded = (
        left.withColumn("any_left", any_left)
        .where("any_left <> 0")
        .withColumn("b", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(any_left, i) = 1)")))
        .select(
            "kind", "rng", "period", (F.shiftleft(F.col("word"), 6) + F.col("b")).alias("code"),
            F.expr(" | ".join(f"shiftleft(cast(getbit(left_{s}, b) AS BIGINT), {s + 1})" for s in sources)).alias("mask"),
        )
        .join(codes, ["kind", "rng", "code"])
        .select("kind", "key", "period", "mask")
    )
    suspects = decoded.where(F.col("period") != NO_PERIOD).unionByName(none.select("kind", "key", "period", "mask"))
    rows = refs.join(suspects, ["kind", "key", "period"]).where(F.expr("getbit(mask, src + 1) = 1")).select("kind", "src", "key", "t", "row_id")
    p = parents.alias("p")
    r = rows.alias("r")
    exists = (F.col("r.kind") == F.col("p.kind")) & (F.col("r.key") == F.col("p.key")) & (F.col("p.valid_from") <= F.col("r.t")) & (F.col("p.valid_to").isNull() | (F.col("p.valid_to") > F.col("r.t")))
    return r.join(p, exists, "left_anti").select("kind", "src", "row_id")


def orphan_report(found: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orphans and references per table, field and month. rows: (*by, row_id, month); found: (*by, row_id)."""
    flagged = rows.join(found.withColumn("orphan", F.lit(1)), [*by, "row_id"], "left")
    return flagged.groupBy(*by, "month").agg(F.count("*").alias("n_refs"), F.count("orphan").alias("n_orphans"))

