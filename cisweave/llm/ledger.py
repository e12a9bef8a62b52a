"""A reproducible sample that keeps what it selected as the data grow.

The ledger is a table of the keys selected so far. An update joins the population with it, keeps every earlier key, and
fills each group's growth (its quota less what the ledger holds) from unseen keys with the lowest hash priority. The
priority depends on seed and key only, so any partitioning, row order or rerun gives the same sample.

Defined results: a null key is no member; a key's rows count once; a key without a group forms the group null; a quota
below what the ledger holds adds nothing; an empty population leaves the ledger as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.operators.ranking import priority, spread_rank

LEDGER = "key string, grp string, priority string"


def members(rows: DataFrame, seed: int) -> DataFrame:
    """(key, grp, batch, priority), one row per key: its first batch. rows: (key, grp, batch)."""
    first = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("grp").alias("grp"), F.min("batch").cast("long").alias("batch"))
    return first.withColumn("priority", priority(seed, "key"))


def growth(population: DataFrame, ledger: DataFrame, share: float, least: int) -> DataFrame:
    """The ledger rows to add for the population (key, grp, priority): so many that a group holds ceil(share * keys), at
    least `least` (or all its keys), unseen keys of lowest priority first."""
    kept = ledger.groupBy("grp").agg(F.count(F.lit(1)).alias("held")).withColumnRenamed("grp", "_held_grp")
    need = (
        population.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("grp", "_grp")
        .join(kept, F.col("_grp").eqNullSafe(F.col("_held_grp")), "left")
        .withColumn("need", F.greatest(F.ceil(F.col("n") * share), F.lit(least)) - F.coalesce("held", F.lit(0)))
        .where("need > 0").select("_grp", "need")
    )
    unseen = population.select("key", "grp", "priority").join(ledger.select("key"), "key", "left_anti")
    ranked = spread_rank(unseen, ["grp"], "priority", "key")
    return ranked.join(need, F.col("grp").eqNullSafe(F.col("_grp"))).where("rank <= need").select("key", "grp", "priority")


def grow(population: DataFrame, path: str, share: float, least: int = 1) -> DataFrame:
    """Bring the ledger at `path` up to the population, batch by batch, and return it: (key, grp, priority, batch).

    A batch that the ledger has is not repeated, so a rerun appends nothing. Rows that arrive later under an old batch
    count from the next round on; if there is no new batch, a last round makes up for them. population: see members().
    """
    spark = population.sparkSession
    batches = [r[0] for r in population.select("batch").distinct().sort(F.col("batch").asc_nulls_last()).collect()]
    done = rounds(spark, path)
    new = [b for b in batches if _name(b) not in done]
    for b in new:
        known = population if b is None else population.where(F.col("batch") <= max([b, *(int(d) for d in done if d.lstrip("-").isdigit())]))
        growth(known, read(spark, path), share, least).write.parquet(f"{path}/batch={_name(b)}")
    if done and not new:
        late = storage.materialise(growth(population, read(spark, path), share, least), "late")
        if late.limit(1).count():
            late.write.parquet(f"{path}/batch=late-{len(done)}")
    return read(spark, path)


def _name(batch: int | None) -> str:
    return "none" if batch is None else str(batch)


def rounds(spark: SparkSession, path: str) -> list[str]:
    """Batches that the ledger has in full; a round that broke off has no _SUCCESS and is written again."""
    fs, p = storage.filesystem(spark, path)
    found = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        name = s.getPath().getName()
        if name.startswith("batch="):
            if fs.exists(storage.filesystem(spark, f"{path}/{name}/_SUCCESS")[1]):
                found.append(name[6:])
            else:
                fs.delete(s.getPath(), True)
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: every key selected so far, with the batch that added it."""
    parts = [f"{path}/batch={n}" for n in rounds(spark, path)]
    if not parts:
        return spark.createDataFrame([], f"{LEDGER}, batch string")
    return spark.read.option("basePath", path).schema(f"{LEDGER}, batch string").parquet(*parts)
