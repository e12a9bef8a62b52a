"""Queries p1_* (sample by target proportions) and p4_* (stable sample)."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.functions import ids
from cisweave.llm import ledger, proportional
from cisweave.tables import table

SEED = 13
P4_SHARE, P4_LEAST = 0.1, 2


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """(key, chrom, value): each site once, with its latest usable number of SNPs."""
    rows = table(spark, folder, "tuning_selection").select(ids.site_key("cpg_id").alias("key"), "chrom", "m_raw", "counted_at", "sel_row")
    latest = proportional.latest_usable(rows.withColumn("key", F.concat_ws("|", "key", F.when(~F.col("key").rlike(ids.NAMED), F.coalesce(ids.chrom_key("chrom"), F.lit(""))))).where("key <> ''"), "key", "m_raw", ["counted_at", "sel_row"])
    site = F.substring_index("key", "|", 1)
    return latest.select(site.alias("key"), F.coalesce(ids.site_chrom(site), F.nullif(F.substring_index("key", "|", -1), F.lit(""))).alias("chrom"), F.col("m_raw").alias("value"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tuning_targets").withColumn("chrom", ids.chrom_key("chrom"))


def p1_allocation(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    return proportional.allocation(proportional.category_members(_pool(spark, folder), targets), targets)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_allocation(spark, folder).where("is_short").select("plan_id", "chrom", "bin_no")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    members = proportional.category_members(storage.materialise(_pool(spark, folder), "pool"), targets)
    allocated = storage.materialise(proportional.allocation(members, targets), "allocation")
    return proportional.draw(members, allocated, SEED).withColumnRenamed("key", "site")


def p1_sound(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan: rows drawn; whether each site is drawn once, no category gives more than its pool or less than its minimum
    (or all it has), and as many are drawn as are allocated."""
    targets = _targets(spark, folder)
    members = proportional.category_members(storage.materialise(_pool(spark, folder), "pool"), targets)
    allocated = storage.materialise(proportional.allocation(members, targets), "allocation")
    leaf = ["plan_id", "chrom", "bin_no"]
    drawn = storage.materialise(proportional.draw(members, allocated, SEED), "drawn")
    per_leaf = drawn.groupBy(*leaf).agg(F.count("*").alias("n"))
    least = targets.select(*leaf, F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    checks = allocated.join(least, leaf).join(per_leaf, leaf, "left").fillna(0, ["n"]).groupBy("plan_id").agg(
        F.sum("n").alias("n_drawn"), F.bool_and(F.col("n") <= F.col("pool")).alias("within_pool"), F.bool_and(F.col("n") >= F.least("pool", "min_rows")).alias("minima_met"),
        F.bool_and(F.col("n") == F.col("drawn")).alias("as_allocated"),
    )
    repeats = drawn.groupBy("plan_id", "key").agg(F.count("*").alias("k")).groupBy("plan_id").agg((F.max("k") == 1).alias("once"))
    return checks.join(repeats, "plan_id", "left").fillna(True, ["once"])


def p4_growth(spark: SparkSession, folder: str) -> DataFrame:
    """Per chromosome: sites selected from the earlier half of the batches, then, the ledger kept, from all of them; and
    whether each site of the first selection is in the second. The ledger is the call's own."""
    key = ids.site_key("cpg_id")
    rows = table(spark, folder, "sites").select(key.alias("key"), ids.site_chrom(key, "chrom").alias("grp"), F.col("batch_no").alias("batch"))
    path, half = storage.scratch_path(spark, "growth"), rows.agg(F.floor((F.min("batch") + F.max("batch")) / 2)).first()[0]
    early = storage.materialise(ledger.members(rows.where(F.col("batch") <= half), SEED), "population")
    before = storage.materialise(ledger.grow(early, path, P4_SHARE, P4_LEAST).select("key", "grp"), "before")
    population = storage.materialise(ledger.members(rows, SEED), "population")
    after = ledger.grow(population, path, P4_SHARE, P4_LEAST).select("key", "grp")
    both = before.select("key", F.lit(1).alias("a")).join(after.select("key", "grp", F.lit(1).alias("b")), "key", "full").join(population.select("key", F.col("grp").alias("chrom")), "key")
    return both.groupBy("chrom").agg(F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.bool_and(F.col("a").isNull() | F.col("b").isNotNull()).alias("kept"))


def _ledger_path(spark: SparkSession, folder: str) -> str:
    """Where the sample of a table folder lasts in the shared folder; storage.clear() leaves it. Other seeds and shares
    have ledgers of their own."""
    name = hashlib.md5(f"{os.path.abspath(folder)}|{SEED}|{P4_SHARE}|{P4_LEAST}".encode()).hexdigest()
    return f"{storage.shared_dir(spark)}/cisweave-ledgers/p4_sample-{name}"


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Sites selected per chromosome, with the batch of the manifest that added each."""
    key = ids.site_key("cpg_id")
    rows = table(spark, folder, "sites").select(key.alias("key"), ids.site_chrom(key, "chrom").alias("grp"), F.col("batch_no").alias("batch"))
    population = storage.materialise(ledger.members(rows, SEED), "population")
    chosen = ledger.grow(population, _ledger_path(spark, folder), P4_SHARE, P4_LEAST)
    # a round for rows that came late under an old batch has no number: the site's own batch
    own = population.select("key", F.col("batch").alias("own"))
    return chosen.join(own, "key", "left").select(F.col("key").alias("site"), F.col("grp").alias("chrom"), F.coalesce(F.expr("try_cast(batch AS long)"), "own").alias("batch"))


_SITE = ids.sql_site("cpg_id")
_POOL = f"""pool AS (SELECT site, {ids.sql_site_chrom('site')} AS chrom, m_raw FROM
 (SELECT {_SITE} AS site, m_raw, row_number() OVER (PARTITION BY {_SITE} ORDER BY counted_at DESC, sel_row DESC) AS n FROM tuning_selection WHERE m_raw > 0 AND {_SITE} IS NOT NULL) WHERE n = 1),
counts AS (SELECT t.plan_id, {ids.sql_chrom('t.chrom')} AS chrom, t.bin_no, t.target_share, t.min_rows, t.sample_rows, count(p.site) AS pool FROM tuning_targets t
 LEFT JOIN pool p ON p.chrom = {ids.sql_chrom('t.chrom')} AND (t.m_low IS NULL OR p.m_raw >= t.m_low) AND (t.m_high IS NULL OR p.m_raw <= t.m_high) GROUP BY ALL)"""

QUERIES = {"p1_found": p1_found, "p1_allocation": p1_allocation, "p1_sample": p1_sample, "p1_sound": p1_sound, "p4_sample": p4_sample, "p4_growth": p4_growth}
SQL = {
    # all that is asked for is drawn, or all there is; every minimum is met where the sample has room for all
    "p1_sound": f"WITH {_POOL} SELECT plan_id, CAST(least(max(sample_rows), sum(pool)) AS BIGINT) AS n_drawn, true AS within_pool, sum(least(pool, min_rows)) <= max(sample_rows) AS minima_met, true AS as_allocated, true AS once FROM counts GROUP BY plan_id",
    # quotas rise with the batches, so the last one tells how many there are
    "p4_growth": f"""WITH rows AS (SELECT {_SITE} AS site, {ids.sql_site_chrom(_SITE, 'chrom')} AS chrom, batch_no FROM sites WHERE {_SITE} IS NOT NULL),
half AS (SELECT floor((min(batch_no) + max(batch_no)) / 2) AS h FROM rows), m AS (SELECT site, min(chrom) AS chrom, min(batch_no) AS batch FROM rows GROUP BY site),
n AS (SELECT chrom, count(*) FILTER (batch <= h) AS a, count(*) AS b FROM m, half GROUP BY chrom)
SELECT chrom, CAST(least(a, greatest(ceil(a * CAST({P4_SHARE} AS DOUBLE)), {P4_LEAST})) AS BIGINT) AS n_before, CAST(least(b, greatest(ceil(b * CAST({P4_SHARE} AS DOUBLE)), {P4_LEAST})) AS BIGINT) AS n_after, true AS kept FROM n""",
    "p1_found": f"WITH {_POOL} SELECT plan_id, chrom, bin_no FROM counts WHERE pool < min_rows OR pool < target_share * sample_rows",
    # One step a batch; `held` is the ledger of a chromosome.
    "p4_sample": f"""WITH RECURSIVE rows AS (SELECT {_SITE} AS site, {ids.sql_site_chrom(_SITE, 'chrom')} AS chrom, batch_no FROM sites),
member AS (SELECT site, min(chrom) AS chrom, min(batch_no) AS batch, md5('{SEED}|' || site) AS pri FROM rows WHERE site IS NOT NULL GROUP BY site),
batches AS (SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS round FROM (SELECT DISTINCT batch FROM member)),
pops AS (SELECT b.round, m.chrom, list(m.site ORDER BY m.pri, m.site) AS sites, greatest(ceil(count(*) * CAST({P4_SHARE} AS DOUBLE)), {P4_LEAST}) AS quota FROM batches b JOIN member m ON m.batch <= b.batch GROUP BY ALL),
chroms AS (SELECT DISTINCT chrom FROM member),
steps AS (SELECT CAST(-1 AS BIGINT) AS round, chrom, CAST([] AS VARCHAR[]) AS held, CAST([] AS VARCHAR[]) AS added FROM chroms
 UNION ALL
 SELECT s.round + 1, s.chrom, list_concat(s.held, x.new), x.new FROM steps s LEFT JOIN pops p ON p.round = s.round + 1 AND p.chrom = s.chrom,
 LATERAL (SELECT coalesce(list_slice(list_filter(p.sites, lambda k: NOT list_contains(s.held, k)), 1, CAST(greatest(p.quota - len(s.held), 0) AS BIGINT)), CAST([] AS VARCHAR[])) AS new) x
 WHERE s.round + 1 <= (SELECT max(round) FROM batches))
SELECT unnest(added) AS site, chrom, CAST(b.batch AS BIGINT) AS batch FROM steps JOIN batches b USING (round)""",
}
