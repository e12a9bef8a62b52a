"""Queries p5_*: percentiles of final_r2 and h2_unscaled per chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.functions import ids
from cisweave.llm import quantiles
from cisweave.tables import table

EPS = 0.001
AT = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
METRICS = ("final_r2", "h2_unscaled")
#: fixed value: the code that stands for a missing number
MISSING = -9.0


def usable(c: str) -> Column:
    """The value if it is a number on the metric's own scale: not the missing code, not above 1 (a share of variance
    cannot be; such values are percentages), and for h2 not below 0. R2 has no lower bound."""
    x = F.col(c)
    ok = ~F.isnan(x) & (x != MISSING) & (x <= 1)
    return F.when(ok & (x >= 0) if c == "h2_unscaled" else ok, x)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, day, metrics): each result once. A result sent again (same run, site and time) counts as loaded last."""
    key = ids.site_key("cpg_id")
    rows = table(spark, folder, "cpg_summary").select(
        "run_id", F.coalesce(key, F.concat(F.lit("row "), F.col("summary_id").cast("string"))).alias("site"), ids.site_chrom(key, "chrom").alias("chrom"),
        "finished_at", "loaded_at", "summary_id", *[usable(m).alias(m) for m in METRICS],
    )
    last = rows.groupBy("run_id", "site", "finished_at").agg(F.max_by(F.struct("chrom", *METRICS), F.struct("loaded_at", "summary_id")).alias("x"))
    return last.select("x.*", F.to_date("finished_at").alias("day"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles with the interval of ranks each is sure to lie in and the error that accumulated."""
    parts = storage.materialise(quantiles.summaries(records(spark, folder), ["chrom"], METRICS, EPS), "summaries")
    return quantiles.quantiles(quantiles.merged(parts, ["chrom"], EPS), ["chrom"], AT)


def p5_from_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same from stored summaries of single months, which are merged per chromosome."""
    rows = records(spark, folder).withColumn("month", F.date_format("day", "yyyy-MM"))
    monthly = storage.materialise(quantiles.summaries(rows, ["chrom", "month"], METRICS, EPS / 2), "months")
    per_month = storage.materialise(quantiles.merged(monthly, ["chrom", "month"], EPS / 2).withColumn("part", F.abs(F.xxhash64("month"))), "months")
    return quantiles.quantiles(quantiles.merged(per_month.drop("month"), ["chrom"], EPS), ["chrom"], AT)


def _checked(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Whether the true ranks of each answer are within EPS of the rank asked for, by exact counts."""
    rows = records(spark, folder)
    counts = None
    asked = F.broadcast(df.groupBy("chrom", "metric").agg(F.collect_list(F.struct("q", "value", "n")).alias("asked")))  # chromosomes x metrics x quantiles
    long = rows.select("chrom", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("m")).select("chrom", "m.*").where("x IS NOT NULL")
    joined = long.alias("l").join(asked.alias("a"), (F.col("l.metric") == F.col("a.metric")) & F.col("l.chrom").eqNullSafe(F.col("a.chrom"))).select("l.chrom", "l.metric", "x", F.explode("asked").alias("k"))
    counts = joined.groupBy("chrom", "metric", F.col("k.q").alias("q"), F.col("k.n").alias("n")).agg(F.count_if(F.col("x") < F.col("k.value")).alias("below"), F.count_if(F.col("x") <= F.col("k.value")).alias("upto"), F.count("*").alias("total"))
    r = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9)))
    off = F.greatest(F.col("below") + 1 - r, r - F.col("upto"), F.lit(0))
    return counts.select("chrom", "metric", "q", "n", ((off <= F.col("n") * EPS) & (F.col("n") == F.col("total"))).alias("within"))


def p5_within(spark: SparkSession, folder: str) -> DataFrame:
    """Each percentile of p5_percentiles held against exact ranks."""
    return _checked(storage.materialise(p5_percentiles(spark, folder), "percentiles"), spark, folder)


def p5_days_within(spark: SparkSession, folder: str) -> DataFrame:
    """Each percentile of p5_from_days, merged from stored months, held against exact ranks."""
    return _checked(storage.materialise(p5_from_days(spark, folder), "percentiles"), spark, folder)


_KEY = ids.sql_site("cpg_id")
_OK = {m: f"CASE WHEN NOT isnan({m}) AND {m} <> {MISSING} AND {m} <= 1{' AND ' + m + ' >= 0' if m == 'h2_unscaled' else ''} THEN {m} END" for m in METRICS}
QUERIES = {"p5_percentiles": p5_percentiles, "p5_from_days": p5_from_days, "p5_within": p5_within, "p5_days_within": p5_days_within}
SQL = {
    "p5_within": f"""WITH rows AS (SELECT {ids.sql_site_chrom(_KEY, 'chrom')} AS chrom, {', '.join(f'{x} AS {m}' for m, x in _OK.items())},
 row_number() OVER (PARTITION BY run_id, coalesce({_KEY}, 'row ' || summary_id), finished_at ORDER BY loaded_at DESC NULLS LAST, summary_id DESC) AS k FROM cpg_summary),
long AS ({' UNION ALL '.join(f"SELECT chrom, '{m}' AS metric, {m} AS x FROM rows WHERE k = 1 AND {m} IS NOT NULL" for m in METRICS)})
SELECT chrom, metric, q, count(*) AS n, true AS within FROM long, (SELECT unnest([{', '.join(f'CAST({q} AS DOUBLE)' for q in AT)}]) AS q) GROUP BY chrom, metric, q""",
}
SQL["p5_days_within"] = SQL["p5_within"]
