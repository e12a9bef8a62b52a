"""Genotypes, phenotypes, sites and methylation derived from the star-schema tables, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave.tables import table

HALF = 1_600


def genotypes_long(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    at = [F.get("embedding", (F.col("k") + i) % 64).cast("double") for i in range(3)]
    v = at[0] + at[1] + at[2]
    missing = ((F.col("vec_id") * 7 + F.col("k") * 13) % 97 == 0) & (F.col("k") % 16 == 5)
    dosage = F.when(F.col("k") == 63, 1.0).when(missing, F.lit(None).cast("double")).when(v < -0.1, 0.0).when(v < 0.1, 1.0).otherwise(2.0)
    return e.select(
        F.col("vec_id").cast("int").alias("sample_idx"), F.col("k").cast("long").alias("snp_idx"), F.when(F.col("k") < 32, "1").otherwise("2").alias("chrom"),
        F.concat(F.lit("rs"), F.col("k")).alias("snp"), (100000 + (F.col("k") % 32) * 200).cast("long").alias("pos"), dosage.cast("double").alias("dosage"),
    )


def genotypes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per variant, without regrouping: the dosages of 64 variants are built from each vector and gathered by
    sample once."""
    from cisweave.operators.qc import transpose

    return transpose(genotypes_long(spark, folder))


def phenotype(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(pheno_id, sample_idx, y) of `planted`, `label` or `null`."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("int").alias("sample_idx"), F.col("label").cast("double").alias("label"))
    if name == "label":
        y = e.select("sample_idx", F.col("label").alias("y"))
    elif name == "null":
        y = e.select("sample_idx", (F.pmod(F.col("sample_idx") * 7919, F.lit(1009)) / 1009.0).alias("y"))
    else:
        g = genotypes_long(spark, folder).where("snp_idx IN (10, 40)").groupBy("sample_idx").agg(F.sum(F.when(F.col("snp_idx") == 10, 0.5 * F.col("dosage"))).alias("a"), F.sum(F.when(F.col("snp_idx") == 40, 0.4 * F.col("dosage"))).alias("b"))
        y = g.join(e, "sample_idx").select("sample_idx", (F.col("a") - F.col("b") + 0.1 * F.col("label")).alias("y"))
    return y.select(F.lit(name).alias("pheno_id"), "sample_idx", "y")


def sites(spark: SparkSession) -> DataFrame:
    rows = [(f"{c}_{100000 + 1600 * i}", c, 100000 + 1600 * i) for c in ("1", "2") for i in range(4)] + [("1_5000000", "1", 5000000)]
    return spark.createDataFrame(rows, "cpg_id string, chrom string, cpg_pos long")


def big_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Variants from line items; the six columns of the id are unique."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("snp"), F.lit(None).cast("long").alias("snp_idx"),
        (1 + F.col("l_suppkey") % 22).cast("string").alias("chrom"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("pos"),
    )


def big_sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("window_id"), (1 + F.col("p_partkey") % 22).cast("string").alias("chrom"), (90000 + (F.col("p_partkey") * 7919) % 10000000).cast("long").alias("start")
    ).withColumn("end", F.col("start")).withColumn("pheno_id", F.col("window_id"))


def methylation(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "user_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    pos = (1000 * (1 + F.col("event_id") % 20)).cast("long")
    return e.groupBy(F.lit("chr1").alias("chrom"), pos.alias("pos"), F.col("user_id").cast("long").alias("sample_id")).agg(F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("meth"), F.max("k").alias("cov"))


SQL_GENO = """g AS (SELECT CAST(vec_id AS INTEGER) AS sample_idx, CAST(k AS BIGINT) AS snp_idx, CASE WHEN k<32 THEN '1' ELSE '2' END AS chrom, 'rs'||k AS snp, CAST(100000+(k%32)*200 AS BIGINT) AS pos,
 CAST(CASE WHEN k=63 THEN 1.0 WHEN (vec_id*7+k*13)%97=0 AND k%16=5 THEN NULL WHEN v < CAST(-0.1 AS DOUBLE) THEN 0.0 WHEN v < CAST(0.1 AS DOUBLE) THEN 1.0 ELSE 2.0 END AS DOUBLE) AS dosage
 FROM (SELECT vec_id, k, CAST(embedding[k+1] AS DOUBLE)+CAST(embedding[(k+1)%64+1] AS DOUBLE)+CAST(embedding[(k+2)%64+1] AS DOUBLE) AS v FROM (SELECT *, UNNEST(RANGE(64)) AS k FROM embeddings)))"""
SQL_PHENO = {
    "label": "ph AS (SELECT CAST(vec_id AS INTEGER) AS sample_idx, CAST(label AS DOUBLE) AS y FROM embeddings)",
    "planted": """ph AS (SELECT e.vec_id::INTEGER AS sample_idx, CAST(0.5 AS DOUBLE)*a.dosage - CAST(0.4 AS DOUBLE)*b.dosage + CAST(0.1 AS DOUBLE)*e.label AS y FROM embeddings e JOIN g a ON a.sample_idx=e.vec_id AND a.snp_idx=10 JOIN g b ON b.sample_idx=e.vec_id AND b.snp_idx=40)""",
}
SQL_SITES = "st AS (SELECT c.chrom||'_'||(100000+1600*i) AS cpg_id, c.chrom, CAST(100000+1600*i AS BIGINT) AS cpg_pos FROM (SELECT unnest(['1','2']) AS chrom) c, range(4) t(i) UNION ALL SELECT '1_5000000','1',5000000)"
SQL_BIG = """v AS (SELECT CAST(1+l_suppkey%22 AS VARCHAR) AS chrom, CAST(round(l_extendedprice*100) AS BIGINT) AS pos FROM lineitem),
s AS (SELECT CAST(p_partkey AS VARCHAR) AS window_id, CAST(1+p_partkey%22 AS VARCHAR) AS chrom, CAST(90000+(p_partkey*7919)%10000000 AS BIGINT) AS start FROM part)"""
SQL_METH = """m AS (SELECT '1_'||(1000*(1+event_id%20)) AS cpg_id, CAST(1000*(1+event_id%20) AS BIGINT) AS pos, CAST(user_id AS BIGINT) AS sample_id, avg(least(CAST(1.0 AS DOUBLE), value/100)) AS meth, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS cov FROM events GROUP BY 1,2,3)"""
