"""Consolidation of the small coefficient and trajectory files: p3_found and p3_compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.functions import ids
from cisweave.sources.compaction import Compacted, compact
from cisweave.tables import table

#: kind of file: table of its lines, the columns of a record besides run and site
KINDS = {"betas": ("betas", ("snp", "beta")), "h2": ("h2_trajectory", ("iteration", "h2"))}


def lines_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Lines with run_id, site and time of their file. A line of no known file or site has a record of its own file."""
    name, _ = KINDS[kind]
    files = table(spark, folder, "result_files").where(F.col("kind") == kind).select("file_id", "run_id", ids.site_key("cpg_id").alias("site"), F.coalesce("written_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("written_at"))
    joined = table(spark, folder, name).join(files, "file_id", "left")
    return joined.withColumn("site", F.coalesce("site", F.concat(F.lit("file "), F.col("file_id").cast("string"))))


def compacted(spark: SparkSession, folder: str, kind: str, target_bytes: int = 32 << 20) -> Compacted:
    name, record = KINDS[kind]
    return compact(
        lines_of(spark, folder, kind), [f"{folder}/{name}.parquet"], ["run_id", "site", *record], ["written_at", "file_id", "line_no"],
        storage.scratch_path(spark, f"compact-{kind}"), ["file_id", "line_no", "pheno_id", "run_id", "site", *record], target_bytes,
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that the verified compact files leave out."""
    out = None
    for kind, (name, _) in KINDS.items():
        kept = spark.read.parquet(compacted(spark, folder, kind).path).select("file_id", "line_no")
        gone = table(spark, folder, name).select("file_id", "line_no").join(kept, ["file_id", "line_no"], "left_anti").select(F.lit(kind).alias("kind"), "file_id", "line_no")
        out = gone if out is None else out.unionByName(gone)
    return out


def p3_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and records by kind, as the compact files hold them."""
    rows = [(kind, c.lines_in, c.records_out) for kind in KINDS for c in [compacted(spark, folder, kind)]]
    return spark.createDataFrame(rows, "kind string, n_lines long, n_records long")


_SQL = " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, l.file_id, l.line_no, row_number() OVER (PARTITION BY f.run_id, coalesce({ids.sql_site('f.cpg_id')}, 'file ' || l.file_id), {', '.join('l.' + c for c in record)}
 ORDER BY coalesce(f.written_at, TIMESTAMP '9999-12-31'), l.file_id, l.line_no) AS n FROM {name} l LEFT JOIN result_files f ON f.file_id = l.file_id AND f.kind = '{kind}'"""
    for kind, (name, record) in KINDS.items()
)
QUERIES = {"p3_found": p3_found, "p3_compaction": p3_compaction}
SQL = {
    "p3_found": f"SELECT kind, file_id, line_no FROM ({_SQL}) WHERE n > 1",
    "p3_compaction": f"SELECT kind, count(*) AS n_lines, count(*) FILTER (n = 1) AS n_records FROM ({_SQL}) GROUP BY kind",
}
