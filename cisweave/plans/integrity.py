"""Queries on references between tables: p2_found and p2_report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave.functions import ids
from cisweave.operators.orphans import month_no, orphan_references, orphan_report
from cisweave.tables import table

SITE, SAMPLE = 0, 1
#: kind of key, table, field, row id, time; the position is the number of the source
REFERENCES = (
    (SITE, "phenotypes", "cpg_id", "pheno_row", "measured_at"),
    (SITE, "cpg_summary", "cpg_id", "summary_id", "finished_at"),
    (SITE, "error_regions", "cpg_id", "region_row", "listed_at"),
    (SAMPLE, "phenotypes", "iid", "pheno_row", "measured_at"),
)


def references(spark: SparkSession, folder: str) -> DataFrame:
    """All references of REFERENCES as (kind, src, key, t, row_id); a table is scanned once for all of its fields."""
    out = None
    for name in dict.fromkeys(r[1] for r in REFERENCES):
        own = [(n, r) for n, r in enumerate(REFERENCES) if r[1] == name]
        fields = [
            F.struct(
                F.lit(kind).alias("kind"), F.lit(n).alias("src"),
                (ids.site_key(field) if kind == SITE else ids.sample_key(field)).alias("key"),
                F.col(t).cast("timestamp_ntz").alias("t"), F.col(row).cast("long").alias("row_id"),
            )
            for n, (kind, _, field, row, t) in own
        ]
        rows = table(spark, folder, name).select(F.inline(F.array(*fields)))
        out = rows if out is None else out.unionByName(rows)
    return out


def parents(spark: SparkSession, folder: str) -> DataFrame:
    def of(name: str, kind: int, key, start: str, end: str) -> DataFrame:
        return table(spark, folder, name).select(
            F.lit(kind).alias("kind"), key.alias("key"),
            F.col(start).cast("timestamp_ntz").alias("valid_from"), F.col(end).cast("timestamp_ntz").alias("valid_to"),
        )

    return of("sites", SITE, ids.site_key("cpg_id"), "added_at", "retired_at").unionByName(
        of("samples", SAMPLE, ids.sample_key("iid"), "enrolled_at", "withdrawn_at")
    )


def _named(df: DataFrame) -> DataFrame:
    tables = F.array(*[F.lit(r[1]) for r in REFERENCES])
    fields = F.array(*[F.lit(r[2]) for r in REFERENCES])
    return df.withColumn("src_table", F.get(tables, F.col("src"))).withColumn("src_field", F.get(fields, F.col("src")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphan_references(references(spark, folder), parents(spark, folder))
    return _named(found).select("src_table", "src_field", "row_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = references(spark, folder).where("key IS NOT NULL")
    found = orphan_references(references(spark, folder), parents(spark, folder)).select("src", "row_id")
    report = orphan_report(found, rows.withColumn("month", month_no(F.col("t"))), ["src"])
    return _named(report).select("src_table", "src_field", F.floor(F.col("month") / 12).cast("int").alias("year"), (F.pmod("month", F.lit(12)) + 1).cast("int").alias("month"), "n_refs", "n_orphans")


def _sql_refs() -> str:
    return " UNION ALL ".join(
        f"SELECT {kind} AS kind, '{name}' AS src_table, '{field}' AS src_field, {(ids.sql_site if kind == SITE else ids.sql_sample)(field)} AS key, {t} AS t, CAST({row} AS BIGINT) AS row_id FROM {name}"
        for kind, name, field, row, t in REFERENCES
    )


_SQL = f"""WITH refs AS (SELECT * FROM ({_sql_refs()}) WHERE key IS NOT NULL),
parents AS (SELECT DISTINCT {SITE} AS kind, {ids.sql_site('cpg_id')} AS key, added_at AS a, retired_at AS z FROM sites
  UNION SELECT {SAMPLE}, {ids.sql_sample('iid')}, enrolled_at, withdrawn_at FROM samples),
orphans AS (SELECT r.src_table, r.src_field, r.row_id, r.t FROM refs r WHERE NOT EXISTS
  (SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.key = r.key AND p.a <= r.t AND (p.z IS NULL OR p.z > r.t)))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _SQL + "SELECT src_table, src_field, row_id FROM orphans",
    "p2_report": _SQL
    + """SELECT r.src_table, r.src_field, CAST(year(r.t) AS INTEGER) AS year, CAST(month(r.t) AS INTEGER) AS month, count(*) AS n_refs, count(o.row_id) AS n_orphans
FROM refs r LEFT JOIN orphans o USING (src_table, src_field, row_id) GROUP BY 1, 2, 3, 4""",
}
