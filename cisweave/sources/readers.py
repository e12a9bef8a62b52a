"""Scans of variant, sample, phenotype, manifest and region files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = storage.filesystem(spark, path)
    return bool(fs.exists(p))


def _fields(spark: SparkSession, path: str, names: Sequence[tuple[str, str]]) -> DataFrame:
    """Whitespace-separated headerless text, with the line number from 0 as `_line`."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    indexed = lines.rdd.zipWithIndex().map(lambda r: (r[1], r[0][0])).toDF("_line long, value string")
    return indexed.select("_line", *[F.get(parts, i).cast(t).alias(n) for i, (n, t) in enumerate(names)])


def bim(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a BIM file; snp_idx is the line."""
    df = _fields(spark, path, [("chrom", "string"), ("snp", "string"), ("cm", "double"), ("pos", "long"), ("a1", "string"), ("a2", "string")])
    return df.withColumnRenamed("_line", "snp_idx")


def fam(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a FAM file; sample_idx is the line."""
    df = _fields(spark, path, [("fid", "string"), ("iid", "string"), ("father", "string"), ("mother", "string"), ("sex", "int"), ("phenotype", "string")])
    return df.withColumn("sample_idx", F.col("_line").cast("int")).drop("_line")


def tsv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """Tab-separated file, compressed or not; without a header columns are named by position from 0."""
    reader = spark.read.option("sep", "\t").option("header", header)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df if header or schema else df.toDF(*[str(i) for i in range(len(df.columns))])


def phenotypes(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Wide phenotypes by suffix: parquet, or tab-separated text (also .gz)."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tsv(spark, path, header)


def sample_ids(df: DataFrame, column: str | None = None) -> DataFrame:
    """(sample_idx, sample_id): the values of a column of the sample table if it has that one, else its column names."""
    if column in df.columns:
        return with_sample_idx(df).select("sample_idx", F.col(f"`{column}`").cast("string").alias("sample_id"))
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "sample_idx int, sample_id string")


def phenotype_column(df: DataFrame, pheno_id: str | None = None, y_pos: int | None = None) -> DataFrame:
    """One column, by position or else by name, as y."""
    name = df.columns[y_pos] if y_pos is not None else pheno_id
    return df.select(F.col(f"`{name}`").cast("double").alias("y"))


def with_sample_idx(df: DataFrame) -> DataFrame:
    """Rows numbered from 0 in file order: by the row index of one parquet file, else by line."""
    files = df.inputFiles()
    if len(files) == 1 and files[0].endswith(".parquet"):
        return df.withColumn("sample_idx", F.col("_metadata.row_index").cast("int"))
    schema = df.schema.add("sample_idx", "long")
    rows = df.rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return df.sparkSession.createDataFrame(rows, schema).withColumn("sample_idx", F.col("sample_idx").cast("int"))


def wide_to_long(df: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """(pheno_id, sample_idx, y) from one numeric column per phenotype; text columns are not phenotypes."""
    numbered = df if "sample_idx" in df.columns else with_sample_idx(df)
    values = list(ids) if ids else [n for n, t in numbered.dtypes if n != "sample_idx" and t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    cast = numbered.select("sample_idx", *[F.col(f"`{v}`").cast("double").alias(v) for v in values])
    return cast.unpivot("sample_idx", [f"`{v}`" for v in values], "pheno_id", "y").select(F.regexp_replace("pheno_id", "`", "").alias("pheno_id"), "sample_idx", "y")


def genotypes_of_arrays(spark: SparkSession, genotypes, variants) -> DataFrame:
    """Genotypes (schemas.GENOTYPES) of a NumPy matrix, samples x variants, and a pandas table of its variants (chrom, snp,
    pos) in the order of the columns. NaN is a missing call."""
    table = pa.table({
        "snp_idx": pa.array(range(len(variants)), pa.int64()), "chrom": pa.array(variants["chrom"].astype(str)), "snp": pa.array(variants["snp"].astype(str)),
        "pos": pa.array(variants["pos"], pa.int64()), "dosages": pa.array(list(np.asarray(genotypes, np.float32).T), pa.list_(pa.float32())),
    })
    return spark.createDataFrame(table)


def phenotypes_of_arrays(spark: SparkSession, values, name: str = "y") -> DataFrame:
    """Long phenotypes (pheno_id, sample_idx, y) of a pandas table with a numeric column each, or of one NumPy vector."""
    wide = values.select_dtypes("number") if isinstance(values, pd.DataFrame) else pd.DataFrame({name: np.asarray(values, float)})
    n, columns = len(wide), [str(c) for c in wide.columns]
    table = pa.table({
        "pheno_id": pa.array([c for c in columns for _ in range(n)], pa.string()), "sample_idx": pa.array(list(range(n)) * len(columns), pa.int32()),
        "y": pa.array(wide.to_numpy(float).T.ravel(), pa.float64()),
    })
    return spark.createDataFrame(table)


def union_variants(tables: Sequence[DataFrame]) -> DataFrame:
    """Variants of several files, each (chrom, snp, pos) once."""
    return reduce(DataFrame.unionByName, [t.select("chrom", "snp", "pos") for t in tables]).dropDuplicates()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tsv(spark, path)


def manifest(spark: SparkSession, template: str, chromosomes: Sequence) -> DataFrame | None:
    """Sites (cpg_id, chrom, cpg_pos) of the manifests of chromosomes; those without a file are left out. chrom, if a
    file lacks it or has nulls, is the template's."""
    found = []
    for c in chromosomes:
        path = template.format(chrom=c)
        if exists(spark, path):
            df = by_suffix(spark, path)
            chrom = F.coalesce(F.col("chrom").cast("string"), F.lit(str(c))) if "chrom" in df.columns else F.lit(str(c))
            found.append(df.select("cpg_id", chrom.alias("chrom"), F.col("cpg_pos").cast("long").alias("cpg_pos")))
    return reduce(DataFrame.unionByName, found) if found else None


def manifests(spark: SparkSession, template: str, pheno_template: str, chromosomes: Sequence) -> DataFrame | None:
    """manifest() with pheno_path, the file of each site's chromosome."""
    parts = [(c, manifest(spark, template, [c])) for c in chromosomes]
    found = [df.withColumn("pheno_path", F.lit(pheno_template.format(chrom=c))) for c, df in parts if df is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def error_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a tab-separated file with `Chr`, as `Chrom` without the prefix; empty if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "Chrom int, Start long, End long")
    return tsv(spark, path).withColumn("Chrom", F.regexp_replace("Chr", "chr", "").cast("int"))


def window_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless list of chrom, start, end."""
    df = tsv(spark, path, header=False)
    return df.select(F.col("0").cast("string").alias("chrom"), F.col("1").cast("long").alias("start"), F.col("2").cast("long").alias("end"))


def phenotype_mapping(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, phenotype_id as windows."""
    df = tsv(spark, path)
    return df.select(F.concat_ws("_", "chrom", "start", "end").alias("window_id"), F.col("chrom").cast("string").alias("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("phenotype_id").cast("string").alias("pheno_id"))


def chromosomes(spec: str) -> list[str]:
    """'1-22', '1,2,X' or a mixture, in order."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        out += [str(c) for c in range(int(low), int(high) + 1)] if dash else [part]
    return out


def path_of(template: str, **columns) -> str:
    return template.format(**columns)
