"""Queries p7_*: evaluation texts inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave.llm import leakage
from cisweave.tables import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, into how many documents, and the longest stretch."""
    per_item = _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"), F.count_if(F.col("n_edits") == 0).alias("n_exact"))
    return table(spark, folder, "eval_items").select("item_id", "suite").join(per_item, "item_id", "left").fillna(0, ["n_docs", "n_exact"])


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
