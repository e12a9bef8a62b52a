"""Queries p8_*: abusive, hateful or sexual content of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.llm import offence
from cisweave.tables import table


def _scores(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    said = storage.materialise(offence.distinct_sentences(documents), "sentences")
    machine = offence.machine_of(said, table(spark, folder, "content_labels"))
    return offence.scores(documents, said, machine, ("doc_id", *keep))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return offence.cases(_scores(spark, folder)).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder, "source").select("doc_id", "source", "score")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    flagged = _scores(spark, folder, "source").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") > offence.THRESHOLD).alias("n_cases"))
    return flagged.withColumn("rate", F.col("n_cases") / F.col("n_docs"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
