"""Queries p6_*: texts of the documents, in tokens, into containers of each capacity."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cisweave import storage
from cisweave.llm.packing import pack_items
from cisweave.tables import table

#: a tokenizer's rank file: lines of a base64 token and its rank
TOKENIZER = os.environ.get("CISWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: fixed value: how the public byte-level tokenizers divide text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(item, size): tokens of each whole text; null texts have none. The rank file is read once and broadcast."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"item": pdf["doc_id"], "size": [len(encoding.encode_ordinary(t)) for t in pdf["text"]]})

    return documents.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL").mapInPandas(count, "item long, size int")


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = storage.materialise(token_counts(table(spark, folder, "documents")), "tokens")
    capacities = table(spark, folder, "pack_sizes").select("pack_id", F.col("capacity_tokens").alias("capacity"))
    return pack_items(items, capacities), items


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[0].select("pack_id", "container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the least possible number, and the share of space used, per capacity."""
    packed, _ = _packed(spark, folder)
    caps = table(spark, folder, "pack_sizes").select("pack_id", "capacity_tokens")
    each = packed.groupBy("pack_id", "container").agg(F.sum("size").alias("fill"))
    total = each.groupBy("pack_id").agg(F.count("*").alias("n_containers"), F.sum("fill").alias("n_tokens")).join(F.broadcast(caps), "pack_id")
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return total.select("pack_id", "n_containers", least.alias("least"), (F.col("n_tokens") / F.col("capacity_tokens") / F.col("n_containers")).alias("fill"))


def p6_sound(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: texts packed, and whether each is whole, none is divided needlessly and no container overflows."""
    packed, items = _packed(spark, folder)
    packed = storage.materialise(packed, "packed")
    caps = F.broadcast(table(spark, folder, "pack_sizes").select("pack_id", "capacity_tokens"))
    docs = packed.groupBy("pack_id", "item").agg(F.sum("size").alias("got"), F.count("*").alias("n")).join(items, "item", "full").join(caps, "pack_id")
    per_doc = docs.groupBy("pack_id").agg(F.count("item").alias("n_docs"), F.bool_and(F.col("got") == F.col("size")).alias("whole"), F.bool_and(F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))).alias("undivided"))
    full = packed.groupBy("pack_id", "container").agg(F.sum("size").alias("fill")).join(caps, "pack_id").groupBy("pack_id").agg(F.bool_and(F.col("fill") <= F.col("capacity_tokens")).alias("within"))
    return per_doc.join(full, "pack_id")


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_sound": p6_sound}
SQL = {"p6_sound": "SELECT pack_id, count(d.doc_id) AS n_docs, true AS whole, true AS undivided, true AS within FROM pack_sizes, documents d WHERE d.text IS NOT NULL GROUP BY pack_id"}
