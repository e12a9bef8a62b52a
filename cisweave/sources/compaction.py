"""Consolidation of very many small files into a few well-sized ones, each record exactly once.

The scan is tuned so that the engine packs many files into one split: the most bytes of a split and the cost charged
for opening a file are set from the number and total size of the files (`tune_splits`). Records are then written with
`coalesce`, which joins partitions without a shuffle, to a staging folder; the staged files are read back and held
against what went in (`CompactionError` if they differ), and only then moved to their final place by one rename.

Defined results: an empty or missing set of lines publishes an empty dataset. Null record fields are equal to each
other. A line whose file is unknown can repeat only within that file. A file without a time of writing comes after all
that have one. Columns of the lines beyond the record are those of the line that stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cisweave import storage

MAX_BYTES, OPEN_COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


class CompactionError(RuntimeError):
    """What was staged is not what was to be written; nothing was published."""


@dataclass(frozen=True)
class Splits:
    max_partition_bytes: int
    open_cost: int
    count: int


def tune_splits(n_files: int, total_bytes: int, cores: int, target_bytes: int = 128 << 20, open_work: int = 32 << 10, parallel: int = 4) -> Splits:
    """Settings under which the engine packs n_files into about total/target splits, at least `parallel` for each core.

    The engine charges a file its size plus the open cost and fills a split up to the maximum. An open cost far above
    the files' size, as by default (4 MB), spreads tiny files over far too many splits; one of 0 puts a million empty
    files into one task. It is set to the work that opening takes, in bytes read in the same time.
    """
    cost = min(open_work, max(1 << 10, total_bytes // max(1, n_files)))
    load = total_bytes + n_files * cost
    splits = max(1, math.ceil(load / target_bytes), min(cores * parallel, math.ceil(load / (1 << 20))))
    return Splits(max(1 << 20, math.ceil(load / splits)), cost, splits)


@contextmanager
def packed(spark: SparkSession, splits: Splits) -> Iterator[None]:
    """Jobs run inside read their files in such splits."""
    before = {k: spark.conf.get(k) for k in (MAX_BYTES, OPEN_COST)}
    spark.conf.set(MAX_BYTES, str(splits.max_partition_bytes))
    spark.conf.set(OPEN_COST, str(splits.open_cost))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def measure(spark: SparkSession, paths: Sequence[str]) -> tuple[int, int]:
    """Number of files and of bytes below the paths, as the file system counts them, without a list of the files."""
    n = size = 0
    for path in paths:
        fs, p = storage.filesystem(spark, path)
        for status in fs.globStatus(p) or []:
            s = fs.getContentSummary(status.getPath())
            n, size = n + s.getFileCount(), size + s.getLength()
    return n, size


@dataclass(frozen=True)
class Compacted:
    path: str
    files_in: int
    files_out: int
    lines_in: int
    records_out: int
    splits: Splits


def _digest(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("digest")]


def first_of_each(lines: DataFrame, record: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per record: the one that is first by `order`. Partial minima are taken before the shuffle, so that a
    record with very many copies is no hot group."""
    rest = [c for c in lines.columns if c not in (*record, *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order))
    return lines.groupBy(*record).agg(first.alias("_first")).select(*record, "_first.*")


def compact(
    lines: DataFrame, paths: Sequence[str], record: Sequence[str], order: Sequence[str], destination: str,
    keep: Sequence[str], target_bytes: int = 128 << 20, fmt: str = "parquet",
) -> Compacted:
    """Write each record of `lines` once, in files of about target_bytes, to `destination` (replaced if it exists).

    lines: read from the files below `paths`; record: columns that make two lines the same record; order: which of
    these stays; keep: the columns written.
    """
    spark = lines.sparkSession
    n, size = measure(spark, paths)
    splits = tune_splits(n, size, spark.sparkContext.defaultParallelism, target_bytes)
    staged = storage.scratch_path(spark, "staged")
    came, went = Observation(), Observation()
    out = first_of_each(lines.observe(came, F.count(F.lit(1)).alias("n")), record, order).select(*keep)
    out = out.observe(went, *_digest(out))
    files_out = max(1, math.ceil(size / target_bytes))
    with packed(spark, splits):
        out.coalesce(files_out).write.format(fmt).save(staged)
    back = spark.read.format(fmt).schema(out.schema).load(staged)
    found = back.agg(*_digest(back)).first()
    if (found["n"], found["digest"]) != (went.get["n"], went.get["digest"]) or found["n"] > came.get["n"]:
        storage.remove(spark, staged)
        raise CompactionError(f"staged {found['n']} records of digest {found['digest']}, expected {went.get}")
    publish(spark, staged, destination)
    return Compacted(destination, n, measure(spark, [f"{destination}/part-*"])[0], came.get["n"], found["n"], splits)


def publish(spark: SparkSession, staged: str, destination: str) -> None:
    """Move a staged folder to its place; what was there before stays until the new one can take its place."""
    fs, new = storage.filesystem(spark, staged)
    _, at = storage.filesystem(spark, destination)
    _, old = storage.filesystem(spark, f"{destination}.replaced")
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise CompactionError(f"cannot set aside {destination}")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise CompactionError(f"cannot publish {destination}")
    fs.delete(old, True)
