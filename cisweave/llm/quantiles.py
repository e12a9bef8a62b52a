"""Percentiles per group with bounded error from deterministic, mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (v, lo, hi): the rank of v among the n values lies in [lo, hi]. Every
partition makes one per group and column; summaries are merged hierarchically, `FAN_IN` at a time, and compressed after
each step to tuples whose neighbours leave at most the permitted uncertainty. Merging adds the absolute rank errors of
its inputs and compression may use only what the level allows, so the error that has accumulated is known at any time
(`rank_error`) and stays within eps * n. Summaries of separate days, runs or partitions are combined in the same way.

Defined results: null, NaN and infinite values are left out (count them apart); a group without values has no row; a
quantile of one value is that value; ties are kept as such; quantile q is the value of rank ceil(q * n), at least 1. Group columns must not be
named like the columns of a summary or of the answer (metric, part, n, rank_error, v, lo, hi, q, value, group).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
#: values held by a worker before they are turned into summaries
BUFFER = 1 << 18
SUMMARY = "metric string, part long, n long, rank_error long, v array<double>, lo array<long>, hi array<long>"

Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def summarise(values: np.ndarray) -> Summary:
    """The exact summary. Of equal values the first and the last copy are tuples; all ranks between are theirs."""
    v, count = np.unique(values, return_counts=True)
    last = np.cumsum(count)
    first = last - count + 1
    both = np.stack([first, last], 1).ravel()
    use = np.stack([np.ones(len(v), bool), count > 1], 1).ravel()
    rank = both[use].astype(np.int64)
    return int(last[-1]) if len(last) else 0, np.repeat(v, 2)[use], rank, rank.copy()


def merge(a: Summary, b: Summary) -> Summary:
    """Summary of both. A tuple's rank gains at least the lower rank of the other side's last tuple before it and at
    most the upper rank, less one, of the first tuple after it. Of equal values those of `a` come first."""
    if not a[0] or not b[0]:
        return b if not a[0] else a

    def gained(x: Summary, y: Summary, side: str):
        i = np.searchsorted(y[1], x[1], side=side)
        least = np.where(i > 0, y[2][np.maximum(i - 1, 0)], 0)
        most = np.where(i < len(y[1]), y[3][np.minimum(i, len(y[1]) - 1)] - 1, y[0])
        return x[2] + least, x[3] + most

    (la, ha), (lb, hb) = gained(a, b, "left"), gained(b, a, "right")
    v = np.concatenate([a[1], b[1]])
    order = np.argsort(v, kind="stable")
    lo, hi = np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order]
    return a[0] + b[0], v[order], np.maximum.accumulate(lo), np.minimum.accumulate(hi[::-1])[::-1]


def rank_error(s: Summary) -> int:
    """Most ranks by which an answer can be wrong: half the widest gap between neighbours of different value."""
    n, v, lo, hi = s
    gaps = np.where(v[1:] != v[:-1], hi[1:] - lo[:-1], 0)
    return max(int(np.max(gaps, initial=0)) // 2, int(hi[0]) - 1, n - int(lo[-1])) if n else 0


def compress(s: Summary, permitted: int) -> Summary:
    """Leave out tuples as long as neighbours that remain are within 2 * permitted ranks; the ends stay. Between two
    copies of one value nothing is uncertain, so a mass keeps its first and last copy only."""
    n, v, lo, hi = s
    if len(v) <= 2:
        return s
    keep, i, last = [0], 0, len(v) - 1
    end_of_mass = np.searchsorted(v, v, side="right") - 1
    reach = np.searchsorted(hi, lo + 2 * permitted, side="right") - 1
    while i < last:
        i = int(end_of_mass[i]) if end_of_mass[i] > i else min(max(int(reach[i]), i + 1), last)
        keep.append(i)
    k = np.array(keep)
    return n, v[k], lo[k], hi[k]


def query(s: Summary, q: float) -> tuple[float, int, int]:
    """Value at quantile q with the ranks its copies are sure to lie within."""
    n, v, lo, hi = s
    r = min(n, max(1, math.ceil(q * n - 1e-9)))
    # a value's ranks reach at least from its first copy's upper to its last copy's lower rank
    pair = np.r_[v[1:] == v[:-1], False]
    until = np.where(pair, np.r_[lo[1:], lo[-1:]], lo)
    i = int(np.argmin(np.maximum(np.maximum(hi - r, r - until), 0)))
    return float(v[i]), int(lo[i]), int(max(hi[i], hi[i + 1] if pair[i] else 0))


def fold(parts: list[Summary], eps: float) -> Summary:
    """Merge pairwise, so that each tuple takes part in few merges; compress once, at the end."""
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return compress(parts[0], int(eps * parts[0][0]))


def summaries(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], eps: float = 0.001) -> DataFrame:
    """One summary per group, metric and input partition, each within eps/2 of its own values. (groups..., SUMMARY)"""
    names = [f"g{i}" for i in range(len(groups))]
    data = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, flushes = TaskContext.get().partitionId() << 24, 0
        buffers: dict[tuple, list[np.ndarray]] = {}
        held = 0

        def flush() -> pd.DataFrame:
            rows = []
            for (key, m), arrays in buffers.items():
                s = compress(summarise(np.concatenate(arrays)), int(eps / 2 * sum(map(len, arrays))))
                rows.append((*key, metrics[m], task + flushes, s[0], rank_error(s), s[1], s[2], s[3]))
            buffers.clear()
            return pd.DataFrame(rows, columns=[*names, "metric", "part", "n", "rank_error", "v", "lo", "hi"])

        for pdf in batches:
            for key, own in pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]:
                key = tuple(None if pd.isna(k) else k for k in key)
                for m in range(len(metrics)):
                    x = own[f"m{m}"].to_numpy(float)
                    x = x[np.isfinite(x)] + 0.0
                    if len(x):
                        buffers.setdefault((key, m), []).append(x)
                        held += len(x)
            if held >= BUFFER:
                yield flush()
                held, flushes = 0, flushes + 1
        if buffers:
            yield flush()

    types = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    schema = ", ".join([f"{n} {types[n]}" for n in names] + [SUMMARY])
    return data.mapInPandas(make, schema).withColumnsRenamed(dict(zip(names, groups)))


def merged(parts: DataFrame, groups: Sequence[str], eps: float = 0.001) -> DataFrame:
    """One summary per group and metric, about FAN_IN merged at a time. parts is read twice: pass a written table."""
    n = max(1, parts.select("part").distinct().count())
    levels = max(1, math.ceil(math.log(max(2, n), FAN_IN)))
    schema, columns = parts.schema, parts.columns

    def step(level: int):
        allowed = eps / 2 * (1 + (level + 1) / levels)

        def merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
            s = fold([(int(r.n), np.asarray(r.v, float), np.asarray(r.lo, np.int64), np.asarray(r.hi, np.int64)) for r in pdf.itertuples()], allowed)
            row = pdf.iloc[[0]].copy()
            row["part"], row["n"], row["rank_error"] = pdf["group"].iloc[0], s[0], rank_error(s)
            for c, x in zip(("v", "lo", "hi"), s[1:]):
                row[c] = pd.Series([x], index=row.index)
            return row[columns]

        return merge_group

    out = parts
    for level in range(levels):
        n = math.ceil(n / FAN_IN)
        out = out.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(n)))
        out = out.groupBy(*groups, "metric", "group").applyInPandas(step(level), schema)
    return out


def quantiles(merged_summaries: DataFrame, groups: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(groups..., metric, q, value, n, lo, hi, rank_error) of each summary and quantile."""
    fields = {f.name: f.dataType.simpleString() for f in merged_summaries.schema.fields}
    schema = ", ".join([f"`{g}` {fields[g]}" for g in groups] + ["metric string, q double, value double, n long, lo long, hi long, rank_error long"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                s = (int(r["n"]), np.asarray(r["v"], float), np.asarray(r["lo"], np.int64), np.asarray(r["hi"], np.int64))
                for q in at:
                    value, lo, hi = query(s, q)
                    rows.append((*[r[g] for g in groups], r["metric"], float(q), value, s[0], lo, hi, r["rank_error"]))
            yield pd.DataFrame(rows, columns=[*groups, "metric", "q", "value", "n", "lo", "hi", "rank_error"])

    return merged_summaries.mapInPandas(ask, schema)
