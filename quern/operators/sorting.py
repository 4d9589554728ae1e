"""Sorting, limits and top rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[tuple[str, bool]]):
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


def sort(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*_order(keys))


def top(df: DataFrame, keys: list[tuple[str, bool]], k: int) -> DataFrame:
    """k rows per task, then one merge: TakeOrderedAndProject."""
    return df.orderBy(*_order(keys)).limit(k)


def top_per_group(df: DataFrame, group: list[str], keys: list[tuple[str, bool]], k: int) -> DataFrame:
    """Spark prunes to k rows a group and task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*_order(keys))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_runs(runs: list[DataFrame], keys: list[tuple[str, bool]]) -> DataFrame:
    """One sorted table of several: stretches of the keys' range are dealt to tasks, each of which merges what
    it gets of every run."""
    return sort(functools.reduce(DataFrame.unionByName, runs), keys)


def cut_runs(batch_bytes: list[int], limit: int) -> list[list[int]]:
    """Indices of batches in each sorted run: a run is cut when the next batch would pass the limit."""
    runs: list[list[int]] = [[]]
    held = 0
    for i, size in enumerate(batch_bytes):
        if runs[-1] and held + size > limit:
            runs.append([])
            held = 0
        runs[-1].append(i)
        held += size
    return [r for r in runs if r]


def merge_passes(runs: int, fan_in: int) -> int:
    """Passes that write runs again before a last merge that streams its result."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    passes = 0
    while runs > fan_in:
        runs = -(-runs // fan_in)
        passes += 1
    return passes


def bytes_spilled(batch_bytes: list[int], limit: int, fan_in: int) -> int:
    """Bytes written to disk by an external sort; nothing where all fits."""
    runs = cut_runs(batch_bytes, limit)
    if len(runs) <= 1:
        return 0
    return sum(batch_bytes) * (1 + merge_passes(len(runs), fan_in))
