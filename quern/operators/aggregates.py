"""Aggregation forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import exact_avg, exact_sum


def summary(df: DataFrame, keys: list, value: str) -> DataFrame:
    """count, sum, min, max and avg of one column by keys (none: over all rows)."""
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        exact_sum(x).alias("total"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        exact_avg(x).alias("mean"),
    )


def partial(df: DataFrame, keys: list[str], value: str, by: Column) -> DataFrame:
    """States of `summary` for each key and part, such as a month: they can be stored, and combined with
    those of other parts when these come in."""
    x = F.col(value)
    return df.groupBy(*keys, by.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(x).alias("n_values"),
        F.sum(x.cast("decimal(18,2)")).alias("total"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )


def combine(states: DataFrame, keys: list[str]) -> DataFrame:
    """`summary` from states: counts add up, and avg comes from the sum and the number of values that aren't null."""
    total = F.sum("total").cast("double")
    return states.groupBy(*keys).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), total.alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), (total / F.nullif(F.sum("n_values"), F.lit(0))).alias("mean"))


def equal_depth(df: DataFrame, column: str, buckets: int, accuracy: int = 100_000) -> DataFrame:
    """Bounds of an equal-depth histogram: exact while the accuracy is above the number of rows, else each within
    rows / accuracy places."""
    cuts = [i / buckets for i in range(buckets + 1)]
    return df.agg(F.percentile_approx(column, cuts, accuracy).alias("bounds")).select(F.posexplode("bounds").alias("bucket", "bound"))


def misra_gries(rows, k: int) -> dict:
    """At most k counters over a stream; any key above a share of 1/(k+1) is among them. Counters are
    kept above a floor that rises in place of lowering each."""
    held, floor, at = {}, 0, {}
    for x in rows:
        if x in held:
            n = held[x]
            at[n].discard(x)
        elif len(held) < k:
            n = floor
        elif at.get(floor + 1):
            # one with a single count left goes, and with it a count of all others
            floor += 1
            for y in at.pop(floor):
                del held[y]
            continue
        else:
            floor += 1
            continue
        held[x] = n + 1
        at.setdefault(n + 1, set()).add(x)
    return {x: n - floor for x, n in held.items() if n > floor}
