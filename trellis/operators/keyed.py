"""Per-key aggregates that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_counts(df: DataFrame, key: str, distinct: str | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_rows[, n_distinct][, sum_x, nonnull_x ...]) for each value of `key`, the NULL key included as one group.

    Every measure is algebraic, so each task folds its rows into a hash table of partial states and only those are
    shuffled: a key with a third of all rows sends one state per task. With `distinct` the states are keyed by
    (key, distinct) first, which spreads a hot key over all tasks, and then counted per key. NULL values of `distinct`
    are not counted; NULLs in sums are skipped and nonnull_x tells how many were not. An empty table gives no row.
    Other columns of df are pruned and cannot clash.
    """
    parts = [F.col(key).alias("key"), *([F.col(distinct).alias("d")] if distinct else []), *[F.col(c).alias(f"v{i}") for i, c in enumerate(sums)]]
    base = df.select(*parts)
    first = [F.count(F.lit(1)).alias("n_rows")]
    for i in range(len(sums)):
        first += [F.sum(f"v{i}").alias(f"s{i}"), F.count(f"v{i}").alias(f"c{i}")]
    if distinct:
        base = base.groupBy("key", "d").agg(*first)
        second: list[Column] = [F.sum("n_rows").alias("n_rows"), F.count("d").alias("n_distinct")]
        for i in range(len(sums)):
            second += [F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"c{i}").alias(f"c{i}")]
        base = base.groupBy("key").agg(*second)
    else:
        base = base.groupBy("key").agg(*first)
    named = [F.col(f"{short}{i}").alias(f"{long}_{c}") for i, c in enumerate(sums) for short, long in (("s", "sum"), ("c", "nonnull"))]
    return base.select(F.col("key").alias(key), "n_rows", *(["n_distinct"] if distinct else []), *named)


def heavy_keys(counts: DataFrame, key: str, share: float) -> DataFrame:
    """Keys of a keyed_counts result with at least `share` of all rows; the total is a scalar subquery over the counts."""
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.where(F.col("n_rows") >= F.lit(share) * total)
