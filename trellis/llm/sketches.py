"""Distinct counts from bit matrices of hash ranks, merged by bitwise union and read by maximum likelihood.

A sketch of m rows keeps, for each row, the set of ranks seen: an item's hash picks the row with its low bits, and the
lowest set bit of the rest is its rank. A sketch is stored as relational rows (keys..., row, bits), so building and
merging are one `bit_or` aggregate with a map-side combine, partial results over days or graphs merge by the same
aggregate in any order, and a hot key costs one state per row and task. An item seen twice changes nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1024


def _ranks(m: int) -> int:
    if m < 16 or m & (m - 1):
        raise ValueError("the rows of a sketch are a power of two, 16 at least")
    return 64 - (m.bit_length() - 1)


def _packing(m: int) -> tuple[int, int]:
    """(counters that are packed into one bigint, bits of each): a counter is at most m."""
    width = m.bit_length()
    return 63 // width, width


def item_row(item_hash: Column, m: int = ROWS) -> Column:
    return item_hash.bitwiseAND(F.lit(m - 1)).cast("int")


def item_bits(item_hash: Column, m: int = ROWS) -> Column:
    """A bigint with one bit set: the lowest set bit of the hash without its row bits."""
    rest = F.shiftrightunsigned(item_hash, m.bit_length() - 1)
    return F.when(rest == 0, F.lit(1 << (_ranks(m) - 1))).otherwise(rest.bitwiseAND(-rest))


def sketch(df: DataFrame, keys: dict[str, Column], items: list[Column], m: int = ROWS) -> DataFrame:
    """(keys..., row, bits) of the distinct combinations of `items` per combination of keys.

    NULL keys are groups of their own. A combination with a NULL item is not counted. An empty table gives no row.
    """
    known = F.lit(True)
    for i in items:
        known = known & i.isNotNull()
    base = df.where(known).select(*[c.alias(k) for k, c in keys.items()], F.xxhash64(*items).alias("h"))
    return base.groupBy(*keys, item_row(F.col("h"), m).alias("row")).agg(F.bit_or(item_bits(F.col("h"), m)).alias("bits"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Union of sketches over every key that is not in `keys`."""
    return sketches.groupBy(*keys, "row").agg(F.bit_or("bits").alias("bits"))


def _packed(m: int) -> list[Column]:
    """For each rank the number of rows that saw it, several counters to a bigint; sums of these are the sufficient statistic."""
    out = []
    fields, width = _packing(m)
    for start in range(0, _ranks(m), fields):
        word = F.lit(0).cast("bigint")
        for i in range(min(fields, _ranks(m) - start)):
            bit = F.shiftrightunsigned(F.col("bits"), start + i).bitwiseAND(F.lit(1))
            word = word.bitwiseOR(F.shiftleft(bit, width * i))
        out.append(F.sum(word))
    return out


def likelihood_estimate(counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, standard error) for rows of rank counts.

    With Poisson arrivals a bit of rank k is set with probability 1 - exp(-n q_k), q_k = 2^-(k+1) / m. The score is
    monotone in n, so bisection on log n finds its root. The inverse Fisher information is the estimate's variance when the
    number of arrivals varies as well; the number of items does not, so its variance n is taken off.
    """
    ranks = counts.shape[1]
    q = 2.0 ** -np.minimum(np.arange(1, ranks + 1), ranks - 1) / m
    set_, unset = counts.astype(float), (m - counts).astype(float)
    right = unset @ q
    lo, hi = np.full(len(counts), np.log(1e-3)), np.full(len(counts), np.log(m) + ranks * np.log(2))
    for _ in range(64):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore", invalid="ignore"):
            left = (set_ * (q / np.expm1(np.exp(mid)[:, None] * q))).sum(axis=1)
        lo, hi = np.where(left > right, mid, lo), np.where(left > right, hi, mid)
    n = np.exp((lo + hi) / 2)
    with np.errstate(over="ignore"):
        information = (m * q**2 / np.expm1(n[:, None] * q)).sum(axis=1)
    none = set_.sum(axis=1) == 0
    return np.where(none, 0.0, n), np.where(none, 0.0, np.sqrt(np.maximum(1 / information - n, 0.0)))


def estimate(sketches: DataFrame, keys: list[str], m: int = ROWS) -> DataFrame:
    """(keys..., n_distinct, std_error, low, high): maximum-likelihood estimate, bounds three standard errors and one item away.

    The standard error is about 0.65 / sqrt(m) of a large count; the one item stands for a collision among few.
    """
    words = _packed(m)
    fields, width = _packing(m)
    sums = sketches.groupBy(*keys).agg(*[w.alias(f"__w{i}") for i, w in enumerate(words)])

    @F.pandas_udf("n_distinct double, std_error double")
    def read(packed: pd.Series) -> pd.DataFrame:
        if not len(packed):
            return pd.DataFrame({"n_distinct": [], "std_error": []}, dtype=float)
        w = np.vstack(packed.to_numpy()).astype(np.int64)
        counts = np.stack([(w[:, k // fields] >> (width * (k % fields))) & ((1 << width) - 1) for k in range(_ranks(m))], axis=1)
        n, se = likelihood_estimate(counts, m)
        return pd.DataFrame({"n_distinct": n, "std_error": se})

    out = sums.select(*keys, read(F.array(*[f"__w{i}" for i in range(len(words))])).alias("e"))
    n, se = F.col("e.n_distinct"), F.col("e.std_error")
    return out.select(*keys, n.alias("n_distinct"), se.alias("std_error"), F.greatest(n - 3 * se - 1, F.lit(0.0)).alias("low"), (n + 3 * se + 1).alias("high"))


def write(sketches: DataFrame, path: str, m: int = ROWS, mode: str = "errorifexists") -> None:
    """Keep sketches (keys..., row, bits) for later merging, as Parquet with their number of rows."""
    sketches.withColumn("m", F.lit(m)).write.mode(mode).parquet(path)


def read(spark: SparkSession, *paths: str) -> tuple[DataFrame, int]:
    """(sketches, m) of one or more kept tables of the same keys, not merged yet; an empty table has ROWS rows.

    Sketches of different numbers of rows, which cannot be merged, are an error.
    """
    df = spark.read.parquet(*paths)
    sizes = [r.m for r in df.select("m").distinct().collect()]
    if len(sizes) > 1:
        raise ValueError(f"sketches of {sorted(sizes)} rows cannot be merged")
    return df.drop("m"), sizes[0] if sizes else ROWS


def distinct_by_sets(df: DataFrame, keys: dict[str, Column], items: list[Column], sets: list[tuple[str, ...]], m: int = ROWS) -> DataFrame:
    """Estimates for every grouping set of `keys`: (by, keys..., n_distinct, std_error, low, high).

    `by` names the keys of the set, the others are NULL in it. See distinct_counts.
    """
    return distinct_counts(df, keys, {"items": (items, sets)}, m).drop("counted")


def distinct_counts(df: DataFrame, keys: dict[str, Column], counts: dict[str, tuple[list[Column], list[tuple[str, ...]]]], m: int = ROWS) -> DataFrame:
    """Estimates of several counts, each of its items over its own grouping sets, from one scan.

    Result: (counted, by, keys..., n_distinct, std_error, low, high). Of each count a sketch at its finest grouping is
    built from the rows; all its sets are merged from that one, under a 64-bit group hash that carries the row in its low
    bits, so that what is shuffled for them is two bigints a state whatever the keys are. The hash is turned back into keys
    by a join with the groups, which come from the finest sketches too. Rows with a NULL item are not counted and make no
    group.
    """
    low, names = m - 1, list(counts)
    _ranks(m)  # checks m
    combos = [(i, s) for i, name in enumerate(names) for s in counts[name][1]]
    finest_of = [{k for s in counts[name][1] for k in s} for name in names]
    columns = df.select(*[c.alias(k) for k, c in keys.items()], *[F.struct(*[x.alias(f"i{j}") for j, x in enumerate(counts[n][0])]).alias(f"__items{i}") for i, n in enumerate(names)])

    def entry(i: int) -> Column:
        own = [(F.col(k) if k in finest_of[i] else F.lit(None).cast(columns.schema[k].dataType)).alias(k) for k in keys]
        items = [F.col(f"__items{i}")[f"i{j}"] for j in range(len(counts[names[i]][0]))]
        known = reduce(lambda a, b: a & b, [x.isNotNull() for x in items])
        return F.when(known, F.struct(F.lit(i).alias("__c"), *own, F.xxhash64(*items).alias("__h")))

    entries = F.explode(F.array(*[entry(i) for i in range(len(names))])) if len(names) > 1 else entry(0)
    base = columns.select(entries.alias("__e")).where(F.col("__e").isNotNull()).select("__e.*")
    finest = base.groupBy("__c", *keys, item_row(F.col("__h"), m).alias("row")).agg(F.bit_or(item_bits(F.col("__h"), m)).alias("bits"))

    def group_hash(i: int, s: tuple[str, ...]) -> Column:
        parts = [F.lit(i), F.lit(",".join(s))]
        for k in s:
            parts += [F.coalesce(F.col(k).cast("string"), F.lit("")), F.col(k).isNull()]
        return F.xxhash64(*parts).bitwiseAND(F.lit(~low))

    def expand(frame: DataFrame, wanted: list[int], keep: list) -> DataFrame:
        """Rows of the finest groups under each of their sets among `wanted` (numbers of combos)."""
        each = None
        for i in range(len(names)):
            own = [F.struct(group_hash(*combos[n]).alias("gh"), F.lit(n).alias("set")) for n in wanted if combos[n][0] == i]
            own = F.array(*own) if own else F.array().cast("array<struct<gh:bigint,set:int>>")
            each = F.when(F.col("__c") == i, own) if each is None else each.when(F.col("__c") == i, own)
        return frame.select(*keep, F.explode(each).alias("x")).select(*keep, F.col("x.gh").alias("gh"), F.col("x.set").alias("set"))

    # the finest groups have their states already; only the coarser ones are merged
    fine = [n for n, (i, s) in enumerate(combos) if set(s) == finest_of[i]]
    coarse = [n for n in range(len(combos)) if n not in fine]
    states = expand(finest, fine, ["bits"]).select("gh", "bits")
    if coarse:
        merged = expand(finest, coarse, ["row", "bits"]).select(F.col("gh").bitwiseOR(F.col("row").cast("bigint")).alias("k"), "bits").groupBy("k").agg(F.bit_or("bits").alias("bits"))
        states = states.unionByName(merged.select(F.col("k").bitwiseAND(F.lit(~low)).alias("gh"), "bits"))
    groups = expand(finest.select("__c", *keys).distinct(), list(range(len(combos))), ["__c", *keys])
    kept = [F.when(F.array_contains(F.array(*[F.lit(n) for n, (_, s) in enumerate(combos) if k in s]), F.col("set")), F.col(k)).alias(k) if any(k in s for _, s in combos) else F.lit(None).cast(columns.schema[k].dataType).alias(k) for k in keys]
    by = F.element_at(F.array(*[F.lit(",".join(s) or "all") for _, s in combos]), F.col("set") + 1).alias("by")
    counted = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__c") + 1).alias("counted")
    named = groups.select("gh", counted, by, *kept).distinct()
    return estimate(states, ["gh"], m).join(named, "gh").select("counted", "by", *keys, "n_distinct", "std_error", "low", "high")
