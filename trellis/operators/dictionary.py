"""Term dictionaries: ids for terms, both directions, and re-encoding in term order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.operators.keyed import heavy_keys, keyed_counts
from trellis.session import broadcast_if_small, cut_lineage, parallelism

#: Bits of a global id below the rank that owns it.
RANK_SHIFT = 48


def distinct_terms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(nt): the terms of the columns, each once; a map-side combine goes before the shuffle."""
    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias("nt")) for c in columns]).where("nt IS NOT NULL").distinct()


def number_in_order(df: DataFrame, keys: Sequence, start: int = 1) -> DataFrame:
    """Add `id`, dense from start in the order of keys (Columns), without gathering the rows in one task.

    Rows are range-partitioned and sorted by the keys, marked with their place in their partition and written once; the
    partitions' sizes, one small row each, give the offsets. Ties get ids in no stated order.
    """
    named = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    order = [F.col(f"__k{i}").asc_nulls_first() for i in range(len(keys))]
    return number_rows(named.repartitionByRange(*order).sortWithinPartitions(*order).drop(*[f"__k{i}" for i in range(len(keys))]), start)


def number_rows(df: DataFrame, start: int = 1) -> DataFrame:
    """Add `id`, dense from start in the order that the rows stand in, as after a sort."""
    # the generated number holds the partition above its lower 33 bits and the row's place below
    placed = cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).count()
    first = sizes.select("__part", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__first"))
    out = placed.withColumn("__part", part).join(F.broadcast(first), "__part")
    return out.select((F.coalesce("__first", F.lit(0)) + place + start).alias("id"), *df.columns)


def build_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, nt, kind, value, lang, dt) with ids dense from 1 in term order: blank nodes, IRIs, literals, then by value."""
    terms = T.explode_term(distinct_terms(df, columns), "nt")
    return number_in_order(terms, [T.kind_rank("nt"), F.col("value"), F.col("nt")])


def extend_dictionary(terms: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The dictionary with ids, from its greatest upwards, for terms that it does not know yet."""
    new = distinct_terms(df, columns).join(terms.select("nt"), "nt", "left_anti")
    last = terms.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number_in_order(T.explode_term(new, "nt"), [T.kind_rank("nt"), F.col("value"), F.col("nt")], last + 1)
    return terms.unionByName(numbered)


def remove_terms(terms: DataFrame, gone: DataFrame) -> DataFrame:
    """The dictionary without the terms (nt) of a table."""
    return terms.join(gone.select("nt"), "nt", "left_anti")


def _with_pairs(df: DataFrame, column: str, pairs: DataFrame, out: str) -> DataFrame:
    """Left join of a column with a dictionary (key, value), whose value is added as `out`.

    A small dictionary is broadcast. With a greater one, keys that hold a larger share of the rows than a task's are counted
    first, with a map-side combine, and met by a broadcast of their few pairs; their rows are spread by a hash of the row
    instead of the key, so that no task gets all rows of a key.
    """
    held = broadcast_if_small(pairs)
    if held is not pairs:
        return df.join(held.toDF("__k", out), F.col(column) == F.col("__k"), "left").drop("__k")
    share = 1 / (4 * parallelism(df.sparkSession))
    heavy = heavy_keys(keyed_counts(df.where(F.col(column).isNotNull()), column), column, share).select(F.col(column).alias("__hk"))
    known = pairs.toDF("__hk", "__hv").join(F.broadcast(heavy), "__hk")  # at most 1 / share rows
    first = df.join(F.broadcast(known), F.col(column) == F.col("__hk"), "left")
    # a key that no term can have, one of many
    aside = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    key = F.when(F.col("__hk").isNull() & F.col(column).isNotNull(), F.col(column).cast("string")).otherwise(aside)
    rest = pairs.select(F.col(pairs.columns[0]).cast("string").alias("__k"), F.col(pairs.columns[1]).alias("__v"))
    joined = first.withColumn("__key", key).join(rest, F.col("__key") == F.col("__k"), "left")
    return joined.select(*df.columns, F.coalesce("__hv", "__v").alias(out))


def encode_columns(df: DataFrame, columns: Sequence[str], terms: DataFrame) -> DataFrame:
    """Replace terms by ids; rows with a term that the dictionary lacks drop out (they can match nothing)."""
    order = df.columns
    for c in columns:
        df = _with_pairs(df, c, terms.select("nt", "id"), f"__id_{c}").where(F.col(f"__id_{c}").isNotNull()).drop(c).withColumnRenamed(f"__id_{c}", c)
    return df.select(*order)


def decode_columns(df: DataFrame, columns: Sequence[str], terms: DataFrame) -> DataFrame:
    """Replace ids by terms; NULL stays NULL, an id without a term becomes NULL."""
    order = df.columns
    for c in columns:
        df = _with_pairs(df, c, terms.select("id", "nt"), f"__nt_{c}").drop(c).withColumnRenamed(f"__nt_{c}", c)
    return df.select(*order)


def lookup(requests: DataFrame, column: str, terms: DataFrame, by: str = "nt") -> DataFrame:
    """Add the other side of the dictionary to a column of terms (by nt) or ids (by id); NULL where it is unknown."""
    other = "id" if by == "nt" else "nt"
    return _with_pairs(requests, column, terms.select(by, other), f"{column}_{other}")


def global_id(ident: Column, ranks: int) -> Column:
    """An id tagged with the rank that owns it, id % ranks, above the lower 48 bits."""
    return F.shiftleft(F.pmod(ident, F.lit(ranks)), RANK_SHIFT).bitwiseOR(ident)


def local_id(gid: Column) -> Column:
    return gid.bitwiseAND(F.lit((1 << RANK_SHIFT) - 1))


def owner(gid: Column) -> Column:
    return F.shiftright(gid, RANK_SHIFT).cast("int")
