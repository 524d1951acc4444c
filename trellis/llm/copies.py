"""Records that differ only in whitespace, letter case, punctuation or order of fields.

A text is cut at `;` and `|` into fields; a field is its sequence of words (runs of letters and digits, in lower case);
fields without words drop out. Each (column, field) pair is hashed and the hashes of a record are added, so that their
order does not matter and repeats count; the sums are the record's fingerprint. Records are grouped by fingerprint, and
every member is then held, field by field, against the record that is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.session import cut_lineage, parallelism

SPLIT = "[;|]"
NO_WORD = "[^\\p{L}\\p{N}]+"


def _words(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), NO_WORD, " "))


def fields(text: Column) -> Column:
    """The fields of a text as normalized strings, in their order; NULL for NULL.

    A text without separators is one field and is spared the higher-order functions.
    """
    several = F.filter(F.transform(F.split(text, SPLIT), _words), lambda f: f != "")
    single = (F.instr(text, ";") == 0) & (F.instr(text, "|") == 0)
    return F.when(single, F.array_remove(F.array(_words(text)), "")).otherwise(several)


def _sums(name: str, items: Column, seed: int) -> list[Column]:
    """Order-free hash of a multiset of fields: its size and the sums of the halves of their hashes (no overflow)."""
    of = lambda f: F.xxhash64(F.lit(seed), F.lit(name), f)

    def total(half) -> Column:
        several = F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, f: acc + half(of(f)))
        return F.when(F.size(items) == 1, half(of(F.get(items, F.lit(0))))).otherwise(F.coalesce(several, F.lit(-1)))

    low, high = total(lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), total(lambda h: F.shiftrightunsigned(h, 32))
    return [F.coalesce(F.size(items), F.lit(-1)), low, high]


def fingerprints(df: DataFrame, ident: str, exact: list[str], loose: list[str], seed: int = 1) -> DataFrame:
    """(id, f1, f2, exact, loose): a 128-bit fingerprint with what it stands for.

    `exact` columns must be identical (NULL equals NULL only), `loose` ones have equal fields (NULL equals NULL only; a
    text without words has no fields and equals every other such text).
    """
    base = df.select(F.col(ident).alias("id"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in exact]).alias("exact"), F.struct(F.lit(0).alias("_"), *[fields(F.col(c)).alias(c) for c in loose]).alias("loose"))
    flags = [x for c in exact for x in (F.col("exact")[c], F.col("exact")[c].isNull())]
    fp = lambda seed: F.xxhash64(F.lit(seed), *flags, *[x for c in loose for x in _sums(c, F.col("loose")[c], seed)])
    return base.select("id", fp(seed).alias("f1"), fp(seed + 1).alias("f2"), "exact", "loose")


def same_fields(a: Column, b: Column) -> Column:
    """Multiset equality without sorting: equal sizes, and no field that one has more often than the other.

    Where no field repeats, one set difference decides; else each distinct field is counted on both sides.
    """
    kinds = F.array_distinct(a)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    simple = (F.size(kinds) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    equal = F.when(simple, F.size(F.array_except(a, b)) == 0).otherwise(F.forall(kinds, lambda x: count(a, x) == count(b, x)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & equal)


def copies(df: DataFrame, ident: str, exact: list[str], loose: list[str], seed: int = 1) -> DataFrame:
    """(keep_id, copy_id): each record that equals one with a smaller id, with the smallest id of its group.

    ids must be unique and not NULL. An empty table gives no row. Groups are counted by fingerprint, with a map-side combine.
    Then the rows travel once, by fingerprint, and meet the kept record of their group where they are; groups so large that
    they would fill a task are salted: their rows are spread, and the kept record is repeated per salt. Rows whose fields
    differ from the kept record's although the fingerprints agree are grouped among themselves under another seed.
    """
    base = fingerprints(df, ident, exact, loose, seed)
    spark = df.sparkSession
    groups = cut_lineage(base.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id")).where("n > 1"))
    share = max(10_000, groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // (4 * parallelism(spark)))
    salts = F.ceil(F.col("n") / share).cast("int")
    # at most one group per `share` rows, 24 bytes each
    hot = groups.where(F.col("n") > share).select("f1", "f2", salts.alias("salts"))
    salt = lambda ident, salts: F.pmod(F.xxhash64(ident), salts).cast("int")
    rows = base.join(F.broadcast(hot), ["f1", "f2"], "left").withColumn("salt", F.coalesce(salt("id", "salts"), F.lit(0))).drop("salts")
    rows = rows.repartition("f1", "f2", "salt")
    keys = groups.select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), salt("keep_id", salts).alias("k_salt"), "keep_id", salts.alias("salts"))
    meet = (F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2")) & (F.col("salt") == F.col("k_salt"))
    # not an equality, which would be a further key and have the rows shuffled again
    is_kept = (F.col("id") >= F.col("keep_id")) & (F.col("id") <= F.col("keep_id"))
    kept = rows.join(keys.hint("shuffle_hash"), meet & is_kept)
    kept = kept.select("k1", "k2", "keep_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("k_salt"), F.col("exact").alias("keep_exact"), F.col("loose").alias("keep_loose"))
    same = F.lit(True)
    for c in exact:
        same = same & F.col("exact")[c].eqNullSafe(F.col("keep_exact")[c])
    for c in loose:
        same = same & same_fields(F.col("loose")[c], F.col("keep_loose")[c])
    met = rows.join(kept.hint("shuffle_hash"), meet & (F.col("id") != F.col("keep_id")))
    judged = cut_lineage(met.select("keep_id", F.col("id").alias("copy_id"), same.alias("same")))
    out = judged.where("same").select("keep_id", "copy_id")
    other = judged.where(~F.col("same")).select("copy_id")
    if other.isEmpty():
        return out
    return out.unionByName(copies(df.join(other, df[ident] == other.copy_id, "left_semi"), ident, exact, loose, seed + 2))


def collapsed(df: DataFrame, ident: str, exact: list[str], loose: list[str]) -> DataFrame:
    """The records that are kept, as (id, n_copies): one row per record, n_copies counts the record itself too."""
    pairs = copies(df, ident, exact, loose)
    counts = pairs.groupBy(F.col("keep_id").alias("id")).agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    kept = df.select(F.col(ident).alias("id")).join(pairs.select(F.col("copy_id").alias("id")), "id", "left_anti")
    return kept.join(counts, "id", "left").select("id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
