"""Entity-attribute-value rows to one typed row per entity."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.session import BROADCAST_ROWS, cut_lineage

#: Spark type of each range.
TYPES = {"integer": "bigint", "decimal": "decimal(38,10)", "date": "date", "datetime": "timestamp_ntz", "boolean": "boolean"}
#: Greatest size of a bigint that has a negative, too.
MOST_INTEGER = Decimal((1 << 63) - 1)
#: Columns of one group of a wide table that is made in groups.
GROUP_COLUMNS = 1000


@dataclass(frozen=True)
class Attribute:
    code: int
    predicate: str
    range_dt: str
    column: str


def attributes(vocab: DataFrame) -> list[Attribute]:
    """Single-valued typed predicates of a vocabulary table: one column each, held by the driver."""
    rows = vocab.where((F.col("max_card") == 1) & F.col("range_dt").isin(list(TYPES))).select("nt", "range_dt").distinct().orderBy("nt").collect()
    names: set[str] = {"s", "failures"}
    out = []
    for i, r in enumerate(rows):
        name = base = re.sub(r"\W+", "_", re.split(r"[/#]", r.nt.strip("<>"))[-1]) or "value"
        k = 2
        while name.lower() in names:
            name, k = f"{base}_{k}", k + 1
        names.add(name.lower())
        out.append(Attribute(i, r.nt, r.range_dt, name))
    return out


def _plain_number(text: Column) -> Column:
    """One spelling per number: no plus, no leading zeros, no trailing zeros after the point, no negative zero."""
    digits = F.regexp_replace(text, "^[+-]", "")
    whole = F.ltrim(F.substring_index(digits, ".", 1), F.lit("0"))
    part = F.when(F.instr(digits, ".") > 0, F.rtrim(F.substring_index(digits, ".", -1), F.lit("0"))).otherwise("")
    size = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when((size != "0") & text.startswith("-"), F.concat(F.lit("-"), size)).otherwise(size)


def literal_text(term: Column) -> Column:
    """Lexical text of a literal, whatever its datatype, with surrounding blanks cut off; NULL for other terms."""
    return F.btrim(T.unescape(T.raw_text(term)), F.lit(" \t\r\n\u00a0"))


def canonical(text: Column, range_dt: Column) -> Column:
    """One spelling per value of a text under a range, NULL when it cannot be read as that range."""
    day, time = F.substr(text, F.lit(1), F.lit(10)), F.substr(text, F.lit(1), F.lit(19))
    stamp = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?$"
    return (
        F.when(range_dt == "integer", F.when(text.rlike("^[+-]?[0-9]+$"), _plain_number(text)))
        .when(range_dt == "decimal", F.when(text.rlike("^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$"), _plain_number(text)))
        .when(range_dt == "date", F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & day.try_cast("date").isNotNull(), day))
        .when(range_dt == "datetime", F.when(text.rlike(stamp) & day.try_cast("date").isNotNull(), time))
        .when((range_dt == "boolean") & text.isin("true", "1"), F.lit("true"))
        .when((range_dt == "boolean") & text.isin("false", "0"), F.lit("false"))
    )


def readable(term: Column, range_dt: Column) -> Column:
    """Canonical text of a literal under a range; IRIs, blank nodes, NULL and what cannot be read give NULL."""
    return canonical(literal_text(term), range_dt)


def _number(text: Column, range_dt: Column) -> Column:
    """A canonical text as decimal(38,10), NULL if that cannot hold it; dates and times as their digits in a row."""
    return (
        F.when(range_dt.isin("integer", "decimal"), F.when(~text.rlike("\\.[0-9]{11}"), text.try_cast("decimal(38,10)")))
        .when(range_dt.isin("date", "datetime"), F.regexp_replace(text, "[^0-9]", "").try_cast("decimal(38,10)"))
        .when(range_dt == "boolean", (text == "true").cast("int").cast("decimal(38,10)"))
    )


def _typed(value: Column, range_dt: str) -> Column:
    """The inverse, as the column's type; NULL where the value lies beyond it."""
    if range_dt == "boolean":
        return value == 1
    if range_dt == "integer":
        return F.when(F.abs(value) <= F.lit(MOST_INTEGER), value.try_cast("bigint"))
    if range_dt == "decimal":
        return value
    digits = F.lpad(value.cast("decimal(28,0)").cast("string"), 8 if range_dt == "date" else 14, "0")
    form = ("(....)(..)(..)", "$1-$2-$3") if range_dt == "date" else ("(....)(..)(..)(..)(..)(..)", "$1-$2-$3T$4:$5:$6")
    return F.regexp_replace(digits, *form).try_cast(TYPES[range_dt])


def entity_maps(statements: DataFrame, attrs: list[Attribute]) -> DataFrame:
    """(s, cells): for each subject a map from attribute code to (value, why).

    Rows are first folded per (subject, attribute) with a map-side combine, so a subject with a third of all rows shuffles
    one state per task and attribute; only then are the folded pairs, at most one per attribute, gathered per subject. A
    state is numbers alone, which the hash aggregate can update in place: the least and greatest value as a decimal, and of
    texts that no decimal(38,10) can hold those of a 64-bit hash, which serve to tell whether the texts of one cell differ.
    value is the cell's one distinct value; why is NULL beside a value, else unreadable, contradictory or out_of_range.
    Subjects without any of the attributes get an empty map. NULL subjects are dropped; NULL predicates and objects count as no
    attribute and as unreadable.
    """
    spark = statements.sparkSession
    known = spark.createDataFrame([(a.predicate, a.code, a.range_dt) for a in attrs], "__p string, c int, r string")
    known = F.broadcast(known) if len(attrs) <= BROADCAST_ROWS else known
    base = statements.where(F.col("s").isNotNull()).select("s", "p", "o").join(known, F.col("p") == F.col("__p"), "left")
    # each step is a column of its own, so that the next reads it instead of working it out again
    base = base.select("s", "c", "r", F.when(F.col("c").isNotNull(), literal_text(F.col("o"))).alias("t"))
    base = base.select("s", F.col("c").alias("a"), "r", canonical(F.col("t"), F.col("r")).alias("v"))
    base = base.select("s", "a", "v", _number(F.col("v"), F.col("r")).alias("x"))
    far = F.when(F.col("x").isNull() & F.col("v").isNotNull(), F.xxhash64("v"))
    folded = base.groupBy("s", "a").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n_held"), F.min(far).alias("far_lo"), F.max(far).alias("far_hi"), F.count("v").alias("n_read")
    )
    value = F.when((F.col("n_held") == F.col("n_read")) & (F.col("lo") == F.col("hi")), F.col("lo"))
    why = (
        F.when(F.col("n_read") == 0, "unreadable").when(value.isNotNull(), F.lit(None).cast("string"))
        .when((F.col("n_held") == 0) & (F.col("far_lo") == F.col("far_hi")), "out_of_range").otherwise("contradictory")
    )
    cell = F.struct("a", F.struct(value.alias("value"), why.alias("why")))
    return folded.groupBy("s").agg(F.map_from_entries(F.collect_list(F.when(F.col("a").isNotNull(), cell))).alias("cells"))


def project_cells(maps: DataFrame, attrs: list[Attribute]) -> DataFrame:
    """The entities of entity_maps as rows of s, a typed column per attribute, and failures, for the given attributes."""
    cols, fails = [], []
    for a in attrs:
        cell = F.try_element_at("cells", F.lit(a.code))
        typed = _typed(cell["value"], a.range_dt)
        why = cell["why"]
        if a.range_dt == "integer":  # of the other ranges a value that the fold holds fits the column
            why = F.coalesce(why, F.when(F.abs(cell["value"]) > F.lit(MOST_INTEGER), "out_of_range"))
        cols.append(typed.alias(a.column))
        fails.append(F.struct(F.lit(a.predicate).alias("k"), why.alias("v")))
    empty = F.expr("CAST(map() AS map<string,string>)")
    failures = F.map_from_entries(F.filter(F.array(*fails), lambda x: x["v"].isNotNull())) if fails else empty
    return maps.select("s", *cols, failures.alias("failures"))


def widen(statements: DataFrame, attrs: list[Attribute]) -> DataFrame:
    """One row per subject: s, a typed column per attribute, and `failures`.

    failures maps the predicate of each cell that has rows but no value to unreadable (no object could be read),
    contradictory (more than one distinct readable value) or out_of_range (read, but beyond the column's type, as decimals of
    more than ten places are).
    Repeated rows and different spellings of one value are one value. An empty table gives no row. Thousands of columns
    are better made by widen_groups.
    """
    return project_cells(entity_maps(statements, attrs), attrs)


def widen_groups(statements: DataFrame, attrs: list[Attribute], columns: int = GROUP_COLUMNS) -> list[DataFrame]:
    """The wide table in groups of at most so many columns, each with s and the failures of its own attributes.

    Every group has every subject. The entities' maps are made and written once.
    """
    maps = cut_lineage(entity_maps(statements, attrs))
    return [project_cells(maps, attrs[i : i + columns]) for i in range(0, max(1, len(attrs)), columns)]
