"""Hot keys and wide tables against plain Python."""

import random
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from trellis.operators import keyed, wide


def test_keyed_counts_with_a_hot_key_nulls_and_clashing_names(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]), rnd.choice([None, *range(50)]), rnd.choice([None, 1, 5]), "x") for _ in range(3000)]
    df = spark.createDataFrame(data, "p string, s int, n bigint, n_rows string")
    want = {}
    for p in {r[0] for r in data}:
        own = [r for r in data if r[0] == p]
        want[p] = (len(own), len({r[1] for r in own} - {None}), sum(r[2] or 0 for r in own), sum(r[2] is not None for r in own))
    got = keyed.keyed_counts(df, "p", distinct="s", sums=("n",))
    assert {r.p: (r.n_rows, r.n_distinct, r.sum_n, r.nonnull_n) for r in got.collect()} == want
    plain = keyed.keyed_counts(df, "p")
    assert {r.p: r.n_rows for r in plain.collect()} == {p: w[0] for p, w in want.items()}
    assert {r.p for r in keyed.heavy_keys(plain, "p", 0.3).collect()} == {p for p, w in want.items() if w[0] >= 900}


def test_keyed_counts_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "p string, s int")
    assert {r.p for r in keyed.heavy_keys(keyed.keyed_counts(df, "p", "s"), "p", 0.5).collect()} == {"a", "b"}
    empty = df.where("false")
    assert keyed.keyed_counts(empty, "p", "s", ("s",)).count() == 0
    assert keyed.heavy_keys(keyed.keyed_counts(empty, "p"), "p", 0.1).count() == 0


def test_balance_of_a_hot_key(spark):
    """No shuffled partition of the first fold holds more than a small part of the rows although one key has them all."""
    df = spark.range(100_000, numPartitions=8).select(F.lit("hot").alias("p"), (F.col("id") % 50_000).alias("s"))
    first = df.groupBy("p", "s").agg(F.count(F.lit(1)).alias("n")).repartition(8, "p", "s")
    sizes = [r[0] for r in first.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2 * sum(sizes) / 8
    assert keyed.keyed_counts(df, "p", "s").first().n_distinct == 50_000


VOCAB = [("<e#pages>", "integer", 1), ("<e#size>", "decimal", 1), ("<e#born>", "date", 1), ("<e#seen>", "datetime", 1), ("<e#open>", "boolean", 1), ("<f#pages>", "integer", 1), ("<e#tag>", None, None), ("<e#many>", "integer", 3)]


def _vocab(spark):
    return spark.createDataFrame(VOCAB, "nt string, range_dt string, max_card int")


def test_wide_values_and_failures(spark):
    rows = [
        ("a", "<e#pages>", '"007"'), ("a", "<e#pages>", '" +7 "^^<x>'), ("a", "<e#pages>", "<iri>"), ("a", "<e#size>", '"-0.50"'), ("a", "<e#size>", '"-.5"'), ("a", "<e#tag>", '"x"'),
        ("a", "<e#born>", '"2024-02-29"@en'), ("a", "<e#seen>", '"2024-01-01T00:00:00Z"'), ("a", "<e#seen>", '"2024-01-01T00:00:00"'), ("a", "<e#open>", '"1"'), ("a", "<e#open>", '"true"'),
        ("b", "<e#pages>", '"1"'), ("b", "<e#pages>", '"2"'), ("b", "<e#born>", '"2023-02-29"'), ("b", "<e#size>", '"."'), ("b", "<e#open>", '"yes"'), ("b", "<e#open>", None), ("b", "<e#seen>", '"2024-01-01T25:00:00"'),
        ("b", "<f#pages>", '"99999999999999999999"'), ("c", "<e#tag>", '"x"'), ("c", None, '"x"'), (None, "<e#pages>", '"1"'), ("d", "<e#size>", '"-0"'), ("d", "<e#size>", '"0.000"'),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "s string, p string, o string, cells string")
    attrs = wide.attributes(_vocab(spark))
    assert [a.column for a in attrs] == ["born", "open", "pages", "seen", "size", "pages_2"]
    got = {r.s: r.asDict() for r in wide.widen(df, attrs).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"] == {"s": "a", "born": date(2024, 2, 29), "open": True, "pages": 7, "seen": datetime(2024, 1, 1), "size": Decimal("-0.5"), "pages_2": None, "failures": {}}
    assert got["b"]["failures"] == {"<e#pages>": "contradictory", "<e#born>": "unreadable", "<e#size>": "unreadable", "<e#open>": "unreadable", "<e#seen>": "unreadable", "<f#pages>": "out_of_range"}
    assert got["c"]["failures"] == {} and got["d"]["size"] == 0
    assert all(got["b"][a.column] is None for a in attrs)


def test_wide_hot_subject_and_empty(spark):
    df = spark.range(20_000).select(F.lit("hub").alias("s"), F.when(F.col("id") % 2 == 0, "<e#tag>").otherwise("<e#pages>").alias("p"), F.lit('"3"').alias("o"))
    attrs = wide.attributes(_vocab(spark))
    assert [r.pages for r in wide.widen(df, attrs).collect()] == [3]
    assert wide.widen(df.where("false"), attrs).count() == 0
    assert wide.widen(df, []).collect()[0].failures == {}


def test_canonical_spellings_do_not_merge_different_numbers(spark):
    texts = ["1", "01", "+1", "10", "1.0", "1.", "0.10", ".1", "-1", "--1", "1e3", "", "12345678901234567890123", "012345678901234567890123"]
    df = spark.createDataFrame([(f'"{t}"',) for t in texts], "o string")
    got = dict(zip(texts, [r[0] for r in df.select(wide.readable(F.col("o"), F.lit("decimal"))).collect()]))
    groups = defaultdict(set)
    for t, v in got.items():
        groups[v].add(t)
    assert groups[None] == {"--1", "1e3", ""} and groups["1"] == {"1", "01", "+1", "1.0", "1."} and groups["0.1"] == {"0.10", ".1"}
    assert groups["12345678901234567890123"] == {"12345678901234567890123", "012345678901234567890123"}


def test_wide_groups_equal_one_table(spark, rows):
    """More attributes than one group holds, of every range, with values that no decimal holds."""
    kinds = list(wide.TYPES)
    attrs = [wide.Attribute(i, f"<e#p{i}>", kinds[i % 5], f"p{i}") for i in range(260)]
    texts = {"integer": ["-0012", "9" * 30, "9" * 30, "x"], "decimal": ["1.50", "0.00000000001", "2.5"], "date": ["2024-02-29", "0001-01-01", "2023-02-29"], "datetime": ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00"], "boolean": ["1", "true", "0"]}
    data = [(f"<s{k}>", f"<e#p{i}>", f'"{t}"') for i in (0, 1, 2, 3, 4, 107, 200, 259) for k, t in enumerate(texts[kinds[i % 5]])]
    data += [("<all>", "<e#p0>", f'"{"9" * 40}"'), ("<all>", "<e#p0>", f'"0{"9" * 40}"'), ("<all>", "<e#p5>", f'"{"8" * 40}"'), ("<all>", "<e#p5>", f'"{"7" * 40}"'), ("<none>", "<other>", '"1"')]
    df = spark.createDataFrame(data, "s string, p string, o string")
    groups = wide.widen_groups(df, attrs, 100)
    assert [len(g.columns) for g in groups] == [102, 102, 62]
    got: dict = {}
    for g in groups:
        for r in g.collect():
            cells = got.setdefault(r.s, {})
            cells.update({k: v for k, v in r.asDict().items() if v is not None and k not in ("s", "failures")})
            cells.update(r.failures)
    few = [a for a in attrs if a.code in (0, 1, 2, 3, 4, 5, 107, 200, 259)]
    want = {r.s: {**{k: v for k, v in r.asDict().items() if v is not None and k not in ("s", "failures")}, **r.failures} for r in wide.widen(df, few).collect()}
    assert got == want and got["<none>"] == {}
    assert got["<all>"] == {"<e#p0>": "out_of_range", "<e#p5>": "contradictory"} and str(got["<s0>"]["p2"]) == "2024-02-29" and str(got["<s1>"]["p2"]) == "0001-01-01"
