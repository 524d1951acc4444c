"""Sketches, filters, frequent values and copies against exact answers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import copies, frequent, seen, sketches

# ---------------------------------------------------------------- distinct counts


@pytest.mark.parametrize("n", [0, 1, 10, 500, 5_000, 200_000])
def test_estimates_lie_within_their_bounds(spark, n):
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 31).cast("string").alias("v"))
    got = sketches.estimate(sketches.sketch(df.unionByName(df), {"k": F.col("k")}, [F.col("v")]), ["k"]).collect()
    if not n:
        assert got == []
        return
    r = got[0]
    assert r.low <= n <= r.high and r.std_error < 0.03 * n + 1
    if n > 5000:
        assert r.std_error == pytest.approx(0.65 / math.sqrt(sketches.ROWS) * n, rel=0.2)


def test_standard_error_is_what_is_measured(spark):
    """Over many independent hashes the errors spread as the Fisher information says."""
    df = spark.range(3000).crossJoin(spark.range(60).withColumnRenamed("id", "run"))
    s = sketches.sketch(df, {"run": F.col("run")}, [F.col("id"), F.col("run")], 256)
    got = sketches.estimate(s, ["run"], 256).collect()
    z = [(r.n_distinct - 3000) / r.std_error for r in got]
    assert abs(np.mean(z)) < 0.6 and 0.6 < np.std(z) < 1.4


@pytest.mark.parametrize("m", [16, 256, 4096, 16384])
def test_counts_of_many_items_at_any_number_of_rows(spark, m):
    df = spark.range(400_000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    r = sketches.estimate(sketches.sketch(df, {"k": F.col("k")}, [F.col("v")], m), ["k"], m).collect()[0]
    assert abs(r.n_distinct - 400_000) <= 5 * r.std_error and r.std_error == pytest.approx(0.65 / math.sqrt(m) * 400_000, rel=0.3)


def test_sketches_are_kept_and_read_again(spark, rows, tmp_path):
    df = spark.range(3000).select((F.col("id") % 4).alias("day"), (F.col("id") % 900).alias("v"))
    for day in range(4):
        sketches.write(sketches.sketch(df.where(F.col("day") == day), {"day": F.col("day")}, [F.col("v")], 64), f"{tmp_path}/{day}", 64)
    kept, m = sketches.read(spark, *[f"{tmp_path}/{day}" for day in range(4)])
    assert m == 64 and rows(sketches.merge(kept, [])) == rows(sketches.sketch(df, {}, [F.col("v")], 64))
    sketches.write(sketches.sketch(df, {"day": F.col("day")}, [F.col("v")], 128), f"{tmp_path}/other", 128)
    with pytest.raises(ValueError):
        sketches.read(spark, f"{tmp_path}/0", f"{tmp_path}/other")
    with pytest.raises(ValueError):
        sketches.estimate(kept, ["day"], 100)


def test_several_counts_come_from_one_scan(spark):
    data = [(i % 3, f"g{i % 2}", f"v{i % 40}", f"p{i % 7}") for i in range(500)] + [(None, "g0", None, "p0"), (1, None, "v1", None)]
    df = spark.createDataFrame(data, "d int, g string, v string, p string")
    counts = {"pairs": ([F.col("v"), F.col("p")], [(), ("g",), ("d", "g")]), "ones": ([F.col("v")], [(), ("d",)])}
    out = sketches.distinct_counts(df, {"d": F.col("d"), "g": F.col("g")}, counts)
    want: dict = {}
    for d, g, v, p in data:
        for name, item, sets in (("pairs", (v, p), [(), ("g",), ("d", "g")]), ("ones", (v,), [(), ("d",)])):
            if None not in item:
                for s in sets:
                    want.setdefault((name, ",".join(s) or "all", d if "d" in s else None, g if "g" in s else None), set()).add(item)
    got = {(r.counted, r.by, r.d, r.g): r for r in out.collect()}
    assert set(got) == set(want) and all(got[k].low <= len(v) <= got[k].high for k, v in want.items())


def test_partial_sketches_merge_in_any_order(spark, rows):
    df = spark.range(2000).select((F.col("id") % 5).alias("day"), (F.col("id") % 3).alias("g"), (F.col("id") % 700).cast("string").alias("v"))
    fine = sketches.sketch(df, {"day": F.col("day"), "g": F.col("g")}, [F.col("v")])
    direct = sketches.sketch(df, {"g": F.col("g")}, [F.col("v")])
    halves = sketches.sketch(df.where("day < 2"), {"g": F.col("g")}, [F.col("v")]).unionByName(sketches.sketch(df.where("day >= 1"), {"g": F.col("g")}, [F.col("v")]))
    assert rows(sketches.merge(fine, ["g"])) == rows(direct) == rows(sketches.merge(halves, ["g"]))


def test_all_grouping_sets_with_nulls_and_clashing_names(spark):
    data = [(None if i % 11 == 0 else i % 4, None if i % 7 == 0 else f"g{i % 3}", f"v{i % 900}", i) for i in range(6000)] + [(1, "g1", None, 0)]
    df = spark.createDataFrame(data, "d int, g string, v string, row int")
    sets = [(), ("d",), ("g",), ("d", "g")]
    got = sketches.distinct_by_sets(df, {"d": F.col("d"), "g": F.col("g")}, [F.col("v")], sets).collect()
    want: dict = {}
    for d, g, v, _ in data:
        for s in sets:
            want.setdefault((",".join(s) or "all", d if "d" in s else None, g if "g" in s else None), set()).add(v)
    assert {(r.by, r.d, r.g) for r in got} == set(want)
    for r in got:
        n = len(want[r.by, r.d, r.g] - {None})
        assert r.low <= n <= r.high, (r, n)
    assert sketches.distinct_by_sets(df.where("false"), {"d": F.col("d")}, [F.col("v")], [(), ("d",)]).count() == 0


# ---------------------------------------------------------------- seen before


def _requests(spark, data):
    return spark.createDataFrame([(*r, True, 1) for r in data], "req long, nt string, maybe boolean, h int")


def test_verdicts_equal_the_exact_answer(spark):
    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() < 0.35 else f"k{rnd.randrange(3000)}") for i in range(9000)]
    rnd.shuffle(data)
    known = [f"k{i}" for i in range(0, 3000, 7)] + ["other", "k0"]
    earlier = spark.createDataFrame([(k,) for k in known] + [(None,)], "nt string")
    answers, report = seen.seen_before(_requests(spark, [*data, (9999, None), (None, "k1")]).repartition(5), "req", "nt", earlier, fpp=0.05)
    had, want = set(known), {}
    for i, k in sorted(data):
        want[i] = k in had
        had.add(k)
    got = {r["at"]: (r.maybe, r.seen) for r in answers.collect()}
    assert {i: s for i, (_, s) in got.items()} == want
    assert all(m for m, s in got.values() if s)
    r = report.collect()[0]
    assert r.n_requests == 9000 and r.wrong_answers == sum(m and not s for m, s in got.values()) and r.error_rate == r.wrong_answers / 9000
    assert r.probes > 0 and r.probe_error_rate < 0.05


def test_batches_against_a_kept_index_equal_one_pass(spark, tmp_path):
    rnd = random.Random(4)
    data = [(i, "hot" if rnd.random() < 0.35 else f"k{rnd.randrange(2000)}") for i in range(4000)]
    known = [f"k{i}" for i in range(0, 2000, 5)] + ["other", "k0"]
    path = f"{tmp_path}/index"
    seen.SeenIndex.create(spark, path, spark.createDataFrame([(k,) for k in known] + [(None,)], "nt string"), fpp=0.05)
    had, want, got, wrong = set(known), {}, {}, 0
    for k in range(3):
        batch = data[k::3]
        for i, x in sorted(batch):
            want[i] = x in had
            had.add(x)
        answers, report = seen.SeenIndex.open(spark, path).answer(_requests(spark, [*batch, (None, "k1"), (7_000, None)]).repartition(3), "req", "nt")
        got.update({r["at"]: r.seen for r in answers.collect()})
        wrong += report.collect()[0].wrong_answers
    assert got == want and wrong > 0
    index = seen.SeenIndex.open(spark, path)
    assert spark.table(index.table).count() == len(known) + len(had - set(known)) and index.number == 4
    plan = index._doubtful(spark.createDataFrame([("a", 1, True)], "key string, at long, all_maybe boolean"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_filters_merge(spark):
    layout = seen.Layout(3, 500)
    a, b = (spark.range(k, k + 600).select(F.col("id").cast("string")) for k in (0, 400))
    both = {r.slot: r.words for r in seen.build_filters(a.union(b), layout).collect()}
    assert {r.slot: r.words for r in seen.merge_filters(seen.build_filters(a, layout), seen.build_filters(b, layout)).collect()} == both and len(both) == 3


def test_false_positive_rate_of_the_filter():
    rnd = np.random.default_rng(1)
    bloom = seen.BlockedBloom(100_000, 0.01)
    keys = rnd.integers(0, 2**64, 100_000, dtype=np.uint64)
    bloom.insert(keys)
    assert bloom.query(keys).all()
    assert 0.003 < bloom.query(rnd.integers(0, 2**64, 200_000, dtype=np.uint64)).mean() < 0.02
    fresh = seen.BlockedBloom(10, 0.01)
    assert fresh.query_then_insert(np.array([1, 2, 1, 2, 3], dtype=np.uint64)).tolist() == [False, False, True, True, False]


def test_seen_before_on_empty_tables(spark):
    empty = spark.createDataFrame([], "nt string")
    answers, report = seen.seen_before(_requests(spark, []), "req", "nt", empty)
    assert answers.count() == 0 and report.collect()[0].error_rate == 0.0
    answers, _ = seen.seen_before(_requests(spark, [(5, ""), (3, ""), (4, "x" * 100_000)]), "req", "nt", empty)
    assert {r["at"]: r.seen for r in answers.collect()} == {3: False, 4: False, 5: True}


# ---------------------------------------------------------------- frequent values


def test_frequent_values_among_many_rare_ones(spark):
    rnd = random.Random(5)
    data = [f"top{i}" for i in range(6) for _ in range(400 * (i + 1))] + [f"rare{i}" for i in range(20_000)] + ["third"] * 9000 + [None] * 3000
    rnd.shuffle(data)
    df = spark.createDataFrame([(x, 1.0) for x in data], "v string, approx double").repartition(5)
    counts = Counter(x for x in data if x is not None)
    for share in (0.01, 0.05):
        got = {r.value: r for r in frequent.frequent_values(df.withColumn("w", F.lit("same")), ["v", "w"], share).where("fld = 'v'").collect()}
        assert set(got) == {k for k, n in counts.items() if n >= share * len(data)}
        for k, r in got.items():
            assert r.n_rows == counts[k] and abs(r.approx - r.n_rows) <= 6 * r.std_error + 1


@pytest.mark.parametrize("memory, top", [(frequent.MEMORY, 0.8), (100_000, 0.8), (frequent.MEMORY, 0.02)])
def test_small_shares_beside_a_value_with_most_rows(spark, memory, top):
    """Recall of values of 0.1 % where one value, or none, makes the error of the counters great."""
    n = 60_000
    rare = [f"v{i}" for i in range(300) for _ in range(30 + i % 90)]
    data = ["huge"] * int(top * n) + rare + [f"once{i}" for i in range(max(0, n - int(top * n) - len(rare)))]
    random.Random(9).shuffle(data)
    df = spark.createDataFrame([(x,) for x in data], "v string").repartition(3)
    small = frequent.Shape(1 << 10)
    got = {r.value: r.n_rows for r in frequent.frequent_values(df, ["v"], 0.001, small, memory).collect()}
    assert got == {k: n for k, n in Counter(data).items() if n >= 0.001 * len(data)} and len(got) > 100


def test_values_of_known_counts_leave_the_counters(spark):
    shape, rng = frequent.Shape(1 << 8), np.random.default_rng(2)
    h = rng.integers(0, 2**64, 40, dtype=np.uint64)
    counters = np.zeros(shape.total, dtype=np.int64)
    shape.add(counters, np.repeat(h, 7))
    shape.take_out(counters, h >> np.uint64(32), np.full(40, 7))
    assert not counters.any()
    assert frequent.Shape.for_share(1e-4).total * 8 < frequent.MEMORY / 2


def test_frequent_ties_at_the_threshold_and_empty(spark):
    df = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d"] * 25], "v string")
    assert {r.value for r in frequent.frequent_values(df, ["v"], 0.25).collect()} == {"a", "b", "c", "d"}
    assert frequent.frequent_values(df, ["v"], 0.26).count() == 0
    assert frequent.frequent_values(df.where("false"), ["v"], 0.1).count() == 0
    assert frequent.frequent_values(df.select(F.lit(None).cast("string").alias("v")), ["v"], 0.1).count() == 0


def test_sketches_of_parts_add(spark):
    df = spark.range(30_000).select((F.col("id") % 777).cast("string").alias("v"))
    shape = frequent.Shape.for_share(0.01)
    whole = {r.cell: r.n for r in frequent.sketch_counters(df, ["v"], shape).collect()}
    parts = Counter()
    for k in range(3):
        parts.update({r.cell: r.n for r in frequent.sketch_counters(df.where(f"v % 3 = {k}"), ["v"], shape).collect()})
    assert {c: n for c, n in parts.items() if n} == {c: n for c, n in whole.items() if n}


# ---------------------------------------------------------------- copies

VARIANTS = ["Ref=A1; year=1900 | name=Ann Lee", " name = ann  LEE;REF: a1;year 1900", "(year=1900);(name=Ann Lee);;(ref=A1!)", "ref=A1; year=1900; name=Ann Lee; name=Ann Lee", "ref=A1; year=1900; name=Lee Ann", "ref=A1 year=1900 name=Ann Lee"]


def _naive(data, loose, exact):
    def norm(x):
        import re

        return None if x is None else tuple(sorted(w for f in re.split("[;|]", x) if (w := tuple(re.findall(r"[^\W_]+", f.lower())))))

    groups: dict = {}
    for r in data:
        groups.setdefault((*[r[i] for i in exact], *[norm(r[i]) for i in loose]), []).append(r[0])
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_copies_by_definition(spark, rows):
    data = [(i, "p", v, "o") for i, v in enumerate(VARIANTS)] + [
        (20, "p", "", "o"), (21, "p", " -- ; | ", "o"), (22, "p", None, "o"), (23, "p", None, "o"), (24, None, "x", "o"), (25, None, "X.", "o"), (26, "", "x", "o"), (27, "p", "x", None), (28, "p", "x", None),
        (29, "p", "a;a;b", "o"), (30, "p", "a;b;b", "o"), (31, "p", "b;a;a", "o"), (32, "p", "ÄÖ_ß", "o"), (33, "p", "äö ß", "o"), (34, "p", "x" * 200_000 + ";y", "o"), (35, "p", "y|" + "X" * 200_000, "o"),
        (36, "p", ";".join(map(str, range(3000))), "o"), (37, "p", "|".join(map(str, reversed(range(3000)))), "o"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in data], "id long, p string, s string, o string, keep_id int")
    got = rows(copies.copies(df, "id", ["p"], ["s", "o"]))
    assert got == _naive(data, [2, 3], [1])
    assert (0, 1) in got and (0, 2) in got and (29, 31) in got and (29, 30) not in got and (36, 37) in got
    kept = {r.id: r.n_copies for r in copies.collapsed(df, "id", ["p"], ["s", "o"]).collect()}
    assert len(kept) == len(data) - len(got) and sum(kept.values()) == len(data) and kept[0] == 3


def test_a_group_with_most_rows_is_split_and_whole(spark):
    n = 60_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Same; "), F.lit("text"))).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("v"))
    got = copies.copies(df, "id", [], ["v"])
    assert got.count() == n // 2 - 1 and got.where("keep_id <> 0").count() == 0 and got.select("copy_id").distinct().count() == n // 2 - 1


def test_fingerprint_collisions_are_found_out(spark, rows, monkeypatch):
    """With a fingerprint that is equal for all rows, the field check alone must tell the groups apart."""
    real = copies.fingerprints
    monkeypatch.setattr(copies, "fingerprints", lambda *a: real(*a).withColumns({"f1": F.lit(1).cast("bigint"), "f2": F.lit(1).cast("bigint")}))
    data = [(i, "p", v) for i, v in enumerate(["a;b", "B;a", "c", "C!", "d", "b a", "c."])]
    df = spark.createDataFrame(data, "id long, p string, v string")
    assert rows(copies.copies(df, "id", ["p"], ["v"])) == _naive(data, [2], [1])


def test_no_copies_in_empty_tables(spark):
    df = spark.createDataFrame([], "id long, v string")
    assert copies.copies(df, "id", [], ["v"]).count() == 0 and copies.collapsed(df, "id", [], ["v"]).count() == 0
