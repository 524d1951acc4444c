"""Queries of the subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import copies, frequent, leaks, mixing, quality, seen, sketches
from trellis.session import shared_folder, table

FREQUENT_SHARE = 0.01
LEAK_WORDS = 10
#: Windows of p8_edited_leaks, which allows one edit.
EDITED_WORDS, EDITS = 15, 1


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct subjects and subject-predicate pairs per day, graph, predicate and every combination of these.

    Within one predicate pairs and subjects are the same number, so sets with the predicate read both off one sketch.
    """
    return _distinct(table(spark, d, "quads"))


def _sets(*keys: str) -> list[tuple[str, ...]]:
    return [s for n in range(len(keys) + 1) for s in combinations(keys, n)]


def _distinct(quads: DataFrame) -> DataFrame:
    keys = {"day": F.to_date("asserted_at"), "graph": F.col("g"), "predicate": F.col("p")}
    counts = {"pairs": ([F.col("s"), F.col("p")], _sets(*keys)), "subjects": ([F.col("s")], _sets("day", "graph"))}
    got = sketches.distinct_counts(quads, keys, counts)
    both = F.when(F.col("by").contains("predicate"), F.array(F.lit("pairs"), F.lit("subjects"))).otherwise(F.array("counted"))
    return got.withColumn("counted", F.explode(both))


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of subjects of all, of every day, graph, predicate and graph with predicate, and whether the estimate
    lies within six standard errors and two of it."""
    quads = table(spark, d, "quads").where("s IS NOT NULL AND p IS NOT NULL").select(F.to_date("asserted_at").alias("day"), F.col("g").alias("graph"), F.col("p").alias("predicate"), "s")
    by = F.concat_ws(",", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in ("graph", "predicate")])
    sets = [[F.col(k) for k in s] for s in _sets("graph", "predicate")]
    exact = quads.select("graph", "predicate", "s").distinct().groupingSets(sets, "graph", "predicate").agg(F.count_distinct("s").alias("n"), by.alias("by"))
    exact = exact.select(F.when(F.col("by") == "", "all").otherwise(F.col("by")).alias("by"), F.lit(None).cast("date").alias("day"), "graph", "predicate", "n")
    days = quads.select("day", "s").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    exact = exact.unionByName(days.select(F.lit("day").alias("by"), "day", F.lit(None).cast("string").alias("graph"), F.lit(None).cast("string").alias("predicate"), "n"))
    est = _distinct(table(spark, d, "quads")).where("counted = 'subjects'")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}")) for k in ("by", "day", "graph", "predicate")]
    inside = F.abs(F.col("n_distinct") - F.col("n")) <= 6 * F.col("std_error") + 2
    return exact.alias("x").join(est.alias("e"), on, "left").select("x.by", "x.day", "x.graph", "x.predicate", "n", F.coalesce(inside, F.lit(False)).alias("inside"))


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """Subjects per graph from sketches that were kept day by day, read again and merged."""
    quads = table(spark, d, "quads")
    folder = shared_folder(spark, "sketches")
    sketches.write(sketches.sketch(quads, {"day": F.to_date("asserted_at"), "graph": F.col("g")}, [F.col("s")]), folder)
    kept, m = sketches.read(spark, folder)
    got = sketches.estimate(sketches.merge(kept, ["graph"]), ["graph"], m)
    exact = quads.groupBy(F.col("g").alias("graph")).agg(F.count_distinct("s").alias("n"))
    inside = F.abs(F.col("n_distinct") - F.col("n")) <= 6 * F.col("std_error") + 2
    return exact.alias("x").join(got.alias("e"), F.col("e.graph").eqNullSafe(F.col("x.graph")), "left").select("x.graph", "n", F.coalesce(inside, F.lit(False)).alias("inside"))


def _earlier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab").select("nt").unionByName(table(spark, d, "terms").select("nt"))


def p5_answers(spark: SparkSession, d: str) -> DataFrame:
    """For each request whether its term has an id, and if not the next_id that it takes."""
    requests = table(spark, d, "id_requests")
    answers, _ = seen.seen_before(requests, "req_id", "nt", _earlier(spark, d))
    return requests.select("req_id", "next_id").join(answers.withColumnRenamed("at", "req_id"), "req_id").select("req_id", "seen", F.when(~F.col("seen"), F.col("next_id")).alias("next_id"))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same answers given batch by batch from an index that is kept between them."""
    requests = table(spark, d, "id_requests")
    half = requests.agg(F.coalesce(F.percentile_approx("req_id", 0.5), F.lit(0))).first()[0]
    folder = shared_folder(spark, "seen")
    seen.SeenIndex.create(spark, folder, _earlier(spark, d))
    parts = [seen.SeenIndex.open(spark, folder).answer(batch, "req_id", "nt")[0] for batch in (requests.where(F.col("req_id") <= half), requests.where(F.col("req_id") > half))]
    return parts[0].unionByName(parts[1]).select(F.col("at").alias("req_id"), "seen")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """(n_requests, probes_held, answers_held): whether both error rates lie within four times what the filters are made for."""
    r = seen.seen_before(table(spark, d, "id_requests"), "req_id", "nt", _earlier(spark, d))[1]
    return r.select("n_requests", (F.col("probe_error_rate") <= 4 * seen.FPP).alias("probes_held"), (F.col("error_rate") <= 4 * seen.FPP).alias("answers_held"))


def p5_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "id_requests"), "req_id", "nt", _earlier(spark, d))[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    answers, _ = seen.seen_before(table(spark, d, "id_requests"), "req_id", "nt", _earlier(spark, d))
    return answers.where("seen").select(F.col("at").alias("req_id"))


def p6_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Frequent objects and predicates with the sketch's count, its standard error and the verified count."""
    return frequent.frequent_values(table(spark, d, "quads"), ["o", "p"], FREQUENT_SHARE).withColumnRenamed("value", "item")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequent(spark, d).select("fld", "item")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same with the verified count, and whether the sketch's count lies within six standard errors of it."""
    near = F.abs(F.col("approx") - F.col("n_rows")) <= 6 * F.col("std_error") + 1
    return p6_frequent(spark, d).select("fld", "item", "n_rows", near.alias("near"))


def p6_tenth_percent(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(table(spark, d, "quads"), ["o", "p"], 0.001).select("fld", F.col("value").alias("item"), "n_rows")


def p6_hundredth_percent(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(table(spark, d, "quads"), ["o", "p"], 0.0001).select("fld", F.col("value").alias("item"), "n_rows")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    triples = copies.copies(table(spark, d, "triples"), "t_id", ["p"], ["s", "o"])
    terms = copies.copies(table(spark, d, "terms"), "id", ["kind", "lang", "dt"], ["value"])
    return triples.select(F.lit("triples").alias("tbl"), "keep_id", "copy_id").unionByName(terms.select(F.lit("terms").alias("tbl"), "keep_id", "copy_id"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    triples = copies.collapsed(table(spark, d, "triples"), "t_id", ["p"], ["s", "o"])
    terms = copies.collapsed(table(spark, d, "terms"), "id", ["kind", "lang", "dt"], ["value"])
    return triples.select(F.lit("triples").alias("tbl"), "id", "n_copies").unionByName(terms.select(F.lit("terms").alias("tbl"), "id", "n_copies"))


def _leaks(spark: SparkSession, d: str, window: int, edits: int) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", window, edits)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, LEAK_WORDS, 0).select("doc_id", "item_id")


def p8_edited_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of fifteen words of which one may be changed, dropped or inserted."""
    return _leaks(spark, d, EDITED_WORDS, EDITS)


def _mix(spark: SparkSession, d: str, fit: str) -> mixing.Mix:
    return mixing.mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mix_targets"), fit=fit)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of the greatest total of which every source reaches its share within its cap."""
    return _mix(spark, d, "shares").rows


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "shares").shares


def p9_mix_total(spark: SparkSession, d: str) -> DataFrame:
    """The mix that keeps the total: what a source lacks is taken from the others."""
    return _mix(spark, d, "total").rows


def p9_held(spark: SparkSession, d: str) -> DataFrame:
    """(source, share_held, cap_held): whether the mix repeats no document too often and reaches each share within a hundredth,
    and two documents beside, as documents are drawn whole."""
    m = _mix(spark, d, "shares")
    most = m.rows.groupBy("source").agg(F.max("copies").alias("most"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))
    rows = m.rows.agg(F.max("n_tokens").alias("longest"), F.sum(F.col("n_tokens") * F.col("copies")).alias("whole"))
    slack = F.coalesce(rows.select(2 * F.col("longest") / F.col("whole")).scalar(), F.lit(0))
    held = F.abs(F.col("reached_share") - F.col("target_share")) <= 0.01 + slack
    return m.shares.join(most, "source", "left").select("source", held.alias("share_held"), ((F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("n", F.lit(0)) == F.coalesce("ids", F.lit(0)))).alias("cap_held"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources to which the apportionment gives more blocks than their repeats hold."""
    return _mix(spark, d, "total").shares.where("beyond_cap").select("source")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"), "lang")


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts among the statistics."""
    return p10_statistics(spark, d).select("doc_id", "n_chars", "n_words", "n_lines")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where(~F.col("is_prose")).select("doc_id")


def p10_layouts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on texts of known layout, with the corpus's common words."""
    docs = spark.createDataFrame([(n, t) for n, t, _ in LAYOUTS], "name string, text string")
    return quality.quality(docs, "name", "text", table(spark, d, "common_words")).select(F.col("doc_id").alias("name"), "is_prose")


_SENTENCE = "The drun of wood was in a troudrick for the kid and sool."
#: (name, text, whether it is prose)
LAYOUTS = [
    ("plain", _SENTENCE, True),
    ("wrapped", "The drun of wood was\nin a troudrick for the\nkid and sool. A stool of\nthe team was on jool.", True),
    ("shouted", _SENTENCE.upper(), True),
    ("bulleted sentences", f"- {_SENTENCE}\n- The team of wool was on the grist and in sool.", True),
    ("cut off", "The drun of wood was in a troudrick for th", True),
    ("wide gaps", _SENTENCE.replace(" ", "  "), True),
    ("list", "- drun of wood\n- the kid\n- a sool for team\n- wool", False),
    ("pairs", "drun of: wood\nthe kid: sool\nteam is: wool\nhames: the stool", False),
    ("cells", '"the drun","4","a kid"\n"sool","-","for wood"\n"of team","7","wool"', False),
    ("bars", "Drun | Wood | The Kid | Sool | Of Team | Wool", False),
    ("repeated words", "niness sted " * 15, False),
    ("repeated sentence", f"{_SENTENCE} " * 6, False),
    ("template", "\n".join(f"Please take the cookies of this page to read part {i} of the text now." for i in range(40)), False),
    ("numbers", "21657 238594 45 188857 0 22 1466 58 34 75515 910 38", False),
    ("symbols", "{~c-bI%{=%== Il l%O#@I~b&e*d/@#~O$&e#e[@Icc%/aO|+b{<#", False),
    ("empty", "", None),
]

QUERIES = {
    f.__name__: f
    for f in (p4_distinct, p4_checked, p4_merged, p5_answers, p5_batches, p5_rates, p5_error_rate, p5_found, p6_frequent, p6_counts, p6_tenth_percent, p6_hundredth_percent, p6_found, p7_found, p7_records, p8_found, p8_edited_leaks, p9_mix, p9_mix_total, p9_shares, p9_held, p9_found, p10_statistics, p10_counts, p10_layouts, p10_found)
}

_SEEN = """
  SELECT r.req_id, r.next_id,
    (r.nt IN (SELECT nt FROM known)) OR r.req_id > min(r.req_id) OVER (PARTITION BY r.nt) AS seen
  FROM id_requests r"""
_KNOWN = "WITH known AS (SELECT nt FROM vocab UNION ALL SELECT nt FROM terms)"
_NORM = lambda c: f"""CASE WHEN {c} IS NULL THEN NULL ELSE list_sort(list_filter(list_transform(string_split_regex({c}, '[;|]'), lambda f: trim(regexp_replace(lower(f), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda f: f <> '')) END"""
_GROUPED = f"""
  SELECT 'triples' AS tbl, t_id AS id, min(t_id) OVER w AS keep_id, count(*) OVER w AS n FROM triples
    WINDOW w AS (PARTITION BY p, {_NORM('s')}, {_NORM('o')})
  UNION ALL
  SELECT 'terms', id, min(id) OVER w, count(*) OVER w FROM terms WINDOW w AS (PARTITION BY kind, lang, dt, {_NORM('value')})"""

_FREQUENT = lambda share, more="": " UNION ALL ".join(
    f"SELECT '{c}' AS fld, {c} AS item, count(*) AS n_rows{more} FROM quads WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= {share} * (SELECT count(*) FROM quads)" for c in "op"
)

_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
_WINDOWS = lambda t, i: f"""(SELECT DISTINCT {i}, array_to_string(w[k : k + {LEAK_WORDS - 1}], ' ') AS g
  FROM (SELECT {i}, w, unnest(range(1, len(w) - {LEAK_WORDS - 2})) AS k FROM (SELECT {i}, {_WORDS('text')} AS w FROM {t})))"""  # noqa: E731

_LISTS = lambda t, i: f"(SELECT {i}, {_WORDS('text')} AS w FROM {t})"
_GRAMS = lambda t, i, n: f"(SELECT {i}, w[k : k + {n - 1}] AS g FROM (SELECT {i}, w, unnest(range(1, len(w) - {n - 2})) AS k FROM {_LISTS(t, i)}))"
_MASKED = lambda g, j: f"array_to_string(list_concat({g}[: {j} - 1], ['*'], {g}[{j} + 1 :]), ' ')"
_N = EDITED_WORDS
# one word of fifteen changed, dropped or put in between, or none
_EDITED = f"""
  WITH win AS (SELECT DISTINCT item_id, g FROM {_GRAMS('eval_items', 'item_id', _N)}),
  marks AS (
    SELECT item_id, 0 AS kind, 0 AS j, array_to_string(g, ' ') AS t FROM win
    UNION SELECT item_id, 1, 0, array_to_string(list_concat(g[: j - 1], g[j + 1 :]), ' ') FROM win, unnest(range(1, {_N + 1})) u(j)
    UNION SELECT item_id, 2, j, {_MASKED('g', 'j')} FROM win, unnest(range(1, {_N + 1})) u(j)
    UNION SELECT item_id, 3, j + 1, array_to_string(list_concat(g[: j], ['*'], g[j + 1 :]), ' ') FROM win, unnest(range(1, {_N})) u(j)),
  seen AS (
    SELECT doc_id, 0 AS kind, 0 AS j, array_to_string(g, ' ') AS t FROM {_GRAMS('documents', 'doc_id', _N)}
    UNION SELECT doc_id, 1, 0, array_to_string(g, ' ') FROM {_GRAMS('documents', 'doc_id', _N - 1)}
    UNION SELECT doc_id, 2, j, {_MASKED('g', 'j')} FROM {_GRAMS('documents', 'doc_id', _N)}, unnest(range(1, {_N + 1})) u(j)
    UNION SELECT doc_id, 3, j, {_MASKED('g', 'j')} FROM {_GRAMS('documents', 'doc_id', _N + 1)}, unnest(range(2, {_N + 1})) u(j))
  SELECT doc_id, item_id, CAST(min(CASE WHEN kind = 0 THEN 0 ELSE 1 END) AS INTEGER) AS edits FROM marks JOIN seen USING (kind, j, t) GROUP BY doc_id, item_id"""

SQL = {
    "p4_checked": """
      WITH q AS (SELECT CAST(asserted_at AS DATE) AS day, g AS graph, p AS predicate, s FROM quads WHERE s IS NOT NULL AND p IS NOT NULL)
      SELECT 'all' AS by, CAST(NULL AS DATE) AS day, CAST(NULL AS VARCHAR) AS graph, CAST(NULL AS VARCHAR) AS predicate, count(DISTINCT s) AS n, true AS inside FROM q
      UNION ALL SELECT 'day', day, NULL, NULL, count(DISTINCT s), true FROM q GROUP BY day
      UNION ALL SELECT 'graph', NULL, graph, NULL, count(DISTINCT s), true FROM q GROUP BY graph
      UNION ALL SELECT 'predicate', NULL, NULL, predicate, count(DISTINCT s), true FROM q GROUP BY predicate
      UNION ALL SELECT 'graph,predicate', NULL, graph, predicate, count(DISTINCT s), true FROM q GROUP BY graph, predicate""",
    "p4_merged": "SELECT g AS graph, count(DISTINCT s) AS n, true AS inside FROM quads GROUP BY g",
    "p10_counts": f"""SELECT doc_id, length(text) AS n_chars, len({_WORDS('text')}) AS n_words,
      len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM documents""",
    "p8_edited_leaks": _EDITED,
    "p10_layouts": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'CAST(NULL AS BOOLEAN)' if v is None else str(v).lower()})" for n, _, v in LAYOUTS) + ") t(name, is_prose)",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM {_WINDOWS('documents', 'doc_id')} d JOIN {_WINDOWS('eval_items', 'item_id')} e ON d.g = e.g",
    # sizes in characters: for these tables every usual unit puts the same sources beyond their caps
    "p9_found": """
      WITH sizes AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(length(d.text)), 0) AS n
        FROM mix_targets m LEFT JOIN documents d ON d.source = m.source GROUP BY m.source, m.target_share, m.max_repeats)
      SELECT source FROM sizes WHERE target_share * (SELECT sum(n) FROM sizes) > max_repeats * n""",
    # every source of the targets has documents, so each can reach its share of some total
    "p9_held": "SELECT source, source IN (SELECT source FROM documents) AS share_held, true AS cap_held FROM mix_targets",
    "p5_answers": f"{_KNOWN} SELECT req_id, seen, CASE WHEN NOT seen THEN next_id END AS next_id FROM ({_SEEN})",
    "p5_batches": f"{_KNOWN} SELECT req_id, seen FROM ({_SEEN})",
    "p5_rates": "SELECT count(*) AS n_requests, true AS probes_held, true AS answers_held FROM id_requests WHERE nt IS NOT NULL",
    "p5_found": f"{_KNOWN} SELECT req_id FROM ({_SEEN}) WHERE seen",
    "p6_found": """
      SELECT 'o' AS fld, o AS item FROM quads GROUP BY o HAVING count(*) >= 0.01 * (SELECT count(*) FROM quads) AND o IS NOT NULL
      UNION ALL
      SELECT 'p', p FROM quads GROUP BY p HAVING count(*) >= 0.01 * (SELECT count(*) FROM quads) AND p IS NOT NULL""",
    "p6_counts": _FREQUENT(0.01, ", true AS near"),
    "p6_tenth_percent": _FREQUENT(0.001),
    "p6_hundredth_percent": _FREQUENT(0.0001),
    "p7_found": f"SELECT tbl, keep_id, id AS copy_id FROM ({_GROUPED}) WHERE id <> keep_id",
    "p7_records": f"SELECT tbl, id, n AS n_copies FROM ({_GROUPED}) WHERE id = keep_id",
}
