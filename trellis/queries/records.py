"""Queries of the record-level operators: failed lines, hot keys, wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import keyed, wide
from trellis.session import table
from trellis.sources import ntriples

HEAVY_SHARE = 0.05


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its statement, or its raw text and the reason of failure."""
    return ntriples.read_permissive(table(spark, d, "ntriple_lines"), "ntriple", ["line_id", "file_name"])


def p1_statements(spark: SparkSession, d: str) -> DataFrame:
    return ntriples.statements(p1_lines(spark, d))


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return ntriples.rejects(p1_lines(spark, d))


#: (line, reason) of lines that fail, and of ones that do not (None).
LINES = [
    ("<http://e/a> <http://e/p> <http://e/b> .", None), ("_:a <http://e/p> \"x\"@en-US .\t# note\r", None), ("  # only a note", None), ("", None), (None, "missing_line"),
    ('<http://e/a> <http://e/p> "open .', "unbalanced_quote"), ("<http://e/a> <http://e/p <http://e/b> .", "unclosed_iri"), ("<http://e/a> <http://e/p> <http://e/b>", "missing_stop"),
    ("<http://e/a> <http://e/p> .", "too_few_terms"), ("<http://e/a> <http://e/p> <http://e/b> <http://e/c> .", "too_many_terms"), ('<http://e/a> <http://e/p> "a\\q" .', "bad_escape"),
    ('"s" <http://e/p> <http://e/b> .', "bad_subject"), ("<rel> <http://e/p> <http://e/b> .", "bad_subject"), ("<http://e/a> _:p <http://e/b> .", "bad_predicate"), ("<http://e/a> <http://e/p> word .", "bad_object"),
    ('<http://e/a> <http://e/p> "x"@en--us .', "bad_language"), ('<http://e/a> <http://e/p> "x"^^<http://www.w3.org/2001/XMLSchema#integer> .', "bad_value"),
    ('<http://e/a> <http://e/p> "2023-02-29"^^<http://www.w3.org/2001/XMLSchema#date> .', "bad_value"), ('<http://e/a> <http://e/p> "2024-02-29"^^<http://www.w3.org/2001/XMLSchema#date> .', None),
]


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are known to fail, each with its reason, and lines that do not."""
    lines = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "line_id bigint, line string")
    return ntriples.read_permissive(lines, "line", ["line_id"]).select("line_id", "reason")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_rejects(spark, d).select("line_id")


def p2_predicates(spark: SparkSession, d: str) -> DataFrame:
    return keyed.keyed_counts(table(spark, d, "quads"), "p", distinct="s")


def p2_gids(spark: SparkSession, d: str) -> DataFrame:
    return keyed.keyed_counts(table(spark, d, "gid_lookups"), "gid", sums=("n_bytes",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = keyed.heavy_keys(keyed.keyed_counts(table(spark, d, "quads"), "p"), "p", HEAVY_SHARE)
    gid = keyed.heavy_keys(keyed.keyed_counts(table(spark, d, "gid_lookups"), "gid"), "gid", HEAVY_SHARE)
    return p.select(F.lit("p").alias("fld"), F.col("p").alias("item")).unionByName(
        gid.select(F.lit("gid").alias("fld"), F.col("gid").cast("string").alias("item"))
    )


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per subject; failures as one string, `predicate reason` pairs in order."""
    out = wide.widen(table(spark, d, "quads"), wide.attributes(table(spark, d, "vocab")))
    pairs = F.transform(F.map_entries("failures"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return out.withColumn("failures", F.array_join(F.array_sort(pairs), ", "))


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table, one row each, with their typed values as text."""
    attrs = wide.attributes(table(spark, d, "vocab"))
    out = wide.widen(table(spark, d, "quads"), attrs)
    cells = F.array(*[F.struct(F.lit(a.predicate).alias("p"), F.col(a.column).cast("string").alias("value")) for a in attrs])
    return out.select("s", F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c")).select("s", "c.p", "c.value")


def p3_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every cell without a value with the reason."""
    out = wide.widen(table(spark, d, "quads"), wide.attributes(table(spark, d, "vocab")))
    return out.select("s", F.explode("failures").alias("p", "why"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the wide table that stay empty although rows for them exist."""
    out = wide.widen(table(spark, d, "quads"), wide.attributes(table(spark, d, "vocab")))
    return out.select("s", F.explode("failures").alias("p", "why")).where(F.col("why") != "out_of_range").select("s", "p")


QUERIES = {f.__name__: f for f in (p1_lines, p1_statements, p1_rejects, p1_reasons, p1_found, p2_predicates, p2_gids, p2_found, p3_wide, p3_cells, p3_failures, p3_found)}

_RE = lambda x: "'" + x.replace("'", "''") + "'"


def _valid_line_sql() -> str:
    """Rows (line_id, file_name, ntriple, obj, stated, ok): whether a line of ntriple_lines is valid, in the words of RE2."""
    mask = f"regexp_replace(ntriple, {_RE(ntriples.ECHAR)}, chr(1) || chr(1), 'g')"
    mask = f"regexp_replace({mask}, {_RE(ntriples.UCHAR4)}, 'uuuuuu', 'g')"
    mask = f"regexp_replace({mask}, {_RE(ntriples.UCHAR8)}, 'uuuuuuuuuu', 'g')"
    obj = f"regexp_extract(masked, {_RE(ntriples.PREFIX + '(' + ntriples.OBJECT + ')[ \\t]*\\.')}, 1)"
    text = "regexp_extract(obj, '^\"([^\"]*)\"', 1)"
    dt = "regexp_extract(obj, '\"\\^\\^<([^>]*)>$', 1)"
    rules = []
    for name, pattern in ntriples.LEXICAL.items():
        fits = f"regexp_matches(txt, {_RE(pattern)})"
        if name.startswith("date"):
            fits += " AND try_cast(regexp_extract(txt, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE) IS NOT NULL"
        rules.append(f"WHEN dt = 'http://www.w3.org/2001/XMLSchema#{name}' THEN {fits}")
    return f"""
    SELECT line_id, file_name, ntriple, obj, coalesce(regexp_matches(masked, {_RE(ntriples.STATEMENT)}), false) AS stated,
      length(regexp_extract(masked, {_RE('(' + ntriples.PREFIX + ')')}, 1)) AS lead,
      coalesce(regexp_matches(ntriple, {_RE(ntriples.NOTHING)}), false) OR
      (coalesce(regexp_matches(masked, {_RE(ntriples.STATEMENT)}), false) AND NOT regexp_matches(obj, {_RE(ntriples.BAD_LANG)})
        AND CASE {' '.join(rules)} ELSE true END) AS ok
    FROM (SELECT *, {text} AS txt, {dt} AS dt FROM (SELECT *, {obj} AS obj FROM (SELECT *, {mask} AS masked FROM ntriple_lines)))"""


_READ = """
  SELECT q.s, q.p, v.range_dt AS r,
    CASE WHEN q.o LIKE '"%' THEN trim(regexp_extract(q.o, '^"(.*)"[^"]*$', 1), ' ' || chr(9) || chr(160)) END AS t
  FROM quads q JOIN vocab v ON q.p = v.nt WHERE v.max_card = 1 AND q.s IS NOT NULL"""
_CANON = f"""
  SELECT s, p, r, t, CASE
    WHEN r = 'integer' AND regexp_matches(t, '^[+-]?[0-9]+$') THEN CAST(CAST(t AS HUGEINT) AS VARCHAR)
    WHEN r = 'decimal' AND regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(CAST(t AS DECIMAL(38,10)) AS VARCHAR)
    WHEN r = 'date' AND regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(try_cast(t AS DATE) AS VARCHAR)
    WHEN r = 'datetime' AND regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?$')
      THEN CAST(try_cast(replace(t, 'Z', '') AS TIMESTAMP) AS VARCHAR)
    WHEN r = 'boolean' AND t IN ('true', '1') THEN 'true'
    WHEN r = 'boolean' AND t IN ('false', '0') THEN 'false' END AS v
  FROM ({_READ})"""

SQL = {
    "p1_found": f"SELECT line_id FROM ({_valid_line_sql()}) WHERE NOT ok",
    "p1_statements": f"""SELECT line_id, file_name, regexp_extract(ntriple, '^[ \t]*([^ \t]+)', 1) AS s, regexp_extract(ntriple, '^[ \t]*[^ \t]+[ \t]+([^ \t]+)', 1) AS p,
      substr(ntriple, lead + 1, length(obj)) AS o FROM ({_valid_line_sql()}) WHERE ok AND stated""",
    "p1_reasons": "SELECT CAST(line_id AS BIGINT) AS line_id, CAST(reason AS VARCHAR) AS reason FROM (VALUES " + ", ".join(f"({i}, {_RE(r) if r else 'NULL'})" for i, (_, r) in enumerate(LINES)) + ") t(line_id, reason)",
    "p2_predicates": "SELECT p, count(*) AS n_rows, count(DISTINCT s) AS n_distinct FROM quads GROUP BY p",
    "p2_gids": "SELECT gid, count(*) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS sum_n_bytes, count(n_bytes) AS nonnull_n_bytes FROM gid_lookups GROUP BY gid",
    "p2_found": """
      SELECT 'p' AS fld, p AS item FROM quads GROUP BY p HAVING count(*) >= 0.05 * (SELECT count(*) FROM quads)
      UNION ALL
      SELECT 'gid', CAST(gid AS VARCHAR) FROM gid_lookups GROUP BY gid HAVING count(*) >= 0.05 * (SELECT count(*) FROM gid_lookups)""",
    "p3_cells": f"SELECT s, p, min(v) AS value FROM ({_CANON}) GROUP BY s, p HAVING count(DISTINCT v) = 1",
    "p3_failures": f"""SELECT s, p, CASE WHEN count(v) = 0 THEN 'unreadable' WHEN count(DISTINCT v) > 1 THEN 'contradictory' ELSE 'out_of_range' END AS why FROM ({_CANON}) GROUP BY s, p
      HAVING count(DISTINCT v) <> 1 OR max(CASE WHEN r = 'integer' AND abs(try_cast(v AS HUGEINT)) > 9223372036854775807 OR r = 'decimal' AND regexp_matches(rtrim(t, '0'), '[.][0-9]{{11}}') THEN 1 ELSE 0 END) = 1""",
    "p3_found": f"SELECT s, p FROM ({_CANON}) GROUP BY s, p HAVING count(DISTINCT v) <> 1",
}
