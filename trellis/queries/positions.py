"""Queries whose results tell the order of their rows: each has a column `at`, the row's place."""

from __future__ import annotations

from trellis.engine import Engine, EngineConfig
from trellis.functions.terms import iri, var
from trellis.operators.bindings import sort_bindings
from trellis.operators.dictionary import number_rows
from trellis.queries.graph import _CITES, _DT, _VAL, _XSD, PREFIXES, SCHEMA, P_, Q, _statements

QUERIES: dict = {}
SQL: dict = {}

_RANK = lambda c: f"CASE WHEN {c} LIKE '\\_:%' ESCAPE '\\' THEN 0 WHEN {c} LIKE '<%' THEN 1 ELSE 2 END"
_TEXT = lambda c: f"CASE WHEN {c} LIKE '\\_:%' ESCAPE '\\' THEN substr({c}, 3) WHEN {c} LIKE '<%' THEN substr({c}, 2, length({c}) - 2) ELSE {_VAL(c)} END"
_KINDS = ", ".join(f"'{_XSD}{n}'" for n in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))
_NUMBER = lambda c: f"CASE WHEN {_DT(c)} IN ({_KINDS}) THEN try_cast(trim({_VAL(c)}, ' ' || chr(9) || chr(10) || chr(13)) AS DOUBLE) END"
_BY_TERM = lambda c: f"{_RANK(c)}, {_TEXT(c)}, {c}"
_BY_VALUE = lambda c: f"{_RANK(c)}, {_NUMBER(c)} IS NULL, {_NUMBER(c)}, {_TEXT(c)}, {c}"
_PAGES = f"(SELECT s AS x, o AS y FROM {Q} WHERE p = {P_('pages')})"


def _ordered(name: str, run, source: str, order: str) -> None:
    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS at, x, y FROM {source}"


def _placed(df):
    return number_rows(df).withColumnRenamed("id", "at")


_SELECT = "SELECT ?x ?y { ?x d:pages ?y } ORDER BY "
# numbers by value, before other literals
_ordered("order_by_values", lambda spark, d: _placed(Engine(_statements(spark, d)).sparql(PREFIXES + _SELECT + "?y ?x")), _PAGES, f"{_BY_VALUE('y')}, {_BY_VALUE('x')}")
# all literals by their texts
_ordered("order_by_lexical", lambda spark, d: _placed(Engine(_statements(spark, d), EngineConfig(lexical_order=True)).sparql(PREFIXES + _SELECT + "?y ?x")), _PAGES, f"{_BY_TERM('y')}, {_BY_TERM('x')}")
_ordered("order_by_places", lambda spark, d: _placed(Engine(_statements(spark, d)).sparql(PREFIXES + "SELECT ?x ?y { ?x d:cites ?y } ORDER BY ?y ?x")), _CITES, f"{_BY_VALUE('y')}, {_BY_VALUE('x')}")
_ordered("sort_pattern", lambda spark, d: _placed(_statements(spark, d).match(var("x"), iri(SCHEMA + "cites"), var("y"), ["y", "x"])), _CITES, f"{_BY_TERM('y')}, {_BY_TERM('x')}")
_ordered("scan_by_index", lambda spark, d: _placed(_statements(spark, d).match_by(var("x"), iri(SCHEMA + "cites"), var("y"), "POS")), _CITES, f"{_BY_TERM('y')}, {_BY_TERM('x')}")
_ordered("sort_all_columns", lambda spark, d: _placed(sort_bindings(_statements(spark, d).match(var("x"), iri(SCHEMA + "pages"), var("y")))), _PAGES, f"{_BY_TERM('x')}, {_BY_TERM('y')}")
