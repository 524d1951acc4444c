"""Queries of the graph engine over the supplied tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.engine import Engine, EngineConfig
from trellis.functions import terms as T
from trellis.functions.terms import RDF, iri, var
from trellis.operators import dictionary
from trellis.plans import planner as P
from trellis.plans.algebra import Triple
from trellis.plans.parser import parse_bgp
from trellis.session import table
from trellis.sources.store import TripleStore
from trellis.sources.tables import BASE, MappedStore

SCHEMA = "http://data.example/schema/"
PREFIXES = f"""PREFIX rdf: <{RDF}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX d: <{SCHEMA}>
PREFIX t: <{BASE}> PREFIX o: <{BASE}orders#> PREFIX c: <{BASE}customer#> PREFIX n: <{BASE}nation#> PREFIX r: <{BASE}region#>
PREFIX l: <{BASE}lineitem#> PREFIX p: <{BASE}part#> PREFIX s: <{BASE}supplier#> PREFIX e: <{BASE}events#> PREFIX doc: <{BASE}documents#>
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _statements(spark: SparkSession, d: str) -> TripleStore:
    """The statements of quads as a set of triples, graphs aside."""
    return TripleStore.from_rows(table(spark, d, "quads").select("s", "p", "o"))


def _named(spark: SparkSession, d: str) -> TripleStore:
    return TripleStore.from_rows(table(spark, d, "quads").select("s", "p", "o", "g"))


def _records(spark: SparkSession, d: str) -> TripleStore:
    """The export of `triples`; its rows are unique."""
    return TripleStore(table(spark, d, "triples").select("s", "p", "o"))


def _tables(*names: str) -> Callable[[SparkSession, str], MappedStore]:
    return lambda spark, d: MappedStore.open(spark, d, names)


def _sparql(name: str, store: Callable, text: str, sql: str | None, **config) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine(store(spark, d), EngineConfig(**config)).sparql(PREFIXES + text)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL that writes terms of the mapped tables
def _row(table_: str, key: str) -> str:
    return f"'<{BASE}{table_}/' || {key} || '>'"


def _int(x: str) -> str:
    return f"'\"' || {x} || '\"^^<http://www.w3.org/2001/XMLSchema#integer>'"


def _dbl(x: str) -> str:
    return f"'\"' || CAST({x} AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#double>'"


def _txt(x: str) -> str:
    return f"'\"' || {x} || '\"'"


Q = "(SELECT DISTINCT s, p, o FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"
P_ = lambda name: f"'<{SCHEMA}{name}>'"
TYPE = f"'<{RDF}type>'"

# ---------------------------------------------------------------- scans, membership, counts

_sparql("scan_predicate", _statements, "{ ?x d:cites ?y }", f"SELECT s AS x, o AS y FROM {Q} WHERE p = {P_('cites')}")
_sparql("scan_subject", _statements, "{ <http://data.example/collection/main> ?p ?o }", f"SELECT p, o FROM {Q} WHERE s = '<http://data.example/collection/main>'")
_sparql("scan_object", _statements, "{ ?s ?p <http://data.example/class/parcel> }", f"SELECT s, p FROM {Q} WHERE o = '<http://data.example/class/parcel>'")
_sparql("scan_all_bound_but_one", _statements, '{ ?s rdf:type <http://data.example/class/bridge> }', f"SELECT s FROM {Q} WHERE p = {TYPE} AND o = '<http://data.example/class/bridge>'")
_sparql("scan_unknown_constant", _statements, "{ ?x <http://nowhere.example/p> ?y }", f"SELECT s AS x, o AS y FROM {Q} WHERE p = '<http://nowhere.example/p>'")
_sparql("ask_contains", _statements, "ASK { ?x rdf:type <http://data.example/class/parcel> }", f"SELECT count(*) > 0 AS answer FROM {Q} WHERE p = {TYPE} AND o = '<http://data.example/class/parcel>'")


@_query(f"""SELECT 'all' AS pattern, count(*) AS n FROM {Q} UNION ALL SELECT 'type', count(*) FROM {Q} WHERE p = {TYPE}
  UNION ALL SELECT 'hub', count(*) FROM {Q} WHERE s = '<http://data.example/collection/main>' UNION ALL SELECT 'self', count(*) FROM {Q} WHERE s = o""")
def count_pattern(spark, d):
    """Exact counts of several patterns in one pass."""
    store = _statements(spark, d)
    patterns = {
        "all": Triple(var("a"), var("b"), var("c")), "type": Triple(var("a"), iri(RDF + "type"), var("c")),
        "hub": Triple(iri("http://data.example/collection/main"), var("b"), var("c")), "self": Triple(var("a"), var("b"), var("a")),
    }
    return spark.createDataFrame(list(zip(patterns, store.counts(list(patterns.values())))), "pattern string, n bigint")


@_query(f"""SELECT s, p, o, CASE grouping(s) * 4 + grouping(p) * 2 + grouping(o) WHEN 3 THEN 's' WHEN 5 THEN 'p' WHEN 6 THEN 'o' WHEN 1 THEN 'sp' WHEN 2 THEN 'so' WHEN 4 THEN 'po' END AS mask,
  count(*) AS n FROM {Q} GROUP BY GROUPING SETS ((s), (p), (o), (s, p), (s, o), (p, o))""")
def pattern_stats(spark, d):
    return _statements(spark, d).statistics()


# ---------------------------------------------------------------- updates


@_query("SELECT s, p, o FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL UNION SELECT s, p, o FROM triples")
def dedup_add(spark, d):
    return _statements(spark, d).add(table(spark, d, "triples")).df


@_query(f"SELECT s, p, o FROM {Q} a WHERE NOT EXISTS (SELECT 1 FROM quads b WHERE b.g = '<http://data.example/graph/legacy>' AND a.s = b.s AND a.p = b.p AND a.o = b.o)")
def remove_triples(spark, d):
    gone = table(spark, d, "quads").where(F.col("g") == "<http://data.example/graph/legacy>").select("s", "p", "o").distinct()
    return _statements(spark, d).remove(gone).df


@_query(f"SELECT s, p, o FROM {Q} a WHERE EXISTS (SELECT 1 FROM quads b WHERE b.g = '<http://data.example/graph/legacy>' AND a.s = b.s AND a.p = b.p AND a.o = b.o)")
def contained_triples(spark, d):
    some = table(spark, d, "quads").where(F.col("g") == "<http://data.example/graph/legacy>").select("s", "p", "o")
    return _statements(spark, d).contained(some)


# ---------------------------------------------------------------- basic graph patterns

_STAR = "{ ?o rdf:type t:orders ; o:o_totalprice ?price ; o:o_orderstatus ?status ; o:o_orderpriority ?priority }"
_STAR_SQL = f"SELECT {_row('orders', 'o_orderkey')} AS o, {_dbl('o_totalprice')} AS price, {_txt('o_orderstatus')} AS status, {_txt('o_orderpriority')} AS priority FROM orders"
_PATH = "{ ?o o:ref-o_custkey ?c . ?c c:ref-c_nationkey ?n . ?n n:ref-n_regionkey ?r . ?r r:r_name ?region }"
_PATH_SQL = f"""SELECT {_row('orders', 'o_orderkey')} AS o, {_row('customer', 'c_custkey')} AS c, {_row('nation', 'n_nationkey')} AS n, {_row('region', 'r_regionkey')} AS r, {_txt('r_name')} AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_FLAKE = """SELECT ?customer ?nation ?price { ?l l:ref-l_orderkey ?o ; l:ref-l_partkey ?p ; l:ref-l_suppkey ?s ; l:l_extendedprice ?price .
  ?o o:ref-o_custkey ?c . ?c c:c_name ?customer ; c:ref-c_nationkey ?n . ?n n:n_name ?nation ; n:ref-n_regionkey ?r . ?r r:r_name "ASIA" .
  ?p p:p_size ?size . ?s s:ref-s_nationkey ?sn }"""
_FLAKE_SQL = f"""SELECT {_txt('c_name')} AS customer, {_txt('n_name')} AS nation, {_dbl('l_extendedprice')} AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE r_name = 'ASIA'"""
_sparql("bgp_star", _tables("orders", "customer"), _STAR, _STAR_SQL)
_sparql("bgp_path", _tables("orders", "customer", "nation", "region"), _PATH, _PATH_SQL)
_sparql("bgp_snowflake", _tables("lineitem", "orders", "customer", "nation", "region", "part", "supplier"), _FLAKE, _FLAKE_SQL)
_sparql("bgp_nondistinguished", _tables("orders", "customer"), "{ _:o o:ref-o_custkey ?c ; o:o_orderstatus ?status }", f"SELECT {_row('customer', 'o_custkey')} AS c, {_txt('o_orderstatus')} AS status FROM orders")
_ITEM = f"{{ ?x rdf:type <http://data.example/class/parcel> ; d:country ?c ; d:label ?l }}"
_ITEM_SQL = f"SELECT a.s AS x, b.o AS c, e.o AS l FROM {Q} a JOIN {Q} b ON a.s = b.s JOIN {Q} e ON a.s = e.s WHERE a.p = {TYPE} AND a.o = '<http://data.example/class/parcel>' AND b.p = {P_('country')} AND e.p = {P_('label')}"
_sparql("bgp_statements_star", _statements, _ITEM, _ITEM_SQL)

_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
_TAGGED = lambda x, lang: f"'\"' || {_ESC(x)} || '\"' || coalesce('@' || {lang}, '')"
_sparql("bgp_documents", _tables("documents"), "{ ?d doc:text ?text ; doc:tgt_text ?target }", f"SELECT {_row('documents', 'doc_id')} AS d, {_TAGGED('text', 'lang')} AS text, {_TAGGED('tgt_text', 'tgt_lang')} AS target FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND tgt_text IS NOT NULL")
_sparql("bgp_events", _tables("events"), "{ ?e e:event_type ?type ; e:props ?props }", f"SELECT {_row('events', 'event_id')} AS e, {_txt('event_type')} AS type, {_txt(_ESC('props'))} AS props FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND props IS NOT NULL")


def _trade(spark: SparkSession, d: str) -> TripleStore:
    """Edges between nations: a customer's nation buys from a supplier's."""
    edges = (
        table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_nationkey", "s_nationkey").distinct()
    )
    nation = lambda c: F.concat(F.lit(f"<{BASE}nation/"), F.col(c).cast("string"), F.lit(">"))
    return TripleStore(edges.select(nation("c_nationkey").alias("s"), F.lit(f"<{BASE}buys>").alias("p"), nation("s_nationkey").alias("o")))


_TRADE_SQL = f"""(SELECT DISTINCT {_row('nation', 'c_nationkey')} AS s, {_row('nation', 's_nationkey')} AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_sparql("scan_repeated_var", _trade, "{ ?x ?p ?x }", f"SELECT s AS x, '<{BASE}buys>' AS p FROM {_TRADE_SQL} WHERE s = o")
_sparql("bgp_triangle", _trade, "{ ?p t:buys ?q . ?q t:buys ?r . ?r t:buys ?p }", f"SELECT a.s AS p, a.o AS q, b.o AS r FROM {_TRADE_SQL} a JOIN {_TRADE_SQL} b ON a.o = b.s JOIN {_TRADE_SQL} c ON b.o = c.s AND c.o = a.s")

# ---------------------------------------------------------------- join algorithms

_PAIR = "{ ?o o:ref-o_custkey ?c ; o:o_orderstatus ?status . ?c c:c_mktsegment ?segment }"
_PAIR_SQL = f"SELECT {_row('orders', 'o_orderkey')} AS o, {_row('customer', 'c_custkey')} AS c, {_txt('o_orderstatus')} AS status, {_txt('c_mktsegment')} AS segment FROM orders JOIN customer ON o_custkey = c_custkey"
for _algorithm in ("merge", "hash"):
    _sparql(f"join_{_algorithm}", _tables("orders", "customer"), _PAIR, _PAIR_SQL, join=_algorithm)
_sparql("join_nestedloop", _tables("customer", "nation"), "{ ?c c:ref-c_nationkey ?n . ?n n:n_name ?name }", f"SELECT {_row('customer', 'c_custkey')} AS c, {_row('nation', 'n_nationkey')} AS n, {_txt('n_name')} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey", join="nestedloop")
_sparql("join_cartesian", _tables("nation", "region"), "{ ?n n:n_name ?name . ?r r:r_name ?region }", f"SELECT {_row('nation', 'n_nationkey')} AS n, {_txt('n_name')} AS name, {_row('region', 'r_regionkey')} AS r, {_txt('r_name')} AS region FROM nation CROSS JOIN region")
for _order in ("greedy", "dp"):
    _sparql(f"{_order}_reorder", _tables("orders", "customer", "nation", "region"), "{ ?o o:ref-o_custkey ?c ; o:o_orderstatus \"F\" . ?c c:ref-c_nationkey ?n . ?n n:n_name ?name ; n:ref-n_regionkey ?r . ?r r:r_name \"EUROPE\" }", f"""SELECT {_row('orders', 'o_orderkey')} AS o, {_row('customer', 'c_custkey')} AS c, {_row('nation', 'n_nationkey')} AS n, {_txt('n_name')} AS name, {_row('region', 'r_regionkey')} AS r
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND r_name = 'EUROPE'""", order=_order)

# ---------------------------------------------------------------- optional, union, graphs

_sparql("optional_left", _statements, "{ ?x d:country ?c OPTIONAL { ?x d:label ?l } }", f"SELECT a.s AS x, a.o AS c, b.o AS l FROM (SELECT * FROM {Q} WHERE p = {P_('country')}) a LEFT JOIN (SELECT * FROM {Q} WHERE p = {P_('label')}) b ON a.s = b.s")
_sparql("optional_filter_scope", _statements, '{ ?x d:country ?c OPTIONAL { ?x d:label ?l FILTER(LANG(?l) = "en" && ?c != "QH") } }', f"""SELECT a.s AS x, a.o AS c, b.o AS l FROM (SELECT * FROM {Q} WHERE p = {P_('country')}) a
  LEFT JOIN (SELECT * FROM {Q} WHERE p = {P_('label')}) b ON a.s = b.s AND regexp_matches(b.o, '"@en$') AND a.o NOT LIKE '"QH"%'""")
_sparql("optional_chain", _tables("nation", "region"), """{ ?n n:n_name ?name OPTIONAL { ?n n:ref-n_regionkey ?k . FILTER(?name < "NATION_2") } OPTIONAL { ?m n:ref-n_regionkey ?k . ?m n:n_name "NATION_3" } }""", f"""
  SELECT a.n, a.name, coalesce(a.k, b.k) AS k, b.m FROM (SELECT {_row('nation', 'n_nationkey')} AS n, {_txt('n_name')} AS name, CASE WHEN n_name < 'NATION_2' THEN '<{BASE}region/' || n_regionkey || '>' END AS k FROM nation) a
  LEFT JOIN (SELECT {_row('nation', 'n_nationkey')} AS m, '<{BASE}region/' || n_regionkey || '>' AS k FROM nation WHERE n_name = 'NATION_3') b ON a.k = b.k OR a.k IS NULL""")
_sparql("optional_chain_quads", _statements, "{ ?x d:country ?c OPTIONAL { ?x d:label ?l FILTER(LANG(?l) = 'en') } OPTIONAL { ?x d:label ?l } }", f"""SELECT a.x, a.c, coalesce(a.l, b.o) AS l
  FROM (SELECT c.s AS x, c.o AS c, e.o AS l FROM (SELECT * FROM {Q} WHERE p = {P_('country')}) c LEFT JOIN (SELECT * FROM {Q} WHERE p = {P_('label')} AND regexp_matches(o, '"@en$')) e ON c.s = e.s) a
  LEFT JOIN (SELECT * FROM {Q} WHERE p = {P_('label')}) b ON a.x = b.s AND (a.l IS NULL OR a.l = b.o)""")
_sparql("union_same_vars", _tables("customer", "supplier", "nation"), "{ { ?x c:ref-c_nationkey ?n } UNION { ?x s:ref-s_nationkey ?n } }", f"SELECT {_row('customer', 'c_custkey')} AS x, {_row('nation', 'c_nationkey')} AS n FROM customer UNION ALL SELECT {_row('supplier', 's_suppkey')}, {_row('nation', 's_nationkey')} FROM supplier")
_sparql("union_diff_vars", _tables("customer", "supplier"), "{ { ?x c:c_mktsegment ?segment } UNION { ?y s:s_name ?name } }", f"SELECT {_row('customer', 'c_custkey')} AS x, {_txt('c_mktsegment')} AS segment, CAST(NULL AS VARCHAR) AS y, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT NULL, NULL, {_row('supplier', 's_suppkey')}, {_txt('s_name')} FROM supplier")
_G = "(SELECT DISTINCT s, p, o, g FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"
_sparql("named_graph", _named, "{ GRAPH ?g { ?x rdf:type ?c } }", f"SELECT g, s AS x, o AS c FROM {_G} WHERE g IS NOT NULL AND p = {TYPE}")
_sparql("named_graph_constant", _named, "{ GRAPH <http://data.example/graph/main> { ?x d:country ?c . ?x d:label ?l } }", f"SELECT a.s AS x, a.o AS c, b.o AS l FROM {_G} a JOIN {_G} b ON a.s = b.s WHERE a.g = '<http://data.example/graph/main>' AND b.g = a.g AND a.p = {P_('country')} AND b.p = {P_('label')}")
_sparql("default_graph", _named, "{ ?x d:country ?c }", f"SELECT s AS x, o AS c FROM {_G} WHERE g IS NULL AND p = {P_('country')}")
_sparql("from_named", _named, "SELECT ?g ?x FROM NAMED <http://data.example/graph/legacy> WHERE { GRAPH ?g { ?x rdf:type <http://data.example/class/parcel> } }", f"SELECT g, s AS x FROM {_G} WHERE g = '<http://data.example/graph/legacy>' AND p = {TYPE} AND o = '<http://data.example/class/parcel>'")

# ---------------------------------------------------------------- filters

_COUNTRY = f"(SELECT s AS x, o AS c FROM {Q} WHERE p = {P_('country')})"
_LABEL = f"(SELECT s AS x, o AS l FROM {Q} WHERE p = {P_('label')})"
_VAL = lambda c: f"regexp_extract({c}, '^\"(.*)\"[^\"]*$', 1)"
_CITES = f"(SELECT s AS x, o AS y FROM {Q} WHERE p = {P_('cites')})"
_sparql("filter_eq", _statements, '{ ?x d:country ?c FILTER(?c = "QH") }', f"SELECT * FROM {_COUNTRY} WHERE c LIKE '\"%' AND {_VAL('c')} = 'QH'")
_sparql("filter_neq", _statements, '{ ?x d:country ?c FILTER(?c != "QH") }', f"SELECT * FROM {_COUNTRY} WHERE NOT (c LIKE '\"%' AND {_VAL('c')} = 'QH')")
_sparql("filter_is_iri", _statements, "{ ?x ?p ?y FILTER isIRI(?y) }", f"SELECT s AS x, p, o AS y FROM {Q} WHERE o LIKE '<%'")
_sparql("filter_is_blank", _statements, "{ ?x ?p ?y FILTER isBLANK(?x) }", f"SELECT s AS x, p, o AS y FROM {Q} WHERE s LIKE '\\_:%' ESCAPE '\\'")
_sparql("filter_is_literal", _statements, "{ ?x ?p ?y FILTER isLITERAL(?y) }", f"SELECT s AS x, p, o AS y FROM {Q} WHERE o LIKE '\"%'")
_ORDERS = f"SELECT {_row('orders', 'o_orderkey')} AS o, {_dbl('o_totalprice')} AS price FROM orders"
_sparql("filter_compare", _tables("orders", "customer"), "{ ?o o:o_totalprice ?price FILTER(?price >= 250000) }", f"{_ORDERS} WHERE o_totalprice >= 250000")
_sparql("filter_logic", _tables("orders", "customer"), '{ ?o o:o_totalprice ?price ; o:o_orderstatus ?st FILTER((?price < 50000 || ?price > 400000) && !(?st = "F")) }', f"SELECT {_row('orders', 'o_orderkey')} AS o, {_dbl('o_totalprice')} AS price, {_txt('o_orderstatus')} AS st FROM orders WHERE (o_totalprice < 50000 OR o_totalprice > 400000) AND o_orderstatus <> 'F'")
_sparql("filter_arith", _tables("lineitem", "part"), "{ ?l l:l_extendedprice ?e ; l:l_discount ?dis FILTER(?e * (1 - ?dis) / 2 + 1 > 30000) }", f"SELECT {_row('lineitem', "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)")} AS l, {_dbl('l_extendedprice')} AS e, {_dbl('l_discount')} AS dis FROM lineitem WHERE l_extendedprice * (1 - l_discount) / 2 + 1 > 30000")
_sparql("filter_bound", _statements, "{ ?x d:country ?c OPTIONAL { ?x d:closed ?l } FILTER(!BOUND(?l)) }", f"SELECT a.x, a.c, CAST(NULL AS VARCHAR) AS l FROM {_COUNTRY} a WHERE NOT EXISTS (SELECT 1 FROM quads b WHERE b.p = {P_('closed')} AND a.x = b.s)")
_sparql("filter_str", _statements, '{ ?x rdf:type ?t FILTER(STR(?t) = "http://data.example/class/parcel") }', f"SELECT s AS x, o AS t FROM {Q} WHERE p = {TYPE} AND o IN ('<http://data.example/class/parcel>', '\"http://data.example/class/parcel\"')")
_sparql("filter_lang", _statements, '{ ?x d:label ?l FILTER(LANG(?l) = "en") }', f"SELECT * FROM {_LABEL} WHERE regexp_matches(l, '\"@en$')")
_sparql("filter_langmatches", _statements, '{ ?x d:label ?l FILTER LANGMATCHES(LANG(?l), "EN") }', f"SELECT * FROM {_LABEL} WHERE regexp_matches(lower(l), '\"@en(-[a-z0-9-]+)?$')")
_sparql("filter_datatype", _statements, "{ ?x ?p ?v FILTER(DATATYPE(?v) = xsd:date) }", f"SELECT s AS x, p, o AS v FROM {Q} WHERE o LIKE '%\"^^<http://www.w3.org/2001/XMLSchema#date>'")
_sparql("filter_sameterm", _statements, '{ ?x d:country ?c FILTER SAMETERM(?c, "QH") }', f"SELECT * FROM {_COUNTRY} WHERE c = '\"QH\"'")
_sparql("filter_regex", _statements, '{ ?x d:label ?l FILTER REGEX(?l, "^STR|1[0-9]+$", "i") }', f"SELECT * FROM {_LABEL} WHERE l LIKE '\"%' AND regexp_matches({_VAL('l')}, '(?i)^STR|1[0-9]+$')")
_DT = lambda c: f"regexp_extract({c}, '\"\\^\\^<([^>]*)>$', 1)"
_XSD = "http://www.w3.org/2001/XMLSchema#"


def _cast_sql(v: str) -> str:
    """xsd:integer of a literal by the standard: plain texts in its lexical space, numbers without their fraction, truth values."""
    text, dt = f"trim({_VAL(v)}, ' ' || chr(9) || chr(10) || chr(13))", _DT(v)
    whole = f"CASE WHEN regexp_matches({text}, '^[+-]?[0-9]+$') THEN try_cast({text} AS HUGEINT) END"
    number = f"CASE WHEN regexp_matches({text}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trunc(try_cast({text} AS DECIMAL(38,10))) AS HUGEINT) END"
    kinds = ", ".join(f"'{_XSD}{n}'" for n in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))
    return f"""CASE WHEN {v} NOT LIKE '"%' THEN NULL WHEN regexp_matches({v}, '"$') OR {dt} = '{_XSD}string' THEN {whole}
      WHEN {dt} IN ({kinds}) THEN coalesce({whole}, {number}) WHEN {dt} = '{_XSD}boolean' THEN CASE WHEN {text} IN ('true', '1') THEN 1 WHEN {text} IN ('false', '0') THEN 0 END END"""


_sparql("filter_cast", _statements, "{ ?x d:pages ?v FILTER(xsd:integer(?v) > 900) }", f"SELECT s AS x, o AS v FROM {Q} WHERE p = {P_('pages')} AND {_cast_sql('o')} > 900")
_sparql("filter_cast_decimals", _statements, "{ ?x d:price ?v FILTER(xsd:integer(?v) < 100) }", f"SELECT s AS x, o AS v FROM {Q} WHERE p = {P_('price')} AND {_cast_sql('o')} < 100")
_sparql("filter_is_uri", _statements, "{ ?x ?p ?y FILTER isURI(?y) }", f"SELECT s AS x, p, o AS y FROM {Q} WHERE o LIKE '<%'")
_sparql("filter_le", _tables("orders", "customer"), "{ ?o o:o_totalprice ?price FILTER(?price <= 20000) }", f"{_ORDERS} WHERE o_totalprice <= 20000")
_sparql("filter_ebv", _statements, "{ ?x d:digital ?v FILTER(?v) }", f"""SELECT s AS x, o AS v FROM {Q} WHERE p = {P_('digital')} AND o LIKE '"%' AND CASE
  WHEN {_DT('o')} IN ('', '{_XSD}string') THEN {_VAL('o')} <> '' WHEN {_DT('o')} = '{_XSD}boolean' THEN {_VAL('o')} = 'true'
  WHEN {_DT('o')} IN ('{_XSD}integer', '{_XSD}decimal', '{_XSD}double', '{_XSD}float') THEN coalesce(try_cast({_VAL('o')} AS DOUBLE) <> 0, false) ELSE false END""")
_sparql("filter_unary", _tables("supplier", "nation"), "{ ?s s:s_acctbal ?b FILTER(-?b > +500) }", f"SELECT {_row('supplier', 's_suppkey')} AS s, {_dbl('s_acctbal')} AS b FROM supplier WHERE -s_acctbal > 500")

# ---------------------------------------------------------------- result modifiers

_sparql("project_missing", _tables("nation", "region"), "SELECT ?name ?nothing { ?n n:n_name ?name }", f"SELECT {_txt('n_name')} AS name, CAST(NULL AS VARCHAR) AS nothing FROM nation")
_sparql("select_distinct", _statements, "SELECT DISTINCT ?c { ?x d:country ?c }", f"SELECT DISTINCT c FROM {_COUNTRY}")
_sparql("order_by_terms", _statements, "SELECT ?x ?y { ?x d:cites ?y } ORDER BY ?y ?x", f"SELECT x, y FROM {_CITES}")
_sparql("limit_offset", _tables("orders", "customer"), "SELECT ?o ?price { ?o o:o_totalprice ?price } ORDER BY DESC(?price) ?o LIMIT 50 OFFSET 20", f"{_ORDERS} ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50 OFFSET 20")
_sparql("values_inline", _tables("nation", "region"), '{ VALUES ?name { "NATION_3" "NATION_7" } ?n n:n_name ?name }', f"SELECT {_txt('n_name')} AS name, {_row('nation', 'n_nationkey')} AS n FROM nation WHERE n_name IN ('NATION_3', 'NATION_7')")
_sparql("construct", _tables("customer", "nation"), "CONSTRUCT { ?n t:home-of ?c } WHERE { ?c c:ref-c_nationkey ?n }", f"SELECT {_row('nation', 'c_nationkey')} AS s, '<{BASE}home-of>' AS p, {_row('customer', 'c_custkey')} AS o FROM customer")


@_query(f"SELECT s AS x, o AS y FROM {Q} WHERE p = {P_('cites')}")
def sort_by_column(spark, d):
    """Bindings of a pattern in the term order of one column."""
    df = _statements(spark, d).match(var("x"), iri(SCHEMA + "cites"), var("y"))
    return df.orderBy(*T.order_keys("y"), *T.order_keys("x"))


_TERMS_SQL = f"SELECT DISTINCT t AS nt FROM (SELECT s AS t FROM {Q} UNION ALL SELECT p FROM {Q} UNION ALL SELECT o FROM {Q})"


@_query(f"""SELECT row_number() OVER (ORDER BY CASE WHEN nt LIKE '\\_:%' ESCAPE '\\' THEN 0 WHEN nt LIKE '<%' THEN 1 ELSE 2 END,
  CASE WHEN nt LIKE '\\_:%' ESCAPE '\\' THEN substr(nt, 3) WHEN nt LIKE '<%' THEN substr(nt, 2, length(nt) - 2) ELSE {_VAL('nt')} END, nt) AS id, nt FROM ({_TERMS_SQL})""")
def reencode_ids(spark, d):
    """Dictionary whose ids are in term order."""
    return dictionary.build_dictionary(_statements(spark, d).df, ["s", "p", "o"]).select("id", "nt")


@_query("SELECT s, p, o FROM triples")
def id_decode(spark, d):
    """Encode a store by ids and decode it again."""
    from trellis.sources.store import IdStore

    return IdStore.encode(_records(spark, d)).store().df


@_query(f"SELECT a.s AS x, b.p AS p, a.o AS l FROM triples a JOIN triples b ON a.s = b.s WHERE a.p = {P_('caption')} AND a.o LIKE '%@en'")
def id_query(spark, d):
    """A join on ids with a filter on terms."""
    from trellis.sources.store import IdStore

    text = 'SELECT ?x ?p ?l { ?x d:caption ?l . ?x ?p ?y FILTER(LANG(?l) = "en") }'
    return Engine(IdStore.encode(_records(spark, d))).sparql(PREFIXES + text)


@_query("SELECT r.lookup_id, t.nt AS id_nt FROM gid_lookups r LEFT JOIN (SELECT id, nt FROM terms UNION ALL SELECT id, nt FROM vocab) t ON t.id = r.gid & 281474976710655")
def lookup_ids(spark, d):
    """Terms of the ids that ranks ask for."""
    terms = table(spark, d, "terms").select("id", "nt").unionByName(table(spark, d, "vocab").select("id", "nt"))
    asked = table(spark, d, "gid_lookups").select("lookup_id", dictionary.local_id(F.col("gid")).alias("id"))
    return dictionary.lookup(asked, "id", terms, by="id").select("lookup_id", "id_nt")


@_query("SELECT id, ((id % 16) << 48) | id AS gid, CAST(id % 16 AS INTEGER) AS rank FROM terms")
def global_ids(spark, d):
    """Ids of terms tagged with the rank that owns them, and the rank read back."""
    gid = dictionary.global_id(F.col("id"), 16)
    return table(spark, d, "terms").select("id", gid.alias("gid"), dictionary.owner(gid).alias("rank"))


@_query("SELECT r.req_id, t.id FROM id_requests r LEFT JOIN (SELECT id, nt FROM terms UNION ALL SELECT id, nt FROM vocab) t ON t.nt = r.nt")
def lookup_terms(spark, d):
    """Ids of the terms that ask for one, NULL for unknown ones."""
    terms = table(spark, d, "terms").select("id", "nt").unionByName(table(spark, d, "vocab").select("id", "nt"))
    asked = table(spark, d, "id_requests").select("req_id", "nt")
    return dictionary.lookup(asked, "nt", terms).select("req_id", F.col("nt_id").alias("id"))


@_query(_ITEM_SQL)
def federated_union(spark, d):
    """A star over two sources that share no graph: the join is distributed over their union."""
    quads = table(spark, d, "quads")
    main = F.coalesce(F.col("g") == "<http://data.example/graph/main>", F.lit(False))
    one, rest = (TripleStore.from_rows(quads.where(c).select("s", "p", "o")) for c in (main, ~main))
    one_only = TripleStore(one.remove(rest.df).df)  # disjoint, so that no triple is found twice
    engine = Engine(_statements(spark, d)).add_source("A", one_only).add_source("B", rest)
    bgp = parse_bgp(PREFIXES + _ITEM)
    return engine.run_plan(engine.federated(bgp))


@_query(_ITEM_SQL)
def plan_forced(spark, d):
    """The exact search's plan, run with the algorithms that it names."""
    engine = Engine(_statements(spark, d))
    return engine.run_plan(P.Planner(engine.store).optimize(parse_bgp(PREFIXES + _ITEM)), forced=True)


_sparql("empty_relation", _statements, "{ ?x d:cites ?y . ?y <http://nowhere.example/p> ?z FILTER(?z != ?x) }", f"SELECT s AS x, o AS y, p AS z FROM {Q} WHERE false")


@_query(f"SELECT s AS x, o AS l FROM {Q} WHERE p = {P_('label')} AND o LIKE '%\"@en'")
def user_function(spark, d):
    """A registered function inside a filter."""
    english = lambda t: T.make_lit((T.lang_of(t) == "en").cast("string"), T.XSD + "boolean")
    return Engine(_statements(spark, d)).register_function("http://fn.example/english", english).sparql(PREFIXES + "{ ?x d:label ?l FILTER <http://fn.example/english>(?l) }")


@_query("SELECT id, CASE kind WHEN 'bnode' THEN 0 WHEN 'iri' THEN 1 ELSE 2 END AS rank, kind, value, lang, dt FROM terms")
def term_accessors(spark, d):
    """Rank, kind, value, language and datatype read off canonical terms, escaped ones too."""
    df = table(spark, d, "terms").select("id", "nt")
    return T.explode_term(df.withColumn("rank", T.kind_rank("nt")), "nt").drop("nt")


@_query(f"SELECT p, count(*) AS n FROM ({_TERMS_SQL.replace('SELECT DISTINCT t AS nt', 'SELECT t AS p')}) GROUP BY p")
def term_frequencies(spark, d):
    """How often each term stands in any position."""
    df = _statements(spark, d).df
    terms = df.select(F.explode(F.array("s", "p", "o")).alias("p"))
    return terms.groupBy("p").agg(F.count(F.lit(1)).alias("n"))

