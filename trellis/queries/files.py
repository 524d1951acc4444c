"""Queries that go through files, stored layouts, dictionaries, streams, services and tables of bindings."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import cli
from trellis.engine import Engine, EngineConfig, write_rows
from trellis.functions import terms as T
from trellis.functions.terms import iri, var
from trellis.operators import bindings, dictionary
from trellis.plans import planner as P
from trellis.plans.algebra import Triple
from trellis.plans.parser import parse_bgp
from trellis.queries.graph import _COUNTRY, _ITEM, _ITEM_SQL, _LABEL, _TERMS_SQL, _VAL, PREFIXES, SCHEMA, P_, Q, _records, _statements
from trellis.queries.records import _valid_line_sql
from trellis.session import shared_folder, table
from trellis.sources import ntriples, rdf
from trellis.sources.store import ORDERINGS, IdStore, TripleStore
from trellis.streaming import stream

QUERIES: dict = {}
SQL: dict = {}
HUB = "http://data.example/collection/main"


def values(columns: str, rows: list[tuple]) -> str:
    """A table of constants in SQL; columns as `name type, ...`."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    names = [c.split() for c in columns.split(", ")]
    listed = ", ".join(f"({', '.join(map(quote, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM (VALUES {listed}) t({', '.join(n for n, _ in names)})"


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- files


@_query("SELECT DISTINCT s, p, o FROM triples")
def load_ntriples(spark: SparkSession, d: str) -> DataFrame:
    """Statements written as N-Triples lines and loaded again."""
    folder = shared_folder(spark, "nt")
    ntriples.write_ntriples(table(spark, d, "triples").select("s", "p", "o"), folder)
    return rdf.load_files(spark, folder, "ntriples").df


@_query("SELECT DISTINCT s, p, o FROM triples")
def load_turtle(spark: SparkSession, d: str) -> DataFrame:
    """The same through Turtle documents."""
    folder = shared_folder(spark, "ttl")
    rdf.write_turtle(table(spark, d, "triples").select("s", "p", "o"), folder)
    return rdf.load_files(spark, folder, "turtle").df


_XML = f"""<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:e="http://e/" xml:base="http://e/doc">
  <e:Work rdf:about="a"><e:title xml:lang="en">One</e:title><e:size rdf:datatype="{T.XSD}integer">7</e:size><e:part rdf:resource="#b"/></e:Work>
  <rdf:Description rdf:about="http://e/c" e:note="plain"><e:items rdf:parseType="Collection"><rdf:Description rdf:about="http://e/i"/></e:items></rdf:Description>
</rdf:RDF>"""
_XML_ROWS = [
    ("<http://e/a>", f"<{T.RDF}type>", "<http://e/Work>"), ("<http://e/a>", "<http://e/title>", '"One"@en'), ("<http://e/a>", "<http://e/size>", f'"7"^^<{T.XSD}integer>'),
    ("<http://e/a>", "<http://e/part>", "<http://e/doc#b>"), ("<http://e/c>", "<http://e/note>", '"plain"'), ("<http://e/c>", "<http://e/items>", "_:"),
    ("_:", f"<{T.RDF}first>", "<http://e/i>"), ("_:", f"<{T.RDF}rest>", f"<{T.RDF}nil>"),
]


def _unlabelled(df: DataFrame) -> DataFrame:
    plain = lambda c: F.when(T.is_bnode(c), "_:").otherwise(F.col(c)).alias(c)
    return df.select(plain("s"), "p", plain("o"))


@_query(values("s VARCHAR, p VARCHAR, o VARCHAR", _XML_ROWS))
def load_rdfxml(spark, d):
    """An RDF/XML document in a file; labels of blank nodes are left out of the result."""
    folder = shared_folder(spark, "xml")
    spark.createDataFrame([(_XML.replace("\n", " "),)], "value string").coalesce(1).write.text(folder)
    return _unlabelled(rdf.load_files(spark, folder, "rdfxml").df)


_TURTLE = """BASE <http://b/> PREFIX : <http://e/> :a :p 1, 2.5, "x"@en-US, true ; a <T> . [] :q ( :i "j" ) . _:n :r [ :s _:n ] ."""


@_query(values("s VARCHAR, p VARCHAR, o VARCHAR", [
    ("<http://e/a>", "<http://e/p>", f'"1"^^<{T.XSD}integer>'), ("<http://e/a>", "<http://e/p>", f'"2.5"^^<{T.XSD}decimal>'), ("<http://e/a>", "<http://e/p>", '"x"@en-US'), ("<http://e/a>", "<http://e/p>", f'"true"^^<{T.XSD}boolean>'),
    ("<http://e/a>", f"<{T.RDF}type>", "<http://b/T>"), ("_:", "<http://e/q>", "_:"), ("_:", f"<{T.RDF}first>", "<http://e/i>"), ("_:", f"<{T.RDF}rest>", "_:"), ("_:", f"<{T.RDF}first>", '"j"'), ("_:", f"<{T.RDF}rest>", f"<{T.RDF}nil>"),
    ("_:", "<http://e/r>", "_:"), ("_:", "<http://e/s>", "_:"),
]))
def load_string(spark, d):
    """A Turtle text: base, prefixes, typed and tagged literals, `a`, lists, blank nodes with and without labels."""
    return _unlabelled(rdf.load_string(spark, _TURTLE).df)


@_query(values("s VARCHAR, n BIGINT", [("<http://e/x>", 1), ("_:", 2)]))
def load_skolem(spark, d):
    """One label in two files names two nodes."""
    folder = shared_folder(spark, "labels")
    for k in "12":
        spark.createDataFrame([("_:a <http://e/p> _:a .",), ("<http://e/x> <http://e/p> <http://e/y> .",)], "value string").coalesce(1).write.text(f"{folder}/{k}")
    nodes = rdf.load_files(spark, f"{folder}/*", "ntriples").df.select("s").distinct()
    return nodes.groupBy(F.when(T.is_bnode("s"), "_:").otherwise(F.col("s")).alias("s")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT count(CASE WHEN ok AND stated THEN 1 END) AS n_statements, count(CASE WHEN NOT ok THEN 1 END) AS n_rejects FROM ({_valid_line_sql()}) WHERE ntriple IS NOT NULL")
def load_report(spark, d):
    """What a load of raw lines read and what it rejected."""
    folder = shared_folder(spark, "raw")
    table(spark, d, "ntriple_lines").where("ntriple IS NOT NULL").select("ntriple").write.text(folder)
    return rdf.load(spark, folder, "ntriples").report().agg(F.sum("n_statements").alias("n_statements"), F.sum("n_rejects").alias("n_rejects"))


@_query(f"SELECT count(CASE WHEN ok AND stated THEN 1 END) AS n_statements, count(CASE WHEN NOT ok THEN 1 END) AS n_rejects, true AS told FROM ({_valid_line_sql()}) WHERE ntriple IS NOT NULL")
def load_batches(spark, d):
    """The same load in batches of files, whose progress is told batch by batch."""
    folder, told = shared_folder(spark, "raw"), []
    table(spark, d, "ntriple_lines").where("ntriple IS NOT NULL").select("ntriple").repartition(4).write.text(f"{folder}/in")
    stream.load_batches(spark, f"{folder}/in", f"{folder}/out", lambda *progress: told.append(progress), max_files=2)
    n, bad = (spark.read.parquet(f"{folder}/out/{x}").agg(F.count(F.lit(1)).alias(f"n_{x}")) for x in ("statements", "rejects"))
    whole = F.lit(sum(x[1] for x in told)) == F.col("n_statements")
    return n.crossJoin(bad).select("n_statements", "n_rejects", (whole & F.lit(len(told) == 2)).alias("told"))  # one row each


@_query("SELECT '{ x=' || x || ', l=' || l || ' }' AS value FROM " + _LABEL)
def rows_as_text(spark, d):
    """Result rows written in parallel as lines."""
    folder = shared_folder(spark, "rows")
    write_rows(Engine(_statements(spark, d)).sparql(PREFIXES + "{ ?x d:label ?l }"), folder)
    return spark.read.option("lineSep", "\n").text(folder)


@_query("SELECT '{ x=' || s || ', y=' || o || ' }' AS value FROM triples WHERE p = " + P_("note"))
def command_line(spark, d):
    """Load, then a query out of a file, from the command line's verbs."""
    folder = shared_folder(spark, "cli")
    ntriples.write_ntriples(table(spark, d, "triples").select("s", "p", "o"), f"{folder}/nt")
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["load", f"{folder}/store", f"{folder}/nt", "--syntax", "ntriples"], spark)
    cli.main(["query", f"{folder}/store", f"{{ ?x <{SCHEMA}note> ?y }}", "--out", f"{folder}/rows"], spark)
    return spark.read.option("lineSep", "\n").text(f"{folder}/rows")


@_query("SELECT '{ s=' || s || ', p=' || p || ', o=' || o || ' }' AS value FROM triples")
def command_dump(spark, d):
    """The dump of a store, every row of it."""
    folder = shared_folder(spark, "cli")
    _records(spark, d).write(f"{folder}/store", layouts=["spo"], statistics=False)
    cli.main(["dump", f"{folder}/store", "--out", f"{folder}/rows"], spark)
    return spark.read.option("lineSep", "\n").text(f"{folder}/rows")


# ---------------------------------------------------------------- stored layouts


def _stored(spark, d, **options) -> TripleStore:
    folder = shared_folder(spark, "store")
    _statements(spark, d).write(folder, **options)
    return TripleStore.read(spark, folder)


@_query(f"SELECT s, p, o FROM {Q}")
def store_reopen(spark, d):
    """A store written and opened again."""
    return _stored(spark, d, layouts=["spo"]).df.select("s", "p", "o")


@_query(_ITEM_SQL)
def store_layouts(spark, d):
    """A query whose patterns are read from the layouts that suit them, in an order found from stored counts."""
    return Engine(_stored(spark, d), EngineConfig(order="dp")).sparql(PREFIXES + _ITEM)


@_query(f"""SELECT 's' AS mask, count(*) AS n FROM {Q} WHERE s = '<{HUB}>' UNION ALL SELECT 'p', count(*) FROM {Q} WHERE p = {P_('country')}
  UNION ALL SELECT 'sp', count(*) FROM {Q} WHERE s = '<{HUB}>' AND p = {P_('country')} UNION ALL SELECT 'none', 0""")
def stored_counts(spark, d):
    """Counts of patterns from the stored statistics."""
    hub, p, x, y = iri(HUB), iri(SCHEMA + "country"), var("x"), var("y")
    patterns = {"s": Triple(hub, x, y), "p": Triple(x, p, y), "sp": Triple(hub, p, y), "none": Triple(x, iri("http://nowhere.example/p"), y)}
    return spark.createDataFrame(list(zip(patterns, _stored(spark, d).counts(list(patterns.values())))), "mask string, n bigint")


_MASKS = {"": ORDERINGS, "s": ("SPO", "SOP"), "p": ("POS", "PSO"), "o": ("OSP", "OPS"), "sp": ("SPO", "PSO"), "so": ("SOP", "OSP"), "po": ("POS", "OPS"), "spo": ORDERINGS, "x ? x": ("SOP", "OSP")}


@_query(values("mask VARCHAR, ordering VARCHAR", [(m or "all free", o) for m, os in _MASKS.items() for o in os]))
def admissible_orderings(spark, d):
    """The permutations that can answer each set of bound positions."""
    store, term = TripleStore(spark.createDataFrame([], "s string, p string, o string")), iri("t")
    rows = [(m or "all free", x) for m in _MASKS for x in store.orderings(Triple(var("x"), var("y"), var("x")) if m == "x ? x" else Triple(*[term if c in m else var(c) for c in "spo"]))]
    return spark.createDataFrame(rows, "mask string, ordering string")


# ---------------------------------------------------------------- dictionaries


@_query(f"SELECT nt, row_number() OVER (ORDER BY nt) > 0 AS numbered FROM ({_TERMS_SQL})")
def nodemap_reopen(spark, d):
    """A dictionary written, opened again and asked for every term."""
    folder = shared_folder(spark, "terms")
    dictionary.build_dictionary(_statements(spark, d).df, ["s", "p", "o"]).write.parquet(folder)
    again = spark.read.parquet(folder)
    return dictionary.lookup(again.select("nt"), "nt", again.select("id", "nt")).select("nt", (F.col("nt_id") > 0).alias("numbered"))


_NEW = """SELECT DISTINCT nt FROM id_requests WHERE nt IS NOT NULL AND nt NOT IN (SELECT nt FROM terms)"""


@_query(f"SELECT nt, id FROM terms UNION ALL SELECT nt, 0 AS id FROM ({_NEW})")
def extend_dictionary(spark, d):
    """Ids for terms that ask for one: the old ones keep theirs, new ones follow the greatest (given as 0 here)."""
    terms = T.explode_term(table(spark, d, "terms").select("id", "nt"), "nt")
    last = terms.agg(F.max("id")).first()[0]
    more = dictionary.extend_dictionary(terms, table(spark, d, "id_requests"), ["nt"])
    return more.select("nt", F.when(F.col("id") > F.lit(last), 0).otherwise(F.col("id")).alias("id"))


@_query(f"SELECT count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT row_number() OVER (ORDER BY nt) + (SELECT max(id) FROM terms) AS id FROM ({_NEW}))")
def extended_ids(spark, d):
    """The new ids follow the greatest without a gap."""
    terms = T.explode_term(table(spark, d, "terms").select("id", "nt"), "nt")
    more = dictionary.extend_dictionary(terms, table(spark, d, "id_requests"), ["nt"]).join(terms.select("id"), "id", "left_anti")
    return more.agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@_query("SELECT id, nt FROM terms WHERE nt NOT IN (SELECT nt FROM id_requests WHERE nt IS NOT NULL)")
def remove_terms(spark, d):
    """The dictionary without the terms that were asked for."""
    return dictionary.remove_terms(table(spark, d, "terms").select("id", "nt"), table(spark, d, "id_requests").where("nt IS NOT NULL"))


@_query("SELECT s, p, o FROM triples WHERE p = " + P_("title"))
def id_store_reopen(spark, d):
    """Triples of ids and their dictionary, written and opened again."""
    folder = shared_folder(spark, "ids")
    IdStore.encode(_records(spark, d)).write(folder)
    store = IdStore.read(spark, folder)
    return Engine(store).sparql(PREFIXES + "{ ?s d:title ?o . ?s ?p ?o FILTER(?p = d:title) }").select("s", "p", "o")


@_query("SELECT s AS x, o AS y FROM triples WHERE p = " + P_("note"))
def node_lookup_hook(spark, d):
    """Ids turned into terms by a lookup of one's own."""
    store = IdStore.encode(_records(spark, d))
    store.lookup = lambda ids: ids.join(store.terms.select("id", "nt"), "id")
    return Engine(store).sparql(PREFIXES + "{ ?x d:note ?y }")


# ---------------------------------------------------------------- tables of bindings


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    store = _statements(spark, d)
    return store.match(var("x"), iri(SCHEMA + "country"), var("c")), store.match(var("x"), iri(SCHEMA + "label"), var("l"))


@_query(f"SELECT a.x, a.c, b.l FROM {_COUNTRY} a JOIN {_LABEL} b ON a.x = b.x")
def bindings_join(spark, d):
    return bindings.natural_join(*_two(spark, d))


@_query(f"SELECT a.x, a.c, coalesce(a.l, b.l) AS l FROM (SELECT x, c, CASE WHEN c LIKE '\"Q%' THEN c END AS l FROM {_COUNTRY}) a JOIN (SELECT x, CASE WHEN l LIKE '%@en' THEN l END AS l FROM {_LABEL}) b ON a.x = b.x AND (a.l = b.l OR a.l IS NULL OR b.l IS NULL)")
def bindings_compatible(spark, d):
    """Rows are merged where a shared variable agrees or one side leaves it unbound."""
    a, b = _two(spark, d)
    a = a.withColumn("l", F.when(F.col("c").startswith('"Q'), F.col("c")))
    return bindings.natural_join(a, b.withColumn("l", F.when(F.col("l").endswith("@en"), F.col("l"))), may_be_unbound=["l"])


@_query(f"SELECT a.x, a.c, b.l FROM {_COUNTRY} a LEFT JOIN {_LABEL} b ON a.x = b.x")
def bindings_left_join(spark, d):
    return bindings.left_join(*_two(spark, d))


@_query(f"SELECT x, c FROM {_COUNTRY} WHERE x IN (SELECT x FROM {_LABEL})")
def bindings_semi_join(spark, d):
    """Rows that can join, before a join that costs more."""
    return bindings.reduce_by(*_two(spark, d))


@_query(f"SELECT c, CAST(NULL AS VARCHAR) AS nothing FROM {_COUNTRY}")
def bindings_project(spark, d):
    return bindings.project(_two(spark, d)[0], ["c", "nothing"])


@_query(f"SELECT x, c, CAST(NULL AS VARCHAR) AS l FROM {_COUNTRY} UNION ALL SELECT x, NULL, l FROM {_LABEL}")
def bindings_union(spark, d):
    return bindings.union_bindings(*_two(spark, d))


@_query(f"SELECT count(*) AS n, count(DISTINCT x) AS xs FROM {_LABEL}")
def bindings_counts(spark, d):
    """Rows counted, and counted again from where they were kept, placed by a variable."""
    df = bindings.materialize(bindings.spread(_two(spark, d)[1], ["x"], 5))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("xs"))


# ---------------------------------------------------------------- services, substitution, forms, hooks


@_query(f"SELECT a.x, a.c, b.l FROM {_COUNTRY} a JOIN (SELECT s AS x, o AS l FROM triples WHERE p = {P_('title')} UNION ALL SELECT x, l FROM {_LABEL}) b ON a.x = b.x")
def service(spark, d):
    """A pattern answered by a further source."""
    both = TripleStore.from_rows(_statements(spark, d).df.where(f"p = '<{SCHEMA}label>'").unionByName(table(spark, d, "triples").select("s", F.expr(f"CASE WHEN p = '<{SCHEMA}title>' THEN '<{SCHEMA}label>' ELSE p END").alias("p"), "o")))
    return Engine(_statements(spark, d)).add_source("http://other.example/sparql", both).sparql(PREFIXES + "{ ?x d:country ?c SERVICE <http://other.example/sparql> { ?x d:label ?l } }")


@_query(f"SELECT p, o FROM {Q} WHERE s = '<{HUB}>'")
def substitute(spark, d):
    """A variable replaced by a term, in the pattern and in its filter."""
    text = "SELECT ?p ?o { ?x ?p ?o FILTER(?x = ?x) }"
    return Engine(_statements(spark, d)).sparql(text, {"x": iri(HUB)})


@_query(f"SELECT s, p, o FROM {Q} WHERE s = '<{HUB}>' OR s IN (SELECT s FROM {Q} WHERE p = {P_('country')} AND o = '\"QH\"')")
def describe(spark, d):
    """All triples about a named term and about the values of a variable."""
    return Engine(_statements(spark, d)).sparql(PREFIXES + f'DESCRIBE <{HUB}> ?x WHERE {{ ?x d:country "QH" }}')


@_query(f"SELECT DISTINCT c FROM {_COUNTRY}")
def select_reduced(spark, d):
    """REDUCED may keep repeats; what is left of them is removed here."""
    return Engine(_statements(spark, d)).sparql(PREFIXES + "select reduced ?c where { ?x d:country ?c }").distinct()


@_query(f"SELECT a.x, b.l FROM {_COUNTRY} a JOIN {_LABEL} b ON a.x = b.x")
def blank_nodes_in_patterns(spark, d):
    """A blank node in a pattern is no result, and keywords are read in any case."""
    return Engine(_statements(spark, d)).sparql(PREFIXES + "sElEcT ?x ?l wHeRe { ?x d:country _:c . ?x d:label ?l fIlTeR(bOuNd(?l)) }")


@_query(_ITEM_SQL)
def executor_hook(spark, d):
    """Basic graph patterns evaluated by a function of one's own, here by the plan of the exact search."""
    run = lambda compiler, bgp, source: P.execute(P.Planner(source).optimize(bgp), compiler, [source])
    return Engine(_statements(spark, d), EngineConfig(bgp_executor=run)).sparql(PREFIXES + _ITEM)


@_query(_ITEM_SQL)
def plan_generators(spark, d):
    """Plans of one's own generators: one access path a pattern, hash joins in one direction."""
    few = P.Config(access_plans=lambda pl, t: pl.local_access_plans(t)[:1], join_plans=lambda pl, a, b, outer: [P.Join("hash", a[0], b[0])])
    engine = Engine(_statements(spark, d), EngineConfig(planner=few))
    return engine.run_plan(P.Planner(engine.store, few).optimize(parse_bgp(PREFIXES + _ITEM)))


@_query(f"SELECT count(*) AS n, true AS alike FROM {Q}")
def triple_hashes(spark, d):
    """The hash of a triple is the same for its terms in any order."""
    df = _statements(spark, d).df
    alike = (T.triple_hash("s", "p", "o") == T.triple_hash("o", "s", "p")) & (T.triple_hash("s", "p", "o") == T.triple_hash("p", "o", "s"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(alike).alias("alike"))


# ---------------------------------------------------------------- streams


def _drained(df: DataFrame, name: str) -> DataFrame:
    """The rows of a stream over what its source holds now."""
    folder = shared_folder(df.sparkSession, name)
    df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


@_query(f"SELECT a.s AS x, a.o AS t, b.o AS c FROM triples a JOIN {Q} b ON a.s = b.s WHERE a.p = {P_('title')} AND b.p = {P_('country')} UNION ALL SELECT a.s, a.o, b.o FROM {Q} a JOIN {Q} b ON a.s = b.s WHERE a.p = {P_('label')} AND b.p = {P_('country')}")
def stream_match(spark, d):
    """Patterns over statements that arrive as lines of files, joined with stored ones."""
    folder = shared_folder(spark, "arriving")
    kept = table(spark, d, "triples").where(f"p = '<{SCHEMA}title>'").select("s", "p", "o").unionByName(_statements(spark, d).df.where(f"p = '<{SCHEMA}label>'").select("s", F.lit(f"<{SCHEMA}title>").alias("p"), "o"))
    ntriples.write_ntriples(kept, folder)
    bgp = parse_bgp(PREFIXES + "{ ?x d:title ?t . ?x d:country ?c }")
    return _drained(stream.match_stream(stream.read_lines(spark, folder), bgp, _statements(spark, d)), "matched")


@_query(f"SELECT CAST(date_trunc('day', asserted_at) AS TIMESTAMP) AS start, p, count(*) AS n FROM quads WHERE asserted_at IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    """Statements per predicate and day of a stream whose watermark leaves nothing out."""
    rows = table(spark, d, "quads").select("s", "p", "o", F.col("asserted_at").cast("timestamp").alias("at")).where("at IS NOT NULL")
    folder = shared_folder(spark, "events")
    rows.write.parquet(folder)
    end = spark.createDataFrame([("<end>", "<end>", "<end>")], "s string, p string, o string").withColumn("at", F.timestamp_add("day", F.lit(4000), F.lit("2025-01-01").cast("timestamp")))
    end.write.mode("append").parquet(folder)  # its late time closes every window before it
    counted = _drained(stream.windowed_counts(spark.readStream.schema(rows.schema).parquet(folder), "at", "1 day", "3650 days"), "windows")
    return counted.where("p <> '<end>'").select(F.col("start").cast("timestamp_ntz").alias("start"), "p", "n")
