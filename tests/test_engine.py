"""Patterns over small graphs: joins, optionals, unions, filters, graphs, modifiers, and all of it in every store layout."""

import pytest
from fixtures import FILTER, JOIN, PATTERN
from pyspark.sql import functions as F

from trellis.engine import Engine, EngineConfig, format_rows
from trellis.functions import terms as T
from trellis.functions.terms import iri, lit
from trellis.plans.parser import parse_turtle
from trellis.sources.store import IdStore, TripleStore

LAYOUTS = ("terms", "ids", "files")


@pytest.fixture(scope="module")
def open_store(spark, tmp_path_factory):
    made = {}

    def of(text: str, layout: str = "terms"):
        if (text, layout) not in made:
            store = TripleStore.from_triples(spark, parse_turtle(text))
            if layout == "ids":
                store = IdStore.encode(store)
            elif layout == "files":
                path = str(tmp_path_factory.mktemp("store") / "s")
                store.write(path)
                store = TripleStore.read(spark, path)
            made[text, layout] = store
        return made[text, layout]

    return of


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("algorithm", [None, "merge", "hash", "nestedloop", "broadcast"])
def test_path_joins(open_store, rows, algorithm, layout):
    engine = Engine(open_store(JOIN, layout), EngineConfig(join=algorithm))
    assert rows(engine.sparql("SELECT ?from ?n ?to { ?from <p1> ?n . ?n <p1> ?to }")) == [("<r1>", "<r2>", "<r1>"), ("<r2>", "<r1>", "<r2>")]
    if algorithm in (None, "hash"):
        assert rows(engine.sparql("{ ?x <p1> ?y . ?y <p1> ?z . ?z <p2> ?q }")) == [("<r1>", "<r2>", "<r1>", '"l1"'), ("<r2>", "<r1>", "<r2>", '"l2"')]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_products_and_optionals(open_store, rows, layout):
    engine = Engine(open_store(JOIN, layout))
    assert rows(engine.sparql("{ <r1> <p1> ?x . <r2> <p1> ?y }")) == [("<r2>", "<r1>")]
    assert engine.sparql("{ ?a <p1> ?b . ?c <p2> ?d }").count() == 4
    assert rows(engine.sparql('{ ?x <p1> ?y OPTIONAL { ?x <p2> "l1" } }')) == [("<r1>", "<r2>"), ("<r2>", "<r1>")]
    assert rows(engine.sparql('{ ?x <p1> _:a OPTIONAL { ?x ?p "l1" } }')) == [("<r1>", "<p2>"), ("<r2>", None)]
    assert rows(engine.sparql('{ ?x <p1> ?y OPTIONAL { ?x <nothing> ?z } }')) == [("<r1>", "<r2>", None), ("<r2>", "<r1>", None)]
    assert rows(engine.sparql('{ { <r1> ?x <r2> } UNION { <r2> ?y "l2" } }')) == [("<p1>", None), (None, "<p2>")]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_filters_and_groups(open_store, rows, layout):
    engine = Engine(open_store(FILTER, layout))
    assert engine.sparql("{ ?s ?p ?o FILTER isLITERAL(?o) }").count() == 6
    assert rows(engine.sparql("{ ?s ?p ?o FILTER(?o = <r1>) }")) == [("<r2>", "<p1>", "<r1>")]
    engine = Engine(open_store(PATTERN, layout))
    assert rows(engine.sparql('{ ?y <p1> "l1" . ?y <p2> ?x }')) == [("<r1>", '"l2"'), ("<r1>", '"l5"')]
    assert rows(engine.sparql('{ ?y <p1> "l1" . ?y <p2> ?x FILTER(?x = "l5") }')) == [("<r1>", '"l5"')]
    assert engine.sparql("{ { ?y <p1> ?a } { ?y <p2> ?b } }").count() == 8
    assert engine.ask('ASK { <r1> <p1> "l1" }') and not engine.ask('ASK { <r1> <p1> "l9" }')


def test_joins_on_possibly_unbound_variables(open_store, rows):
    engine = Engine(open_store('<a> <p> <x> . <b> <p> <y> . <a> <q> "1" . <c> <r> "1" . <d> <r> "2" .'))
    got = rows(engine.sparql("SELECT ?s ?v ?t { ?s <p> ?o OPTIONAL { ?s <q> ?v } ?t <r> ?v }"))
    assert got == [("<a>", '"1"', "<c>"), ("<b>", '"1"', "<c>"), ("<b>", '"2"', "<d>")]
    got = rows(engine.sparql("SELECT ?s ?v ?t { ?s <p> ?o OPTIONAL { ?s <q> ?v } OPTIONAL { ?t <r> ?v FILTER(?t != <c>) } }"))
    assert got == [("<a>", '"1"', None), ("<b>", '"2"', "<d>")]


EXPRESSIONS = [
    ('?n > 2', {"b", "c"}), ('?n >= 2 && ?n < 10', {"a", "b"}), ('?n = 2 || ?n = 10', {"a", "c"}), ('!(?n > 2)', {"a"}), ("?n * 2 + 1 = 5", {"a"}), ("?n / 0 > 1", set()), ("-?n < -2", {"b", "c"}), ("?n - 1 = 1", {"a"}),
    ('LANG(?l) = "en"', {"a"}), ('LANGMATCHES(LANG(?l), "EN")', {"a", "b"}), ('LANGMATCHES(LANG(?l), "*")', {"a", "b"}), ('DATATYPE(?n) = <http://www.w3.org/2001/XMLSchema#integer>', {"a", "b", "c"}),
    ('DATATYPE(?l) = <http://www.w3.org/2001/XMLSchema#string>', {"c"}), ('REGEX(?l, "^h")', {"a", "b"}), ('REGEX(?l, "^H", "i")', {"a", "b"}), ('REGEX(STR(?s), "a$")', {"a"}), ('STR(?s) = "b"', {"b"}), ('?l = "hi"', {"a", "b"}), ('?l != "hi"', {"c"}),
    ('SAMETERM(?l, "hi"@en)', {"a"}), ("isIRI(?s) && isURI(?s)", {"a", "b", "c"}), ("isBLANK(?s)", set()), ("BOUND(?l) && !BOUND(?zz)", {"a", "b", "c"}), ("?zz = 1", set()), ("?zz = 1 || ?n = 2", {"a"}), ("?l < \"i\"", {"a", "b"}),
    ('?l', {"a", "b", "c"}), ("?n - 2", {"b", "c"}), ("<http://www.w3.org/2001/XMLSchema#integer>(?l) = 1", set()), ("<http://www.w3.org/2001/XMLSchema#string>(?n) = \"2\"", {"a"}), ("?s", set()), ("?n > \"x\"", set()), ("+?n = 2", {"a"}),
]


@pytest.mark.parametrize("layout", ["terms", "ids"])
def test_expressions(open_store, layout):
    engine = Engine(open_store('<a> <n> 2 ; <l> "hi"@en . <b> <n> 7 ; <l> "hi"@en-US . <c> <n> 10 ; <l> "yo" .', layout))
    for text, want in EXPRESSIONS if layout == "terms" else EXPRESSIONS[:6]:
        got = {r.s.strip("<>") for r in engine.sparql(f"SELECT ?s {{ ?s <n> ?n ; <l> ?l FILTER({text}) }}").collect()}
        assert got == want, text


def test_value_equality_is_an_option(open_store):
    store = open_store('<a> <n> 1 . <b> <n> "01"^^<http://www.w3.org/2001/XMLSchema#integer> . <c> <n> 1.0 .')
    assert Engine(store).sparql("{ ?s <n> ?n FILTER(?n = 1) }").count() == 1
    assert Engine(store, EngineConfig(value_equality=True)).sparql("{ ?s <n> ?n FILTER(?n = 1) }").count() == 3


def test_named_graphs_and_datasets(spark, rows):
    df = spark.createDataFrame([("<a>", "<p>", "<b>", None), ("<a>", "<p>", "<c>", "<g1>"), ("<a>", "<p>", "<d>", "<g2>"), ("<a>", "<p>", "<b>", None), (None, "<p>", "<b>", "<g1>")], "s string, p string, o string, g string")
    store = TripleStore.from_rows(df)
    engine = Engine(store)
    assert store.size() == 3 and rows(engine.sparql("{ ?s <p> ?o }")) == [("<a>", "<b>")]
    assert rows(engine.sparql("{ GRAPH ?g { ?s <p> ?o } }")) == [("<g1>", "<a>", "<c>"), ("<g2>", "<a>", "<d>")]
    assert rows(engine.sparql("{ GRAPH <g2> { ?s <p> ?o } }")) == [("<a>", "<d>")]
    assert rows(engine.sparql("SELECT ?o FROM <g1> FROM NAMED <g2> { ?s <p> ?o }")) == [("<c>",)]
    assert rows(engine.sparql("SELECT ?g FROM NAMED <g2> { GRAPH ?g { ?s <p> ?o } }")) == [("<g2>",)]
    assert Engine(TripleStore.from_triples(spark, parse_turtle(JOIN))).sparql("{ GRAPH ?g { ?s ?p ?o } }").count() == 0


def test_modifiers(open_store, rows):
    engine = Engine(open_store(FILTER + " _:b <p1> <a> . <r1> <p1> <z> ."))
    got = [r.o for r in engine.sparql("SELECT ?o { ?s <p1> ?o } ORDER BY ?o").collect()]
    assert got == ["<a>", "<r1>", "<z>", *[f'"l{i}"' for i in range(1, 7)]]
    assert [r.o for r in engine.sparql("SELECT ?o { ?s <p1> ?o } ORDER BY DESC(?o) LIMIT 2 OFFSET 1").collect()] == ['"l5"', '"l4"']
    assert rows(engine.sparql("SELECT DISTINCT ?p { ?s ?p ?o }")) == [("<p1>",)]
    assert rows(engine.sparql("SELECT ?nothing ?p { ?s ?p <a> }")) == [(None, "<p1>")]
    assert rows(engine.sparql("SELECT * { ?X <p1> <a> . ?x <p1> <z> }")) == [("_:b", "<r1>")]
    assert rows(engine.sparql('{ VALUES (?o ?k) { ("l1" 1) ("l2" UNDEF) } ?s <p1> ?o }')) == [('"l1"', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', "<r1>"), ('"l2"', None, "<r1>")]
    assert engine.sparql("{ }").count() == 1 and engine.sparql("{ ?s <p1> ?o FILTER(?s = <nobody>) }").count() == 0


def test_construct_bindings_functions_services(open_store, rows, spark):
    engine = Engine(open_store(JOIN))
    assert rows(engine.sparql("CONSTRUCT { ?y <back> ?x . ?x ?y <bad> } WHERE { ?x <p2> ?y }")) == []
    assert rows(engine.sparql("CONSTRUCT { ?y <back> ?x } WHERE { ?x <p1> ?y }")) == [("<r1>", "<back>", "<r2>"), ("<r2>", "<back>", "<r1>")]
    assert len({r.s for r in engine.sparql("CONSTRUCT { _:n <of> ?x } WHERE { ?x <p1> ?y }").collect()}) == 2
    assert rows(engine.sparql("SELECT ?x ?y { ?x <p2> ?y }", {"x": iri("r1")})) == [(None, '"l1"')]
    assert rows(engine.sparql("{ ?x <p2> ?y }", {"y": lit("l2")})) == [("<r2>",)]
    engine.register_function("up", lambda t: T.make_lit(T.F.upper(T.value_of(t))))
    assert rows(engine.sparql('{ ?x <p2> ?y FILTER(<up>(?y) = "L2") }')) == [("<r2>", '"l2"')]
    engine.add_source("other", TripleStore.from_triples(spark, parse_turtle('<r1> <name> "one" .')))
    assert rows(engine.sparql("SELECT ?x ?n { ?x <p1> ?y SERVICE <other> { ?x <name> ?n } }")) == [("<r1>", '"one"')]
    assert format_rows(engine.sparql('{ ?x <p2> "l1" }')) == ["{ x=<r1> }"]


def test_plan_of_a_statement_star_pushes_its_constants(open_store):
    df = Engine(open_store(JOIN, "files")).sparql("{ ?x <p1> ?y }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(p,<p1>)" in plan and "ReadSchema: struct<s:string,p:string,o:string>" in plan


def test_split_joins_equal_the_plain_condition(spark, rows, monkeypatch):
    """Joins keyed by what is bound give the rows of the condition that compares every pair."""
    from trellis.plans import compile as C

    def plain(self, left, right, loose, same, keys, match, how):
        pairs = [(left.cols[v], right.cols[v]) for v in loose]
        open_ = [(F.col(a.name) == F.col(b.name)) | F.col(a.name).isNull() | F.col(b.name).isNull() for a, b in pairs]
        return C._joined(left.df, right.df, [*keys, *open_, *([match] if match is not None else [])], how)

    store = TripleStore.from_triples(spark, parse_turtle(" ".join(f'<s{i}> <p> <o{i % 3}> . <o{i % 3}> <q> "v{i % 2}" . <t{i}> <r> "v{i % 3}" ; <u> <o{i % 4}> .' for i in range(6))))
    texts = [
        "{ ?s <p> ?o OPTIONAL { ?o <q> ?v FILTER(?s != <s1>) } ?t <r> ?v }",
        "{ ?s <p> ?o OPTIONAL { ?o <q> ?v FILTER(?s != <s1>) } OPTIONAL { ?t <r> ?v . ?t <u> ?o } }",
        '{ ?s <p> ?o OPTIONAL { ?o <q> ?v FILTER(?v = "v1") } OPTIONAL { ?t <r> ?v FILTER(?v != "v2") } }',
        "{ { ?s <p> ?o } UNION { ?t <u> ?x } { ?t <r> ?v } UNION { ?s <p> ?y } }",
        "{ { ?s <p> ?o } UNION { ?t <u> ?x } OPTIONAL { { ?t <r> ?v } UNION { ?s <nothing> ?y } } }",
        "{ ?s <p> ?o OPTIONAL { ?s <nothing> ?n } OPTIONAL { ?n <nothing> ?m } }",
        "{ { { ?s <p> ?o } UNION { ?t <u> ?x } UNION { ?t <r> ?v } } { { ?s <p> ?x } UNION { ?t <r> ?v } UNION { ?t <u> ?o } } }",
        "{ ?s <p> ?o OPTIONAL { ?o <q> ?v } OPTIONAL { ?t <u> ?o } OPTIONAL { ?w <nothing> ?o } OPTIONAL { ?t <r> ?v OPTIONAL { ?w <p> ?o } } }",
    ]
    for text in texts:
        got = []
        for join in (C.Compiler._masked_join, plain):
            monkeypatch.setattr(C.Compiler, "_masked_join", join)
            got.append(rows(Engine(store).sparql(text)))
        assert got[0] == got[1] and got[0], text


def test_unbound_variables_need_no_product_and_few_joins(spark):
    """Two optional variables on both sides, and three, are one equi-join where the patterns share a sure one."""
    store = TripleStore.from_triples(spark, parse_turtle('<a> <p> <b> ; <q> "1" . <b> <q> "2" ; <r> "3" .'))
    side = "{ ?s <p> ?o OPTIONAL { ?s <q> ?x } OPTIONAL { ?s <r> ?y } OPTIONAL { ?s <t> ?z } }"
    for text, most in ((f"{{ {side} {side} }}", 9), (f"{{ {side} OPTIONAL {side} }}", 9)):
        plan = Engine(store).sparql(text)._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and "Join Cross" not in plan
        assert plan.count("Join ") <= most
        assert Engine(store).sparql(text).count() == 1
