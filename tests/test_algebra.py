import pytest

from trellis.functions.terms import iri, lit, var
from trellis.plans.algebra import BGP, Filter, Graph, Group, Service, Triple, call, node
from trellis.plans.parser import ParseError, parse_bgp, parse_pattern, parse_query, parse_turtle

R1, R2, P1, P2, L1, L2 = iri("r1"), iri("r2"), iri("p1"), iri("p2"), lit("l1"), lit("l2")
X, Y, Z = var("x"), var("y"), var("z")
ONE = BGP((Triple(Y, P1, L1), Triple(Y, P2, X)))
ONE_SSE = '(bgp\n    (triple ?y <p1> "l1")\n    (triple ?y <p2> ?x)\n  )\n'


def test_pattern_text():
    assert BGP((Triple(R1, P1, L1),)).sparql() == '{<r1> <p1> "l1"}'
    assert BGP((Triple(R1, P1, L1), Triple(R2, P1, L2))).sparql() == '{\n\t<r1> <p1> "l1" .\n\t<r2> <p1> "l2" .\n}\n'
    assert BGP((Triple(R1, P1, L1), Triple(R2, P1, L2), Triple(R2, P2, L1))).sparql() == '{\n\t<r1> <p1> "l1" .\n\t<r2> <p1> "l2" ;\n\t\t<p2> "l1" .\n}\n'
    assert BGP((Triple(R1, P1, L1), Triple(R1, P1, L2))).sparql() == '{\n\t<r1> <p1> "l1", "l2" .\n}\n'


def test_s_expressions():
    two = parse_bgp('{ <r1> <p1> "l1" . <r2> <p1> "l2" }')
    assert two.sse("\t") == '(bgp\n\t(triple <r1> <p1> "l1")\n\t(triple <r2> <p1> "l2")\n)\n'
    assert two.sse("  ", 2) == '(bgp\n      (triple <r1> <p1> "l1")\n      (triple <r2> <p1> "l2")\n    )\n'
    named = parse_pattern("PREFIX foaf: <http://xmlns.com/foaf/0.1/> { ?p foaf:name ?name }")
    assert named.sse() == "(ggp\n  (bgp\n    (triple ?p <http://xmlns.com/foaf/0.1/name> ?name)\n  )\n)\n"
    assert named.sse("  ", 2) == "(ggp\n      (bgp\n        (triple ?p <http://xmlns.com/foaf/0.1/name> ?name)\n      )\n    )\n"
    assert Graph(Y, ONE).sse() == f"(named-graph ?y\n  {ONE_SSE})\n"
    assert Service(R1, ONE).sse() == f"(service <r1>\n  {ONE_SSE})\n"
    assert Filter(call("str", node(X)), ONE).sse() == f"(filter\n  (sparql:str ?x)\n  {ONE_SSE})\n"
    assert Group((ONE, BGP((Triple(R2, P2, X),)))).sse() == f"(ggp\n  {ONE_SSE}  (bgp\n    (triple <r2> <p2> ?x)\n  )\n)\n"
    assert Triple(R1, P1, L1, R2).sse() == '(quad <r1> <p1> "l1" <r2>)'


def test_variables_and_substitution():
    group = Group((ONE, BGP((Triple(Z, P2, Y),))))
    assert [v.value for v in group.variables()] == ["y", "x", "z"] and BGP((Triple(R1, P1, L1),)).variables() == []
    put = Filter(call("str", node(X)), ONE).substitute({"x": lit("l4")})
    assert put.sse() == '(filter\n  (sparql:str "l4")\n  (bgp\n    (triple ?y <p1> "l1")\n    (triple ?y <p2> "l4")\n  )\n)\n'


def test_operand_numbers():
    for op, n in (("str", 2), ("=", 1), ("regex", 1), ("bound", 0), ("nothing", 1)):
        with pytest.raises(ValueError):
            call(op, *[node(X)] * n)


def test_query_forms():
    q = parse_query('BASE <http://b/> PREFIX : <p#> SELECT DISTINCT ?x $y { ?x :q <rel>, "b"@en, 1, 2.5, -1e3, true ; a :T . _:n :q ?y } ORDER BY DESC(?x) ?y LIMIT 3 OFFSET 1')
    assert (q.form, q.names, q.distinct, q.limit, q.offset, [up for _, up in q.order]) == ("select", ("x", "y"), True, 3, 1, [False, True])
    objects = [t.o.nt for t in parse_bgp('PREFIX : <http://p#> { ?x :q "a", "b", "c" }').triples]
    assert objects == ['"b"', '"c"', '"a"']
    bgp = q.pattern.parts[0]
    assert iri("http://b/rel") in [t.o for t in bgp.triples] and bgp.triples[-1].s.kind == "ndv"
    assert parse_query("ASK { ?x ?p ?y }").form == "ask" and parse_query("{ ?x ?p ?y }").form == "pattern"
    assert parse_query("CONSTRUCT { ?y <p> ?x } WHERE { ?x <q> ?y }").template == (Triple(Y, iri("p"), X),)


def test_long_strings_lists_and_blank_nodes():
    triples = parse_turtle('@prefix : <http://e/> . [] :p """a "quoted"\nline""" . :l :items (1 [ :q "x" ]) . :e :none () .')
    assert any(t.o == lit('a "quoted"\nline') for t in triples) and len(triples) == 8
    assert [t.o for t in triples if t.s == iri("http://e/e")] == [iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#nil")]


@pytest.mark.parametrize("text", ["{ ?x p:q ?y }", "{ ?x <p> }", "SELECT { ?x <p> ?y }", "{ ?x <p> ?y", "{ ?x <p> ?y } nonsense", "{ ?x <p> ^ }", "{ FILTER }"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse_query(text)
