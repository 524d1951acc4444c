"""Plan texts, costs and pattern texts of a small document, against fixed results."""

from __future__ import annotations

from trellis.functions.terms import RDF, iri, lit, var
from trellis.plans import planner as P
from trellis.plans.algebra import BGP, Filter, Graph, Group, Service, Triple, call, node
from trellis.plans.parser import parse_bgp, parse_turtle
from trellis.queries.files import values
from trellis.sources.store import TripleStore

QUERIES: dict = {}
SQL: dict = {}

# A result-set document of 32 triples, whose plans and costs are known.
RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"
_BINDINGS = lambda names: ", ".join(f'[ rs:value "v{n}" ; rs:variable "{n}" ]' for n in names)
DOCUMENT = f"""@prefix rs: <{RS}> . <http://resultset/> a rs:ResultSet ; rs:resultVariable "p", "g", "s", "o" ;
  rs:solution [ rs:binding {_BINDINGS("spgo")} ] ; rs:solution [ rs:binding {_BINDINGS("spog")} ] . <http://resultset2/> a rs:ResultSet ."""
SET = Triple(var("x"), iri(RDF + "type"), iri(RS + "ResultSet"))
VARIABLE = Triple(var("x"), iri(RS + "resultVariable"), var("y"))
BINDING = Triple(var("x"), iri(RS + "binding"), var("z"))
_T = lambda t: "{?x <" + t.p.value + "> " + (t.o.nt) + "}"


def _query(columns: str, rows: list[tuple]):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: spark.createDataFrame(f(spark), columns)
        kinds = {"string": "VARCHAR", "bigint": "BIGINT"}
        SQL[f.__name__] = values(", ".join(f"{n} {kinds[t]}" for n, t in (c.split() for c in columns.split(", "))), rows)
        return f

    return add


def _store(spark) -> TripleStore:
    return TripleStore.from_triples(spark, parse_turtle(DOCUMENT))


@_query("pattern string, n bigint", [("size", 32), ("? binding ?", 8), ("resultset ? ?", 7), ('? ? "s"', 3), ('? variable "s"', 2), ("resultset ? ResultSet", 1), ("resultset resultVariable ?", 4), ('resultset resultVariable "s"', 1), ("resultset resultVariable ResultSet", 0)])
def pattern_counts(spark):
    """Counts of every mask of bound positions."""
    one, x, y, z, r = iri("http://resultset/"), var("x"), var("y"), var("z"), lambda n: iri(RS + n)
    asked = [Triple(x, y, z), Triple(x, r("binding"), z), Triple(one, y, z), Triple(x, y, lit("s")), Triple(x, r("variable"), lit("s")), Triple(one, y, r("ResultSet")), Triple(one, r("resultVariable"), z), Triple(one, r("resultVariable"), lit("s")), Triple(one, r("resultVariable"), r("ResultSet"))]
    names = ["size", "? binding ?", "resultset ? ?", '? ? "s"', '? variable "s"', "resultset ? ResultSet", "resultset resultVariable ?", 'resultset resultVariable "s"', "resultset resultVariable ResultSet"]
    return list(zip(names, _store(spark).counts(asked)))


@_query("plan string, cost bigint, n bigint", [("access", 2, 2), ("access", 4, 2), ("merge", 16, 4), ("merge", 20, 4), ("hash", 18, 8), ("nestedloop", 22, 8)])
def plan_costs(spark):
    """Costs of the access plans of two patterns and of the 24 joins of these, with how many plans have each."""
    planner = P.Planner(_store(spark))
    a, b = planner.access_plans(SET), planner.access_plans(VARIABLE)
    found: dict[tuple[str, int], int] = {}
    for kind, p in [("access", p) for p in a + b] + [(p.algorithm, p) for p in planner.join_plans(a, b)]:
        found[kind, planner.cost(p)] = found.get((kind, planner.cost(p)), 0) + 1
    return [(*k, n) for k, n in found.items()]


_MERGED = f"merge-join(PSO({_T(VARIABLE)}), POS({_T(SET)}))"


@_query("patterns bigint, plan string", [(1, f"POS({_T(SET)})"), (2, _MERGED), (3, f"merge-join({_MERGED}, PSO({_T(BINDING)}))")])
def plan_texts(spark):
    """The cheapest plans of one, two and three patterns."""
    planner = P.Planner(_store(spark))
    return [(n, planner.optimize(BGP((SET, VARIABLE, BINDING)[:n])).text(planner.config)) for n in (1, 2, 3)]


@_query("plan string, place string", [(f"{kind} {k}", f"ASC(?{v})") for kind, k, v in (("access", "PSO", "x"), ("access", "POS", "y"), ("join", "PSO", "x"), ("join", "POS", "y"))])
def plan_orders(spark):
    """The order that an access path gives its rows, and that a join keeps of its left side."""
    planner = P.Planner(_store(spark))
    paths = planner.access_plans(VARIABLE)
    joined = [P.Join("merge", p, planner.access_plans(SET)[0]) for p in paths]
    return [(f"access {p.ordering}", p.order[0]) for p in paths] + [(f"join {p.left.ordering}", p.order[0]) for p in joined]


_N, _P = "({?x <http://e/name> ?n})", f"({{?x <{RDF}type> <http://e/P>}})"


@_query("place bigint, part string", [(0, f"hash-join[A](PSO{_N}, POS{_P})"), (1, f"hash-join[B](PSO{_N}, POS{_P})"), (2, f"hash-join(PSO[A]{_N}, POS[B]{_P})"), (3, f"hash-join(PSO[B]{_N}, POS[A]{_P})")])
def plan_federated(spark):
    """A join over two sources as the union of its branches: joins of one source merged and first, mixed ones after."""
    empty = TripleStore(spark.createDataFrame([], "s string, p string, o string"))
    planner = P.Planner(empty, P.federated_config(["A", "B"]))
    plan = planner.optimize(parse_bgp("{ ?x a <http://e/P> ; <http://e/name> ?n }"))
    return [(i, p.text(planner.config)) for i, p in enumerate(plan.parts)]


@_query("step string, n bigint", [("before", 0), ("moved", 2), ("visited", 3), ("flat", 3), ("first calls", 0)])
def plan_rewrites(spark):
    """Plans visited, rewritten and flattened: numbers of service calls, of nodes and of branches."""
    planner = P.Planner(_store(spark))
    plan, seen = planner.optimize(BGP((SET, VARIABLE))), []
    plan.visit(seen.append)
    moved = plan.rewrite(lambda p: P.replace(p, location=1) if isinstance(p, P.Access) else p)
    flat = P.flatten(P.UnionPlan((P.UnionPlan((moved, plan)), plan)))
    return [("before", plan.service_calls()), ("moved", moved.service_calls()), ("visited", len(seen)), ("flat", len(flat.parts)), ("first calls", flat.parts[0].service_calls())]


_ONE = BGP((Triple(var("y"), iri("p1"), lit("l1")), Triple(var("y"), iri("p2"), var("x"))))
_ONE_SSE = '(bgp\n    (triple ?y <p1> "l1")\n    (triple ?y <p2> ?x)\n  )\n'


@_query("form string, text string", [
    ("bgp", '(bgp\n  (triple <r1> <p1> "l1")\n)\n'), ("group", f"(ggp\n  {_ONE_SSE})\n"), ("graph", f"(named-graph ?g\n  {_ONE_SSE})\n"), ("service", f"(service <r1>\n  {_ONE_SSE})\n"),
    ("filter", f"(filter\n  (sparql:str ?x)\n  {_ONE_SSE})\n"), ("substituted", '(filter\n  (sparql:str "l4")\n  (bgp\n    (triple ?y <p1> "l1")\n    (triple ?y <p2> "l4")\n  )\n)\n'),
    ("sparql", '{\n\t?y <p1> "l1" ;\n\t\t<p2> ?x .\n}\n'), ("variables", "y x z"), ("quad", '(quad <r1> <p1> "l1" <g>)'),
])
def pattern_texts(spark):
    """Patterns as s-expressions and as SPARQL, their variables, and a variable replaced."""
    f = Filter(call("str", node(var("x"))), _ONE)
    return [
        ("bgp", BGP((Triple(iri("r1"), iri("p1"), lit("l1")),)).sse()), ("group", Group((_ONE,)).sse()), ("graph", Graph(var("g"), _ONE).sse()), ("service", Service(iri("r1"), _ONE).sse()),
        ("filter", f.sse()), ("substituted", f.substitute({"x": lit("l4")}).sse()), ("sparql", _ONE.sparql()),
        ("variables", " ".join(v.value for v in Group((_ONE, BGP((Triple(var("z"), iri("p2"), var("y")),)))).variables())), ("quad", Triple(iri("r1"), iri("p1"), lit("l1"), iri("g")).sse()),
    ]
