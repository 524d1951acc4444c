import pytest
from fixtures import JOIN, RESULT_SET, RS, SECOND_SET, TYPE

from trellis.engine import Engine
from trellis.functions.terms import iri, var
from trellis.plans import planner as P
from trellis.plans.algebra import BGP, Triple
from trellis.plans.parser import parse_bgp, parse_turtle
from trellis.sources.store import TripleStore

IS_SET = f"{{?x <{TYPE}> <{RS}ResultSet>}}"
HAS_VARIABLE = f"{{?x <{RS}resultVariable> ?y}}"
T1 = Triple(var("x"), iri(TYPE), iri(RS + "ResultSet"))
T2 = Triple(var("x"), iri(RS + "resultVariable"), var("y"))


@pytest.fixture(scope="module")
def store(spark):
    return TripleStore.from_triples(spark, parse_turtle(RESULT_SET + SECOND_SET, "http://example.org/"))


@pytest.fixture(scope="module")
def planner(store):
    return P.Planner(store)


def test_counts_of_patterns(spark):
    store = TripleStore.from_triples(spark, parse_turtle(RESULT_SET, "http://example.org/"))
    q = lambda s, p, o: Triple(*[parse_bgp(f"{{ {s} {p} {o} }}").triples[0].terms][0])
    cases = [
        ("?a", "?b", "?c", 31), ("?a", f"<{RS}binding>", "?c", 8), ("<http://resultset/>", "?b", "?c", 7), ("?a", "?b", '"s"', 3),
        ("?a", f"<{RS}variable>", '"s"', 2), ("<http://resultset/>", "?b", f"<{RS}ResultSet>", 1), ("<http://resultset/>", f"<{RS}resultVariable>", "?c", 4),
        ("<http://resultset/>", f"<{RS}resultVariable>", '"s"', 1), ("<http://resultset/>", f"<{RS}resultVariable>", f"<{RS}ResultSet>", 0),
    ]
    assert store.size() == 31
    assert store.counts([q(*c[:3]) for c in cases]) == [c[3] for c in cases]


def test_access_plans(planner):
    plans = planner.access_plans(Triple(var("a"), iri(TYPE), var("b")))
    assert {p.ordering for p in plans} == {"PSO", "POS"} and {p.order[0] for p in plans} == {"ASC(?a)", "ASC(?b)"}
    plans = planner.access_plans(T1)
    assert {p.ordering for p in plans} == {"POS", "OPS"} and all(p.order == ("ASC(?x)",) for p in plans)
    assert len(planner.access_plans(Triple(var("x"), var("y"), var("z")))) == 6
    assert [p.ordering for p in planner.access_plans(Triple(var("x"), var("y"), var("x")))] == ["SOP", "OSP"]


def test_join_plans_and_costs(planner):
    joins = planner.join_plans(planner.access_plans(T1), planner.access_plans(T2))
    assert len(joins) == 24
    assert len(planner.join_plans(planner.access_plans(T1), planner.access_plans(T2), outer=True)) == 12
    assert [planner.cost(P.Access(t, "POS")) for t in (T1, T2)] == [2, 4]
    assert {planner.cost(p) for p in joins if p.algorithm == "merge"} == {16, 20}
    assert {planner.cost(p) for p in joins if p.algorithm == "hash"} == {18}
    assert {planner.cost(p) for p in joins if p.algorithm == "nestedloop"} == {22}


def test_pruning_and_two_patterns(planner):
    assert len(planner.prune(planner.access_plans(T1))) == 1
    best = planner.prune(planner.join_plans(planner.access_plans(T1), planner.access_plans(T2)))
    want = f"merge-join(PSO({HAS_VARIABLE}), POS({IS_SET}))"
    assert [p.text(planner.config) for p in best] == [want]
    assert planner.optimize(parse_bgp(f"{{ ?x a <{RS}ResultSet> ; <{RS}resultVariable> ?y }}")).text(planner.config) == want


def test_three_and_eight_patterns(planner):
    bgp = parse_bgp(f"{{ ?x <{RS}binding> ?y ; <{RS}resultVariable> ?z ; a <{RS}ResultSet> }}")
    inner = f"merge-join(PSO({{?x <{RS}resultVariable> ?z}}), POS({IS_SET}))"
    assert planner.optimize(bgp).text(planner.config) == f"merge-join({inner}, PSO({{?x <{RS}binding> ?y}}))"
    bgp = parse_bgp(f"""PREFIX : <{RS}> {{ ?x1 a :ResultSet ; :solution ?s1 . ?s1 :binding ?b1 . ?b1 :value ?value1 ; :variable ?variable1 .
      ?x2 a :ResultSet ; :solution ?s2 . ?s2 :binding ?b2 . }}""")
    assert planner.optimize(bgp).text(planner.config).startswith(
        f"hash-join(hash-join(hash-join(merge-join(PSO({{?x2 <{RS}solution> ?s2}}), POS({{?x2 <{TYPE}> <{RS}ResultSet>}})), PSO({{?s2 <{RS}binding> ?b2}}"
    )


def test_plans_run_and_agree(store, spark, rows):
    engine = Engine(store)
    bgp = parse_bgp(f"{{ ?x a <{RS}ResultSet> ; <{RS}resultVariable> ?y }}")
    plan = P.Planner(store).optimize(bgp)
    assert engine.run_plan(plan).count() == engine.run_plan(plan, forced=True).count() == 4
    text = f"PREFIX : <{RS}> SELECT ?s ?b ?v {{ ?s :binding ?b . ?x :solution ?s . ?b :variable ?v . ?x a :ResultSet }}"
    results = []
    for order in ("connected", "greedy", "dp"):
        engine.config.order = order
        results.append(rows(engine.sparql(text)))
    assert results[0] == results[1] == results[2] and len(results[0]) == 8


def test_joins_of_plans_without_shared_variables(spark):
    store = TripleStore.from_triples(spark, parse_turtle(JOIN))
    planner = P.Planner(store)
    plan = planner.optimize(BGP((Triple(var("a"), iri("p1"), var("b")), Triple(var("c"), iri("p2"), var("d")))))
    assert Engine(store).run_plan(plan, forced=True).count() == 4
    assert planner.is_trivial((Triple(var("a"), iri("p1"), var("b")), Triple(var("c"), iri("p2"), var("d"))))


def test_federated_texts(spark):
    empty = TripleStore(spark.createDataFrame([], "s string, p string, o string"))
    planner = P.Planner(empty, P.federated_config(["http://A/sparql", "http://B/sparql"]))
    person, name = "http://xmlns.com/foaf/0.1/Person", "http://xmlns.com/foaf/0.1/name"
    t1, t2 = Triple(var("x"), iri(TYPE), iri(person)), Triple(var("x"), iri(name), var("y"))
    at = lambda t: [P.replace(p, location=1) for p in planner.local_access_plans(t)]
    a, b = f"{{?x <{TYPE}> <{person}>}}", f"{{?x <{name}> ?y}}"
    assert planner.local_join_plans(at(t1), at(t2))[0].text(planner.config) == f"nestedloop-join(POS[http://A/sparql]({a}), POS[http://A/sparql]({b}))"
    assert planner.join_plans(at(t1), at(t2))[0].text(planner.config) == f"nestedloop-join[http://A/sparql](POS({a}), POS({b}))"
    plan = planner.optimize(parse_bgp("PREFIX foaf: <http://xmlns.com/foaf/0.1/> { ?x a foaf:Person ; foaf:name ?name . }"))
    n, p = f"({{?x <{name}> ?name}})", f"({a})"
    merged = [f"hash-join[http://{k}/sparql](PSO{n}, POS{p})" for k in "AB"]
    mixed = [f"hash-join(PSO[http://{i}/sparql]{n}, POS[http://{k}/sparql]{p})" for i, k in ("AB", "BA")]
    assert plan.text(planner.config) == f"union({', '.join(merged + mixed)})"


def test_federated_result_equals_that_over_all_data(spark, rows):
    triples = parse_turtle(" ".join(f"<p{i}> a <P> ; <n> <n{i}> ." for i in range(6)))
    whole = TripleStore.from_triples(spark, triples)
    parts = [TripleStore.from_triples(spark, triples[k::2]) for k in range(2)]
    engine = Engine(whole).add_source("A", parts[0]).add_source("B", parts[1])
    bgp = parse_bgp("{ ?x a <P> ; <n> ?n }")
    got = engine.run_plan(engine.federated(bgp))
    want = Engine(whole).sparql("{ ?x a <P> ; <n> ?n }")
    assert rows(got.select("x", "n")) == rows(want.select("x", "n")) and got.count() == 6


def test_hooks_and_tree_walks(store, planner):
    plan = planner.optimize(parse_bgp(f"{{ ?x a <{RS}ResultSet> ; <{RS}resultVariable> ?y ; <{RS}solution> ?s }}"))
    before, after = [], []
    plan.visit(lambda p: before.append(type(p).__name__))
    plan.visit(lambda p: after.append(type(p).__name__), postfix=True)
    assert before[0] == after[-1] == "Join" and sorted(before) == sorted(after) and len(before) == 5
    moved = plan.rewrite(lambda p: P.replace(p, location=1) if isinstance(p, P.Access) else p)
    assert moved.service_calls() == 3 and plan.service_calls() == 0 and P.flatten(P.UnionPlan((P.UnionPlan((moved, plan)), plan))).parts == (plan, plan, moved)
    seen = []

    def executor(compiler, bgp, source):
        seen.append(len(bgp.triples))
        return P.execute(P.Planner(source).optimize(bgp), compiler, [source])

    engine = Engine(store)
    engine.config.bgp_executor = executor
    assert engine.sparql(f"{{ ?x a <{RS}ResultSet> ; <{RS}resultVariable> ?y }}").count() == 4 and seen == [2]
    few = P.Config(access_plans=lambda pl, t: pl.local_access_plans(t)[:1], join_plans=lambda pl, a, b, outer: [P.Join("hash", a[0], b[0])])
    assert P.Planner(store, few).optimize(BGP((T1, T2))).text(few).startswith("hash-join(")
    assert engine.create_view("sets", f"{{ ?x a <{RS}ResultSet> }}").sparkSession.sql("SELECT * FROM sets").count() == 2


def test_many_patterns_are_planned_without_the_exact_search(spark):
    store = TripleStore.from_triples(spark, parse_turtle(" ".join(f"<a{i}> <p{i}> <a{i + 1}> ." for i in range(14))))
    bgp = BGP(tuple(Triple(var(f"v{i}"), iri(f"p{i}"), var(f"v{i + 1}")) for i in range(14)))
    planner = P.Planner(store)
    assert sorted(t.p.value for t in planner.order(bgp)) == sorted(f"p{i}" for i in range(14))
    text = planner.optimize(bgp).text(planner.config)
    assert text.count("-join(") == 13 and "p13" in text
    engine = Engine(store).add_source("A", store)
    assert engine.federated(bgp).text(engine.config.planner).count("[A]") >= 1
