"""Round trips over generated terms, patterns and graphs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.engine import Engine
from trellis.functions.terms import Term, parse_term
from trellis.plans.algebra import BGP, Triple
from trellis.plans.parser import parse_bgp, parse_turtle
from trellis.sources.store import TripleStore

NAMES = st.text("abcXYZ019", min_size=1, max_size=6)
IRIS = NAMES.map(lambda x: Term("iri", f"http://e/{x}"))
TEXTS = st.text(st.characters(exclude_categories=["Cs"]), max_size=12)
LITERALS = st.builds(lambda v, k: Term("lit", v, "en-GB" if k == 1 else None, "http://e/dt" if k == 2 else None), TEXTS, st.integers(0, 2))
VARIABLES = NAMES.map(lambda x: Term("var", x))


@given(st.one_of(IRIS, LITERALS, NAMES.map(lambda x: Term("bnode", x))))
def test_terms_survive_their_text(term):
    assert parse_term(term.nt) == term


@given(st.lists(st.builds(Triple, st.one_of(IRIS, VARIABLES), st.one_of(IRIS, VARIABLES), st.one_of(IRIS, VARIABLES, LITERALS)), min_size=1, max_size=6))
@settings(deadline=None)
def test_patterns_survive_their_text(triples):
    again = parse_bgp(BGP(tuple(triples)).sparql())
    assert sorted(again.triples, key=repr) == sorted(triples, key=repr)


@given(st.lists(st.builds(Triple, IRIS, IRIS, st.one_of(IRIS, LITERALS)), max_size=8))
@settings(deadline=None)
def test_documents_survive_their_text(triples):
    text = " ".join(f"{t.s} {t.p} {t.o} ." for t in triples)
    assert parse_turtle(text) == triples


def _solutions(triples, data):
    """All bindings of a basic graph pattern, by trying every combination."""
    out = [{}]
    for t in triples:
        new = []
        for b in out:
            for row in data:
                c = dict(b)
                if all((c.setdefault(x, y) == y) if x.is_var else x.nt == y for x, y in zip(t.terms, row)):
                    new.append(c)
        out = new
    return out


def test_random_patterns_over_random_graphs(spark):
    rnd = random.Random(11)
    nodes = [Term("iri", x) for x in "abcd"]
    data = sorted({(rnd.choice(nodes).nt, rnd.choice(nodes[:2]).nt, rnd.choice(nodes).nt) for _ in range(14)})
    store = TripleStore(spark.createDataFrame(data, "s string, p string, o string"))
    names = [Term("var", x) for x in "xyz"]
    for k in range(12):
        pick = lambda: rnd.choice(names if rnd.random() < 0.7 else nodes)
        triples = [Triple(pick(), rnd.choice([*nodes[:2], *names]), pick()) for _ in range(rnd.randrange(1, 4))]
        engine = Engine(store)
        engine.config.order = ("connected", "greedy", "dp")[k % 3]
        df = engine.run(BGP(tuple(triples)))
        variables = [v for v in BGP(tuple(triples)).variables()]
        got = sorted(tuple(r[v.value] for v in variables) for r in df.collect())
        assert got == sorted(tuple(b[v] for v in variables) for b in _solutions(triples, data)), triples
