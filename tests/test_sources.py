from fixtures import JOIN, RESULT_SET
from pyspark.sql import functions as F

from trellis import cli
from trellis.engine import Engine
from trellis.functions.terms import iri, lit, var
from trellis.operators import bindings as B
from trellis.operators import dictionary as D
from trellis.plans.algebra import Triple
from trellis.plans.parser import parse_turtle
from trellis.sources import rdf
from trellis.sources.store import IdStore, TripleStore
from trellis.sources.tables import MappedStore, Mapping

SPO = "s string, p string, o string"


def test_set_semantics_of_updates(spark, rows):
    one = spark.createDataFrame([("<s>", "<p>", '"l"')], SPO)
    two = spark.createDataFrame([("<s>", "<p>", '"l"'), ("<s>", "<p>", '"l2"'), (None, "<p>", '"x"')], SPO)
    store = TripleStore.from_rows(one.where("false"))
    assert store.size() == 0
    store = store.add(one)
    assert store.size() == 1 and store.add(one).size() == 1
    store = store.add(two)
    assert store.size() == 2 and rows(store.contained(one)) == rows(one)
    store = store.remove(one)
    assert rows(store.df) == [("<s>", "<p>", '"l2"')] and store.remove(two).size() == 0
    assert store.contains(iri("s"), iri("p"), lit("l2")) and not store.contains(iri("s"), iri("p"), lit("l"))


def test_quads_of_the_default_graph_can_be_removed(spark):
    df = spark.createDataFrame([("<s>", "<p>", "<o>", None), ("<s>", "<p>", "<o>", "<g>")], SPO + ", g string")
    store = TripleStore.from_rows(df)
    assert store.size() == 2 and store.remove(df.where("g IS NULL")).size() == 1


def test_scans_counts_and_statistics(spark, rows):
    triples = parse_turtle('<s> <p> "l", "l2", "l3" ; <p2> "l", "l3" . <s2> <p> "l3", "l2" . <x> <x> <x> .')
    store = TripleStore.from_triples(spark, triples)
    assert rows(store.match(var("x"), iri("p2"), var("y"))) == [("<s>", '"l"'), ("<s>", '"l3"')]
    assert store.match(var("x"), iri("p"), var("y")).count() == 5 and store.match(var("a"), var("b"), var("c")).count() == 8
    assert rows(store.match(var("a"), var("a"), var("a"))) == [("<x>",)] and store.match(var("x"), iri("none"), var("y")).columns == ["x", "y"]
    assert store.count(var("a"), var("b"), var("a")) == 1 and store.count(var("q"), iri("p"), lit("l3")) == 2
    stats = {(r.mask, r.s, r.p, r.o): r.n for r in store.statistics().collect()}
    assert stats["p", None, "<p>", None] == 5 and stats["so", "<s>", None, '"l3"'] == 2 and stats["sp", "<s2>", "<p>", None] == 2 and stats["o", None, None, '"l2"'] == 2
    assert len({k[0] for k in stats}) == 6


def test_written_stores(spark, tmp_path, rows):
    quads = spark.createDataFrame([("<a>", "<http://e/p>", '"x=/ %y"', None), ("<a>", "<q>", "<b>", "<g>")], SPO + ", g string")
    store = TripleStore.from_rows(quads, orderings=["spo", "pos"])
    store.write(str(tmp_path / "s"))
    again = TripleStore.read(spark, str(tmp_path / "s"))
    assert rows(again.df.select("s", "p", "o", "g")) == rows(quads) and again.orderings(Triple(var("x"), iri("q"), var("y"))) == ["POS"]
    assert rows(Engine(again).sparql("{ GRAPH ?g { ?s <q> ?o } }")) == [("<g>", "<a>", "<b>")]


def test_turtle_and_xml_files(spark, tmp_path, rows):
    (tmp_path / "a.ttl").write_text("@prefix : <http://e/> . :a :p [ :q 1 ] .")
    (tmp_path / "b.rdf").write_text("""<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://base/">
      <e:T rdf:about="a" e:name="n"><e:p xml:lang="de">x</e:p><e:q rdf:resource="#r"/><e:r rdf:parseType="Resource"><e:s rdf:datatype="http://d">5</e:s></e:r>
      <e:l rdf:parseType="Collection"><rdf:Description rdf:nodeID="k"/></e:l><e:m rdf:parseType="Literal"><b>y</b></e:m></e:T>
      <rdf:Seq rdf:ID="s"><rdf:li>1</rdf:li><rdf:li>2</rdf:li></rdf:Seq></rdf:RDF>""")
    store = rdf.load_files(spark, str(tmp_path))
    e = Engine(store)
    assert rows(e.sparql("PREFIX : <http://e/> { :a :p ?b . ?b :q ?n }"))[0][1] == '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'
    got = {(r.p, r.o) for r in store.df.where("s = '<http://base/a>'").collect() if not r.o.startswith("_:")}
    assert got == {("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://e/T>"), ("<http://e/name>", '"n"'), ("<http://e/p>", '"x"@de'), ("<http://e/q>", "<http://base/#r>"), ("<http://e/m>", '"<b>y</b>"^^<http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral>')}
    assert store.df.where("p LIKE '%#_2>'").count() == 1
    assert len({r.s for r in store.df.where("s LIKE '\\\\_:%'").select("s").distinct().collect()}) == 3
    rdf.write_turtle(store.df, str(tmp_path / "out"))
    assert rdf.load_files(spark, str(tmp_path / "out"), "turtle").size() == store.size()


def test_syntax_is_guessed(spark):
    assert rdf.guess_syntax('<?xml version="1.0"?>') == "rdfxml" and rdf.guess_syntax("@prefix : <x> .") == "turtle"
    assert rdf.guess_syntax('<a> <b> "c" .\n<a> <b> "d" .\n') == "ntriples" and rdf.guess_syntax("<a> <b> 1 ; <c> 2 .") == "turtle"
    assert rdf.load_string(spark, RESULT_SET, "http://example.org/").size() == 31


def test_dictionary(spark, rows):
    store = TripleStore.from_triples(spark, parse_turtle('_:z <p> "b"@en . <a> <p> "b" . <a> <p> "a" .'))
    terms = D.build_dictionary(store.df, ["s", "p", "o"])
    assert [(r.id, r.nt) for r in terms.orderBy("id").collect()] == [(1, "_:z"), (2, "<a>"), (3, "<p>"), (4, '"a"'), (5, '"b"'), (6, '"b"@en')]
    ids = IdStore.encode(store, terms)
    assert rows(ids.store().df) == rows(store.df)
    more = D.extend_dictionary(terms, spark.createDataFrame([("<a>", "<new>", None)], SPO), ["s", "p", "o"])
    assert rows(more.where("id > 6").select("id", "nt")) == [(7, "<new>")]
    assert D.remove_terms(more, more.where("id = 7")).count() == 6
    asked = spark.createDataFrame([("<p>",), ("<unknown>",), (None,)], "t string")
    assert rows(D.lookup(asked, "t", terms)) == [("<p>", 3), ("<unknown>", None), (None, None)]
    assert D.build_dictionary(store.df.where("false"), ["s", "p", "o"]).count() == 0


def test_numbering_is_dense_over_partitions(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"))
    got = [r.id - r.v for r in D.number_in_order(df, [F.col("v")]).collect()]
    assert len(got) == 5000 and set(got) == {1}


def test_mapped_tables(spark, rows):
    a = spark.createDataFrame([(1, "x\"y", 2.5, None, "de"), (2, "z", None, 1, "en"), (None, "lost", 1.0, 1, "en")], "k bigint, name string, num double, up bigint, lang string")
    maps = [Mapping("t", ("k",), {"up": "t"}, {"name": "lang"})]
    store = MappedStore(spark, {"t": a}, maps)
    flat = Engine(TripleStore.from_rows(store.df))
    mapped = Engine(store)
    base = "http://ex.org/"
    for text in (
        "{ ?s ?p ?o }", f"{{ ?s <{base}t#name> ?n ; <{base}t#num> ?x }}", f"{{ ?s a <{base}t> ; <{base}t#up> ?u }}", f"{{ ?s <{base}t#ref-up> ?t . ?t <{base}t#name> ?n }}",
        f'{{ ?s <{base}t#name> "z"@en ; ?p ?o }}', f"{{ <{base}t/2> <{base}t#ref-up> ?x }}", f"{{ <{base}t/02> <{base}t#ref-up> ?x }}", f"{{ ?s <{base}t#k> 2 }}", f"{{ ?s <{base}t#k> \"02\"^^<http://www.w3.org/2001/XMLSchema#integer> }}",
        f"{{ ?s <{base}t#num> ?x FILTER(?x > 2) }}", f"{{ ?s <{base}t#k> ?x ; <{base}t#up> ?x }}", f"{{ ?s <{base}nothing> ?x }}", f"{{ ?x a ?c . ?x <{base}t#k> ?k }}", f"{{ ?s <{base}t#name> ?n FILTER(?n = \"z\") }}",
    ):
        assert rows(mapped.sparql(text)) == rows(flat.sparql(text)), text
    patterns = [Triple(var("s"), iri(base + "t#name"), var("n")), Triple(var("s"), iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), var("n"))]
    assert store.counts(patterns) == [2, 2]
    assert mapped.sparql("{ ?s ?p ?o }").where("s IS NULL OR o IS NULL").count() == 0


def test_binding_operators(spark, rows):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "k string, v string")
    b = spark.createDataFrame([("x", "p"), ("y", "q")], "v string, w string")
    assert rows(B.natural_join(a, b)) == [("1", "x", "p")]
    assert rows(B.natural_join(a, b, may_be_unbound=["v"])) == [("1", "x", "p"), ("2", "x", "p"), ("2", "y", "q")]
    assert rows(B.left_join(a, b)) == [("1", "x", "p"), ("2", None, None), ("3", "z", None)]
    assert B.natural_join(a, b.select("w")).count() == 6 and B.left_join(a, b.select("w").where("false")).count() == 3
    assert B.union_bindings(a, b).columns == ["k", "v", "w"] and B.union_bindings(a, b).count() == 5
    assert rows(B.project(a, ["v", "zz"]).where("v IS NOT NULL")) == [("x", None), ("z", None)]
    assert rows(B.reduce_by(a, b)) == [("1", "x")] and B.materialize(a).count() == 3 and B.spread(a, ["k"], 3).rdd.getNumPartitions() == 3
    assert [r.v for r in B.sort_bindings(spark.createDataFrame([('"b"',), ("<c>",), ("_:d",), (None,)], "v string"), "v").collect()] == [None, "_:d", "<c>", '"b"']


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.ttl").write_text(JOIN.replace("<", "<http://e/"))
    at = str(tmp_path / "store")
    assert cli.main(["load", at, str(tmp_path / "x.ttl")], spark) == 0
    assert "4 triples" in capsys.readouterr().out
    for args, want in ((["count", at], "4"), (["query", at, "{ ?x <http://e/p2> ?y }"], '"l1"'), (["explain", at, "{ ?x <http://e/p1> ?y . ?y <http://e/p2> ?z }"], "-join("), (["dump", at], "<http://e/r1>"), (["stats", at], "sp"), (["terms", at], "lit")):
        cli.main(args, spark)
        assert want in capsys.readouterr().out
    (tmp_path / "q.rq").write_text("{ ?x <http://e/p2> ?y }")
    cli.main(["query", at, f"@{tmp_path / 'q.rq'}", "--out", str(tmp_path / "rows")], spark)
    assert {r.value for r in spark.read.text(str(tmp_path / "rows")).collect()} == {'{ x=<http://e/r1>, y="l1" }', '{ x=<http://e/r2>, y="l2" }'}


def test_scans_through_a_permutation_and_shared_dictionaries(spark, tmp_path, rows):
    store = TripleStore.from_triples(spark, parse_turtle('<s> <p> "l3", "l", "l2" . <s2> <p> "l3", "l2" .'))
    scan = (var("x"), iri("p"), var("y"))
    assert [r.y for r in store.match_by(*scan, "POS").collect()] == ['"l"', '"l2"', '"l2"', '"l3"', '"l3"']
    assert [r.x for r in store.match_by(*scan, "PSO").collect()] == ["<s>"] * 3 + ["<s2>"] * 2
    try:
        store.match_by(*scan, "SPO")
    except ValueError:
        pass
    else:
        raise AssertionError("an ordering that cannot answer the pattern was taken")
    ids = IdStore.encode(store)
    ids.write(str(tmp_path / "ids"))
    again = IdStore.read(spark, str(tmp_path / "ids"))
    assert rows(again.match(*scan)) == rows(store.match(*scan)) and again.count(var("x"), iri("none"), var("y")) == 0
    other = IdStore.encode(TripleStore.from_triples(spark, parse_turtle('<s> <p> "l" .')), again.terms)
    assert rows(other.store().df) == [("<s>", "<p>", '"l"')]


def test_global_ids(spark):
    df = spark.createDataFrame([(i,) for i in (1, 16, 31, 400_000)], "id long")
    got = df.select("id", D.global_id(F.col("id"), 16).alias("g")).select("id", "g", D.local_id(F.col("g")).alias("l"), D.owner(F.col("g")).alias("r")).collect()
    assert all(r.l == r.id and r.r == r.id % 16 and r.g == (r.id % 16) << 48 | r.id for r in got)


def test_layouts_and_statistics_that_are_stored(spark, rows, tmp_path):
    text = " ".join(f"<s{i % 40}> <p{i % 7}> <o{i % 11}> ." for i in range(400)) + f" <{'x' * 400}> <{'long' * 100}> <o1> ."
    plain = TripleStore.from_rows(spark.createDataFrame([tuple(t.split()[:3]) for t in text.split(" . ")], "s string, p string, o string"))
    plain.write(str(tmp_path / "s"))
    stored = TripleStore.read(spark, str(tmp_path / "s"))
    assert set(stored.layouts) == {"SPO", "POS", "OSP"} and rows(stored.df.select("s", "p", "o")) == rows(plain.df)
    x, y, z = var("x"), var("y"), var("z")
    s, p, o = iri("s3"), iri("p3"), iri("o3")
    patterns = [Triple(*t) for t in ((x, y, z), (s, y, z), (x, p, z), (x, y, o), (s, p, z), (s, y, o), (x, p, o), (s, p, o), (x, y, x), (x, iri("none"), z), (x, iri("long" * 100), y))]
    assert [stored.layout(t) for t in patterns[:8]] == ["SPO", "SPO", "POS", "OSP", "SPO", "OSP", "POS", "SPO"]
    assert stored.counts(patterns) == plain.counts(patterns)
    for t in patterns:
        assert rows(stored.match(t.s, t.p, t.o)) == rows(plain.match(t.s, t.p, t.o))
        assert stored.contains(t.s, t.p, t.o) == plain.contains(t.s, t.p, t.o)
    assert [r.x for r in stored.match_by(x, p, o, "POS").collect()] == [r.x for r in plain.match_by(x, p, o, "POS").collect()]
    plan = stored.match(x, p, z)._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan and "EqualTo(p,<p3>)" in plan
    TripleStore.from_rows(plain.df, orderings=["ops"]).write(str(tmp_path / "one"), statistics=False)
    one = TripleStore.read(spark, str(tmp_path / "one"))
    assert list(one.layouts) == ["OPS"] and one.counts(patterns) == plain.counts(patterns)


def test_dictionary_joins_spread_hot_terms(spark, rows, monkeypatch):
    """A dictionary that is not broadcast gives the same ids, with a term that holds most rows."""
    data = [("<hub>" if i % 3 else f"<s{i}>", "<p>", None if i % 50 == 0 else f'"{i % 90}"', i) for i in range(900)]
    df = spark.createDataFrame(data, "s string, p string, o string, note int")
    terms = D.build_dictionary(df, ["s", "p", "o"])
    extra = df.unionByName(spark.createDataFrame([("<unknown>", "<p>", '"1"', -1)], df.schema))
    small = D.encode_columns(extra, ["s", "p", "o"], terms)
    seen, decoded = rows(D.lookup(extra, "s", terms)), rows(D.decode_columns(small, ["s", "p", "o"], terms))
    monkeypatch.setattr(D, "broadcast_if_small", lambda df, rows=0: df)
    big = D.encode_columns(extra, ["s", "p", "o"], terms)
    assert rows(big) == rows(small) and big.count() == sum(r[2] is not None for r in data) and big.columns == df.columns
    assert rows(D.lookup(extra, "s", terms)) == seen and rows(D.decode_columns(big, ["s", "p", "o"], terms)) == decoded
    assert {r.s for r in D.decode_columns(big.select(F.lit(10**9).alias("s")), ["s"], terms).collect()} == {None}
