"""Queries over whole tables: rows that a selection in the query would lose."""

from trellis.functions.terms import lit, parse_term
from trellis.queries import QUERIES
from trellis.sources.tables import MappedStore

NATION = "<http://ex.org/nation/{}>"


def _trade_tables(spark, folder, pairs):
    """Tables in which the nations of `pairs` trade: one order, line, customer and supplier a pair."""
    ids = list(enumerate(pairs))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write([(i, i) for i, _ in ids], "l_orderkey long, l_suppkey long", "lineitem")
    write([(i, i) for i, _ in ids], "o_orderkey long, o_custkey long", "orders")
    write([(i, a) for i, (a, _) in ids], "c_custkey long, c_nationkey int", "customer")
    write([(i, b) for i, (_, b) in ids], "s_suppkey long, s_nationkey int", "supplier")


def test_triangles_and_loops_follow_from_every_edge(spark, rows, tmp_path):
    _trade_tables(spark, tmp_path, [(3, 3), (1, 2), (2, 4), (4, 1), (4, 2)])
    ring = [NATION.format(n) for n in (1, 2, 4)]
    loop = (NATION.format(3),) * 3
    got = {tuple(r[c] for c in "pqr") for r in QUERIES["bgp_triangle"](spark, str(tmp_path)).collect()}
    assert got == {loop, *(tuple(ring[k:] + ring[:k]) for k in range(3))}
    assert [r.x for r in QUERIES["scan_repeated_var"](spark, str(tmp_path)).collect()] == [NATION.format(3)]


def test_accessors_read_escaped_terms_too(spark, tmp_path):
    texts = ["plain", "a\\tb\nc\r\n", 'q"\\', "é\\u0041"]
    terms = [lit(texts[0]), lit(texts[1], lang="de"), lit(texts[2], dt="http://e/t"), lit(texts[3])]
    spark.createDataFrame([(i, t.nt) for i, t in enumerate(terms)], "id long, nt string").write.parquet(f"{tmp_path}/terms.parquet")
    got = sorted(tuple(r[c] for c in ("id", "rank", "kind", "value", "lang", "dt")) for r in QUERIES["term_accessors"](spark, str(tmp_path)).collect())
    assert got == [(i, 2, "lit", t.value, t.lang, t.dt) for i, t in enumerate(terms)]


def test_the_engine_orders_every_row(spark, tmp_path):
    objects = ['"x"', "<http://e/b>", "_:n", '"a"@en', "<http://e/a>", '"a"']
    data = [(f"<http://e/s{k // 6:03}>", "<http://data.example/schema/cites>", objects[k % 6], None) for k in range(1200)]
    spark.createDataFrame(data, "s string, p string, o string, g string").repartition(5).write.parquet(f"{tmp_path}/quads.parquet")
    key = lambda t: (*parse_term(t).order_key, t)
    want = sorted(((s, o) for s, _, o, _ in data), key=lambda r: (key(r[1]), key(r[0])))
    assert [(r.x, r.y) for r in QUERIES["order_by_terms"](spark, str(tmp_path)).collect()] == want


def test_every_cell_of_a_document_is_a_triple(spark, tmp_path):
    data = [(1, "a", "en", 'b\n"', "de"), (2, "c", None, "d", None), (3, "e", "en", None, "de")]
    spark.createDataFrame(data, "doc_id long, text string, lang string, tgt_text string, tgt_lang string").write.parquet(f"{tmp_path}/documents.parquet")
    store = MappedStore.open(spark, str(tmp_path), ["documents"])
    got = {r.o for r in store.df.collect() if r.p == "<http://ex.org/documents#tgt_text>"}
    assert got == {'"b\\n\\""@de', '"d"'}
    assert store.size() == sum(v is not None for r in data for v in r) + len(data)
    assert {(r.text, r.target) for r in QUERIES["bgp_documents"](spark, str(tmp_path)).collect()} == {('"a"@en', '"b\\n\\""@de'), ('"c"', '"d"')}


def test_a_chain_of_optionals_over_statements(spark, tmp_path):
    d = "<http://data.example/schema/{}>".format
    data = [("<a>", d("country"), '"X"'), ("<a>", d("label"), '"one"@en'), ("<a>", d("label"), '"eins"@de'), ("<b>", d("country"), '"Y"'), ("<b>", d("label"), '"zwei"@de'), ("<b>", d("label"), '"deux"@fr'), ("<c>", d("country"), '"Z"')]
    spark.createDataFrame([(*r, None) for r in data], "s string, p string, o string, g string").write.parquet(f"{tmp_path}/quads.parquet")
    df = QUERIES["optional_chain_quads"](spark, str(tmp_path))
    assert {(r.x, r.c, r.l) for r in df.collect()} == {("<a>", '"X"', '"one"@en'), ("<b>", '"Y"', '"zwei"@de'), ("<b>", '"Y"', '"deux"@fr'), ("<c>", '"Z"', None)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan and "isnull(" in plan  # split by what is bound
