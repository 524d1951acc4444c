import pytest
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import XSD, bnode, iri, lit, parse_term, var

CASES = [
    (lit("foo"), '"foo"', "lit", "foo", None, None),
    (lit("bar", lang="en-us"), '"bar"@en-us', "lit", "bar", "en-us", None),
    (lit("7", dt=XSD + "integer"), f'"7"^^<{XSD}integer>', "lit", "7", None, XSD + "integer"),
    (iri(XSD + "integer"), f"<{XSD}integer>", "iri", XSD + "integer", None, None),
    (bnode("r1"), "_:r1", "bnode", "r1", None, None),
    (lit('a"b\\c\n\td'), '"a\\"b\\\\c\\n\\td"', "lit", 'a"b\\c\n\td', None, None),
    (lit(""), '""', "lit", "", None, None),
]


@pytest.mark.parametrize("term, nt, kind, value, lang, dt", CASES)
def test_text_form_and_back(term, nt, kind, value, lang, dt):
    assert term.nt == nt and parse_term(nt) == term
    assert (term.kind, term.value, term.lang, term.dt) == (kind, value, lang, dt)


def test_columns_agree_with_terms(spark):
    df = T.explode_term(spark.createDataFrame([(c[1],) for c in CASES] + [(None,)], "t string"), "t")
    got = [tuple(r)[1:] for r in df.collect()]
    assert got == [c[2:] for c in CASES] + [(None, None, None, None)]


def test_unescape_all_escapes(spark):
    text = r"a\\n\tbé\U0001F600\"\'\\u0041" + "x" * 100_000
    want = "a\\n\tbé\U0001f600\"'\\u0041" + "x" * 100_000
    assert spark.createDataFrame([(text,)], "t string").select(T.unescape(F.col("t"))).first()[0] == want
    assert T.unescape_text(text) == want


def test_numbers_ebv_and_order():
    assert lit("7", dt=XSD + "integer").number == 7 and lit("1.2340", dt=XSD + "float").number == 1.234
    assert lit("x", dt=XSD + "integer").number is None and lit("7").number is None
    assert [lit("true", dt=XSD + "boolean").ebv, lit("1", dt=XSD + "boolean").ebv, lit("0", dt=XSD + "integer").ebv] == [True, False, False]
    assert lit("").ebv is False and lit("x", lang="en").ebv is True and iri("x").ebv is None and bnode("x").ebv is None
    assert lit("x", dt="http://e/own").ebv is False
    shuffled = [var("v"), lit("a"), iri("z"), bnode("m"), iri("b"), lit("A")]
    assert sorted(shuffled, key=lambda t: t.order_key) == [bnode("m"), iri("b"), iri("z"), lit("A"), lit("a"), var("v")]


def test_ebv_and_order_columns(spark):
    terms = [lit("true", dt=XSD + "boolean"), lit("no", dt=XSD + "boolean"), lit("5", dt=XSD + "integer"), lit("0.0", dt=XSD + "double"), lit(""), lit("x"), iri("i"), bnode("b"), lit("z", dt="http://e/own")]
    df = spark.createDataFrame([(t.nt,) for t in terms], "t string")
    assert [r[0] for r in df.select(T.ebv_of("t")).collect()] == [True, False, True, False, False, True, None, None, False]
    want = [t.nt for t in sorted(terms, key=lambda t: (*t.order_key, t.nt))]
    assert [r[0] for r in df.orderBy(*T.order_keys("t")).collect()] == want


def test_triple_hash_ignores_position(spark):
    df = spark.createDataFrame([("<a>", "<b>", "<c>"), ("<c>", "<a>", "<b>"), ("<a>", "<b>", "<d>")], "s string, p string, o string")
    a, b, c = [r[0] for r in df.select(T.triple_hash()).collect()]
    assert a == b != c


def test_bad_terms():
    for text in ("foo", '"open', "<open", ""):
        with pytest.raises(ValueError):
            parse_term(text)
