import pytest

from trellis.sources import ntriples as N

X = "http://www.w3.org/2001/XMLSchema#"
GOOD = [
    '<http://e/s> <http://e/p> "o" .', '_:b1 <http://e/p> _:b2 .', '_:b1 <http://e/p> _:b2.', '<http://e/s>\t<http://e/p>\t"a\\tb\\u00E9\\U0001F600\\""@en-GB\t.',
    '  <http://e/s>  <http://e/p>   <http://e/o>   .  # a "comment', '<http://e/s> <http://e/p> "x"^^<http://e/own>.\r', f'<http://e/s> <http://e/p> "+07"^^<{X}integer> .',
    f'<http://e/s> <http://e/p> ".5"^^<{X}decimal> .', f'<http://e/s> <http://e/p> "-1.5E-3"^^<{X}double> .', f'<http://e/s> <http://e/p> "INF"^^<{X}double> .',
    f'<http://e/s> <http://e/p> "2024-02-29"^^<{X}date> .', f'<http://e/s> <http://e/p> "2023-12-31T23:59:59.5+01:00"^^<{X}dateTime> .', f'<http://e/s> <http://e/p> "12024-02-29Z"^^<{X}date> .',
    f'<http://e/s> <http://e/p> "\\u0031"^^<{X}integer> .', '<http://e/s> <http://e/p> "<x> # . y" .', '<urn:a> <urn:b> "\\\\" .', '<http://e/\\u00E9> <http://e/p> "" .',
]
EMPTY = ["", "   ", "\t", "# note", "  # note\r", "\r"]
BAD = {
    '<http://e/s> <http://e/p> "open .': "unbalanced_quote", '<http://e/s> <http://e/p> "open\\" .': "unbalanced_quote", "<http://e/s <http://e/p> <http://e/o> .": "unclosed_iri",
    "<http://e/s> <http://e/p> <http://e/o>": "missing_stop", "<http://e/s> <http://e/p> .": "too_few_terms", "oops": "too_few_terms",
    '<http://e/s> <http://e/p> "a" "b" .': "too_many_terms", '<http://e/s> <http://e/p> "a" . <http://e/s> <http://e/p> "b" .': "too_many_terms", '<http://e/s> <http://e/p> "a" <http://e/g> .': "too_many_terms",
    '<http://e/s> <http://e/p> "a\\q" .': "bad_escape", '<http://e/s> <http://e/p> "\\u00G1" .': "bad_escape", '"s" <http://e/p> "o" .': "bad_subject", "<rel> <http://e/p> <http://e/o> .": "bad_subject",
    "<http://e/s> _:p <http://e/o> .": "bad_predicate", "<http://e/s> <p> <http://e/o> .": "bad_predicate", "<http://e/s> <http://e/p> <rel> .": "bad_object", "<http://e/s> <http://e/p> _: .": "bad_object",
    '<http://e/s> <http://e/p> "a"@12 .': "bad_language", '<http://e/s> <http://e/p> "a"@en- .': "bad_language", f'<http://e/s> <http://e/p> "1.0"^^<{X}integer> .': "bad_value",
    f'<http://e/s> <http://e/p> ""^^<{X}boolean> .': "bad_value", f'<http://e/s> <http://e/p> "2023-02-29"^^<{X}date> .': "bad_value", f'<http://e/s> <http://e/p> "2023-01-01T24:00:01"^^<{X}dateTime> .': "bad_value",
    f'<http://e/s> <http://e/p> " 5"^^<{X}integer> .': "bad_value",
}


def _read(spark, lines):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "id int, line string, reason string")
    return {r.id: r for r in N.read_permissive(df, "line", ["id"]).collect()}


def test_valid_lines(spark):
    got = _read(spark, GOOD)
    assert {i: r.reason for i, r in got.items() if r.reason} == {}
    assert (got[3].s, got[3].p, got[3].o) == ("<http://e/s>", "<http://e/p>", '"a\\tb\\u00E9\\U0001F600\\""@en-GB')
    assert got[2].o == "_:b2" and got[4].o == "<http://e/o>" and got[14].o == '"<x> # . y"'


def test_lines_without_statement(spark):
    got = _read(spark, EMPTY)
    assert all(r.s is None and r.reason is None and r.corrupt is None for r in got.values()) and len(got) == len(EMPTY)


def test_reasons(spark):
    got = _read(spark, list(BAD))
    assert {x: got[i].reason for i, x in enumerate(BAD)} == BAD
    assert all(got[i].corrupt == x and got[i].s is None for i, x in enumerate(BAD))
    assert set(BAD.values()) <= set(N.REASONS)


def test_null_and_very_long_lines(spark):
    long = "\\\\ \\u00E9" * 200_000
    got = _read(spark, [None, f'<http://e/s> <http://e/p> "{long}" .', f'<http://e/s> <http://e/p> "{long} .', "<http://e/" + "a" * 1_000_000 + "> <http://e/p> _:b ."])
    assert [got[i].reason for i in range(4)] == ["missing_line", None, "unbalanced_quote", None]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, line string")
    assert N.read_permissive(df, "line", ["id"]).count() == 0


def test_files_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("<http://e/s>", "<http://e/p>", '"a\\nb"@en'), ("_:x", "<http://e/p>", "<http://e/o>")], "s string, p string, o string")
    N.write_ntriples(df, str(tmp_path / "out"))
    assert rows(N.read_ntriples(spark, str(tmp_path / "out"))) == rows(df)
    skolem = N.read_ntriples(spark, str(tmp_path / "out"), skolemize=True).where("s LIKE '\\\\_:%'").collect()
    assert len(skolem) == 1 and skolem[0].s.startswith("_:b") and skolem[0].s.endswith("xx")


@pytest.mark.parametrize("day, ok", [("1900-02-29", False), ("2000-02-29", True), ("-0004-02-29", True), ("0000-01-01", True), ("2021-04-31", False)])
def test_calendar(spark, day, ok):
    got = _read(spark, [f'<http://e/s> <http://e/p> "{day}"^^<{X}date> .'])
    assert (got[0].reason is None) == ok
