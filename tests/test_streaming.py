from pyspark.sql import functions as F

from trellis.functions.terms import iri, var
from trellis.plans.algebra import Triple
from trellis.plans.parser import parse_bgp, parse_turtle
from trellis.sources.store import TripleStore
from trellis.streaming import stream as S


def _drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_lines_against_stored_triples(spark, tmp_path, rows):
    (tmp_path / "1.nt").write_text('<http://e/a> <http://e/p> <http://e/b> .\nbroken\n# note\n<http://e/c> <http://e/p> <http://e/d> .\n')
    stored = TripleStore.from_triples(spark, parse_turtle('<http://e/b> <http://e/name> "B" . <http://e/x> <http://e/name> "X" .'))
    arriving = S.read_lines(spark, str(tmp_path))
    out = S.match_stream(arriving, parse_bgp("{ ?s <http://e/p> ?o . ?o <http://e/name> ?n }"), stored)
    assert out.isStreaming and rows(_drain(out, "m1")) == [("<http://e/a>", "<http://e/b>", '"B"')]
    single = S.pattern_of(arriving, Triple(var("s"), iri("http://e/p"), var("o")))
    assert rows(_drain(single, "m2")) == [("<http://e/a>", "<http://e/b>"), ("<http://e/c>", "<http://e/d>")]


def test_two_patterns_of_one_stream(spark, tmp_path, rows):
    (tmp_path / "1.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\n<http://e/b> <http://e/q> <http://e/c> .\n")
    out = S.match_stream(S.read_lines(spark, str(tmp_path)), parse_bgp("{ ?x <http://e/p> ?y . ?y <http://e/q> ?z }"), from_stream=(0, 1))
    assert rows(_drain(out, "m3")) == [("<http://e/a>", "<http://e/b>", "<http://e/c>")]


def test_repeats_and_windows(spark, tmp_path):
    batch = spark.createDataFrame([(f"<s{i % 3}>", "<p>", "<o>", f"2025-01-01 00:0{i}:00") for i in range(6)], "s string, p string, o string, at string")
    batch.select("s", "p", "o", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("s string, p string, o string, at timestamp").parquet(str(tmp_path / "in"))
    assert _drain(S.dedup(arriving, "at", "1 hour"), "m4").count() == 3
    got = {r.n for r in _drain(S.windowed_counts(arriving, "at", "3 minutes", "1 minute"), "m5", "complete").collect()}
    assert got == {3}
