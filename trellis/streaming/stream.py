"""Streams of N-Triples lines or of triple rows, matched against patterns as they arrive.

A stream is compiled by the same compiler as a table: scans, filters, projections, unions and joins with stored triples run
incrementally. Two patterns of one stream join as a stream-stream inner join; a watermark on the arrival time bounds its
state when `within` is given.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.plans.algebra import BGP, Triple
from trellis.plans.compile import Compiler, Relation
from trellis.sources.ntriples import read_permissive, statements
from trellis.sources.store import Encoded, TripleStore


def read_all_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Stream of (s, p, o, corrupt, reason) for each line of N-Triples files that are put into a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(path)
    return read_permissive(lines, "value", [])


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Stream of the statements (s, p, o) alone."""
    return statements(read_all_lines(spark, path, max_files))


def load_batches(spark: SparkSession, source: str, target: str, on_batch: Callable[[int, int, int, float], None] | None = None, max_files: int = 100) -> None:
    """Load what a folder holds in batches of files: statements and rejects (corrupt, reason) go to folders below target.

    on_batch is called after each batch with its number, its statements, its rejects and its seconds. The progress is kept
    below target, so that a load that was broken off goes on where it stopped, and a later one takes new files only. A batch
    has a folder of its own, so that one that is done again replaces what it left before.
    """

    def store(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        batch.where("s IS NOT NULL").select("s", "p", "o").write.mode("overwrite").parquet(f"{target}/statements/batch={number}")
        batch.where("reason IS NOT NULL").select("corrupt", "reason").write.mode("overwrite").parquet(f"{target}/rejects/batch={number}")
        if on_batch:
            n, bad = (spark.read.parquet(f"{target}/{x}/batch={number}").count() for x in ("statements", "rejects"))
            on_batch(number, n, bad, time.perf_counter() - began)

    writer = read_all_lines(spark, source, max_files).writeStream.foreachBatch(store).option("checkpointLocation", f"{target}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()


def dedup(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Set semantics on a stream: repeats of a triple within the watermark's delay are dropped, so that state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["s", "p", "o"])


def match_stream(stream: DataFrame, bgp: BGP, stored: TripleStore | None = None, from_stream: tuple[int, ...] = (0,)) -> DataFrame:
    """Bindings of a basic graph pattern whose patterns at positions `from_stream` read the stream and the others the store."""
    arriving = TripleStore(stream.select("s", "p", "o"))
    compiler = Compiler(stored or arriving)
    relation: Relation | None = None
    order = [*from_stream, *[i for i in range(len(bgp.triples)) if i not in from_stream]]
    for i in order:
        store = arriving if i in from_stream else stored
        if store is None:
            raise ValueError("a pattern reads the store, but none is given")
        part = compiler.scan(bgp.triples[i], store)
        relation = part if relation is None else compiler.join(relation, part)
    names = [v.value for v in bgp.variables() if v.kind == "var"]
    return relation.named(names)


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Triples per predicate and time window, late ones accepted up to the watermark's delay."""
    w = F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w, "p").agg(F.count(F.lit(1)).alias("n")).select("window.start", "p", "n")


def pattern_of(stream: DataFrame, t: Triple) -> DataFrame:
    """Bindings of a single pattern of the stream."""
    names = iter(range(9))
    df, cols = TripleStore(stream.select("s", "p", "o")).scan(t, lambda: f"c{next(names)}")
    return df.select(*[Encoded(e.name).term().alias(v.value) for v, e in cols.items()])
