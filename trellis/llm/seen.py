"""Has this key been seen before? Blocked Bloom filters, one per hash partition of the keys, query then insert.

A filter is an array of 256-bit blocks of eight 32-bit words; a key's hash picks a block and one bit in each word, so a
query touches one cache line. Memory per task is the filter alone: bits_per_key(fpp) for each key of its partition.

Filters are rows of a table, one per partition, so that they can be kept, merged and carried on: a batch of requests travels
to the filters' partitions, the earlier keys stay where they are. SeenIndex keeps filters and keys on shared storage.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import cut_lineage, parallelism

FPP = 0.001
KEYS_PER_PARTITION = 1_000_000
PROBES_PER_PARTITION = 20_000
#: Repeated keys that a task remembers while it pre-aggregates.
REMEMBERED = 1 << 16
# Odd multipliers of the split-block filter published with the Parquet format.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def bits_per_key(fpp: float) -> float:
    return -8 / math.log(1 - fpp ** (1 / 8))


class BlockedBloom:
    def __init__(self, keys: int, fpp: float = FPP, words: bytes | None = None):
        self.blocks = max(1, math.ceil(max(1, keys) * bits_per_key(fpp) / 256))
        self.words = np.zeros((self.blocks, 8), dtype=np.uint32)
        if words is not None:
            self.words |= np.frombuffer(words, dtype=np.uint32).reshape(self.blocks, 8)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        with np.errstate(over="ignore"):
            bit = ((h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] * SALTS) >> np.uint32(27)
        return block.astype(np.int64), np.uint32(1) << bit

    def query(self, h: np.ndarray) -> np.ndarray:
        block, mask = self._place(h)
        return ((self.words[block] & mask) == mask).all(axis=1)

    def insert(self, h: np.ndarray) -> None:
        block, mask = self._place(h)
        for i in range(8):
            np.bitwise_or.at(self.words[:, i], block, mask[:, i])

    def query_then_insert(self, h: np.ndarray) -> np.ndarray:
        """Verdict of each key as if keys came one by one: a key equal to an earlier one of the same batch is seen."""
        seen = self.query(h)
        first = np.zeros(len(h), dtype=bool)
        first[np.unique(h, return_index=True)[1]] = True
        seen |= ~first
        self.insert(h[~seen])
        return seen


def _absent(part: int, n: int) -> np.ndarray:
    """Hashes of keys that no table holds: they begin with NUL, which no RDF term does. Same hash as Spark's xxhash64."""
    return np.array([xxhash.xxh64_intdigest(f"\0absent/{part}/{i}".encode(), seed=42) for i in range(n)], dtype=np.uint64)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregation: of each key in a batch only the row with the least position needs its filter; the rest follow it.

    Keys that repeat within a batch are remembered, up to a fixed number, with the least position that led so far: they
    lead again only with a smaller one. So a key with a third of all rows leads about once per task.
    """
    memory: dict[int, int] = {}
    for b in batches:
        h, at = b.column("h").to_numpy(), b.column("at").to_numpy()
        lead = np.zeros(len(h), dtype=bool)
        if len(h):
            order = np.lexsort((at, h))
            new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            first = order[new]
            sizes = np.diff(np.append(np.flatnonzero(new), len(h)))
            lead[first] = True
            for i in first[sizes > 1]:
                key, place = int(h[i]), int(at[i])
                if memory.get(key, place + 1) <= place:
                    lead[i] = False
                elif key in memory or len(memory) < REMEMBERED:
                    memory[key] = place
        yield b.append_column("lead", pa.array(lead))


@dataclass(frozen=True)
class Layout:
    """How keys are divided: the number of partitions, and the keys that the filter of each is made for."""

    parts: int
    capacity: int
    fpp: float = FPP

    @staticmethod
    def of(spark: SparkSession, keys: int, fpp: float = FPP, per_partition: int = KEYS_PER_PARTITION) -> Layout:
        """For so many distinct keys in all; partitions differ by chance, for which there is some room."""
        parts = max(parallelism(spark), math.ceil(keys / per_partition))
        mean = keys / parts
        return Layout(parts, math.ceil(mean + 4 * math.sqrt(mean)) + 100, fpp)


def _keys(df: DataFrame) -> DataFrame:
    """(key, h) of a one-column table; NULL is no key."""
    return df.select(F.col(df.columns[0]).alias("key")).where(F.col("key").isNotNull()).select("key", F.xxhash64("key").alias("h"))


def _slots(spark: SparkSession, parts: int) -> DataFrame:
    """(h): for each partition a number that is sent to it."""
    n = parts * (20 + math.ceil(math.log(parts + 1)))
    return spark.range(n).groupBy(F.pmod(F.hash("id"), F.lit(parts))).agg(F.min("id").alias("h")).select("h")


def build_filters(keys: DataFrame, layout: Layout) -> DataFrame:
    """(slot, n_keys, words): the filter of each partition over a one-column table of keys; only hashes are shuffled."""
    rows = _keys(keys).select("h", F.lit(False).alias("mark")).unionByName(_slots(keys.sparkSession, layout.parts).select("h", F.lit(True).alias("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, n, slot = BlockedBloom(layout.capacity, layout.fpp), 0, 0
        for b in batches:
            h, mark = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            slot = int(h[mark][0]) if mark.any() else slot
            n += int((~bloom.query_then_insert(h[~mark].view(np.uint64))).sum())
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([n], pa.int64()), pa.array([bloom.words.tobytes()], pa.binary())], names=["slot", "n_keys", "words"])

    return rows.repartition(layout.parts, "h").mapInArrow(run, "slot bigint, n_keys bigint, words binary")


def merge_filters(*filters: DataFrame) -> DataFrame:
    """The filters of several sets of keys under one layout as one: words are united, n_keys adds up (an upper bound)."""

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        words = np.bitwise_or.reduce([np.frombuffer(w, dtype=np.uint32) for w in rows["words"]])
        return pd.DataFrame({"slot": rows["slot"][:1], "n_keys": [int(rows["n_keys"].sum())], "words": [words.tobytes()]})

    both = reduce(DataFrame.unionByName, filters)
    return both.groupBy("slot").applyInPandas(unite, "slot bigint, n_keys bigint, words binary")


def bloom_verdicts(requests: DataFrame, at: str, key: str, filters: DataFrame, layout: Layout) -> DataFrame:
    """Rows (at, key, maybe, inserted, probes, wrong, slot, words).

    One row per request, with `maybe`: false is certain (the key is new), true is wrong at a rate of about fpp. One row
    more per partition (at NULL) has its filter with the requests' keys in it, and tells how many of them are new to it
    and how many of `probes` absent keys it took for seen. `filters` hold the keys that came before all requests; requests
    come in the order of `at`, which must be unique. Requests with a NULL key or position are left out: they name no key.

    A hot key is pre-aggregated before the shuffle: rows that follow another of the same key in their task are spread by
    position instead of by key.
    """
    reqs = requests.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(at).cast("bigint").alias("at"), F.col(key).alias("key"), F.xxhash64(key).alias("h"))
    reqs = reqs.mapInArrow(_leads, "at bigint, key string, h bigint, lead boolean")
    held = filters.select(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("key"), F.col("slot").alias("h"), F.lit(False).alias("lead"), "words")
    rows = held.unionByName(reqs.withColumn("words", F.lit(None).cast("binary")))
    place = F.when(F.col("lead") | F.col("words").isNotNull(), F.col("h")).otherwise(F.xxhash64("at"))
    rows = rows.repartition(layout.parts, place).sortWithinPartitions(F.col("at").asc_nulls_first())
    schema = pa.schema([("at", pa.int64()), ("key", pa.string()), ("maybe", pa.bool_()), ("inserted", pa.int64()), ("probes", pa.int64()), ("wrong", pa.int64()), ("slot", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, inserted, slot = None, 0, None
        for b in batches:
            if bloom is None and b.num_rows:  # the filter comes first
                slot, bloom = b.column("h")[0].as_py(), BlockedBloom(layout.capacity, layout.fpp, b.column("words")[0].as_py())
                b = b.slice(1)
            h = b.column("h").to_numpy().view(np.uint64)
            lead = b.column("lead").to_numpy(zero_copy_only=False)
            maybe = np.ones(len(h), dtype=bool)
            if len(h):
                maybe[lead] = bloom.query_then_insert(h[lead])
            inserted += int((~maybe).sum())
            none = [pa.nulls(len(h), t) for t in schema.types[3:]]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("key").cast(pa.string()), pa.array(maybe), *none], schema=schema)
        if bloom is None:
            return
        ctx = TaskContext.get()
        probes = _absent(ctx.partitionId() if ctx else 0, PROBES_PER_PARTITION)
        wrong = int(bloom.query(probes).sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, inserted, len(probes), wrong, slot, bloom.words.tobytes()], schema.types)], schema=schema)

    return rows.mapInArrow(run, "at bigint, key string, maybe boolean, inserted bigint, probes bigint, wrong bigint, slot bigint, words binary")


def false_positives(verdicts: DataFrame, earlier: DataFrame) -> DataFrame:
    """Positions (at) that the filters took for seen although their key is new: an exact check of the verdicts.

    A key with a certain first request has no wrong verdict. Of the other keys only the least position can be wrong,
    and is if the key is not among the earlier ones. Folding per key has a map-side combine and leaves one row per key,
    so no join here sees a hot key.
    """
    known = earlier.select(F.col(earlier.columns[0]).alias("key")).where(F.col("key").isNotNull())
    keys = verdicts.where(F.col("at").isNotNull()).groupBy("key").agg(F.min("at").alias("at"), F.min("maybe").alias("all_maybe"))
    return keys.where(F.col("all_maybe")).join(known, "key", "left_anti").select("at")


def _distinct(*frames: DataFrame) -> int:
    """About how many keys (h) there are among the frames, with some room for the error."""
    got = reduce(DataFrame.unionByName, [f.select("h") for f in frames]).agg(F.approx_count_distinct("h", 0.02).alias("n")).first().n
    return math.ceil(1.06 * got)


def _report(verdicts: DataFrame, wrong: DataFrame) -> DataFrame:
    total = verdicts.agg(
        F.count("at").alias("n_requests"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.coalesce(F.sum("probes"), F.lit(0)).alias("probes"),
        F.coalesce(F.try_divide(F.sum("wrong"), F.sum("probes")), F.lit(0.0)).alias("probe_error_rate"),
    )
    n_wrong = wrong.agg(F.count(F.lit(1))).scalar()
    total = total.withColumn("wrong_answers", n_wrong)
    return total.withColumn("error_rate", F.coalesce(F.try_divide("wrong_answers", "n_requests"), F.lit(0.0)))


def _answers(verdicts: DataFrame, wrong: DataFrame) -> DataFrame:
    asked = verdicts.where(F.col("at").isNotNull()).select("at", "maybe")
    return asked.join(wrong.withColumn("wrong_one", F.lit(True)), "at", "left").select("at", "maybe", (F.col("maybe") & F.col("wrong_one").isNull()).alias("seen"))


def seen_before(requests: DataFrame, at: str, key: str, earlier: DataFrame, fpp: float = FPP) -> tuple[DataFrame, DataFrame]:
    """((at, maybe, seen) per request, (n_requests, inserted, probes, probe_error_rate, wrong_answers, error_rate)).

    `maybe` is the filters' answer, `seen` the checked one; the second result has one row: the rate measured with absent
    keys, and that of the answers given for the requests; inserted counts the requests' keys that were new. Empty tables
    give no verdicts and zero counts.
    """
    layout = Layout.of(requests.sparkSession, _distinct(_keys(earlier), _keys(requests.select(key))), fpp)
    verdicts = cut_lineage(bloom_verdicts(requests, at, key, build_filters(earlier, layout), layout).drop("slot", "words"))
    wrong = false_positives(verdicts, earlier)
    return _answers(verdicts, wrong), _report(verdicts, wrong)


class SeenIndex:
    """Filters and keys on shared storage, for one batch of requests after another.

    A batch shuffles itself and the filters (about 14 bits a key at the usual rate), not the earlier keys. For the exact check
    they are kept in buckets by hash, in which the batch's doubtful keys meet them without a shuffle of theirs. A batch is
    an answer and a commit: its filters are written under the next number, which a reader takes up once it is complete.
    """

    def __init__(self, spark: SparkSession, path: str, layout: Layout, number: int = 0):
        self.spark, self.path, self.layout, self.number = spark, path.rstrip("/"), layout, number
        self.table = "seen_" + hashlib.sha1(self.path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (h BIGINT, key STRING) USING parquet OPTIONS (path '{self.path}/keys') CLUSTERED BY (h) INTO {layout.parts} BUCKETS")

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: DataFrame, expected: int | None = None, fpp: float = FPP) -> SeenIndex:
        """An index of a one-column table of keys, with room for `expected` distinct ones (twice those of the table)."""
        layout = Layout.of(spark, expected or 2 * _distinct(_keys(keys)), fpp)
        out = cls(spark, path, layout)
        out._keep(_keys(keys))
        out._write(build_filters(keys, layout))
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SeenIndex:
        """The latest complete state of an index."""
        state = spark.read.parquet(f"{path.rstrip('/')}/state").orderBy(F.desc("number")).first()
        return cls(spark, path, Layout(state.parts, state.capacity, state.fpp), state.number)

    def _keep(self, keys: DataFrame) -> None:
        rows = keys.select("h", "key").repartition(self.layout.parts, "h")
        rows.write.mode("append").format("parquet").bucketBy(self.layout.parts, "h").option("path", f"{self.path}/keys").saveAsTable(self.table)

    def _write(self, filters: DataFrame) -> None:
        n = self.number + 1
        filters.write.mode("overwrite").parquet(f"{self.path}/filters-{n}")
        x = self.layout
        self.spark.createDataFrame([(n, x.parts, x.capacity, x.fpp)], "number int, parts int, capacity int, fpp double").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        self.number = n

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/filters-{self.number}")

    def _doubtful(self, firsts: DataFrame) -> DataFrame:
        """(at, key, h) of first requests that the filters took for seen although the index lacks their keys."""
        asked = firsts.where("all_maybe").select("at", "key", F.xxhash64("key").alias("h"))
        known = self.spark.table(self.table).select(F.col("h").alias("known_h"), F.col("key").alias("known"))
        # joined by the bucketing hash alone: an equality of the keys would be a further join key and undo the buckets
        same = (F.col("key") >= F.col("known")) & (F.col("key") <= F.col("known"))
        return asked.join(known.hint("merge"), (F.col("h") == F.col("known_h")) & same, "left_anti")

    def answer(self, requests: DataFrame, at: str, key: str) -> tuple[DataFrame, DataFrame]:
        """The results of seen_before for a batch, after which its keys belong to the index. Positions order one batch."""
        verdicts = cut_lineage(bloom_verdicts(requests, at, key, self.filters, self.layout))
        fold = verdicts.where(F.col("at").isNotNull()).groupBy("key").agg(F.min("at").alias("at"), F.min("maybe").alias("all_maybe"))
        wrong = cut_lineage(self._doubtful(fold))
        answers, report = _answers(verdicts, wrong.select("at")), _report(verdicts, wrong)
        answers, report = cut_lineage(answers), cut_lineage(report)
        new = fold.where(~F.col("all_maybe")).select("key", F.xxhash64("key").alias("h"))
        self._keep(new.unionByName(wrong.select("key", "h")))
        self._write(verdicts.where(F.col("words").isNotNull()).select("slot", F.col("inserted").alias("n_keys"), "words"))
        return answers, report
