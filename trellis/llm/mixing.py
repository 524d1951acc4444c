"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are counted in tokens of a public tokenizer. Each source is cut into shards and each shard into blocks of about
equal tokens; the mix has as many block seats as its total holds. Seats go to sources by highest quotients of their target
shares, no source above max_repeats times its blocks; a source's seats go to its shards the same way, weighted by their
blocks; within a shard the blocks are taken from a seeded one on. Everything per document stays distributed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.session import BROADCAST_ROWS, cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 4096
SHARD_TOKENS = 1 << 20
#: Shards of all sources together, beside one a source; larger inputs have larger shards.
MAX_SHARDS = 20_000
#: Blocks are made smaller where there would be fewer.
LEAST_BLOCKS = 4096

_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer at a path, one per process."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, text: str, keep: dict[str, str], path: str = TOKENIZER) -> DataFrame:
    """(keep..., n_tokens) per row; NULL and empty texts have 0 tokens."""
    kinds = ", ".join(f"{new} {df.schema[old].dataType.simpleString()}" for new, old in keep.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*[F.col(old).alias(new) for new, old in keep.items()], F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, n_tokens bigint")


def sainte_lague(weights: list[Fraction], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 taken + 1), none above its cap; ties go to the earlier entry.

    A multiple of the weights that is safely too small is given out at once, the rest seat by seat. Seats that no cap
    leaves room for stay empty.
    """
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))
    total = sum(weights)
    got = [0] * len(weights)
    if not seats or not total:
        return got
    # With divisor d an entry has floor(w/d + 1/2) seats; the largest d known to give too few or just enough is a start.
    lo, hi = Fraction(0), total / max(1, seats) * 2 + total
    given = lambda d: [min(c, int(w / d + Fraction(1, 2))) if w > 0 else 0 for w, c in zip(weights, caps)]
    for _ in range(200):
        mid = (lo + hi) / 2
        mid = mid.limit_denominator(1 << 60) or mid
        g = given(mid)
        if sum(g) > seats:
            lo = mid
        else:
            hi, got = mid, g
            if seats - sum(g) <= len(weights):
                break
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if w > 0 and g < c]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


class Mix:
    """A planned mix: `rows` (doc_id, source, n_tokens, copies) and `shares`, one row per target source."""

    def __init__(self, rows: DataFrame, shares: DataFrame):
        self.rows, self.shares = rows, shares


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, broadcast if they are few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def held_seats(weights: list[Fraction], caps: list[int], most: int) -> int:
    """The most seats, up to `most`, of which every entry can take what the quotients give it within its cap.

    Seats by highest quotients never fall when there are more of them, so the number can be searched by halving.
    """
    fits = lambda n: all(g <= c for g, c in zip(sainte_lague(weights, n, [n] * len(weights)), caps))
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
    return lo


def mix(
    documents: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, seed: int = 7, path: str = TOKENIZER,
    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, total_tokens: int | None = None, fit: str = "total",
) -> Mix:
    """Plan a mix of the documents whose source is in `targets` (source, target_share, max_repeats).

    The total is total_tokens, or the size of all those documents. fit="total" keeps it: what a source cannot give within its
    cap goes to the others, whose shares then rise. fit="shares" lowers it as far as every source needs to reach its share
    within its cap; a source without documents can reach none and is left out of that.

    Rows of other or NULL sources are no part of the mix. A target whose source has no documents stays empty. doc_id must be
    unique, and so must the sources of the targets. Shares report, per source: its size, the blocks that its share of the total
    asks for, the blocks that its repeats allow, whether it asks for more than that (beyond_cap), the blocks given, the
    tokens drawn and the share that they reach. The driver holds one row per target and per shard.
    """
    if fit not in ("total", "shares"):
        raise ValueError(f"unknown fit {fit}")
    goals = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).orderBy("source").collect()
    spark = documents.sparkSession
    names = [g.source for g in goals]
    wanted = _small(spark, [(n,) for n in names], "source string")
    inside = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).join(wanted, "source", "left_semi")
    counted = cut_lineage(token_counts(inside, "text", {"doc_id": "doc_id", "source": "source"}, path))
    sizes = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    size = sum(sizes.values())
    total = size if total_tokens is None else total_tokens
    # blocks so small that there are enough of them to tell the shares apart
    block = max(1, min(block_tokens, max(size, total) // LEAST_BLOCKS))
    per_shard = max(shard_tokens, -(-size // MAX_SHARDS))
    n_shards = _small(spark, [(s, max(1, round(n / per_shard))) for s, n in sizes.items()], "source string, shards int")
    placed = counted.join(n_shards, "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("shards")).cast("int")).drop("shards")
    sums = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).orderBy("source", "shard").collect()
    blocks: dict[str, list[tuple[int, int, int]]] = {n: [] for n in names}
    for r in sums:
        if r.n:
            blocks[r.source].append((r.shard, max(1, round(r.n / block)), r.n))
    caps = [(g.max_repeats or 0) * sum(b for _, b, _ in blocks[g.source]) for g in goals]
    weights = [Fraction(g.target_share or 0).limit_denominator(10**9) for g in goals]
    seats = round(total / block)
    asked = sainte_lague(weights, seats, [seats] * len(goals))
    if fit == "shares":
        able = [w if blocks[g.source] else Fraction(0) for g, w in zip(goals, weights)]
        quotas = sainte_lague(able, held_seats(able, caps, seats), caps)
    else:
        quotas = sainte_lague(weights, seats, caps)
    beyond = [_asks_too_much(a, w, total, block, (g.max_repeats or 0) * sizes.get(g.source, 0), len(goals)) for a, w, g in zip(asked, weights, goals)]
    plan = []
    for g, quota in zip(goals, quotas):
        own, most = blocks[g.source], g.max_repeats or 0
        for (k, b, n), q in zip(own, sainte_lague([Fraction(b) for _, b, _ in own], quota, [most * b for _, b, _ in own])):
            plan.append((g.source, k, int(b), int(n), int(q)))
    # one row per shard: at most MAX_SHARDS and one a target
    known = _small(spark, plan, "source string, shard int, blocks int, shard_tokens bigint, quota int")
    # documents stand in a seeded order, so that blocks in a row, from a seeded one on, are a seeded choice of blocks
    in_shard = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id")
    middle = F.sum("n_tokens").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") / 2
    drawn = placed.join(known, ["source", "shard"]).withColumn("middle", middle)
    at = F.least(F.floor(F.col("middle") * F.col("blocks") / F.col("shard_tokens")), F.col("blocks") - 1)
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks"))
    extra = (F.pmod(at + first, F.col("blocks")) < F.col("quota") % F.col("blocks")).cast("int")
    drawn = drawn.select("doc_id", "source", "n_tokens", (F.floor(F.col("quota") / F.col("blocks")) + extra).cast("int").alias("copies")).where("copies > 0")
    drawn_sums = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"))
    whole = F.coalesce(drawn.agg(F.sum(F.col("n_tokens") * F.col("copies"))).scalar(), F.lit(0))
    report = [(g.source, g.target_share, g.max_repeats, int(sizes.get(g.source, 0)), int(a), int(c), int(q), b) for g, a, c, q, b in zip(goals, asked, caps, quotas, beyond)]
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats int, n_tokens bigint, asked_blocks int, cap_blocks int, quota_blocks int, beyond_cap boolean")
    shares = shares.join(drawn_sums, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    return Mix(drawn, shares.withColumn("reached_share", F.coalesce(F.try_divide(F.col("drawn_tokens"), whole), F.lit(0.0))))


def _asks_too_much(asked: int, weight: Fraction, total: int, block: int, most: int, n: int) -> bool:
    """Whether the blocks that the quotients give are more than the source's repeats hold; where the two are so near that
    rounding to blocks decides, the tokens do."""
    if abs(asked - Fraction(most, block)) <= 1 + n * weight:
        return weight * total > most
    return asked * block > most
