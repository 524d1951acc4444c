"""Most frequent values: hierarchical count-sketch over hash-bit prefixes, then a verifying scan.

Level b of the hierarchy counts the prefixes of b bits of each value's 64-bit hash. Levels with no more prefixes than
counters are exact; the others are count-sketches of `depth` rows with signed hashes. Sketches add, so each task folds its
rows into arrays of fixed size and ships the nonzero counters, which are summed per counter. Descending from the first
level, the children of a prefix are looked at only if its count may reach the threshold; surviving leaves are the
candidate hashes. A second scan counts the values behind them exactly.

The width grows with 1 / share, not with its square: where a few heavy values make the standard error too great for the
threshold, they are found first, counted exactly and taken out of the counters (sketches are linear), which leaves a smaller
error to the rest. Where that does not suffice, or where counters would need more memory than is given, the values are divided
by further bits of their hashes, and each part has a sketch and a scan of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import parallelism

LEVELS = (12, 22, 32)
#: Bytes of counters that a task, or the driver, holds at once.
MEMORY = 256 << 20
#: Standard errors by which an estimate may fall short: a threshold must be twice as many.
SIGMAS = 4


def _mix(prefix: np.ndarray, level: int, row: int) -> np.ndarray:
    """A 64-bit hash of prefixes for one row of one level."""
    c = np.uint64(0x9E3779B97F4A7C15 * (2 * (8 * level + row) + 1) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        x = (prefix + c) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Shape:
    width: int
    depth: int = 5
    levels: tuple[int, ...] = LEVELS

    @staticmethod
    def for_share(share: float, depth: int = 5) -> Shape:
        """A width of which, once values above eight standard errors are out, the standard error is at most an eighth of the
        threshold: then the squares of the shares that are left add up to at most eight standard errors."""
        need = (2 * SIGMAS * 1.2533) ** 2 / depth / share
        return Shape(1 << max(14, math.ceil(math.log2(need))), depth)

    def rows(self, level: int) -> int:
        return 1 if self.exact(level) else self.depth

    def exact(self, level: int) -> bool:
        return (1 << self.levels[level]) <= 2 * self.width

    def cells(self, level: int) -> int:
        return 1 << self.levels[level] if self.exact(level) else self.width

    def base(self, level: int, row: int) -> int:
        """Number of the first counter of a row."""
        return sum(self.rows(i) * self.cells(i) for i in range(level)) + row * self.cells(level)

    @property
    def total(self) -> int:
        return sum(self.rows(i) * self.cells(i) for i in range(len(self.levels)))

    def place(self, prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Counter within the row, and sign."""
        if self.exact(level):
            return prefix.astype(np.int64), np.ones(len(prefix), dtype=np.int64)
        x = _mix(prefix, level, row)
        return (x & np.uint64(self.width - 1)).astype(np.int64), 1 - 2 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)

    def prefix(self, h: np.ndarray, level: int) -> np.ndarray:
        return h >> np.uint64(64 - self.levels[level])

    def add(self, counters: np.ndarray, h: np.ndarray) -> None:
        for level in range(len(self.levels)):
            prefix, n = np.unique(self.prefix(h, level), return_counts=True)
            for row in range(self.rows(level)):
                cell, sign = self.place(prefix, level, row)
                base = self.base(level, row)
                counters[base : base + self.cells(level)] += np.bincount(cell, weights=sign * n, minlength=self.cells(level)).astype(np.int64)

    def read(self, counters: np.ndarray, prefix: np.ndarray, level: int) -> np.ndarray:
        got = []
        for row in range(self.rows(level)):
            cell, sign = self.place(prefix, level, row)
            got.append(counters[self.base(level, row) + cell] * sign)
        return np.median(np.array(got), axis=0)

    def error(self, counters: np.ndarray, level: int) -> float:
        """Standard error of an estimate, from the rows' own second moments."""
        if self.exact(level):
            return 0.0
        moments = [np.sum(counters[self.base(level, r) : self.base(level, r) + self.width].astype(float) ** 2) for r in range(self.depth)]
        return 1.2533 / math.sqrt(self.depth) * math.sqrt(np.median(moments) / self.width)

    def worst_error(self, counters: np.ndarray) -> float:
        return max(self.error(counters, level) for level in range(len(self.levels)))

    def descend(self, counters: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(leaf prefixes that may reach the threshold, their estimates): those that fall short by at most SIGMAS errors."""
        kept = np.zeros(1, dtype=np.uint64)
        for level in range(len(self.levels)):
            step = self.levels[level] - (self.levels[level - 1] if level else 0)
            children = ((kept[:, None] << np.uint64(step)) | np.arange(1 << step, dtype=np.uint64)).ravel()
            got = self.read(counters, children, level)
            keep = got >= max(1.0, threshold - SIGMAS * self.error(counters, level))
            kept, got = children[keep], got[keep]
        return kept, got

    def take_out(self, counters: np.ndarray, leaves: np.ndarray, n: np.ndarray) -> None:
        """Remove values of known counts from the counters of every level."""
        for level in range(len(self.levels)):
            prefix = leaves >> np.uint64(self.levels[-1] - self.levels[level])
            for row in range(self.rows(level)):
                cell, sign = self.place(prefix, level, row)
                np.subtract.at(counters, self.base(level, row) + cell, sign * n)


def sketch_counters(df: DataFrame, columns: Sequence[str], shape: Shape, parts: int = 1, part: int = 0) -> DataFrame:
    """(cell, n): nonzero counters of the sketches of the columns, one after the other, in one scan; cell -1 counts rows.

    Partial sketches add by the same sum. NULLs are not counted. Of `parts` (a power of two) divisions of the hashes only
    `part` is counted. Tasks read several splits each where there are many, so that the number of sketches that are shipped
    is bounded by the cluster and not by the input.
    """
    hashes = df.select(*[F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"h{i}") for i, c in enumerate(columns)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((len(columns), shape.total), dtype=np.int64)
        held: list[list[np.ndarray]] = [[] for _ in columns]
        rows = waiting = 0

        def spend() -> None:
            for i, own in enumerate(held):
                if own:
                    shape.add(counters[i], np.concatenate(own))
                    own.clear()

        for b in batches:
            for i in range(len(columns)):
                h = b.column(i).drop_null().to_numpy().view(np.uint64)
                held[i].append(h if parts == 1 else h[(h & np.uint64(parts - 1)) == np.uint64(part)])
            rows += b.num_rows
            waiting += b.num_rows
            if waiting >= 1 << 18:
                spend()
                waiting = 0
        spend()
        flat = counters.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(flat[at], rows))], names=["cell", "n"])

    tasks = 4 * parallelism(df.sparkSession)
    return hashes.coalesce(tasks).mapInArrow(fold, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _counters(df: DataFrame, columns: Sequence[str], shape: Shape, parts: int, part: int) -> tuple[np.ndarray, int]:
    """Counters of all columns on the driver, and the number of rows."""
    got = sketch_counters(df, columns, shape, parts, part).toArrow()
    cells, counts = got.column("cell").to_numpy(), got.column("n").to_numpy()
    flat = np.zeros(len(columns) * shape.total, dtype=np.int64)
    flat[cells[cells >= 0]] = counts[cells >= 0]
    return flat.reshape(len(columns), shape.total), int(counts[cells == -1].sum())


def _values(df: DataFrame, columns: Sequence[str], shape: Shape) -> DataFrame:
    """(fld, value, leaf) of every cell that is not NULL."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in columns]))
    values = df.select(each.alias("x")).select("x.fld", "x.value").where(F.col("value").isNotNull())
    return values.withColumn("leaf", F.shiftrightunsigned(F.xxhash64("value"), 64 - shape.levels[-1]))


def _candidates(df: DataFrame, columns: Sequence[str], threshold_share: float, shape: Shape, parts: int, part: int) -> tuple[list[tuple], int] | None:
    """((fld, leaf, approx, std_error) of one division of the hashes, rows of df), or None if it has to be divided further."""
    counters, n_rows = _counters(df, columns, shape, parts, part)
    threshold = max(1.0, threshold_share * n_rows)
    known: list[dict[int, tuple[float, float]]] = [{} for _ in columns]
    while True:
        asked: list[tuple[str, int]] = []
        for name, own, had in zip(columns, counters, known):
            error = shape.worst_error(own)
            enough = 2 * SIGMAS * error <= threshold
            leaves, estimates = shape.descend(own, threshold if enough else 2 * SIGMAS * error)
            new = {int(x): (float(e), error) for x, e in zip(leaves, estimates) if int(x) not in had}
            if not enough and not new:
                return None
            had.update(new)
            asked += [(name, x) for x in new] if not enough else []
        if not asked:
            return [(name, x, *v) for name, had in zip(columns, known) for x, v in had.items()], n_rows
        wanted = df.sparkSession.createDataFrame(asked, "fld string, leaf bigint")
        exact = _values(df, list(dict.fromkeys(name for name, _ in asked)), shape).join(F.broadcast(wanted), ["fld", "leaf"]).groupBy("fld", "leaf").agg(F.count_if((F.xxhash64("value").bitwiseAND(F.lit(parts - 1))) == part).alias("n")).collect()
        for name, own in zip(columns, counters):
            mine = [(r.leaf, r.n) for r in exact if r.fld == name]
            shape.take_out(own, np.array([x for x, _ in mine], dtype=np.uint64), np.array([n for _, n in mine], dtype=np.int64))


def frequent_values(df: DataFrame, columns: Sequence[str], share: float, shape: Shape | None = None, memory: int = MEMORY) -> DataFrame:
    """(fld, value, approx, std_error, n_rows): values of each column with at least `share` of all rows of df; NULL is no value.

    approx and std_error are what the sketch says, n_rows is the exact count of the last scan. Columns must be strings.
    A task and the driver hold the counters, of at most `memory` bytes, and a few candidates per 1 / share. A value at the
    threshold is missed only if its estimate falls four standard errors short at some level; no result is given by counters
    whose error is more than an eighth of the threshold. Empty tables give no row.
    """
    shape, parts = shape or Shape.for_share(share), 1
    while len(columns) * shape.total * 8 > memory and shape.width > 256:
        shape, parts = Shape(shape.width // 2, shape.depth, shape.levels), parts * 2
    spark = df.sparkSession
    todo, found, n_rows = [(parts, k) for k in range(parts)], {}, 0
    while todo:
        n, part = todo.pop()
        got = _candidates(df, columns, share, shape, n, part)
        if got is None:
            todo += [(4 * n, part + k * n) for k in range(4)]
            continue
        n_rows = got[1]
        # a leaf that several divisions share is one candidate
        found.update({(fld, leaf): (approx, error) for fld, leaf, approx, error in got[0] if approx > found.get((fld, leaf), (0,))[0]})
    candidates = spark.createDataFrame([(*k, *v) for k, v in found.items()], "fld string, leaf bigint, approx double, std_error double")
    counted = _values(df, columns, shape).join(F.broadcast(candidates), ["fld", "leaf"]).groupBy("fld", "value", "approx", "std_error").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= math.ceil(share * n_rows - 1e-9))
