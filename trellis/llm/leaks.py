"""Evaluation passages inside corpus texts: pigeonhole pieces, then bit-parallel edit distance.

A text is its sequence of words (runs of letters and digits, in lower case). A passage leaks where `window` consecutive
words of it stand in a document with at most `edits` words inserted, dropped or changed. Each test item is cut, end to
end, into pieces of L = (window + 1) // (edits + 2) words: every window then holds at least edits + 1 whole pieces, and
since each edit can spoil only one, one of them stands in the document unchanged. Pieces are found with one automaton in a
single pass over a document; around each hit, the windows that hold the piece are verified by Myers's bit-parallel
distance over words.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items go to the executors in blocks of at most this many bytes, one pass over the corpus per block.
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def myers_best(pattern: list[str], text: list[str]) -> int:
    """Least edit distance between the pattern and any substring of the text, in words."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        best = min(best, score)
    return best


class LeakFinder:
    """Pieces of a block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, edits: int):
        if (window + 1) // (edits + 2) < 1:
            raise ValueError("the window is too short for that many edits")
        self.window, self.edits = window, edits
        self.length = (window + 1) // (edits + 2)
        self.items = {i: w for i, t in items if len(w := words(t)) >= window}
        at: dict[str, list[tuple[int, int]]] = {}
        for i, w in self.items.items():
            for a in range(0, len(w) - self.length + 1, self.length):
                at.setdefault(f" {' '.join(w[a : a + self.length])} ", []).append((i, a))
        self.machine = ahocorasick.Automaton()
        for piece, places in at.items():
            self.machine.add_word(piece, (len(piece), places))
        if at:
            self.machine.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """{item: least number of edits of a leaked window} for one text."""
        w = words(text)
        if not self.items or len(w) < self.window - self.edits:
            return {}
        flat = f" {' '.join(w)} "
        starts = [0]
        for x in w:
            starts.append(starts[-1] + len(x) + 1)
        best: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()
        known: dict[tuple[str, int], int] = {}  # items that share a passage share its distance
        for end, (size, places) in self.machine.iter(flat):
            b = bisect_left(starts, end - size + 1)
            for item, a in places:
                if best.get(item) == 0:
                    continue
                words_of = self.items[item]
                for i in range(max(0, a + self.length - self.window), min(a, len(words_of) - self.window) + 1):
                    key = (item, i, b - a + i)
                    if key in tried:
                        continue
                    tried.add(key)
                    lo = b - (a - i) - self.edits
                    region = w[max(0, lo) : b - (a - i) + self.window + self.edits]
                    own = words_of[i : i + self.window]
                    same = (" ".join(own), lo)
                    d = known.get(same)
                    if d is None:
                        d = known[same] = myers_best(own, region)
                    if d <= self.edits:
                        best[item] = min(d, best.get(item, d))
        return best


#: The finder of the block that this process worked on last, so that a process builds it once and not for every task.
_last: dict[str, LeakFinder] = {}


def _finder(token: str, items: list[tuple[int, str | None]], window: int, edits: int) -> LeakFinder:
    if token not in _last:
        _last.clear()
        _last[token] = LeakFinder(items, window, edits)
    return _last[token]


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int, edits: int = 0) -> DataFrame:
    """(doc_id, item_id, edits): every document with a leaked window of an item, one row per pair.

    The corpus is read once per block of items and never shuffled; every text is used whole. Items shorter than `window`
    words cannot leak; NULL and empty texts match nothing. Rows that repeat a doc_id are joined into one row per pair.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    held = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits int"
    out = None
    for k in range(blocks):
        block = [(r.i, r.t) for r in held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()]
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            finder = _finder(token, shared.value, window, edits)
            for b in batches:
                docs, found, least = [], [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item, e in finder.find(t).items():
                        docs.append(d)
                        found.append(item)
                        least.append(e)
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(found, pa.int64() if item_kind == "bigint" else None), pa.array(least, pa.int32())], names=["doc_id", "item_id", "edits"])

        part = documents.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
