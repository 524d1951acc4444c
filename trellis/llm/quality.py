"""Per-document text quality: counts, punctuation and common-word shares, repetition, and the share of running sentences.

The text is taken apart the way it was put together: lines that continue a sentence are joined, marked or capitalised lines
begin entries, and cells of tables are separated. Every piece of five or more words that reads as a sentence (function words
in a natural share, whole words rather than codes, more than a few words repeated, not a row of short items, not a copy of an
earlier piece) is prose; everything else is an entry, a cell or junk. All of it is linear in the length of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
MARK = re.compile(r"^(?:[-–—•*·‣◦▪>#+]+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)])[ \t]+")
CLOSE = "\"'”“»«›‹’)]}*_ \t"
STOP = ".!?…"
#: What stands between the cells of a row: tags, bars and arrows, wide gaps, rows of dots, separators that no blank follows.
CELLS = re.compile(r"<[^<>\n]+>|[|»›→\t]|\.{4,}|[ \u00a0]{3,}|\",\"|(?<=[^\s\d])[;,](?=[\w<-]|\"\w)|(?<=\d)[;](?=[\w<-]|\"\w)")
GAP = re.compile(r"[ \u00a0]{2,}")
DOTS = re.compile(r"(?:^|\s)(?:\.{3}|…)(?=\s)")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”»’)\]*_]*\s+")
CLEAN = re.compile(r"[\"'“”„«»‘’(\[¿¡*_–—-]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"'“”»«’)\].,;:!?…*_–—-]*$")
NUMBER = re.compile(r"[(\[]?[+-]?\d[\d.,/:]*%?[)\].,;:!?]*$")
SENTENCE_WORDS = 5
#: Texts of which a greater share is repetition are no prose, whatever their sentences are like. The dominant bigram is left
#: out: in a text of few words one that stands twice is chance.
REPEATED = {
    "duplicate_line_share": 0.3, "duplicate_paragraph_share": 0.3, "top_3gram_share": 0.3, "top_4gram_share": 0.3,
    "repeated_3gram_share": 0.4, "repeated_5gram_share": 0.3,
}
#: Common words that are held in every task; longer lists are joined.
HELD_WORDS = 100_000

COLUMNS = (
    "n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, n_lines bigint, punctuated_line_share double, "
    "common_word_share double, duplicate_line_share double, duplicate_paragraph_share double, top_ngram_share double, top_3gram_share double, top_4gram_share double, "
    "repeated_3gram_share double, repeated_5gram_share double, n_prose_words bigint, prose_share double"
)


def _ends(line: str) -> str:
    """The last character that is no closing mark."""
    return line.rstrip(CLOSE)[-1:]


def _size(piece: str) -> int:
    """Words that are not numbers."""
    return sum(not w.isdigit() for w in WORD.findall(piece))


def _pairs(lines: list[str]) -> bool:
    """Whether most lines are a short name, a colon and a short value."""
    hits = 0
    for x in lines:
        a, colon, b = x.partition(": ")
        hits += bool(colon) and 1 <= _size(a) <= 4 and len(WORD.findall(b)) in range(1, 5) and _ends(x) not in STOP
    return len(lines) >= 3 and hits >= 0.6 * len(lines)


def _row(parts: list[str]) -> list[str]:
    """The cells of a row; a row of short cells without full stops holds no sentence, so its cells come out bare of them."""
    parts = [x for x in parts if x.strip()]
    sizes = sorted(_size(x) for x in parts)
    if len(parts) >= 4 and sizes[-1] <= 6 and sum(_ends(x) in STOP for x in parts) <= 0.2 * len(parts):
        return [piece for x in parts for piece in (" ".join(x.split()[k : k + 4]) for k in range(0, len(x.split()), 4))]
    return parts


def pieces(text: str) -> Iterator[str]:
    """Entries, cells and joined-up sentences of a text, in order."""
    lines = [x.strip() for x in text.splitlines()]
    full = [x for x in lines if x]
    shouted = sum(map(str.isupper, text)) > 0.6 * max(1, sum(map(str.isalpha, text)))
    separate = _pairs(full)
    columns = sum(len(re.findall(r"[ \u00a0]{3,}", x)) > 0 for x in full) >= 0.5 * len(full)
    held: list[str] = []
    blocks: list[str] = []
    after_row = False
    for line in lines:
        marked = MARK.match(line)
        body = line[marked.end() :] if marked else line
        first = next((ch for ch in body if ch.isalnum()), "")
        row = bool(CELLS.search(body))
        goes_on = (
            held and line and not marked and not separate and not row and not after_row
            and _ends(held[-1]) not in STOP
            and (not first.isupper() or shouted)
        )
        if not goes_on and held:
            blocks.append(" ".join(held))
            held = []
        if body:
            held.append(body)
        after_row = row
    if held:
        blocks.append(" ".join(held))
    for block in blocks:
        if columns:
            block = GAP.sub("   ", block)
        cells = CELLS.split(block)
        if separate:
            cells = [x for cell in cells for x in cell.split(": ")]
        for cell in _row(cells) if len(cells) > 1 else cells:
            parts = DOTS.split(cell)
            for part in _row(parts) if len(parts) > 1 else parts:
                yield from (s for s in SENTENCE_END.split(part) if s.strip())


def _listed(piece: str) -> bool:
    """A row of at least five short items set off by commas or the like."""
    if piece.count(",") + piece.count(";") < 4:
        return False
    items = [len(WORD.findall(x)) for x in re.split(r"[,;]\s", piece)]
    items = [n for n in items if n]
    return len(items) >= 5 and max(items) <= 4


def is_sentence(piece: str, words: list[str], common: frozenset[str]) -> bool:
    """Whether a piece reads as running text; its words are given in lower case."""
    n = len(words)
    if sum(not w.isdigit() for w in words) < SENTENCE_WORDS or _listed(piece):
        return False
    clean = numbers = other = 0
    for t in piece.split():
        if t.isalpha() or CLEAN.match(t):
            clean += 1
        elif NUMBER.match(t):
            numbers += 1
        elif WORD.search(t):
            other += 1
    if clean < 0.7 * (clean + other) or numbers > 0.4 * (clean + numbers + other):
        return False
    if len([w for w in words if len(w) == 1]) > 0.5 * n:
        return False
    share = len([w for w in words if w in common]) / n
    punctuated = piece[:1].isupper() and _ends(piece) in STOP
    if share > 0.9 and n >= (20 if punctuated else 8):
        return False
    if share < (0.05 if punctuated else 0.1):
        return False
    return n < 10 or len(set(words)) >= 0.3 * n


def _share(n: float, of: float) -> float:
    return n / of if of else 0.0


def _covered(words: list[str], grams: list[tuple[str, ...]], n: int) -> float:
    """The share of the words' letters that stand in n-grams seen earlier in the text."""
    seen: set[tuple[str, ...]] = set()
    marked = bytearray(len(words))
    for i, gram in enumerate(grams):
        if gram in seen:
            marked[i : i + n] = b"\1" * n
        seen.add(gram)
    return _share(sum(len(w) for w, m in zip(words, marked) if m), sum(map(len, words)))


def _repetition(words: list[str]) -> tuple[float, ...]:
    """Letters' shares of the dominant 2-, 3- and 4-gram, and of repeated 3- and 5-grams; an n-gram that stands once has none.

    A text without a repeated bigram repeats nothing longer either.
    """
    length = sum(map(len, words))
    top, covered = {2: 0.0, 3: 0.0, 4: 0.0}, {3: 0.0, 5: 0.0}
    for n in (2, 3, 4, 5):
        grams = list(zip(*[words[k:] for k in range(n)]))
        counts = Counter(grams)
        if len(counts) == len(grams):
            break
        if n in top:
            best = max(k * sum(map(len, g)) for g, k in counts.items() if k > 1)
            top[n] = min(1.0, _share(best, length))
        if n in covered:
            covered[n] = _covered(words, grams, n)
    return (*top.values(), *covered.values())


def statistics(text: str | None, common: frozenset[str], own: frozenset[str] | None = None) -> tuple:
    """The values of COLUMNS for one text; a NULL text has the same statistics as an empty one.

    `common` are the common words of all languages, by which sentences are told whatever language a text is labelled with;
    `own` those of the text's language, for the share that is reported (None: all of them).
    """
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    length = sum(map(len, words))
    visible = sum(map(len, text.split()))
    symbols = visible - length
    words = [w.lower() for w in words]
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    paragraphs = [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()] if len(lines) > 1 else lines
    repeated = lambda xs: 0.0 if len(set(xs)) == len(xs) else _share(sum(len(x) * (k - 1) for x, k in Counter(xs).items()), sum(map(len, xs)))
    counted = common if own is None else own
    seen: set[str] = set()
    prose = 0
    for piece in pieces(text):
        of = WORD.findall(piece.lower())
        key = " ".join(of)
        if key not in seen and is_sentence(piece, of, common):
            prose += len(of)
        seen.add(key)
    return (
        len(text), n, _share(length, n), _share(symbols, visible), len(lines), _share(sum(_ends(x) in STOP for x in lines), len(lines)),
        _share(len([w for w in words if w in counted]), n), repeated(lines), repeated(paragraphs), *_repetition(words), prose, _share(prose, n),
    )


def _word_sets(common_words: DataFrame, word: str, lang: str | None) -> tuple[frozenset[str], dict[str, frozenset[str]]]:
    by: dict[str, set[str]] = {}
    for r in common_words.select(F.lower(word).alias("w"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("l")).where("w IS NOT NULL").distinct().collect():
        by.setdefault(r.l or "", set()).add(r.w)
    return frozenset().union(*by.values()), {k: frozenset(v) for k, v in by.items() if k}


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, w): each word of a text once."""
    for b in batches:
        pairs = [(r, w) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(WORD.findall((t or "").lower()))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.string())], names=["r", "w"])


def quality(documents: DataFrame, doc_id: str, text: str, common_words: DataFrame, lang: str | None = None, word: str = "word", word_lang: str = "lang", held_words: int = HELD_WORDS) -> DataFrame:
    """(doc_id, COLUMNS..., is_prose): statistics of every text, in one narrow stage.

    is_prose is NULL for empty, blank and NULL texts, which are neither; else it tells whether at least half of the words
    stand in running sentences and no share of REPEATED is exceeded. A text of symbols alone is no prose. `lang` is the
    column of the documents' languages, by which common_word_share picks its words. Tables of up to held_words common words go
    to every task; of a longer one each text is sent the words that it has, by a join. Rows that repeat a doc_id are judged each
    by itself.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.float64() if " double" in x else pa.int64() for x in COLUMNS.split(", ")]
    held = common_words.limit(held_words + 1).count() <= held_words
    common, by_lang = _word_sets(common_words, word, word_lang if lang else None) if held else (frozenset(), {})
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    if not held:
        base = cut_lineage(base.withColumn("r", F.monotonically_increasing_id()))  # written, so that the numbers stay
        known = common_words.select(F.lower(word).alias("w"), (F.col(word_lang) if lang else F.lit(None)).cast("string").alias("l")).where("w IS NOT NULL").distinct()
        own = base.select("r", "text").mapInArrow(_own_words, "r bigint, w string").join(known, "w").groupBy("r").agg(F.collect_list("w").alias("ws"), F.collect_list(F.coalesce("l", F.lit(""))).alias("ls"))
        base = base.join(own, "r", "left").select("doc_id", "text", "lang", "ws", "ls")
        languages = {r.l for r in known.select("l").where("l IS NOT NULL").distinct().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            if held:
                rows = [statistics(t, common, by_lang.get(x)) for t, x in zip(texts, langs)]
            else:
                rows = []
                for t, x, ws, ls in zip(texts, langs, b.column(3).to_pylist(), b.column(4).to_pylist()):
                    own = frozenset(w for w, y in zip(ws or (), ls or ()) if y == x)
                    rows.append(statistics(t, frozenset(ws or ()), own if x in languages else None))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types)]], names=["doc_id", *names])

    out = base.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
    prose = reduce(lambda a, b: a & b, [F.col(c) <= most for c, most in REPEATED.items()], F.col("prose_share") >= 0.5)
    return out.withColumn("is_prose", F.when((F.col("n_words") == 0) & (F.col("symbol_ratio") == 0), None).otherwise(prose))
