"""Leaks, mixes and text statistics against brute force and hand-made cases."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trellis.llm import leaks, mixing, quality

# ---------------------------------------------------------------- leaks


def _distance(pattern, text):
    """Least edit distance of the pattern to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        assert leaks.myers_best(a, b * 2) == _distance(a, b * 2)
    long = [str(i) for i in range(200)]
    assert leaks.myers_best(long, ["x", *long[:100], "y", *long[100:]]) == 1


def _brute(docs, items, window, edits):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        for i, x in items:
            v = leaks.words(x)
            if any(_distance(v[k : k + window], w) <= edits for k in range(len(v) - window + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("window, edits", [(10, 0), (15, 1), (12, 2)])
def test_leaks_equal_brute_force(spark, window, edits):
    rnd = random.Random(window)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, window, 25, 40])))) for i in range(8)]
    docs = []
    for d in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if d % 2:
            v = items[rnd.randrange(8)][1].split()
            cut = v[rnd.randrange(0, 4) :][: rnd.randrange(6, 22)]
            for _ in range(rnd.randrange(0, 3)):
                k = rnd.randrange(max(1, len(cut)))
                rnd.choice([lambda: cut.insert(k, "new"), lambda: cut.__setitem__(slice(k, k + 1), []), lambda: cut.__setitem__(slice(k, k + 1), ["alt"])])()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((d, "; ".join(x.upper() if rnd.random() < 0.3 else x for x in w)))
    dd = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaks(dd, "doc_id", "text", ii, "item_id", "text", window, edits)
    want = _brute(docs, items, window, edits)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_leaks_with_nulls_long_texts_repeats_and_blocks(spark, monkeypatch):
    passage = " ".join(f"tok{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, "x " * 300_000 + passage), (4, passage), (4, passage), (5, passage.replace("tok5", "other")), (6, " ".join(passage.split()[:9]))]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(10, passage), (11, None), (12, ""), (13, "too short"), (14, passage)], "item_id long, text string")
    want = {(d, i) for d in (3, 4) for i in (10, 14)}
    for size in (leaks.BLOCK_BYTES, 40):
        monkeypatch.setattr(leaks, "BLOCK_BYTES", size)
        got = leaks.leaks(dd, "doc_id", "text", ii, "item_id", "text", 10).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == 4
    assert leaks.leaks(dd, "doc_id", "text", ii.where("false"), "item_id", "text", 10).count() == 0
    assert leaks.leaks(dd.where("false"), "doc_id", "text", ii, "item_id", "text", 10).count() == 0
    with pytest.raises(ValueError):
        leaks.LeakFinder([(1, passage)], 3, 4)


# ---------------------------------------------------------------- mixing


def _seat_by_seat(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i, w in enumerate(weights) if w > 0 and got[i] < caps[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportionment_equals_seat_by_seat():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(1, 8)
        weights = [Fraction(rnd.choice([0, 1, 1, 3, 7, 20]), 10) for _ in range(n)]
        caps = [rnd.choice([0, 1, 5, 1000]) for _ in range(n)]
        seats = rnd.randrange(0, 120)
        assert mixing.sainte_lague(weights, seats, caps) == _seat_by_seat(weights, seats, caps)


def test_mix_reaches_shares_within_caps(spark):
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["a"] * 6 + ["b"] * 3 + ["c"]), "word " * rnd.randrange(20, 80)) for i in range(3000)] + [(9000, None, "x"), (9001, "z", "x"), (9002, "a", None), (9003, "a", "")]
    dd = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(dd, "doc_id", "source", "text", targets, block_tokens=512, shard_tokens=8192)
    shares = {r.source: r for r in m.shares.collect()}
    assert {s for s, r in shares.items() if r.beyond_cap} == {"c"} and shares["none"].drawn_tokens == 0
    rows = m.rows.collect()
    cap = {"a": 1, "b": 3, "c": 2}
    drawn = defaultdict(int)
    for r in rows:
        assert 1 <= r.copies <= cap[r.source]
        drawn[r.source] += r.copies * r.n_tokens
    assert len({r.doc_id for r in rows}) == len(rows)
    total = sum(drawn.values())
    for s in "abc":
        assert shares[s].drawn_tokens == drawn[s] and shares[s].reached_share == pytest.approx(drawn[s] / total)
    assert drawn["c"] == 2 * shares["c"].n_tokens
    assert drawn["a"] / drawn["b"] == pytest.approx(0.75, rel=0.08)
    again = {(r.doc_id, r.copies) for r in mixing.mix(dd.repartition(7), "doc_id", "source", "text", targets, block_tokens=512, shard_tokens=8192).rows.collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    other = {(r.doc_id, r.copies) for r in mixing.mix(dd, "doc_id", "source", "text", targets, seed=8, block_tokens=512, shard_tokens=8192).rows.collect()}
    assert other != again


def test_a_mix_of_smaller_total_holds_every_share(spark):
    rnd = random.Random(8)
    dd = spark.createDataFrame([(i, rnd.choice("aaaaaabbbc"), "word " * rnd.randrange(20, 80)) for i in range(4000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(dd, "doc_id", "source", "text", targets, fit="shares")
    got = {r.source: r for r in m.shares.collect()}
    assert all(abs(r.reached_share - r.target_share) < 0.01 for r in got.values())
    assert got["c"].drawn_tokens == pytest.approx(2 * got["c"].n_tokens, rel=0.01) and got["c"].quota_blocks <= got["c"].cap_blocks
    small = mixing.mix(dd, "doc_id", "source", "text", targets, fit="shares", total_tokens=20_000)
    assert sum(r.drawn_tokens for r in small.shares.collect()) == pytest.approx(20_000, rel=0.05)
    with pytest.raises(ValueError):
        mixing.mix(dd, "doc_id", "source", "text", targets, fit="other")


def test_the_apportionment_decides_which_sources_fall_short(spark, monkeypatch):
    dd = spark.createDataFrame([(i, "ab"[i % 10 == 0], "word " * 30) for i in range(500)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    found = lambda: {r.source for r in mixing.mix(dd, "doc_id", "source", "text", targets).shares.where("beyond_cap").collect()}
    assert found() == {"b"}
    monkeypatch.setattr(mixing, "sainte_lague", lambda weights, seats, caps: [0] * len(weights))
    assert found() == set()


@pytest.mark.parametrize("most", [99, 100, 101])
def test_near_a_cap_the_tokens_decide(most):
    assert mixing._asks_too_much(10, Fraction(1, 10), 1000, 10, most, 7) == (100 > most)


def test_mix_of_empty_tables(spark):
    dd = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(dd, "doc_id", "source", "text", targets)
    assert m.rows.count() == 0 and [(r.drawn_tokens, r.beyond_cap) for r in m.shares.collect()] == [(0, False)]
    one = spark.createDataFrame([(1, "a", "some text here")], "doc_id long, source string, text string")
    assert mixing.mix(one, "doc_id", "source", "text", targets.where("false")).shares.count() == 0
    assert [r.copies for r in mixing.mix(one, "doc_id", "source", "text", targets).rows.collect()] == [1]


# ---------------------------------------------------------------- quality

COMMON = frozenset("the of and to a in is was for on".split())
SENTENCE = "The drun of wood was in a troudrick for the kid and sool."
PROSE = {
    "plain": SENTENCE,
    "wrapped": "The drun of wood was\nin a troudrick for the\nkid and sool. A stool of\nthe team was on jool.",
    "shouted": SENTENCE.upper(),
    "lower": SENTENCE.lower().rstrip("."),
    "bulleted sentences": f"- {SENTENCE}\n- The team of wool was on the grist and in sool.",
    "dialogue": f"– {SENTENCE}\n– To the wool of hames in a drun!",
    "cut off": "The drun of wood was in a troudrick for th",
    "unknown words": "Kolmun tarra the venik soola brim. Dalor kenta a mirun fos tel.",
    "wide gaps": "The  drun  of  wood  was  in  a  troudrick  for  the  kid.",
    "sentence with a short list": f"{SENTENCE} {SENTENCE.replace('wood', 'wool')}\n- drun\n- kid",
}
JUNK = {
    "list": "- drun of wood\n- the kid\n- a sool for team\n- wool",
    "numbered": "1. drun in wood\n2. kid\n3. the sool of team",
    "titles": "Drun Of Wood\nThe Kid\nSool\nTeam And Wool",
    "pairs": "drun of: wood\nthe kid: sool\nteam is: wool\nhames: the stool",
    "csv": '"the drun","4","a kid"\n"sool","-","for wood"\n"of team","7","wool"',
    "semicolons": "the drun;4;a kid\nsool;-;for wood\nof team;7;wool",
    "columns": "the drun      4        a kid\nsool          -        for wood\nof team       7        wool",
    "leaders": "drun of wood ........ 12\nthe kid ......... 15\nsool of a team ....... 20",
    "bars": "Drun | Wood | The Kid | Sool | Of Team | Wool",
    "commas": "the drun, a kid of wood, sool, team for wool, hames, stool, a grist, the brim",
    "repeated words": "niness sted " * 15,
    "repeated sentence": f"{SENTENCE} " * 6,
    "only small words": "the of and to a in is was for on the of a and to in is was on for the of",
    "only long words": "brekafun dram caibreaness dokeness codeaprut clilodral goler gaidrethoon hooming proocat kabrid",
    "numbers": "21657 238594 45 188857 0 22 1466 58 34 75515 910 38",
    "spaced letters": "d r u n o f w o o d w a s i n a k i d",
    "code": "drun.wood = {{the_kid}}; // %f\nsool.team = {{of_wool}}; // %d",
    "symbols": "{~c-bI%{=%== Il l%O#@I~b&e*d/@#~O$&e#e[@Icc%/aO|+b{<#",
    "tags": '<td class="x">for the kid</td>\n<div class="y">a drun of wood</div>',
    "only symbols": "%$ #@ !! ~~",
    "short sentences": "Drun of wood.\nKid.\nThe sool.\nTeam.",
}


@pytest.mark.parametrize("name", PROSE)
def test_prose(name):
    assert quality.statistics(PROSE[name], COMMON)[-1] >= 0.5


@pytest.mark.parametrize("name", JUNK)
def test_junk(name):
    assert quality.statistics(JUNK[name], COMMON)[-1] < 0.5


def test_statistics_of_a_small_text():
    text = "The kid, the drun!\n\nSool: 12\n\nSool: 12"
    got = dict(zip([c.split()[0] for c in quality.COLUMNS.split(", ")], quality.statistics(text, COMMON)))
    assert got["n_words"] == 8 and got["n_lines"] == 3 and got["n_chars"] == len(text)
    assert got["mean_word_length"] == pytest.approx(25 / 8) and got["punctuated_line_share"] == pytest.approx(1 / 3)
    assert got["common_word_share"] == pytest.approx(2 / 8) and got["symbol_ratio"] == pytest.approx(4 / 29)
    assert got["duplicate_line_share"] == got["duplicate_paragraph_share"] == pytest.approx(8 / 34)
    assert got["top_ngram_share"] == pytest.approx(12 / 25)


def test_joined_common_words_equal_held_ones(spark, rows):
    docs = [(1, "en", SENTENCE), (2, "de", SENTENCE), (3, "xx", SENTENCE), (4, None, JUNK["list"]), (5, "en", None), (6, "de", "")]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("de", "der"), ("de", "und"), (None, "kid")], "lang string, word string")
    held = quality.quality(df, "doc_id", "text", common, "lang")
    assert rows(held) == rows(quality.quality(df, "doc_id", "text", common, "lang", held_words=3))
    share = {r.doc_id: r.common_word_share for r in held.collect()}
    assert share[1] == pytest.approx(8 / 13) and share[2] == 0 and share[3] == pytest.approx(9 / 13)


def test_templates_are_no_prose(spark):
    lines = "\n".join(f"Please accept the cookies on this page to read part {i} of the text now." for i in range(40))
    df = spark.createDataFrame([(1, lines), (2, SENTENCE)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df, "doc_id", "text", spark.createDataFrame([(w,) for w in COMMON], "word string")).collect()}
    assert not got[1].is_prose and got[2].is_prose and got[1].top_ngram_share > 0.15 and got[2].top_4gram_share == 0


def test_quality_with_nulls_empties_repeats_and_long_texts(spark):
    long = SENTENCE * 20_000
    docs = [(1, None), (2, ""), (3, " \n "), (4, "%%%"), (5, SENTENCE), (5, SENTENCE), (6, long), (7, "word" * 100_000), (None, SENTENCE)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None), ("de", "the")], "lang string, word string")
    got = quality.quality(df, "doc_id", "text", common).collect()
    verdict = defaultdict(list)
    for r in got:
        verdict[r.doc_id].append(r.is_prose)
    assert verdict[1] == verdict[2] == verdict[3] == [None] and verdict[4] == [False] and verdict[5] == [True, True] and verdict[None] == [True] and verdict[7] == [False]
    assert [r.n_words for r in got if r.doc_id == 6] == [len(quality.WORD.findall(long))]
    assert quality.quality(df.where("false"), "doc_id", "text", common).count() == 0
    assert quality.quality(df, "doc_id", "text", common.where("false")).count() == len(docs)
