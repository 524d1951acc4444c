"""N-Triples lines: permissive reading with a reason for every line that is no statement, and writing.

Reading is in two steps. A permissive pass under the explicit schema (s, p, o) either matches a whole line or keeps its
raw text as corrupt; a second pass looks at corrupt lines only, and tells quoting faults, wrong term counts and bad terms
apart; typed literals that parsed are then checked by casts. All of it is JVM expressions, and no pattern repeats a group,
so that a line of any length is matched without deep recursion: escapes are first overwritten, length for length, with
characters that an IRI may (code points) or may not (letters) hold, after which a literal is one character class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import terms as T

# Fixed values of the N-Triples 1.1 grammar.
_BASE = (
    "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}\\x{370}-\\x{37D}\\x{37F}-\\x{1FFF}\\x{200C}-\\x{200D}"
    "\\x{2070}-\\x{218F}\\x{2C00}-\\x{2FEF}\\x{3001}-\\x{D7FF}\\x{F900}-\\x{FDCF}\\x{FDF0}-\\x{FFFD}\\x{10000}-\\x{EFFFF}"
)
_CHARS = _BASE + "_:0-9\\-\\x{B7}\\x{300}-\\x{36F}\\x{203F}-\\x{2040}"
IRI = '<[A-Za-z][A-Za-z0-9+.\\-]*:[^\\x{00}-\\x{20}<>"{}|^`\\\\]*>'
BNODE = f"_:[{_BASE}_:0-9](?:[{_CHARS}.]*[{_CHARS}])?"
LANG = "@[A-Za-z]+[A-Za-z0-9\\-]*"
LITERAL = f'"[^"\\\\\\n\\r]*"(?:{LANG}|\\^\\^{IRI})?'
PREFIX = f"^[ \\t]*(?:{IRI}|{BNODE})[ \\t]+{IRI}[ \\t]+"
OBJECT = f"(?:{IRI}|{BNODE}|{LITERAL})"
#: A whole line: what comes before the object, the object, the rest.
STATEMENT = f"({PREFIX})({OBJECT})[ \\t]*\\.[ \\t]*(?:#[^\\n\\r]*)?\\r?$"
NOTHING = "^[ \\t]*(?:#[^\\n\\r]*)?\\r?$"
BAD_LANG = '"@(?:[A-Za-z]+[0-9][A-Za-z0-9]*|[A-Za-z0-9\\-]*--[A-Za-z0-9\\-]*|[A-Za-z0-9\\-]*-)$'

ECHAR = "\\\\[tbnrf\"'\\\\]"
UCHAR4, UCHAR8 = "\\\\u[0-9A-Fa-f]{4}", "\\\\U(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{4}"

ZONE = "(?:Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
YEAR = "-?(?:[1-9][0-9]{3}[0-9]*|0[0-9]{3})"
#: Lexical spaces of the checked datatypes; dates must exist besides.
LEXICAL = {
    "integer": "^[+-]?[0-9]+$",
    "decimal": "^[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)$",
    "double": "^(?:[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "boolean": "^(?:true|false|0|1)$",
    "date": f"^{YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]){ZONE}$",
    "dateTime": f"^{YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\\.[0-9]+)?|24:00:00(?:\\.0+)?){ZONE}$",
}

REASONS = {
    "missing_line": "the line is NULL",
    "unbalanced_quote": "a literal is opened and not closed",
    "unclosed_iri": "an IRI is opened and not closed",
    "missing_stop": "three terms without a full stop",
    "too_few_terms": "fewer than three terms",
    "too_many_terms": "more than three terms, or text after the full stop",
    "bad_escape": "an escape that the grammar does not know",
    "bad_subject": "the first term may not be a subject",
    "bad_predicate": "the second term may not be a predicate",
    "bad_object": "the third term is no IRI, blank node or literal",
    "bad_language": "a language tag outside the grammar",
    "bad_value": "text outside the lexical space of its datatype, or a date that does not exist",
}


def _masked(line: Column) -> Column:
    """The line with each escape overwritten by as many characters."""
    masked = F.regexp_replace(line, ECHAR, "\u0001\u0001")
    masked = F.regexp_replace(masked, UCHAR4, "uuuuuu")
    return F.when(F.instr(line, "\\") == 0, line).otherwise(F.regexp_replace(masked, UCHAR8, "uuuuuuuuuu"))


def date_exists(text: Column) -> Column:
    """Whether the leading [-]Y-MM-DD is a day of the calendar; years repeat every 400, so any year can be held."""
    day = F.regexp_extract(text, "([0-9]{4})-([0-9]{2}-[0-9]{2})", 2)
    year = F.regexp_extract(text, "([0-9]{4})-([0-9]{2}-[0-9]{2})", 1).try_cast("int")
    return F.concat((year % 400 + 2000).cast("string"), F.lit("-"), day).try_cast("date").isNotNull()


def valid_lexical(text: Column, dt: Column) -> Column:
    """True unless dt is one of the checked XSD types and text lies outside its lexical space."""
    ok = F.lit(True)
    for name, pattern in LEXICAL.items():
        fits = text.rlike(pattern)
        if name.startswith("date"):
            fits = fits & date_exists(text)
        ok = F.when(dt == T.XSD + name, fits).otherwise(ok)
    return ok


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _reason(x: Column) -> Column:
    """Why a corrupt line (raw, masked) is no statement: quoting first, then the number of terms, then the terms themselves."""
    m = x["masked"]
    words = lambda text: F.split(F.trim(F.regexp_replace(text, "[ \\t]+", " ")), " ")
    # literals and IRIs out of the way; what is left tells the shape
    bare = F.regexp_replace(F.regexp_replace(m, '"[^"]*"[^ \\t."]*', "L"), '<[^<>"]*>', "I")

    def shape(cut: Column) -> Column:
        return _struct(cut=cut, body=F.regexp_replace(cut, "[ \\t]*\\.[ \\t]*(?:#.*)?$", ""))

    def by_number(y: Column) -> Column:
        n = F.size(words(y["body"]))
        return F.when((n == 3) & (y["cut"] == y["body"]), "missing_stop").when(n < 3, "too_few_terms").when(n > 3, "too_many_terms")

    def by_quoting(b: Column) -> Column:
        return (
            F.when(x["raw"].isNull(), "missing_line").when(F.instr(b, '"') > 0, "unbalanced_quote").when(F.instr(b, "<") > 0, "unclosed_iri")
            .otherwise(_let(_let(F.regexp_replace(b, "[ \\t\\r]+(?:#.*)?$", ""), shape), by_number))
        )

    def by_terms(tokens: Column) -> Column:
        first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
        return (
            F.when(F.instr(m, "\\") > 0, "bad_escape").when(~first.rlike(f"^(?:{IRI}|{BNODE})$"), "bad_subject").when(~second.rlike(f"^{IRI}$"), "bad_predicate")
            .when(m.rlike('"@'), "bad_language").otherwise("bad_object")
        )

    return F.coalesce(_let(bare, by_quoting), _let(words(m), by_terms))


def parsed(raw: Column) -> Column:
    """A line as (s, p, o, reason): of a statement the terms, of a failure the reason, of anything else nothing."""
    none = F.lit(None).cast("string")

    def statement(x: Column, lead: Column) -> Column:
        held = F.length(F.regexp_extract(x["masked"], STATEMENT, 2))

        def terms(y: Column) -> Column:
            head = F.split(F.trim(F.regexp_replace(F.substr(x["raw"], F.lit(1), y["lead"]), "[ \\t]+", " ")), " ")
            return _struct(head=head, o=F.substr(x["raw"], y["lead"] + 1, y["held"]))

        def checked(z: Column) -> Column:
            o = z["o"]
            bad_value = _let(_struct(text=T.raw_text(o), dt=T.dt_of(o)), lambda w: F.when(w["dt"].isin([T.XSD + n for n in LEXICAL]), ~_let(T.unescape(w["text"]), lambda t: valid_lexical(t, w["dt"]))))
            why = F.when(F.coalesce(bad_value, F.lit(False)), "bad_value").when(o.rlike(BAD_LANG), "bad_language")
            return _let(why, lambda r: F.when(r.isNull(), _struct(s=F.get(z["head"], F.lit(0)), p=F.get(z["head"], F.lit(1)), o=o, reason=none)).otherwise(_struct(s=none, p=none, o=none, reason=r)))

        return _let(_let(_struct(lead=lead, held=held), terms), checked)

    def line(x: Column) -> Column:
        return _let(F.length(F.regexp_extract(x["masked"], STATEMENT, 1)), lambda lead: by_shape(x, lead))

    def by_shape(x: Column, lead: Column) -> Column:
        nothing = F.coalesce(x["raw"].rlike(NOTHING), F.lit(False))
        return F.when(F.coalesce(lead > 0, F.lit(False)), statement(x, lead)).otherwise(_struct(s=none, p=none, o=none, reason=F.when(~nothing, _reason(x))))

    return _let(_struct(raw=raw, masked=_masked(raw)), line)


def read_permissive(lines: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every input line as (keep..., s, p, o, corrupt, reason).

    A statement has s, p and o; an empty, blank or comment line has nothing set; any other line has its raw text in
    `corrupt` and a reason out of REASONS. A NULL line is corrupt with an empty text. Columns of the input beyond `keep`
    and `text` are dropped, so that names such as s or reason in it cannot clash. One narrow stage, no shuffle.
    """
    df = lines.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("raw"))
    df = df.withColumn("x", parsed(F.col("raw")))
    return df.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)],
        *[F.col(f"x.{c}").alias(c) for c in ("s", "p", "o")],
        F.when(F.col("x.reason").isNotNull(), F.coalesce("raw", F.lit(""))).alias("corrupt"),
        F.col("x.reason").alias("reason"),
    )


def _held(condition: Column) -> Column:
    """The condition, kept above the reading, which would else be done for it and again for the result; by way of that it is
    marked as not repeatable, though it always says the same."""
    return condition | (F.rand(0) < 0)


def statements(read: DataFrame) -> DataFrame:
    """The lines of read_permissive that hold a statement."""
    return read.where(_held(F.col("s").isNotNull())).drop("corrupt", "reason")


def rejects(read: DataFrame) -> DataFrame:
    """The lines of read_permissive that failed, with raw text and reason."""
    return read.where(_held(F.col("reason").isNotNull())).drop("s", "p", "o")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, s, p, o, corrupt, reason) of every line of N-Triples files, which split by line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    return read_permissive(lines, "value", ["file"])


def read_ntriples(spark: SparkSession, path: str, skolemize: bool = False) -> DataFrame:
    """Statements of N-Triples files, see named_apart; their other lines are those of rejects(read_files(...))."""
    return named_apart(statements(read_files(spark, path)), skolemize)


def named_apart(out: DataFrame, skolemize: bool = True) -> DataFrame:
    """(s, p, o) of statements with their file; with skolemize, blank labels become unique per file."""
    if skolemize:
        named = lambda c: F.when(T.is_bnode(c), F.concat(F.lit("_:b"), F.hex(F.xxhash64("file")), F.lit("x"), F.substr(c, F.lit(3)))).otherwise(F.col(c))
        out = out.withColumns({"s": named("s"), "o": named("o")})
    return out.select("s", "p", "o")


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode(mode).text(path)
