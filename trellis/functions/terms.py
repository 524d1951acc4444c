"""RDF terms: a Python value class and Column accessors over canonical N-Triples strings.

A term travels as one string: ``<iri>``, ``_:label``, ``"text"``, ``"text"@lang`` or ``"text"^^<datatype>``.
Every accessor is built from JVM expressions and gives NULL for NULL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE_RE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_TERM_RE = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?', re.S)
#: Stands for an escaped backslash while the other escapes are resolved; a noncharacter, so no text holds it.
_HOLD = "\uFDD0"


def escape_text(text: str) -> str:
    return "".join(_ESCAPES.get(ch, ch) for ch in text)


def unescape_text(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2]
        return chr(int(code, 16)) if code else _UNESCAPES.get(m[3], m[3])

    return _ESCAPE_RE.sub(one, text)


@dataclass(frozen=True)
class Term:
    """kind is var, ndv (non-distinguished variable), iri, bnode or lit."""

    kind: str
    value: str
    lang: str | None = None
    dt: str | None = None

    @property
    def is_var(self) -> bool:
        return self.kind in ("var", "ndv")

    @property
    def nt(self) -> str:
        if self.kind == "iri":
            return f"<{self.value}>"
        if self.kind == "bnode":
            return f"_:{self.value}"
        if self.kind == "var":
            return f"?{self.value}"
        if self.kind == "ndv":
            return f"?__ndv_{self.value}"
        text = f'"{escape_text(self.value)}"'
        return text + (f"@{self.lang}" if self.lang else f"^^<{self.dt}>" if self.dt else "")

    def __str__(self) -> str:
        return self.nt

    @property
    def number(self) -> int | float | None:
        """The numeric value of integer, decimal, float and double literals that can be read, else None."""
        if self.kind != "lit" or not self.dt or not self.dt.startswith(XSD):
            return None
        name = self.dt[len(XSD) :]
        try:
            return int(self.value) if name == "integer" else float(self.value) if name in ("float", "double", "decimal") else None
        except ValueError:
            return None

    @property
    def ebv(self) -> bool | None:
        """Effective boolean value; None is a type error."""
        if self.kind != "lit":
            return None
        if not self.dt or self.dt == XSD + "string":
            return self.value != ""
        if self.dt == XSD + "boolean":
            return self.value == "true"
        return bool(self.number) if self.number is not None else False

    @property
    def order_key(self) -> tuple:
        return ({"bnode": 0, "iri": 1, "lit": 2, "var": 3, "ndv": 3}[self.kind], self.value)


def var(name: str) -> Term:
    return Term("var", name)


def iri(value: str) -> Term:
    return Term("iri", value)


def bnode(label: str) -> Term:
    return Term("bnode", label)


def lit(value: str, lang: str | None = None, dt: str | None = None) -> Term:
    return Term("lit", value, lang, dt)


def parse_term(text: str) -> Term:
    """Read one N-Triples term, or ?name as a variable. Raises ValueError for anything else."""
    if text.startswith("?") or text.startswith("$"):
        return var(text[1:])
    if text.startswith("<") and text.endswith(">"):
        return iri(unescape_text(text[1:-1]))
    if text.startswith("_:"):
        return bnode(text[2:])
    if m := _TERM_RE.fullmatch(text):
        return lit(unescape_text(m[1]), m[2], m[3])
    raise ValueError(f"not an RDF term: {text!r}")


# ---------------------------------------------------------------- columns


def _c(t: Column | str) -> Column:
    return F.col(t) if isinstance(t, str) else t


def is_iri(t: Column | str) -> Column:
    return _c(t).startswith("<")


def is_bnode(t: Column | str) -> Column:
    return _c(t).startswith("_:")


def is_lit(t: Column | str) -> Column:
    return _c(t).startswith('"')


def raw_text(t: Column | str) -> Column:
    """The literal's text as written, still escaped; NULL for other kinds. No regular expression is run."""
    t = _c(t)
    tail = F.length(F.substring_index(t, '"', -1))
    return F.when(is_lit(t), F.substr(t, F.lit(2), F.length(t) - F.lit(2) - tail))


def unescape(text: Column) -> Column:
    """Resolve N-Triples escapes inside a text column, JVM-side; texts without a backslash pass untouched."""
    held = F.replace(text, F.lit("\\\\"), F.lit(_HOLD))
    for letter, ch in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'")):
        held = F.replace(held, F.lit("\\" + letter), F.lit(ch))
    codes = F.array_distinct(F.regexp_extract_all(held, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})"), F.lit(1)))
    char = lambda x: F.decode(F.unhex(F.lpad(F.substr(x, F.lit(3)), 8, "0")), "UTF-32")
    done = F.aggregate(codes, held, lambda acc, x: F.replace(acc, x, char(x)))
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.replace(done, F.lit(_HOLD), F.lit("\\")))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for ch, to in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(ch), F.lit(to))
    return out


def kind_of(t: Column | str) -> Column:
    return F.when(is_iri(t), "iri").when(is_bnode(t), "bnode").when(is_lit(t), "lit")


def value_of(t: Column | str) -> Column:
    """IRI without brackets, label without `_:`, or the literal's unescaped text."""
    t = _c(t)
    return (
        F.when(is_iri(t), F.substr(t, F.lit(2), F.length(t) - F.lit(2)))
        .when(is_bnode(t), F.substr(t, F.lit(3)))
        .when(is_lit(t), unescape(raw_text(t)))
    )


def _tail(t: Column | str) -> Column:
    return F.substring_index(_c(t), '"', -1)


def lang_of(t: Column | str) -> Column:
    tail = _tail(t)
    return F.when(is_lit(t) & tail.startswith("@"), F.substr(tail, F.lit(2)))


def dt_of(t: Column | str) -> Column:
    tail = _tail(t)
    return F.when(is_lit(t) & tail.startswith("^^<"), F.substr(tail, F.lit(4), F.length(tail) - F.lit(4)))


#: Datatypes of numbers.
NUMERIC = [XSD + n for n in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]


def num_of(t: Column | str) -> Column:
    """DOUBLE value of a numeric literal; NULL when the datatype is not numeric or the text cannot be read."""
    return F.when(dt_of(t).isin(NUMERIC), raw_text(t).try_cast("double"))


def ebv_of(t: Column | str) -> Column:
    """Effective boolean value of a term; NULL for IRIs, blank nodes and unbound."""
    t, text, dt = _c(t), raw_text(t), dt_of(t)
    return F.when(
        is_lit(t),
        F.when(dt.isNull() | (dt == XSD + "string"), text != "")
        .when(dt == XSD + "boolean", text == "true")
        .otherwise(F.coalesce(num_of(t) != 0, F.lit(False))),
    )


def kind_rank(t: Column | str) -> Column:
    return F.when(is_bnode(t), 0).when(is_iri(t), 1).when(is_lit(t), 2)


def order_keys(t: Column | str, ascending: bool = True) -> list[Column]:
    """Sort keys of the term order: blank nodes, IRIs, literals, then by value; equal values fall back to the term."""
    keys = [kind_rank(t), value_of(t), _c(t)]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]


def same_value(a: Column, b: Column) -> Column:
    """The lexical rule of FILTER `=`: same kind and same value, language and datatype ignored."""
    return (kind_rank(a) == kind_rank(b)) & (value_of(a) == value_of(b))


def make_iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def make_lit(value: Column, dt: str | None = None, lang: Column | None = None) -> Column:
    text = F.concat(F.lit('"'), escape(value), F.lit('"'))
    if lang is not None:
        return F.when(lang.isNull(), text).otherwise(F.concat(text, F.lit("@"), lang))
    return F.concat(text, F.lit(f"^^<{dt}>")) if dt else text


def explode_term(df, column: str, prefix: str = ""):
    """Add kind, value, lang and dt of a term column under the given prefix."""
    parts = {"kind": kind_of(column), "value": value_of(column), "lang": lang_of(column), "dt": dt_of(column)}
    return df.withColumns({prefix + k: v for k, v in parts.items()})


def triple_hash(s: str = "s", p: str = "p", o: str = "o") -> Column:
    """XOR of the term hashes: equal for any order of the three terms."""
    return F.xxhash64(s).bitwiseXOR(F.xxhash64(p)).bitwiseXOR(F.xxhash64(o))
