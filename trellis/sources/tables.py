"""Relational tables as RDF: a direct mapping, and a store that answers patterns from the tables themselves.

Each row is a subject <base/table/key>, each cell that is not NULL a triple with predicate <base/table#column>, each
reference besides a triple <base/table#ref-column> to the other row's IRI, and each row has a type triple. The mapped store
turns patterns into column selections: constants become conditions on raw columns, which reach the Parquet scan, patterns
of one subject are one scan without a join, and terms are put together only when they leave the query.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from trellis.functions import terms as T
from trellis.functions.terms import RDF, XSD, Term
from trellis.plans.algebra import Triple
from trellis.sources.store import ORDERINGS, Encoded, TripleStore

BASE = "http://ex.org/"


@dataclass(frozen=True)
class Mapping:
    """Key columns of a table, its references {column: table}, and columns that hold language-tagged text {column: tag column}."""

    table: str
    key: tuple[str, ...]
    refs: dict[str, str] = field(default_factory=dict)
    langs: dict[str, str] = field(default_factory=dict)


STAR_SCHEMA = (
    Mapping("region", ("r_regionkey",)),
    Mapping("nation", ("n_nationkey",), {"n_regionkey": "region"}),
    Mapping("customer", ("c_custkey",), {"c_nationkey": "nation"}),
    Mapping("supplier", ("s_suppkey",), {"s_nationkey": "nation"}),
    Mapping("part", ("p_partkey",)),
    Mapping("orders", ("o_orderkey",), {"o_custkey": "customer"}),
    Mapping("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    Mapping("events", ("event_id",)),
    Mapping("documents", ("doc_id",), langs={"text": "lang", "tgt_text": "tgt_lang"}),
)


def _datatype(kind: ST.DataType) -> str | None:
    if isinstance(kind, (ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType)):
        return XSD + "integer"
    if isinstance(kind, (ST.FloatType, ST.DoubleType)):
        return XSD + "double"
    if isinstance(kind, ST.DecimalType):
        return XSD + "decimal"
    if isinstance(kind, (ST.TimestampType, ST.TimestampNTZType)):
        return XSD + "dateTime"
    if isinstance(kind, ST.DateType):
        return XSD + "date"
    if isinstance(kind, ST.BooleanType):
        return XSD + "boolean"
    return None


class MappedStore(TripleStore):
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], mappings: Sequence[Mapping] = STAR_SCHEMA, base: str = BASE, orderings: Sequence[str] = ORDERINGS):
        self.base = base
        self.maps = {m.table: m for m in mappings if m.table in tables}
        self.tables = {k: tables[k] for k in self.maps}
        self.properties: dict[str, tuple[str, str]] = {}  # predicate -> (table, column; "" is the type, "ref-x" a reference)
        for name, m in self.maps.items():
            for f in self.tables[name].schema.fields:
                if not isinstance(f.dataType, (ST.ArrayType, ST.MapType, ST.StructType)):
                    self.properties[f"{base}{name}#{f.name}"] = (name, f.name)
            for c, to in m.refs.items():
                if to in self.maps:
                    self.properties[f"{base}{name}#ref-{c}"] = (name, f"ref-{c}")
        branches = [self._branch(name, "") for name in self.maps] + [self._branch(*x) for x in self.properties.values()]
        super().__init__(reduce(DataFrame.unionByName, branches), orderings)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: Sequence[str] | None = None, **options) -> MappedStore:
        names = names or [m.table for m in STAR_SCHEMA]
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, **options)

    # ------------------------------------------------------------ columns

    def _subject(self, table: str) -> tuple[Column, Encoded]:
        key = self.maps[table].key
        raw = F.col(key[0]) if len(key) == 1 else F.concat_ws("-", *[F.col(k).cast("string") for k in key])
        return raw, Encoded("", f"row {table}", f"<{self.base}{table}/", ">")

    def _object(self, table: str, column: str) -> tuple[Column, Encoded]:
        m = self.maps[table]
        if column == "":
            return F.lit(f"{self.base}{table}"), Encoded("", "type", "<", ">")
        if column.startswith("ref-"):
            to = m.refs[column[4:]]
            return F.col(column[4:]), Encoded("", f"row {to}", f"<{self.base}{to}/", ">")
        kind = self.tables[table].schema[column].dataType
        dt = _datatype(kind)
        if column in m.langs:
            return T.make_lit(F.col(column), lang=F.col(m.langs[column])), Encoded("")
        if dt is None:
            return F.col(column), Encoded("", "text", '"', '"', text=True)
        if dt == XSD + "integer":
            return F.col(column).cast("bigint"), Encoded("", "integer", '"', f'"^^<{dt}>', number=True)
        # equal doubles can be written differently (-0.0), and dates need their text form: compared as terms, kept raw
        return F.col(column), Encoded("", f"raw {table}.{column}", '"', f'"^^<{dt}>', number=dt != XSD + "dateTime" and dt != XSD + "date" and dt != XSD + "boolean")

    def _term(self, raw: Column, e: Encoded) -> Column:
        if e.template is None:
            return raw
        return F.concat(F.lit(e.prefix), T.escape(raw) if e.text else raw.cast("string"), F.lit(e.suffix))

    def _present(self, table: str, column: str) -> Column:
        plain = column[4:] if column.startswith("ref-") else column
        needed = [k for k in self.maps[table].key] + ([plain] if plain else [])
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in dict.fromkeys(needed)])

    def _branch(self, table: str, column: str) -> DataFrame:
        predicate = RDF + "type" if column == "" else f"{self.base}{table}#{column}"
        s, o = self._subject(table), self._object(table, column)
        df = self.tables[table].where(self._present(table, column))
        return df.select(self._term(*s).alias("s"), F.lit(f"<{predicate}>").alias("p"), self._term(*o).alias("o"))

    # ------------------------------------------------------------ conditions on raw columns

    def _is_row(self, raw: Column, table: str, term: Term) -> Column:
        """Whether a raw row reference is the row named by an IRI; only the canonical spelling of a key names one."""
        prefix = f"{self.base}{table}/"
        if term.kind != "iri" or not term.value.startswith(prefix):
            return F.lit(False)
        key = term.value[len(prefix) :]
        kinds = self.tables[table].schema
        if len(self.maps[table].key) == 1 and isinstance(kinds[self.maps[table].key[0]].dataType, (ST.IntegerType, ST.LongType)):
            canonical = key.lstrip("-").isdigit() and str(int(key)) == key and abs(int(key)) < 1 << 63
            return raw == F.lit(int(key)) if canonical else F.lit(False)
        return raw.cast("string") == key

    def _equals(self, table: str, column: str, term: Term) -> Column:
        raw, e = self._object(table, column)
        if column == "":
            return F.lit(term == T.iri(f"{self.base}{table}"))
        if column.startswith("ref-"):
            return self._is_row(raw, self.maps[table].refs[column[4:]], term)
        if e.text and term.kind == "lit" and not term.lang and not term.dt:
            return raw == term.value
        if e.template == "integer":
            fits = term.kind == "lit" and term.dt == XSD + "integer" and term.value.lstrip("-").isdigit() and str(int(term.value)) == term.value
            return raw == F.lit(int(term.value)) if fits and abs(int(term.value)) < 1 << 63 else F.lit(False)
        return self._term(raw, e) == term.nt

    # ------------------------------------------------------------ scans

    def _place(self, t: Triple) -> tuple[str, str] | None:
        """(table, column) of a pattern that one column answers; None if the predicate or the type is open."""
        if t.p.is_var or t.g is not None:
            return None
        if t.p.value == RDF + "type":
            name = t.o.value[len(self.base) :] if t.o.kind == "iri" and t.o.value.startswith(self.base) else None
            return (name, "") if name in self.maps else None
        return self.properties.get(t.p.value)

    def star(self, triples: Sequence[Triple], name):
        places = [self._place(t) for t in triples]
        if None in places or len({x[0] for x in places}) != 1 or len({t.s for t in triples}) != 1:
            return None
        table = places[0][0]
        df = self.tables[table]
        conditions: list[Column] = []
        columns: dict[Term, tuple[Column, Encoded]] = {}

        def bind(term: Term, raw: Column, e: Encoded) -> None:
            if term not in columns:
                columns[term] = (raw, e)
                return
            other, oe = columns[term]
            same = oe.template is not None and oe.template == e.template
            conditions.append(other == raw if same else self._term(other, oe) == self._term(raw, e))

        s = triples[0].s
        raw, e = self._subject(table)
        if s.is_var:
            bind(s, raw, e)
        else:
            conditions.append(self._is_row(raw, table, s))
        for t, (_, column) in zip(triples, places):
            conditions.append(self._present(table, column))
            if t.o.is_var:
                bind(t.o, *self._object(table, column))
            else:
                conditions.append(self._equals(table, column, t.o))
        df = df.where(reduce(lambda a, b: a & b, conditions))
        out = {term: e.renamed(name()) for term, (_, e) in columns.items()}
        selected = [columns[term][0].alias(e.name) for term, e in out.items()]
        return df.select(*(selected or [F.lit(1).alias(name())])), out

    def scan(self, t: Triple, name):
        if not t.p.is_var and t.g is None:
            found = self.star([t], name)
            if found:
                return found
            if t.p.value != RDF + "type" and t.p.value not in self.properties:
                out = {x: Encoded(name()) for x in t.variables()}
                none = self.spark.createDataFrame([], ", ".join(f"{e.name} string" for e in out.values()) or f"{name()} int")
                return none, out
        return super().scan(t, name)

    def counts(self, patterns: Sequence[Triple]) -> list[int]:
        """One column count per pattern that one column answers; the rest over the mapped triples."""
        keys = [self._key(t) for t in patterns]
        rest = []
        for k, t in zip(keys, patterns):
            if k not in self._counts and self._place(t):
                n = iter(range(9))
                self._counts[k] = self.scan(t, lambda n=n: f"c{next(n)}")[0].count()
            elif k not in self._counts:
                rest.append(t)
        if rest:
            super().counts(rest)
        return [self._counts[k] for k in keys]


