"""Triple stores: a DataFrame of canonical terms behind scans, counts, set-semantics updates, statistics and layouts."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import Term
from trellis.plans.algebra import Triple

SCHEMA = "s string, p string, o string"
QUAD_SCHEMA = SCHEMA + ", g string"
#: Permutations an access path can have, and the positions that each lists.
ORDERINGS = ("SPO", "SOP", "POS", "PSO", "OSP", "OPS")
#: Masks of the stored statistics: every set of one or two bound positions.
MASKS = ("s", "p", "o", "sp", "so", "po")
#: Permutations that are written: each set of bound positions is a leading part of one of them.
LAYOUTS = ("SPO", "POS", "OSP")
#: Folders of a layout, by a hash of its first position.
BUCKETS = 32


class Encoded:
    """A column of bindings: a plain term, or a raw value whose term is made only where it is needed.

    `prefix` and `suffix` turn the raw value into its term; `template` is equal for columns whose raw values can be
    compared in place of the terms. `number` tells that the raw value is a number. `dictionary` (id, nt) is set where the
    raw value is an id: such a column has no term until a join has brought it in.
    """

    def __init__(
        self, name: str, template: str | None = None, prefix: str = "", suffix: str = "", number: bool = False, text: bool = False,
        dictionary: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.name, self.template, self.prefix, self.suffix, self.number, self.text = name, template, prefix, suffix, number, text
        self.dictionary = dictionary

    def renamed(self, name: str) -> Encoded:
        return Encoded(name, self.template, self.prefix, self.suffix, self.number, self.text, self.dictionary)

    def term(self) -> Column:
        raw = F.col(self.name)
        if self.dictionary is not None:
            raise ValueError("the ids of this column must be decoded first")
        if self.template is None:
            return raw
        value = T.escape(raw) if self.text else raw.cast("string")
        return F.concat(F.lit(self.prefix), value, F.lit(self.suffix))


class TripleStore:
    """Triples (s, p, o) with set semantics, optionally in named graphs (g, NULL for the default graph).

    `df` must hold each triple once per graph; `from_rows` and `add` see to it. Rows with a NULL s, p or o are no triples.
    """

    def __init__(self, df: DataFrame, orderings: Sequence[str] = ORDERINGS):
        self.df = df
        self.spark = df.sparkSession
        self.has_graphs = "g" in df.columns
        self.columns = ["s", "p", "o"] + (["g"] if self.has_graphs else [])
        self._orderings = tuple(x for x in ORDERINGS if x.lower() in {o.lower() for o in orderings})
        self._counts: dict[tuple, int] = {}

    # ------------------------------------------------------------ making and changing

    @classmethod
    def from_rows(cls, df: DataFrame, **options) -> TripleStore:
        """A store of the distinct triples among rows with columns s, p, o and perhaps g; further columns are dropped."""
        columns = ["s", "p", "o"] + (["g"] if "g" in df.columns else [])
        return cls(df.select(*columns).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").dropDuplicates(), **options)

    @classmethod
    def from_triples(cls, spark: SparkSession, triples: Iterable[Triple], **options) -> TripleStore:
        """A small store out of algebra triples."""
        rows = [(t.s.nt, t.p.nt, t.o.nt, t.g.nt if t.g else None) for t in dict.fromkeys(triples)]
        quads = any(r[3] for r in rows)
        df = spark.createDataFrame(rows if quads else [r[:3] for r in rows], QUAD_SCHEMA if quads else SCHEMA)
        return cls(df, **options)

    def _same(self, other: DataFrame, kind: str) -> DataFrame:
        """Join on all columns, a NULL graph being equal to itself."""
        marked = other.select(*[F.col(c).alias(f"__{c}") for c in self.columns])
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") if c != "g" else F.col(c).eqNullSafe(F.col(f"__{c}")) for c in self.columns])
        return self.df.join(marked, on, kind)

    def add(self, rows: DataFrame) -> TripleStore:
        """Set union: a triple that is there already is no second one."""
        return TripleStore.from_rows(self.df.unionByName(rows.select(*self.columns)), orderings=self._orderings)

    def remove(self, rows: DataFrame) -> TripleStore:
        return TripleStore(self._same(rows, "left_anti"), self._orderings)

    def contained(self, rows: DataFrame) -> DataFrame:
        """Those triples of the store that are among the rows."""
        return self._same(rows, "left_semi")

    # ------------------------------------------------------------ reading

    def pattern_condition(self, t: Triple) -> Column:
        """Constants and repeated variables of a pattern as a predicate."""
        conditions, at = [F.lit(True)], {}
        for c, term in zip(("s", "p", "o", "g"), t.terms):
            if not term.is_var:
                conditions.append(F.col(c) == term.nt)
            elif term in at:
                conditions.append(F.col(c) == F.col(at[term]))
            else:
                at[term] = c
        return reduce(lambda a, b: a & b, conditions)

    def scan(self, t: Triple, name) -> tuple[DataFrame, dict[Term, Encoded]]:
        """Rows of a pattern with one freshly named column per variable; name() gives the names.

        A pattern outside GRAPH reads the default graph of a store with graphs; one with a graph term reads named graphs.
        """
        df = self.df
        if self.has_graphs:
            df = df.where(F.col("g").isNull() if t.g is None else F.col("g").isNotNull())
        elif t.g is not None:
            df = df.where(F.lit(False)).withColumn("g", F.lit(None).cast("string"))
        df = df.where(self.pattern_condition(t))
        out: dict[Term, Encoded] = {}
        columns = []
        for c, term in zip(("s", "p", "o", "g"), t.terms):
            if term.is_var and term not in out:
                out[term] = Encoded(name())
                columns.append(F.col(c).alias(out[term].name))
        return df.select(*(columns or [F.lit(1).alias(name())])), out

    def star(self, triples: Sequence[Triple], name):
        """A scan that answers several patterns of one subject at once, where the layout allows it; else None."""
        return None

    def match(self, s: Term, p: Term, o: Term, sort: Sequence[str] = ()) -> DataFrame:
        """Bindings of one pattern under the variables' own names, in the term order of the variables `sort` if given."""
        n = iter(range(99))
        df, cols = self.scan(Triple(s, p, o), lambda: f"__{next(n)}")
        df = df.select(*[e.term().alias(t.value) for t, e in cols.items()])
        return df.orderBy(*[k for name in sort for k in T.order_keys(name)]) if sort else df

    def match_by(self, s: Term, p: Term, o: Term, ordering: str) -> DataFrame:
        """The same through one of the permutations that can answer the pattern: rows come in its order."""
        t = Triple(s, p, o)
        if ordering not in self.orderings(t):
            raise ValueError(f"{ordering} cannot answer {t.sse()}")
        place = dict(zip("SPO", t.terms))
        return self.match(s, p, o, list(dict.fromkeys(place[k].value for k in ordering if place[k].is_var)))

    def contains(self, s: Term, p: Term, o: Term) -> bool:
        return not self.df.where(self.pattern_condition(Triple(s, p, o))).isEmpty()

    def size(self) -> int:
        return self.df.count()

    def counts(self, patterns: Sequence[Triple]) -> list[int]:
        """Exact number of triples of each pattern, all in one pass over the store; known counts are not counted again."""
        keys = [self._key(t) for t in patterns]
        new = {k: t for k, t in zip(keys, patterns) if k not in self._counts}
        if new:
            got = self.df.agg(*[F.count_if(self.pattern_condition(t)).alias(f"n{i}") for i, t in enumerate(new.values())]).first()
            self._counts.update(zip(new, got))
        return [self._counts[k] for k in keys]

    def count(self, s: Term, p: Term, o: Term) -> int:
        return self.counts([Triple(s, p, o)])[0]

    @staticmethod
    def _key(t: Triple) -> tuple:
        """Equal for patterns that match the same triples."""
        names: dict[Term, int] = {}
        return tuple(names.setdefault(x, len(names)) if x.is_var else x.nt for x in t.terms)

    def statistics(self) -> DataFrame:
        """(s, p, o, mask, n): the number of triples for every value of each single position and pair of positions."""
        sets = [[F.col(c) for c in m] for m in MASKS]
        grouped = self.df.groupingSets(sets, "s", "p", "o").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
        mask = F.element_at(F.create_map(*[F.lit(x) for m in MASKS for x in (sum(4 >> i for i, c in enumerate("spo") if c not in m), m)]), F.col("gid").cast("int"))
        return grouped.select("s", "p", "o", mask.alias("mask"), "n")

    def orderings(self, t: Triple) -> list[str]:
        """Permutations that can answer a pattern: its bound positions come first, then a repeated variable's places."""
        place = dict(zip("SPO", t.terms))
        bound = {k for k, x in place.items() if not x.is_var}
        repeated = {k for k, x in place.items() if x.is_var and [t.s, t.p, t.o].count(x) > 1}
        first = len(bound)
        return [x for x in self._orderings if set(x[:first]) == bound and (not repeated or set(x[first : first + len(repeated)]) == repeated)]

    # ------------------------------------------------------------ files

    def write(self, path: str, mode: str = "errorifexists", layouts: Sequence[str] | None = None, statistics: bool = True) -> None:
        """Parquet in one or more layouts, a copy of the triples each, with counts for the planner.

        A layout is a permutation: rows are in its order over all files, so that bound leading positions skip files and row
        groups by their ranges, and its first position is hashed into BUCKETS folders, whose number does not grow with the
        data. Tasks are split by range, never by one position alone: a predicate with a third of the triples is written by
        all of them. By default SPO, POS and OSP are written as far as the store has these orderings; each mask of
        bound positions is then a leading part of one of them.
        """
        chosen = [x.upper() for x in layouts] if layouts else [x for x in LAYOUTS if x in self._orderings] or list(self._orderings[:1])
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        for layout in chosen:
            order = ["bucket", *layout.lower()]
            df = self.df.select(*self.columns).withColumn("bucket", _bucket(F.col(layout[0].lower())))
            df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket").parquet(os.path.join(path, f"triples-{layout}"))
        if statistics:
            self.statistics().repartition("mask").write.mode(mode).partitionBy("mask").parquet(os.path.join(path, "statistics"))
        manifest = json.dumps({"columns": self.columns, "orderings": list(self._orderings), "layouts": chosen, "statistics": statistics})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode(mode).text(os.path.join(path, "manifest"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TripleStore:
        return StoredTriples(spark, path)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class StoredTriples(TripleStore):
    """A written store. A pattern is read from the layout of which its bound positions are a leading part; patterns of one or
    two bound positions are counted by the stored statistics."""

    def __init__(self, spark: SparkSession, path: str):
        manifest = json.loads(spark.read.text(os.path.join(path, "manifest")).first()[0])
        self.layouts = {x: spark.read.parquet(os.path.join(path, f"triples-{x}")).select(*manifest["columns"], "bucket") for x in manifest["layouts"]}
        super().__init__(next(iter(self.layouts.values())), manifest["orderings"])
        self._stored = spark.read.parquet(os.path.join(path, "statistics")) if manifest["statistics"] else None

    def layout(self, t: Triple) -> str:
        """The stored layout with the longest leading part of bound positions."""
        bound = {k for k, x in zip("SPO", t.terms) if not x.is_var}
        lead = lambda x: next((i for i, k in enumerate(x) if k not in bound), 3)
        return max(self.layouts, key=lead)

    def pattern_condition(self, t: Triple, layout: str | None = None) -> Column:
        base, place = super().pattern_condition(t), dict(zip("SPO", t.terms))
        first = place[(layout or next(iter(self.layouts)))[0]]
        return base if first.is_var else base & (F.col("bucket") == self._bucket_of(first))

    def _bucket_of(self, term: Term) -> Column:
        return _bucket(F.lit(term.nt))

    def _at(self, layout: str) -> TripleStore:
        """This store with only one layout, which then is the one that is read."""
        out = copy.copy(self)
        out.layouts, out.df = {layout: self.layouts[layout]}, self.layouts[layout]
        return out

    def scan(self, t: Triple, name):
        at = self._at(self.layout(t))
        return TripleStore.scan(at, t, name)

    def match_by(self, s: Term, p: Term, o: Term, ordering: str) -> DataFrame:
        """Through the stored layout of that name where there is one, which has few rows left to sort; else through the best."""
        at = self._at(ordering) if ordering in self.layouts else self
        return TripleStore.match_by(at, s, p, o, ordering)

    def contains(self, s: Term, p: Term, o: Term) -> bool:
        return TripleStore.contains(self._at(self.layout(Triple(s, p, o))), s, p, o)

    def counts(self, patterns: Sequence[Triple]) -> list[int]:
        """As the plain store's, but from the statistics where these have the pattern: one job, which reads the files of its
        masks and skips the row groups of other terms."""
        asked: dict[tuple, tuple[str, Column]] = {}
        for t in patterns:
            mask = "".join(c for c, x in zip("spo", t.terms) if not x.is_var)
            free = [x for x in t.terms[:3] if x.is_var]
            if self._stored is not None and mask in MASKS and t.g is None and not self.has_graphs and len(set(free)) == len(free) and self._key(t) not in self._counts:
                asked[self._key(t)] = mask, reduce(lambda a, b: a & b, [F.col(c) == x.nt for c, x in zip("spo", t.terms) if not x.is_var])
        if asked:
            rows = [self._stored.where((F.col("mask") == mask) & on).select(F.lit(i).alias("i"), "n") for i, (mask, on) in enumerate(asked.values())]
            got = {r.i: r.n for r in reduce(DataFrame.unionByName, rows).collect()}
            self._counts.update({k: got.get(i, 0) for i, k in enumerate(asked)})
        return super().counts(patterns)


class IdStore(TripleStore):
    """Triples of bigint ids with a dictionary (id, nt, ...): queries join on ids, terms come in where they are needed.

    Constants of a pattern are looked up once, a handful of rows; an unknown constant matches nothing. The compiler brings
    terms in by joins with the dictionary before filters that read them and at the end of a query. A lookup of one's own can
    stand in for that: a function of a table of ids (id) that gives their terms (id, nt).
    """

    def __init__(self, ids: DataFrame, terms: DataFrame, orderings: Sequence[str] = ORDERINGS, lookup: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__(ids.select("s", "p", "o"), orderings)
        self.terms, self.lookup = terms, lookup
        self._ids: dict[str, int] = {}
        self._template = f"id {id(self)}"

    @classmethod
    def encode(cls, store: TripleStore, terms: DataFrame | None = None) -> IdStore:
        """Encode a store by a dictionary, made from its terms in term order where none is given."""
        from trellis.operators.dictionary import build_dictionary, encode_columns

        terms = terms if terms is not None else build_dictionary(store.df, ["s", "p", "o"])
        return cls(encode_columns(store.df.select("s", "p", "o"), ["s", "p", "o"], terms), terms, store._orderings)

    def ids_of(self, terms: Sequence[Term]) -> None:
        """Look constants up; ids start at 1, so that 0 stands for an unknown term."""
        new = [t.nt for t in terms if not t.is_var and t.nt not in self._ids]
        if new:
            found = {r.nt: r.id for r in self.terms.where(F.col("nt").isin(new)).select("nt", "id").collect()}
            self._ids.update({n: found.get(n, 0) for n in new})

    def pattern_condition(self, t: Triple) -> Column:
        self.ids_of(t.terms)
        conditions, at = [F.lit(True)], {}
        for c, term in zip(("s", "p", "o"), t.terms):
            if not term.is_var:
                conditions.append(F.col(c) == F.lit(self._ids[term.nt]))
            elif term in at:
                conditions.append(F.col(c) == F.col(at[term]))
            else:
                at[term] = c
        return reduce(lambda a, b: a & b, conditions)

    def scan(self, t: Triple, name):
        df, cols = super().scan(t, name)
        if t.g is not None:
            return df, cols
        return df, {v: Encoded(e.name, self._template, dictionary=self.lookup or self.terms) for v, e in cols.items()}

    def write(self, path: str, mode: str = "errorifexists", sort: str = "spo") -> None:
        """Parquet of ids, sorted by range, and of the dictionary, which other stores may share."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).write.mode(mode).parquet(os.path.join(path, "ids"))
        self.terms.write.mode(mode).parquet(os.path.join(path, "terms"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> IdStore:
        return cls(spark.read.parquet(os.path.join(path, "ids")), spark.read.parquet(os.path.join(path, "terms")))

    def match(self, s: Term, p: Term, o: Term, sort: Sequence[str] = ()) -> DataFrame:
        n = iter(range(99))
        df, cols = self.scan(Triple(s, p, o), lambda: f"__{next(n)}")
        df = self.decode(df.select(*[F.col(e.name).alias(t.value) for t, e in cols.items()]), [t.value for t in cols])
        return df.orderBy(*[k for name in sort for k in T.order_keys(name)]) if sort else df

    def decode(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        from trellis.operators.dictionary import decode_columns

        return decode_columns(df, columns, self.terms)

    def store(self) -> TripleStore:
        return TripleStore(self.decode(self.df, ["s", "p", "o"]).select("s", "p", "o"), self._orderings)
