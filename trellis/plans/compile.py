"""Algebra to DataFrames.

Every scan gives its variables freshly numbered columns, so a self-join has no ambiguous name and SPARQL's case-sensitive
variables meet no case-insensitive SQL one; names are put back at the end. Each relation knows which variables are surely
bound: joins on those are plain equi-joins, and those with a shared variable that may be unbound are keyed by what is bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.exprs import ExprCompiler, Function
from trellis.functions.terms import Term
from trellis.plans.algebra import BGP, Expr, Filter, Graph, Group, Optional, Pattern, Query, Service, Triple, Union, Values
from trellis.session import broadcast_if_small, cut_lineage
from trellis.sources.store import Encoded, TripleStore

#: Join algorithms by the hint that asks Spark for them.
HINTS = {"merge": "merge", "hash": "shuffle_hash", "nestedloop": "shuffle_replicate_nl", "broadcast": "broadcast"}


def _joined(left: DataFrame, right: DataFrame, conditions: Sequence[Column], how: str) -> DataFrame:
    if conditions:
        return left.join(right, reduce(lambda a, b: a & b, conditions), how)
    return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)


def _comparable(a: Encoded, b: Encoded) -> bool:
    """Whether equal raw values mean equal terms, and different ones different terms."""
    return a.template is not None and a.template == b.template and not a.template.startswith("raw ")


class _Either(Encoded):
    """Reads as the bound one of two columns."""

    def __init__(self, a: Encoded, b: Encoded):
        super().__init__(a.name)
        self.a, self.b = a, b

    def term(self) -> Column:
        return F.coalesce(self.a.term(), self.b.term())


@dataclass
class Relation:
    df: DataFrame
    cols: dict[str, Encoded]
    sure: frozenset[str]

    def decoded(self, variables: Iterable[str] | None = None) -> Relation:
        """Bring the terms of id columns in by joins with their dictionary: for some variables, or for all."""
        df, cols = self.df, dict(self.cols)
        for v in cols if variables is None else variables:
            e = cols.get(v)
            if e is None or e.dictionary is None:
                continue
            name = f"{e.name}t"
            source = e.dictionary
            if callable(source):  # a lookup of one's own is asked for the ids at hand
                source = source(df.where(F.col(e.name).isNotNull()).select(F.col(e.name).alias("id")).distinct())
            pairs = broadcast_if_small(source.select(F.col("id").alias(f"__{name}"), F.col("nt").alias(name)))
            df = df.join(pairs, F.col(e.name) == F.col(f"__{name}"), "left").drop(f"__{name}", e.name)
            cols[v] = Encoded(name)
        return replace(self, df=df, cols=cols)

    def named(self, names: Sequence[str]) -> DataFrame:
        """Terms under variable names; a name that the relation lacks is a NULL column."""
        if any(e.dictionary is not None for e in self.cols.values()):
            r = self.decoded([n for n in names])
            return replace(r, cols={n: e for n, e in r.cols.items() if e.dictionary is None}).named(names)
        out = [(self.cols[n].term() if n in self.cols else F.lit(None).cast("string")) for n in names]
        return self.df.select(*[c.alias(f"__r{i}") for i, c in enumerate(out)]).toDF(*names)


def _name(t: Term) -> str:
    """Key of a variable; non-distinguished ones cannot clash with others."""
    return t.value if t.kind == "var" else f"\0{t.value}"


class Compiler:
    def __init__(
        self, store: TripleStore, sources: Mapping[str, TripleStore] | None = None, order: Callable[[BGP, TripleStore], Sequence[Triple]] | None = None,
        functions: Mapping[str, Function] | None = None, value_equality: bool = False, hint: str | None = None, bgp_executor=None, stars: bool = True,
        lexical_order: bool = False,
    ):
        self.store, self.sources, self.order = store, dict(sources or {}), order
        self.functions, self.value_equality, self.hint = functions, value_equality, hint
        self.bgp_executor, self.stars, self.lexical_order = bgp_executor, stars, lexical_order
        self._n = itertools.count()

    def fresh(self) -> str:
        return f"v{next(self._n)}"

    # ------------------------------------------------------------ relations

    def scan(self, t: Triple, store: TripleStore) -> Relation:
        df, cols = store.scan(t, self.fresh)
        cols = {_name(v): e for v, e in cols.items()}
        return Relation(df, cols, frozenset(cols))

    def unit(self) -> Relation:
        """One row that binds nothing."""
        return Relation(self.store.spark.range(1).select(F.col("id").alias(self.fresh())), {}, frozenset())

    def join(self, left: Relation, right: Relation, how: str = "inner", extra: Expr | None = None, hint: str | None = None) -> Relation:
        """Natural join on shared variables; `extra` is a condition that a left join's match must also meet."""
        shared = [v for v in right.cols if v in left.cols]
        hint = hint or self.hint
        alien = [v for v in shared if left.cols[v].template != right.cols[v].template]
        read = [v.value for v in extra.variables()] if extra is not None else []
        left, right = left.decoded(alien + read), right.decoded(alien + read)
        loose = [v for v in shared if v not in left.sure or v not in right.sure]
        same = {v: _comparable(left.cols[v], right.cols[v]) for v in shared}

        def equal(v: str) -> Column:
            a, b = left.cols[v], right.cols[v]
            return F.col(a.name) == F.col(b.name) if same[v] else a.term() == b.term()

        keys = [equal(v) for v in shared if v not in loose]
        cols = {**left.cols, **{v: e for v, e in right.cols.items() if v not in left.cols}}
        match = None
        if extra is not None:
            # within a match a loosely shared variable has whichever value is bound
            env = {**cols, **{v: self._either(left.cols[v], right.cols[v], same[v]) for v in loose}}
            match = F.coalesce(ExprCompiler(env, self.functions, self.value_equality).condition(extra), F.lit(False))
        # a broadcast is asked for only of a side that was counted
        right_df = right.df if not hint else broadcast_if_small(right.df) if hint == "broadcast" else right.df.hint(HINTS[hint])
        if not loose:
            df = _joined(left.df, right_df, keys + ([match] if match is not None else []), how)
        else:
            df = self._masked_join(left, right, loose, same, keys, match, how)
        for v in loose:
            name = self.fresh()
            df = df.withColumn(name, self._either(left.cols[v], right.cols[v], same[v], raw=True))
            cols[v] = left.cols[v].renamed(name) if same[v] else Encoded(name)
        df = df.select(*([e.name for e in cols.values()] or [F.lit(1).alias(self.fresh())]))
        return Relation(df, cols, left.sure | right.sure if how == "inner" else left.sure)

    @staticmethod
    def _either(a: Encoded, b: Encoded, same: bool, raw: bool = False):
        """Whichever of two columns is bound: as a Column, or as something an expression can read."""
        if raw:
            return F.coalesce(F.col(a.name), F.col(b.name)) if same else F.coalesce(a.term(), b.term())
        return _Either(a, b)

    def _masked_join(self, left: Relation, right: Relation, loose: Sequence[str], same: Mapping[str, bool], keys, match, how: str) -> DataFrame:
        """Join with variables that may be unbound, as one equi-join whatever their number.

        The mask of a row tells which of these variables it binds. Rows of two masks join on the variables that both bind,
        so each row is offered under every mask that the other side can have, with the two masks and the values of the
        common variables as its key. Only masks without a common variable, where no other key exists, are a product, and
        every row of that is a result. A left join adds the left rows that nothing matches: as an outer join where every
        left row has one key, else by the rows' numbers, for which the left side is written once.
        """
        ln, rn, lm, rm = self.fresh(), self.fresh(), self.fresh(), self.fresh()
        bit = {v: 1 << i for i, v in enumerate(loose)}
        names = {v: (self.fresh(), self.fresh()) for v in loose}

        def possible(r: Relation) -> list[int]:
            out = [0]
            for v in loose:
                out = [m | bit[v] for m in out] + ([] if v in r.sure else out)
            return sorted(out)

        def masked(r: Relation, name: str) -> DataFrame:
            bits = [F.lit(bit[v]) if v in r.sure else F.when(F.col(r.cols[v].name).isNull(), 0).otherwise(bit[v]) for v in loose]
            return r.df.withColumn(name, reduce(lambda a, b: a + b, bits))

        def offered(df: DataFrame, r: Relation, own: str, other: str, masks: Sequence[int], side: int) -> DataFrame:
            """Each row under the masks of the other side with which it has a key."""
            out = df.withColumn(other, F.explode(F.array(*map(F.lit, masks))) if len(masks) > 1 else F.lit(masks[0]))
            common = F.col(own).bitwiseAND(F.col(other))
            out = out if keys else out.where(common != 0)
            value = lambda v: F.col(r.cols[v].name) if same[v] else r.cols[v].term()
            return out.withColumns({names[v][side]: F.when(common.bitwiseAND(F.lit(bit[v])) != 0, value(v)) for v in loose})

        def trimmed(df: DataFrame, *more: str) -> DataFrame:
            return df.select(*left.df.columns, *more, *right.df.columns)

        l_masks, r_masks = possible(left), possible(right)
        on = [F.col(lm) == F.col(ln), F.col(rm) == F.col(rn)] + [F.col(a).eqNullSafe(F.col(b)) for a, b in names.values()] + keys + ([match] if match is not None else [])
        apart = [] if keys else [(a, b) for a in l_masks for b in r_masks if not a & b]
        extra = [match] if match is not None else []
        one_key = how == "left" and len(r_masks) == 1
        number = self.fresh() if how == "left" and not one_key else None
        first = masked(left, lm)
        if number:
            first = cut_lineage(first.withColumn(number, F.monotonically_increasing_id()))
        second = masked(right, rn)
        # the left rows carry (own mask lm, other's mask rm), the right ones (own mask rn, other's mask ln)
        met = _joined(offered(first, left, lm, rm, r_masks, 0), offered(second, right, rn, ln, l_masks, 1), on, "left" if one_key else "inner")
        more = [number] if number else []
        frames = [trimmed(met, *more)]
        for a, b in apart:
            frames.append(trimmed(_joined(first.where(F.col(lm) == a), second.where(F.col(rn) == b), extra, "left" if one_key else "inner"), *more))
        out = reduce(DataFrame.unionByName, frames)
        if not number:
            return out
        matched = out.select(F.col(number).alias(f"{number}m")).distinct()
        alone = first.join(matched, F.col(number) == F.col(f"{number}m"), "left_anti")
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.df.schema.fields]
        return trimmed(out).unionByName(alone.select(*left.df.columns, *missing))

    def union(self, parts: Sequence[Relation]) -> Relation:
        """Bag union by variable; a variable that a part lacks is NULL in its rows."""
        names = list(dict.fromkeys(v for r in parts for v in r.cols))
        mixed = [v for v in names if len({r.cols[v].template for r in parts if v in r.cols}) > 1]
        parts = [r.decoded(mixed) for r in parts]
        out: dict[str, Encoded] = {}
        for v in names:
            kinds = {(r.cols[v].template, r.cols[v].prefix, r.cols[v].suffix) for r in parts if v in r.cols}
            first = next(r.cols[v] for r in parts if v in r.cols)
            out[v] = first.renamed(self.fresh()) if len(kinds) == 1 else Encoded(self.fresh())
        frames = []
        for r in parts:
            columns = []
            for v in names:
                if v not in r.cols:
                    columns.append(F.lit(None).alias(out[v].name))
                else:
                    columns.append((F.col(r.cols[v].name) if out[v].template is not None else r.cols[v].term()).alias(out[v].name))
            frames.append(r.df.select(*(columns or [F.lit(1).alias("one")])))
        sure = frozenset(v for v in names if all(v in r.sure for r in parts))
        return Relation(reduce(DataFrame.unionByName, frames), out, sure)

    def filter(self, r: Relation, e: Expr) -> Relation:
        r = r.decoded(v.value for v in e.variables())
        return Relation(r.df.where(ExprCompiler(r.cols, self.functions, self.value_equality).condition(e)), r.cols, r.sure)

    # ------------------------------------------------------------ patterns

    def pattern(self, p: Pattern, store: TripleStore | None = None, graph: Term | None = None) -> Relation:
        store = store or self.store
        if isinstance(p, BGP):
            return self.bgp(p, store, graph)
        if isinstance(p, Group):
            parts = [self.pattern(x, store, graph) for x in p.parts]
            return reduce(self.join, parts) if parts else self.unit()
        if isinstance(p, Filter):
            return self.filter(self.pattern(p.child, store, graph), p.expr)
        if isinstance(p, Optional):
            left, right, extra = self.pattern(p.left, store, graph), p.right, None
            while isinstance(right, Filter):
                extra = right.expr if extra is None else Expr("&&", (right.expr, extra))
                right = right.child
            return self.join(left, self.pattern(right, store, graph), "left", extra)
        if isinstance(p, Union):
            return self.union([self.pattern(x, store, graph) for x in p.parts])
        if isinstance(p, Graph):
            return self.pattern(p.child, store, p.name)
        if isinstance(p, Service):
            if p.name.value not in self.sources:
                raise ValueError(f"unknown source {p.name}")
            return self.pattern(p.child, self.sources[p.name.value], None)
        if isinstance(p, Values):
            names = [self.fresh() for _ in p.names]
            rows = [tuple(None if t is None else t.nt for t in r) for r in p.rows]
            schema = ", ".join(f"{n} string" for n in names) or "one int"
            df = store.spark.createDataFrame(rows, schema)
            sure = frozenset(v for i, v in enumerate(p.names) if all(r[i] is not None for r in p.rows))
            return Relation(df, {v: Encoded(n) for v, n in zip(p.names, names)}, sure)
        raise TypeError(f"no pattern: {p!r}")

    def bgp(self, p: BGP, store: TripleStore, graph: Term | None) -> Relation:
        if not p.triples:
            return self.unit()
        triples = [replace(t, g=graph) if graph is not None else t for t in p.triples]
        if self.bgp_executor is not None:
            out = self.bgp_executor(self, BGP(tuple(triples)), store)
        else:
            ordered = list(self.order(BGP(tuple(triples)), store)) if self.order else connected_order(triples)
            out = reduce(self.join, self._groups(ordered, store))
        # non-distinguished variables go, without removing repeated rows
        cols = {v: e for v, e in out.cols.items() if not v.startswith("\0")}
        if len(cols) == len(out.cols):
            return out
        df = out.df.select(*([e.name for e in cols.values()] or [F.lit(1).alias(self.fresh())]))
        return Relation(df, cols, out.sure & set(cols))

    def _groups(self, triples: Sequence[Triple], store: TripleStore) -> list[Relation]:
        """Relations of the patterns in order; patterns of one subject become one scan where the store can do that."""
        out: list[Relation] = []
        done: set[int] = set()
        for i, t in enumerate(triples):
            if i in done:
                continue
            own = [j for j in range(i, len(triples)) if j not in done and triples[j].s == t.s]
            star = None
            while self.stars and len(own) > 1 and star is None:
                star = store.star([triples[j] for j in own], self.fresh)
                if star is None:
                    own = [own[0], *[j for j in own[1:] if store.star([t, triples[j]], self.fresh) is not None]] if len(own) > 2 else own[:1]
            if star:
                cols = {_name(v): e for v, e in star[1].items()}
                out.append(Relation(star[0], cols, frozenset(cols)))
                done.update(own)
            else:
                out.append(self.scan(t, store))
                done.add(i)
        return out

    # ------------------------------------------------------------ queries

    def query(self, q: Query) -> DataFrame:
        r = self.pattern(q.pattern)
        if q.form == "ask":
            return r.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if q.order or q.form in ("construct", "describe"):
            r = r.decoded()
        if q.order:
            compiler = ExprCompiler(r.cols, self.functions, self.value_equality, self.lexical_order)
            r = replace(r, df=r.df.orderBy(*[c for e, up in q.order for c in compiler.order_columns(e, up)]))
        if q.form == "construct":
            return self._construct(q, r)
        if q.form == "describe":
            return self._describe(q, r)
        df = r.named(q.variables())
        if q.distinct:
            keep = df
            df = df.distinct()
            if q.order:
                # DISTINCT loses an order; sort again by what is left of it
                compiler = ExprCompiler({n: Encoded(n) for n in keep.columns}, self.functions, self.value_equality, self.lexical_order)
                df = df.orderBy(*[c for e, up in q.order for c in compiler.order_columns(e, up)])
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df

    def _describe(self, q: Query, r: Relation) -> DataFrame:
        """(s, p, o): the triples whose subject is one of the named terms, or a value of the named variables (of all, for *)."""
        chosen = q.described or tuple(Term("var", v) for v in r.cols if not v.startswith("\0"))
        df = r.df.offset(q.offset) if q.offset else r.df
        df = df.limit(q.limit) if q.limit is not None else df
        found = [r.cols[t.value].term() for t in chosen if t.is_var and t.value in r.cols]
        fixed = [F.lit(t.nt) for t in chosen if not t.is_var]
        parts = [df.select(F.explode(F.array(*found)).alias("__d"))] if found else []
        parts += [self.store.spark.range(1).select(F.explode(F.array(*fixed)).alias("__d"))] if fixed else []
        if not parts:
            return self.store.spark.createDataFrame([], "s string, p string, o string")
        wanted = reduce(DataFrame.unionByName, parts).where(F.col("__d").isNotNull()).distinct()
        names = [Term("var", x) for x in "spo"]
        every = self.scan(Triple(*names), self.store).named(list("spo"))
        return every.join(wanted, F.col("s") == F.col("__d"), "left_semi")

    def _construct(self, q: Query, r: Relation) -> DataFrame:
        """(s, p, o): the template for each row, without triples that have an unbound or misplaced term, each once.

        A blank node of the template is one per row, named by a hash of the row.
        """
        row = F.hex(F.xxhash64(*[F.col(e.name) for e in r.cols.values()])) if r.cols else F.lit("0")

        def put(t: Term) -> Column:
            if t.kind == "ndv":
                return F.concat(F.lit(f"_:{t.value}x"), row)
            if t.is_var:
                return r.cols[t.value].term() if t.value in r.cols else F.lit(None).cast("string")
            return F.lit(t.nt)

        df = r.df.offset(q.offset) if q.offset else r.df
        df = df.limit(q.limit) if q.limit is not None else df
        made = df.select(F.explode(F.array(*[F.struct(put(t.s).alias("s"), put(t.p).alias("p"), put(t.o).alias("o")) for t in q.template])).alias("t")).select("t.*")
        return made.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND NOT startswith(s, '\"') AND startswith(p, '<')").distinct()


def connected_order(triples: Sequence[Triple]) -> list[Triple]:
    """Textual order, but a pattern that shares a variable with those before it goes ahead of one that does not."""
    left, out, seen = list(triples), [], set()
    while left:
        k = next((i for i, t in enumerate(left) if not out or seen & set(t.variables())), 0)
        t = left.pop(k)
        out.append(t)
        seen |= set(t.variables())
    return out

