"""The engine: queries over a store and named sources, with a choice of join order, join algorithm and equality rule."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.exprs import Function
from trellis.functions.terms import Term
from trellis.plans import planner as P
from trellis.plans.algebra import BGP, Pattern, Query
from trellis.plans.compile import Compiler, Relation
from trellis.plans.parser import parse_query
from trellis.sources.store import TripleStore


@dataclass
class EngineConfig:
    """order: connected (textual, without jobs), greedy or dp (both count patterns first).

    join forces one algorithm (merge, hash, nestedloop, broadcast) on all joins; None leaves it to Spark, which switches
    at run time. lexical_order sorts literals by their texts, numbers too. stars lets a store answer several patterns of a subject in one scan. bgp_executor replaces the evaluation
    of basic graph patterns: a function of (compiler, bgp, store) that gives a relation.
    """

    order: str = "connected"
    join: str | None = None
    value_equality: bool = False
    lexical_order: bool = False
    stars: bool = True
    planner: P.Config = field(default_factory=P.Config)
    functions: dict[str, Function] = field(default_factory=dict)
    bgp_executor: object = None


class Engine:
    def __init__(self, store: TripleStore, config: EngineConfig | None = None):
        self.store, self.config = store, config or EngineConfig()
        self.sources: dict[str, TripleStore] = {}

    def add_source(self, name: str, store: TripleStore) -> Engine:
        """Name a further store, for SERVICE <name> and for federated plans."""
        self.sources[name] = store
        return self

    def register_function(self, name: str, function: Function) -> Engine:
        """Make <name>(...) callable in expressions: a function of term columns that gives a term column."""
        self.config.functions[name] = function
        return self

    def compiler(self) -> Compiler:
        order = None
        if self.config.order in ("greedy", "dp"):
            def order(bgp: BGP, store: TripleStore):
                planner = P.Planner(store, self.config.planner)
                return planner.greedy(bgp.triples) if self.config.order == "greedy" else planner.order(bgp)
        elif self.config.order != "connected":
            raise ValueError(f"unknown order {self.config.order}")
        c = self.config
        return Compiler(self.store, self.sources, order, c.functions, c.value_equality, c.join, c.bgp_executor, c.stars and c.join is None, c.lexical_order)

    def sparql(self, text: str, bindings: Mapping[str, Term] | None = None) -> DataFrame:
        """Run a query text; bindings replace variables by terms first. Columns are variables, unbound is NULL."""
        q = parse_query(text)
        return self.run(q.substitute(bindings) if bindings else q)

    def run(self, q: Query | Pattern) -> DataFrame:
        if isinstance(q, Pattern):
            q = Query(q)
        engine = self
        if q.graphs or q.named_graphs:
            engine = Engine(self._dataset(q), self.config)
            engine.sources = self.sources
        return engine.compiler().query(q)

    def _dataset(self, q: Query) -> TripleStore:
        """FROM merges graphs into the default graph, FROM NAMED keeps the ones that GRAPH can see."""
        df = self.store.df
        if not self.store.has_graphs:
            raise ValueError("the store has no named graphs")
        default = df.where(F.col("g").isin([t.nt for t in q.graphs])).select("s", "p", "o", F.lit(None).cast("string").alias("g")).distinct()
        named = df.where(F.col("g").isin([t.nt for t in q.named_graphs])).select("s", "p", "o", "g")
        return TripleStore(default.unionByName(named))

    def create_view(self, name: str, text: str) -> DataFrame:
        """Run a query and make its result a temporary view, for SQL clients."""
        df = self.sparql(text)
        df.createOrReplaceTempView(name)
        return df

    def ask(self, text: str) -> bool:
        return self.sparql(text).first()[0]

    def explain(self, bgp: BGP) -> str:
        """Text of the plan that the exact search picks."""
        return P.Planner(self.store, self.config.planner).optimize(bgp).text(self.config.planner)

    def run_plan(self, plan: P.Plan, forced: bool = False) -> DataFrame:
        """Execute a plan of the planner; locations are the engine's sources in the order of the planner's configuration."""
        stores = [self.store, *[self.sources[n] for n in self.config.planner.sources[1:]]]
        relation: Relation = P.execute(plan, self.compiler(), stores, forced)
        names = [v.value for v in P.variables_of(plan) if v.kind == "var"]
        return relation.named(names)

    def federated(self, bgp: BGP) -> P.Plan:
        """Plan over all sources: unions pushed above joins, joins at one source done there, cheap branches first."""
        self.config.planner = P.federated_config(list(self.sources))
        return P.Planner(self.store, self.config.planner).optimize(bgp)


def row_text(df: DataFrame) -> Column:
    """A row in the form of format_rows."""
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns]
    return F.concat(F.lit("{ "), F.concat_ws(", ", *pairs), F.lit(" }")).alias("value")


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result rows as lines of text, written in parallel, in the form of format_rows."""
    df.select(row_text(df)).write.mode(mode).text(path)


def format_rows(df: DataFrame) -> list[str]:
    """Result rows as text, `{ x=<a>, y="b" }`; unbound variables are left out. Gathers the rows: for small results."""
    return ["{ " + ", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) + " }" for r in df.collect()]
