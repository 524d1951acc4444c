"""The query algebra: patterns and expressions as immutable trees, with variables, substitution and two printers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from trellis.functions.terms import Term

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _unique(terms: Iterable[Term]) -> list[Term]:
    return list(dict.fromkeys(terms))


# ---------------------------------------------------------------- expressions

#: Names in the s-expression form; operators without a name print as themselves.
SSE_NAMES = {
    "str": "sparql:str", "lang": "sparql:lang", "datatype": "sparql:datatype", "bound": "sparql:bound", "isiri": "sparql:isiri", "isuri": "sparql:isuri",
    "isblank": "sparql:isblank", "isliteral": "sparql:isliteral", "langmatches": "sparql:langmatches", "sameterm": "sparql:sameterm", "=": "eq", "!=": "neq",
}
#: Number of operands of each operator.
ARITY = {
    **dict.fromkeys(["!", "neg", "pos", "str", "lang", "datatype", "bound", "isiri", "isuri", "isblank", "isliteral"], (1, 1)),
    **dict.fromkeys(["||", "&&", "=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/", "langmatches", "sameterm"], (2, 2)),
    "regex": (2, 3),
    "function": (1, 99),
    "node": (1, 1),
}


@dataclass(frozen=True)
class Expr:
    """An operator with operands; op `node` holds a term, op `function` has the function's IRI as its first operand."""

    op: str
    args: tuple

    def __post_init__(self) -> None:
        least, most = ARITY.get(self.op, (None, None))
        if least is None:
            raise ValueError(f"unknown operator {self.op}")
        if not least <= len(self.args) <= most:
            raise ValueError(f"{self.op} takes {least} to {most} operands, not {len(self.args)}")

    def sse(self) -> str:
        if self.op == "node":
            return self.args[0].nt
        name = {"neg": "-", "pos": "+"}.get(self.op, SSE_NAMES.get(self.op, self.op))
        return f"({name} {' '.join(a.sse() for a in self.args)})"

    def variables(self) -> list[Term]:
        if self.op == "node":
            return [self.args[0]] if self.args[0].is_var else []
        return _unique(v for a in self.args for v in a.variables())

    def substitute(self, values: Mapping[str, Term]) -> Expr:
        if self.op == "node":
            t = self.args[0]
            return node(values[t.value]) if t.kind == "var" and t.value in values else self
        return Expr(self.op, tuple(a.substitute(values) for a in self.args))


def node(term: Term) -> Expr:
    return Expr("node", (term,))


def call(op: str, *args: Expr) -> Expr:
    return Expr(op, args)


# ---------------------------------------------------------------- patterns


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term
    g: Term | None = None

    @property
    def terms(self) -> tuple[Term, ...]:
        return (self.s, self.p, self.o) + ((self.g,) if self.g else ())

    def variables(self) -> list[Term]:
        return _unique(t for t in self.terms if t.is_var)

    def substitute(self, values: Mapping[str, Term]) -> Triple:
        put = lambda t: values[t.value] if t is not None and t.kind == "var" and t.value in values else t
        return Triple(put(self.s), put(self.p), put(self.o), put(self.g))

    def sse(self) -> str:
        return f"({'quad' if self.g else 'triple'} {' '.join(t.nt for t in self.terms)})"


class Pattern:
    """Base of all patterns. Children are the patterns below; a subclass names its own line in the s-expression form."""

    def children(self) -> tuple[Pattern, ...]:
        return ()

    def variables(self) -> list[Term]:
        """In order of first appearance."""
        return _unique(v for c in self.children() for v in c.variables())

    def head(self, pad: str) -> str:
        raise NotImplementedError

    def sse(self, indent: str = "  ", level: int = 0) -> str:
        deeper = indent * (level + 1)
        inner = "".join(deeper + c.sse(indent, level + 1) for c in self.children())
        return f"({self.head(deeper)}\n{inner}{indent * level})\n"


@dataclass(frozen=True)
class BGP(Pattern):
    triples: tuple[Triple, ...]

    def variables(self) -> list[Term]:
        return _unique(v for t in self.triples for v in t.variables())

    def substitute(self, values: Mapping[str, Term]) -> BGP:
        return BGP(tuple(t.substitute(values) for t in self.triples))

    def sse(self, indent: str = "  ", level: int = 0) -> str:
        inner = "".join(f"{indent * (level + 1)}{t.sse()}\n" for t in self.triples)
        return f"(bgp\n{inner}{indent * level})\n"

    def sparql(self) -> str:
        """Turtle-like text, with `;` for a repeated subject and `,` for a repeated subject and predicate."""
        parts: list[str] = []
        last: Triple | None = None
        for t in self.triples:
            if last and t.s == last.s and t.p == last.p:
                parts.append(f", {t.o}")
            elif last and t.s == last.s:
                parts.append(f" ;\n\t\t{t.p} {t.o}")
            else:
                parts.append((" .\n\t" if last else "") + f"{t.s} {t.p} {t.o}")
            last = t
        body = "".join(parts)
        return f"{{{body}}}" if len(self.triples) < 2 else f"{{\n\t{body} .\n}}\n"


@dataclass(frozen=True)
class Group(Pattern):
    parts: tuple[Pattern, ...]

    def children(self):
        return self.parts

    def head(self, pad):
        return "ggp"

    def substitute(self, values):
        return Group(tuple(p.substitute(values) for p in self.parts))


@dataclass(frozen=True)
class Union(Pattern):
    parts: tuple[Pattern, ...]

    def children(self):
        return self.parts

    def head(self, pad):
        return "union"

    def substitute(self, values):
        return Union(tuple(p.substitute(values) for p in self.parts))


@dataclass(frozen=True)
class Optional(Pattern):
    left: Pattern
    right: Pattern

    def children(self):
        return (self.left, self.right)

    def head(self, pad):
        return "optional"

    def substitute(self, values):
        return Optional(self.left.substitute(values), self.right.substitute(values))


@dataclass(frozen=True)
class Filter(Pattern):
    expr: Expr
    child: Pattern

    def children(self):
        return (self.child,)

    def head(self, pad):
        return f"filter\n{pad}{self.expr.sse()}"

    def substitute(self, values):
        return Filter(self.expr.substitute(values), self.child.substitute(values))


@dataclass(frozen=True)
class Graph(Pattern):
    name: Term
    child: Pattern

    def children(self):
        return (self.child,)

    def variables(self):
        return _unique([*([self.name] if self.name.is_var else []), *self.child.variables()])

    def head(self, pad):
        return f"named-graph {self.name}"

    def substitute(self, values):
        name = values.get(self.name.value, self.name) if self.name.kind == "var" else self.name
        return Graph(name, self.child.substitute(values))


@dataclass(frozen=True)
class Service(Pattern):
    name: Term
    child: Pattern

    def children(self):
        return (self.child,)

    def head(self, pad):
        return f"service {self.name}"

    def substitute(self, values):
        return Service(self.name, self.child.substitute(values))


@dataclass(frozen=True)
class Values(Pattern):
    """Inline rows; None is unbound."""

    names: tuple[str, ...]
    rows: tuple[tuple[Term | None, ...], ...]

    def variables(self):
        return [Term("var", n) for n in self.names]

    def sse(self, indent="  ", level=0):
        rows = "".join(f"{indent * (level + 1)}(row {' '.join('undef' if t is None else t.nt for t in r)})\n" for r in self.rows)
        return f"(table {' '.join('?' + n for n in self.names)}\n{rows}{indent * level})\n"

    def substitute(self, values):
        return self


@dataclass(frozen=True)
class Query:
    """A pattern with its result form: select (names None is *), ask, construct, describe or pattern (the bare `{...}` form)."""

    pattern: Pattern
    form: str = "pattern"
    names: tuple[str, ...] | None = None
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    template: tuple[Triple, ...] = ()
    graphs: tuple[Term, ...] = ()
    named_graphs: tuple[Term, ...] = ()
    described: tuple[Term, ...] = ()

    def variables(self) -> list[str]:
        if self.names is not None:
            return list(self.names)
        return [v.value for v in self.pattern.variables() if v.kind == "var"]

    def substitute(self, values: Mapping[str, Term]) -> Query:
        return replace(self, pattern=self.pattern.substitute(values))


@dataclass
class Fresh:
    """Numbers for labels that a parser has to invent."""

    n: int = field(default=0)

    def __call__(self, prefix: str) -> str:
        self.n += 1
        return f"{prefix}{self.n}"
