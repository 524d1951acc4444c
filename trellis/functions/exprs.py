"""Expressions to Columns. Every type error is NULL, so SQL's three-valued logic is SPARQL's, and nothing can throw."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.functions.terms import XSD, Term
from trellis.plans.algebra import Expr
from trellis.sources.store import Encoded

Function = Callable[..., Column]


class Value:
    """A compiled operand: kind is term, num, bool or text (a plain string)."""

    def __init__(self, kind: str, column: Column, const: Term | None = None, raw: Encoded | None = None):
        self.kind, self.column, self.const, self.raw = kind, column, const, raw

    def term(self) -> Column:
        if self.kind == "term":
            return self.column
        if self.kind == "num":
            return T.make_lit(self.column.cast("string"), XSD + "double")
        if self.kind == "bool":
            return T.make_lit(self.column.cast("string"), XSD + "boolean")
        return T.make_lit(self.column)

    def ebv(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "num":
            return (self.column != 0) & ~F.isnan(self.column.cast("double"))
        return self.column != "" if self.kind == "text" else T.ebv_of(self.column)

    def number(self) -> Column | None:
        """NULL where it is no number; None if it never is one."""
        if self.kind == "num":
            return self.column
        if self.kind != "term":
            return None
        if self.const is not None:
            n = self.const.number
            return None if n is None else F.lit(n)
        if self.raw is not None and self.raw.template is not None:
            return F.col(self.raw.name) if self.raw.number else None
        return T.num_of(self.column)

    def text(self) -> Column:
        """Lexical value of a literal, the string of an IRI or label."""
        if self.kind == "text":
            return self.column
        if self.kind != "term":
            return self.column.cast("string")
        if self.const is not None:
            return F.lit(self.const.value)
        if self.raw is not None and self.raw.text:
            return F.col(self.raw.name)
        if self.raw is not None and self.raw.template is not None and self.raw.prefix == '"':
            return F.col(self.raw.name).cast("string")
        return T.value_of(self.column)

    def rank(self) -> Column:
        if self.kind != "term":
            return F.when(self.column.isNotNull(), 2)
        if self.const is not None:
            return F.lit(self.const.order_key[0])
        if self.raw is not None and self.raw.template is not None:
            return F.when(F.col(self.raw.name).isNotNull(), 2 if self.raw.prefix == '"' else 1)
        return T.kind_rank(self.column)


#: Lexical spaces of the types that a plain text can be cast to.
_SPACES = {
    "integer": "^[+-]?[0-9]+$",
    "decimal": "^[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)$",
    "double": "^(?:[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "dateTime": "^-?[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?$",
}


def _casts() -> dict[str, Function]:
    """The XPath constructor casts: a plain text must be in the type's lexical space, a number is converted (to an integer by
    cutting its fraction off), a truth value is 1 or 0; anything else is an error. IRIs can be cast to strings only."""

    def parts(t: Column):
        dt, text = T.dt_of(t), F.btrim(T.value_of(t), F.lit(" \t\r\n"))
        plain = T.is_lit(t) & T.lang_of(t).isNull() & (dt.isNull() | (dt == XSD + "string"))
        numeric = dt.isin(T.NUMERIC) & text.rlike(_SPACES["double"])
        return text, plain, numeric, dt == XSD + "boolean"

    def truth(text: Column) -> Column:
        return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)

    def double(text: Column) -> Column:
        return F.replace(text, F.lit("INF"), F.lit("Infinity")).try_cast("double")

    def tidy(text: Column) -> Column:
        """A decimal without trailing zeros."""
        return F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)

    def integer(t: Column) -> Column:
        text, plain, numeric, boolean = parts(t)
        number = text.try_cast("decimal(38,10)")
        cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        whole = F.when(text.rlike(_SPACES["integer"]), text.try_cast("decimal(38,0)").cast("string"))
        return F.when(plain, whole).when(numeric, F.coalesce(whole, cut.cast("string"))).when(boolean, truth(text).cast("int").cast("string"))

    def decimal(t: Column) -> Column:
        text, plain, numeric, boolean = parts(t)
        number = tidy(text.try_cast("decimal(38,10)").cast("string"))
        return F.when(plain, F.when(text.rlike(_SPACES["decimal"]), number)).when(numeric, number).when(boolean, truth(text).cast("int").cast("string"))

    def floating(kind: str) -> Function:
        def of(t: Column) -> Column:
            text, plain, numeric, boolean = parts(t)
            number = F.replace(double(text).cast(kind).cast("string"), F.lit("Infinity"), F.lit("INF"))
            return F.when(plain & text.rlike(_SPACES["double"]) | numeric, number).when(boolean, truth(text).cast(kind).cast("string"))

        return of

    def boolean(t: Column) -> Column:
        text, plain, numeric, is_boolean = parts(t)
        number = double(text)
        return F.when(plain | is_boolean, truth(text).cast("string")).when(numeric, ((number != 0) & ~F.isnan(number)).cast("string"))

    def stamp(t: Column) -> Column:
        text, plain, _, _ = parts(t)
        read = F.replace(text.try_cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
        return F.when((plain | (T.dt_of(t) == XSD + "dateTime")) & text.rlike(_SPACES["dateTime"]), read)

    made = {"integer": integer, "decimal": decimal, "double": floating("double"), "float": floating("float"), "boolean": boolean, "dateTime": stamp}
    out: dict[str, Function] = {XSD + n: (lambda t, n=n, f=f: T.make_lit(f(t), XSD + n)) for n, f in made.items()}
    out[XSD + "string"] = lambda t: T.make_lit(F.when(~T.is_bnode(t), T.value_of(t)))
    return out


class ExprCompiler:
    """Compiles against columns of variables; a variable without a column is unbound.

    value_equality makes `=` and `!=` compare numbers by value; the default compares kind and lexical value only.
    lexical_order makes ORDER BY compare the texts of literals; the default compares numbers by value, before other literals.
    """

    def __init__(self, env: Mapping[str, Encoded], functions: Mapping[str, Function] | None = None, value_equality: bool = False, lexical_order: bool = False):
        self.env, self.value_equality, self.lexical_order = env, value_equality, lexical_order
        self.functions = {**_casts(), **(functions or {})}

    def condition(self, e: Expr) -> Column:
        """True, false or NULL (an error)."""
        return self.value(e).ebv()

    def order_columns(self, e: Expr, ascending: bool) -> list[Column]:
        v = self.value(e)
        if v.kind == "term":
            number = None if self.lexical_order else v.number()
            keys = [v.rank(), v.text(), v.term()]
            if number is not None:
                keys[1:1] = [number.isNull(), number]
            return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]
        return [v.column.asc_nulls_first() if ascending else v.column.desc_nulls_last()]

    def value(self, e: Expr) -> Value:
        if e.op == "node":
            return self._node(e.args[0])
        if e.op == "function":
            name = e.args[0].args[0].value
            if name not in self.functions:
                raise ValueError(f"unknown function <{name}>")
            return Value("term", self.functions[name](*[self.value(a).term() for a in e.args[1:]]))
        return getattr(self, "_" + _METHODS[e.op])(e)

    def _node(self, t: Term) -> Value:
        if not t.is_var:
            return Value("term", F.lit(t.nt), const=t)
        got = self.env.get(t.value)
        if got is None:
            return Value("term", F.lit(None).cast("string"))
        return Value("term", got.term(), raw=got)

    def _logic(self, e: Expr) -> Value:
        a = self.condition(e.args[0])
        if e.op == "!":
            return Value("bool", ~a)
        b = self.condition(e.args[1])
        return Value("bool", a | b if e.op == "||" else a & b)

    def _equal(self, e: Expr) -> Value:
        a, b = self.value(e.args[0]), self.value(e.args[1])
        x, y = a.number(), b.number()
        if x is not None and y is not None and (self.value_equality or a.kind == "num" or b.kind == "num"):
            same = F.coalesce(x == y, (a.rank() == b.rank()) & (a.text() == b.text()))
        else:
            # the text first: on a raw column it is a condition that the scan can use
            same = (a.text() == b.text()) & (a.rank() == b.rank())
            for v, other in ((a, b), (b, a)):
                if v.raw is not None and v.raw.text and other.const is not None and other.const.kind == "lit":
                    same = v.text() == other.text()
        return Value("bool", same if e.op == "=" else ~same)

    def _order(self, e: Expr) -> Value:
        a, b = self.value(e.args[0]), self.value(e.args[1])
        compare = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[e.op]
        x, y = a.number(), b.number()
        numeric = compare(x, y) if x is not None and y is not None else None
        surely = [v.kind == "num" or v.const is not None and v.const.number is not None or v.raw is not None and v.raw.number for v in (a, b)]
        if any(surely):
            return Value("bool", numeric if numeric is not None else F.lit(None).cast("boolean"))
        texts = F.when(a.rank() == b.rank(), compare(a.text(), b.text()))
        if numeric is None:
            return Value("bool", texts)
        return Value("bool", F.when(x.isNull() & y.isNull(), texts).otherwise(numeric))

    def _arithmetic(self, e: Expr) -> Value:
        numbers = [self.value(a).number() for a in e.args]
        if any(n is None for n in numbers):
            return Value("num", F.lit(None).cast("double"))
        a = numbers[0].cast("double")
        if len(numbers) == 1:
            return Value("num", -a if e.op == "neg" else a)
        b = numbers[1].cast("double")
        return Value("num", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e.op]())

    def _accessor(self, e: Expr) -> Value:
        v = self.value(e.args[0])
        t = v.term()
        if e.op == "str":
            return Value("text", v.text())
        if e.op == "lang":
            return Value("text", F.when(T.is_lit(t), F.coalesce(T.lang_of(t), F.lit(""))))
        plain = F.when(T.is_lit(t) & T.lang_of(t).isNull(), F.coalesce(T.dt_of(t), F.lit(XSD + "string")))
        return Value("term", T.make_iri(plain))

    def _test(self, e: Expr) -> Value:
        t = self.value(e.args[0]).term()
        test = {"isiri": T.is_iri, "isuri": T.is_iri, "isblank": T.is_bnode, "isliteral": T.is_lit, "bound": lambda x: x.isNotNull()}[e.op]
        return Value("bool", test(t))

    def _sameterm(self, e: Expr) -> Value:
        return Value("bool", self.value(e.args[0]).term() == self.value(e.args[1]).term())

    def _langmatches(self, e: Expr) -> Value:
        tag, wanted = (F.lower(self.value(a).text()) for a in e.args)
        return Value("bool", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))

    def _regex(self, e: Expr) -> Value:
        v = self.value(e.args[0])
        text = v.text() if v.kind != "term" else F.when(T.is_lit(v.term()), v.text())
        pattern = self.value(e.args[1])
        flags = self.value(e.args[2]).const.value if len(e.args) > 2 else ""
        if set(flags) - set("imsx"):
            raise ValueError(f"unknown flags of a regular expression: {flags}")
        head = f"(?{flags})" if flags else ""
        if pattern.const is not None:
            return Value("bool", text.rlike(head + pattern.const.value))
        return Value("bool", F.rlike(text, F.concat(F.lit(head), pattern.text())))


_METHODS = {
    **dict.fromkeys(["!", "||", "&&"], "logic"), **dict.fromkeys(["=", "!="], "equal"), **dict.fromkeys(["<", ">", "<=", ">="], "order"),
    **dict.fromkeys(["+", "-", "*", "/", "neg", "pos"], "arithmetic"), **dict.fromkeys(["str", "lang", "datatype"], "accessor"),
    **dict.fromkeys(["isiri", "isuri", "isblank", "isliteral", "bound"], "test"), "sameterm": "sameterm", "langmatches": "langmatches", "regex": "regex",
}
