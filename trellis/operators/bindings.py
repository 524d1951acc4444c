"""Operators on tables of bindings: one nullable string column per variable, NULL for unbound.

These are the algebra's joins, unions and projections for frames made elsewhere, of which the caller says what may be unbound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import terms as T
from trellis.plans.compile import Compiler, Relation
from trellis.session import cut_lineage
from trellis.sources.store import Encoded


def shared_variables(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", may_be_unbound: Sequence[str] = (), hint: str | None = None) -> DataFrame:
    """Join on all variables that both sides have; without any, the product (which an outer join keeps whole as well).

    Variables of `may_be_unbound` also match where one side has NULL and take the other's value; the rest are an
    equi-join, in which NULL matches nothing. Columns: the left ones, then the new right ones.
    """
    compiler = Compiler(None)

    def relation(df: DataFrame) -> Relation:
        cols = {c: Encoded(compiler.fresh()) for c in df.columns}
        return Relation(df.select(*[F.col(c).alias(e.name) for c, e in cols.items()]), cols, frozenset(c for c in cols if c not in may_be_unbound))

    joined = compiler.join(relation(left), relation(right), how, hint=hint)
    return joined.named([*left.columns, *[c for c in right.columns if c not in left.columns]])


def left_join(left: DataFrame, right: DataFrame, may_be_unbound: Sequence[str] = ()) -> DataFrame:
    return natural_join(left, right, "left", may_be_unbound)


def union_bindings(*parts: DataFrame) -> DataFrame:
    """Bag union; a variable that a part lacks is NULL in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of the given variables in that order; an unknown one is unbound everywhere."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def distinct_bindings(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort_bindings(df: DataFrame, *names: str, ascending: bool = True) -> DataFrame:
    """Term order of the named variables, of all where none is named; unbound comes first."""
    return df.orderBy(*[k for n in names or df.columns for k in T.order_keys(n, ascending)])


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate once and read again as often as wanted; the rows are written to the shared checkpoint folder."""
    return cut_lineage(df)


def reduce_by(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that some row of right can join: a semi-join on the shared variables, for use before a costly join."""
    shared = shared_variables(left, right)
    return left.join(right.select(*shared).distinct(), shared, "left_semi").select(*left.columns) if shared else left


def spread(df: DataFrame, names: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows placed by a hash of the named variables, so that several joins on them need no further shuffle."""
    return df.repartition(partitions, *names) if partitions else df.repartition(*names)
