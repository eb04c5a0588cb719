"""Expressions compiled to lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedExpression
from ..functions import columns_of, proxy
from ..operators.nodes import Difference, Empty, Expression, Full, Intersect, Join, Mono, Product, Project, Relation, Select, Singleton, Union, View, no_rows


@dataclass(frozen=True)
class Plan:
    """A DataFrame and whether its rows are known to be distinct."""

    df: DataFrame
    unique: bool

    def distinct(self) -> DataFrame:
        return self.df if self.unique else self.df.distinct()


def select(e: Select, df: DataFrame) -> DataFrame:
    return df.where(e.predicate(proxy(e.schema)))


def project(e: Project, df: DataFrame) -> DataFrame:
    return df.select(columns_of(e.mapper(proxy(e.expression.schema))))


def product(e: Product, left: DataFrame, right: DataFrame) -> DataFrame:
    """Each side is a struct, so that names can't clash; Catalyst still prunes the fields that aren't used."""
    pairs = left.select(F.struct("*").alias("l")).crossJoin(right.select(F.struct("*").alias("r")))
    return pairs.select(columns_of(e.mapper(proxy(e.left.schema, "l"), proxy(e.right.schema, "r"))))


def read_columns(df: DataFrame) -> set[str]:
    """Names of the columns that the outermost projection of ``df`` reads, as Spark has resolved them."""
    found = df._jdf.queryExecution().analyzed().references().toSeq()
    return {found.apply(i).name() for i in range(found.size())}


def join(e: Join, left: DataFrame, right: DataFrame, nulls_apart: bool = False) -> DataFrame:
    """A null-safe equi-join; plain equality where a side's key can't be null, as that lets Catalyst infer filters.

    With ``nulls_apart``, a key of one column is compared plainly, which is much faster, and null keys are joined on their own; their
    filters reach the scans, whose statistics tell where there are none.  If the mapper reads the key and one side alone, a semi-join gives the same set with fewer rows.
    """
    out = e.mapped()
    lk, rk = e.key_schemas

    def side(name: str, df: DataFrame) -> DataFrame:
        """The side's struct and its key as columns of their own, on which Spark can partition and push filters."""
        return e.keyed(name, df).select(name, *[F.col(f"k.`{f.name}`").alias(f"{name}k{i}") for i, f in enumerate(lk.fields)])

    def key(name: str) -> Column:
        return F.struct(*[F.col(f"{name}k{i}").alias(f.name) for i, f in enumerate(lk.fields)]).alias("k")

    l, r = side("l", left), side("r", right)  # noqa: E741
    on = []
    for i, (a, b) in enumerate(zip(lk.fields, rk.fields)):
        x, y = F.col(f"lk{i}"), F.col(f"rk{i}")
        on.append(x.eqNullSafe(y) if a.nullable and b.nullable else x == y)
    if nulls_apart and len(on) == 1 and lk.fields[0].nullable and rk.fields[0].nullable:
        x, y = F.col("lk0"), F.col("rk0")
        return joined(l, r, x == y, out, key).union(joined(l.where(x.isNull()), r.where(y.isNull()), x.eqNullSafe(y), out, key))
    return joined(l, r, reduce(lambda a, b: a & b, on), out, key)


def joined(l: DataFrame, r: DataFrame, condition: Column, out: list[Column], key: Callable[[str], Column]) -> DataFrame:  # noqa: E741
    whole = l.join(r, condition).select("l", "r", key("l")).select(out)
    reads = read_columns(whole)
    for main, other, name, unread in ((l, r, "l", "r"), (r, l, "r", "l")):
        if unread not in reads:
            return main.join(other, condition, "left_semi").select(name, key(name)).select(out)
    return whole


def evaluate(e: Expression, leaf: Callable[[Expression], Plan]) -> Plan:
    """The whole set of ``e``.  ``leaf`` gives the rows of relations and views.

    Results are sets, but only the root makes rows distinct where it must: selection, projection, union, product and join
    don't mind repeated input.  As product and join multiply it, a projection or union below them is made distinct first.
    """
    if isinstance(e, (Relation, View)):
        return leaf(e)
    if isinstance(e, Full):
        raise UnsupportedExpression("Full", "Evaluate")
    if isinstance(e, Empty):
        return Plan(no_rows(e.schema), True)
    if isinstance(e, Singleton):
        return Plan(SparkSession.active().createDataFrame([e.row], e.schema), True)
    if isinstance(e, Mono):
        return evaluate(e.expression, leaf)
    if isinstance(e, Select):
        p = evaluate(e.expression, leaf)
        return Plan(select(e, p.df), p.unique)
    if isinstance(e, Project):
        return Plan(project(e, evaluate(e.expression, leaf).df), False)
    left, right = evaluate(e.left, leaf), evaluate(e.right, leaf)
    if isinstance(e, Union):
        return Plan(left.df.union(right.df), False)
    if isinstance(e, Intersect):
        return Plan(left.df.intersect(right.df), True)
    if isinstance(e, Difference):
        return Plan(left.df.subtract(right.df), True)
    pair = [p.distinct() if isinstance(x, (Project, Union)) else p.df for x, p in ((e.left, left), (e.right, right))]
    return Plan((product if isinstance(e, Product) else join)(e, *pair), False)


@dataclass(frozen=True)
class Change:
    """What an expression had (``old``) and what has come since (``new``, which may repeat ``old``); None is nothing."""

    old: DataFrame | None
    new: DataFrame | None

    @property
    def all(self) -> DataFrame | None:
        return both(self.old, self.new)


def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return a.union(b) if a is not None and b is not None else a if b is None else b


def changes(e: Expression, leaf: Callable[[Expression], Change], first: bool) -> Change:
    """The change of ``e`` from the changes of its leaves.  ``first``: there was nothing before, so constants are new.

    Of two inputs: new = new left with all right, and old left with new right.  Difference isn't monotone and has no such rule.
    """
    if isinstance(e, (Relation, View)):
        return leaf(e)
    if isinstance(e, Full):
        raise UnsupportedExpression("Full", "Evaluate")
    if isinstance(e, Difference):
        raise UnsupportedExpression("Difference", "Create View")
    if isinstance(e, Empty):
        return Change(None, None)
    if isinstance(e, Singleton):
        df = SparkSession.active().createDataFrame([e.row], e.schema)
        return Change(None, df) if first else Change(df, None)
    if isinstance(e, Mono):
        return changes(e.expression, leaf, first)
    if isinstance(e, (Select, Project)):
        apply, c = select if isinstance(e, Select) else project, changes(e.expression, leaf, first)
        return Change(*(None if df is None else apply(e, df) for df in (c.old, c.new)))
    left, right = changes(e.left, leaf, first), changes(e.right, leaf, first)
    if isinstance(e, Union):
        return Change(both(left.old, right.old), both(left.new, right.new))
    pair = {Intersect: lambda a, b: a.intersect(b), Product: lambda a, b: product(e, a, b), Join: lambda a, b: join(e, a, b, nulls_apart=True)}[type(e)]
    of = lambda a, b: None if a is None or b is None else pair(a, b)
    return Change(of(left.old, right.old), both(of(left.new, right.all), of(left.old, right.new)))
