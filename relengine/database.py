"""The database: named relations that only grow, and views that stay up to date."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .errors import InstanceExists, InstanceNotFound, UnsupportedExpression
from .operators.nodes import Difference, Expression, Full, Intersect, Join, Product, Project, Relation, Select, Union, View, no_rows, to_expression
from .operators.visitor import contains
from .plans import Change, changes, evaluate, rewrite
from .plans.compile import Plan
from .schema import from_row, same, tuple_schema
from .sources import Store, Tuples, checked, rows

MOST_EPOCHS = 8  # batches of an instance before those that every view has seen become one


@dataclass
class Instance:
    """Tuples as epochs, each an immutable DataFrame of tuples that no earlier one has; ``pending`` was inserted since."""

    schema: Any
    epochs: list[tuple[int, DataFrame]] = field(default_factory=list)
    pending: list[DataFrame] = field(default_factory=list)
    distinct: bool = True  # whether the epochs' rows are distinct

    @property
    def last(self) -> int:
        return self.epochs[-1][0] if self.epochs else 0

    def upto(self, seen: int) -> DataFrame | None:
        return _union(df for n, df in self.epochs if n <= seen)

    def since(self, seen: int) -> DataFrame | None:
        return _union(df for n, df in self.epochs if n > seen)

    def copy(self) -> Instance:
        return Instance(self.schema, list(self.epochs), list(self.pending), self.distinct)


@dataclass
class Stored:
    """A view's instance, and the last epoch of each instance it reads that it has taken in (None: nothing yet).

    ``plan`` is the expression that is maintained: the view's own, with inner joins as views of their own.
    """

    view: View
    plan: Expression
    instance: Instance
    seen: dict[Any, int] | None = None

    def copy(self) -> Stored:
        return Stored(self.view, self.plan, self.instance.copy(), None if self.seen is None else dict(self.seen))


def _union(dfs: Iterable[DataFrame]) -> DataFrame | None:
    found = list(dfs)
    return reduce(DataFrame.union, found) if found else None


class Database:
    """Relations by name and views by reference.

    Evaluation gives lazy DataFrames of distinct rows in no order; :meth:`tuples` sorts and collects them.  Inserts are
    gathered until an evaluation or a view needs them.  A view is refreshed by the new tuples alone.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._store = spark, Store(spark)
        self._relations: dict[str, Instance] = {}
        self._views: dict[tuple[str, int], Stored] = {}
        self._family, self._next = uuid.uuid4().hex, 0

    def add_relation(self, name: str, schema: str | DataType) -> Relation:
        """A new, empty relation of a tuple type: a DDL string such as ``int`` or ``a int not null, b string``, or a Spark type."""
        if name in self._relations:
            raise InstanceExists(name)
        r = Relation(name, tuple_schema(schema))
        self._relations[name] = Instance(r.schema)
        return r

    def attach(self, name: str, df: DataFrame, *, unique: bool = False) -> Relation:
        """A new relation over a DataFrame that can be read again, such as a Parquet table, without copying it.

        ``unique`` promises that its rows are distinct, which saves a shuffle.
        """
        r = self.add_relation(name, df.schema)
        self._relations[name] = Instance(r.schema, [(1, df)], [], unique)
        return r

    def insert(self, relation: Relation, tuples: Iterable[Any] | DataFrame) -> None:
        """Add tuples, given as Python values or as a DataFrame of the relation's type; what is there already stays as it is."""
        instance = self._instance(relation)
        if isinstance(tuples, DataFrame):
            instance.pending.append(checked(tuples, instance.schema))
        elif values := list(tuples):
            instance.pending.append(rows(self.spark, values, instance.schema))

    def evaluate(self, expression: Expression) -> DataFrame:
        """The set of an expression or builder, as a lazy DataFrame."""
        e = to_expression(expression)
        self._refresh_all(e)
        return evaluate(rewrite(e) if not contains(e, Full) else e, self._plan).distinct()

    def tuples(self, expression: Expression) -> Tuples:
        """The sorted set as Python values: fields in order, None first."""
        e = to_expression(expression)
        df = self.evaluate(e)
        return Tuples(from_row(r, e.schema) for r in df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in df.columns]).collect())

    def store_view(self, expression: Expression) -> View:
        """Keep an expression's set up to date.  Nothing is registered unless all it reads is there and it can be maintained."""
        e = to_expression(expression)
        if contains(e, Difference):
            raise UnsupportedExpression("Difference", "Create View")
        if contains(e, Full):
            raise UnsupportedExpression("Full", "Evaluate")
        self._check(e)
        return self._keep_view(e)

    def _keep_view(self, e: Expression) -> View:
        plan = self._staged(rewrite(e))
        self._next += 1
        v = View((self._family, self._next), e)
        self._views[v.reference] = Stored(v, plan, Instance(e.schema))
        return v

    def _staged(self, e: Expression) -> Expression:
        """``e`` with each join or intersection below another pair of inputs as a view of its own.

        A refresh then meets what such an input had as a stored table and what it gained as a small one, and never joins old tuples again.
        """
        if isinstance(e, (Select, Project)):
            x = self._staged(e.expression)
            return Select(x, e.predicate) if isinstance(e, Select) else Project(x, e.mapper)
        if isinstance(e, Union):
            return Union(self._staged(e.left), self._staged(e.right))
        if isinstance(e, (Join, Product, Intersect)):
            left, right = (self._keep_view(x) if contains(x, Join) or contains(x, Intersect) else x for x in (e.left, e.right))
            if isinstance(e, Join):
                return Join(left, right, e.left_key, e.right_key, e.mapper)
            return Product(left, right, e.mapper) if isinstance(e, Product) else Intersect(left, right)
        return e

    def clone(self) -> Database:
        """A snapshot: both go on apart, and handles of relations and views work on both.  DataFrames are shared, not copied."""
        other = Database.__new__(Database)
        other.spark, other._store = self.spark, Store(self.spark)
        other._relations = {k: v.copy() for k, v in self._relations.items()}
        other._views = {k: v.copy() for k, v in self._views.items()}
        other._family, other._next = self._family, self._next
        return other

    __copy__ = clone

    def _instance(self, e: Expression) -> Instance:
        if isinstance(e, View):
            found = self._views.get(e.reference)
            if found is None or found.view is not e:
                raise InstanceNotFound(f"view {e.reference[1]}")
            return found.instance
        found = self._relations.get(e.name)
        if found is None or not same(found.schema, e.schema):
            raise InstanceNotFound(e.name)
        return found

    def _leaves(self, e: Expression) -> list[Expression]:
        if isinstance(e, (Relation, View)):
            return [e]
        return [x for i in e.inputs for x in self._leaves(i)]

    def _check(self, e: Expression) -> None:
        for leaf in self._leaves(e):
            self._instance(leaf)

    def _refresh_all(self, e: Expression) -> None:
        self._check(e)
        for leaf in dict.fromkeys(self._leaves(e)):
            self._refresh(leaf)

    def _plan(self, leaf: Expression) -> Plan:
        i = self._instance(leaf)
        df = i.upto(i.last)
        return Plan(no_rows(i.schema), True) if df is None else Plan(df, i.distinct)

    def _refresh(self, leaf: Expression) -> None:
        """Make an epoch of what is pending or, for a view, of what it gains by its inputs' new epochs."""
        i = self._instance(leaf)
        if isinstance(leaf, Relation):
            if i.pending:
                new = _union(i.pending).distinct()
                self._append(i, new)
                i.pending = []
            return
        stored = self._views[leaf.reference]
        e = stored.plan
        inputs = list(dict.fromkeys(self._leaves(e)))
        for x in inputs:
            self._refresh(x)
        now = {_key(x): self._instance(x).last for x in inputs}
        if stored.seen == now:
            return
        first, seen = stored.seen is None, stored.seen or {}

        def change(x: Expression) -> Change:
            source = self._instance(x)
            old = seen.get(_key(x), 0)
            return Change(source.upto(old), source.since(old))

        gain = changes(e, change, first).new
        if gain is not None:
            self._append(i, gain.distinct())
        stored.seen = now
        for x in inputs:
            self._compact(x)

    def _append(self, i: Instance, new: DataFrame) -> None:
        """One more epoch, of the tuples of ``new`` (distinct) that aren't there yet; written, so that plans don't grow with epochs.

        What is there is much more than what is new, as a rule.  If the new tuples are few enough to be broadcast, by Spark's estimate
        or as measured once they are written, what is there is only scanned for them and isn't shuffled; else both are.
        """
        old, store = i.upto(i.last), self._store
        if old is not None and store.is_small(new, of_pure=True):
            kept = store.keep(missing(new, old))
        else:
            kept = store.keep(new)
            if old is not None:
                kept = store.keep(missing(kept, old) if store.is_small(kept) else kept.subtract(old))
        if not store.is_empty(kept):
            i.epochs.append((i.last + 1, kept))

    def _compact(self, x: Expression) -> None:
        """Write the epochs that every view has taken in as one, once there are many.  The first is left alone if it is attached."""
        i = self._instance(x)
        if len(i.epochs) <= MOST_EPOCHS:
            return
        marks = [s.seen.get(_key(x), 0) if s.seen is not None else i.last for s in self._views.values() if s.seen is None or _key(x) in s.seen]
        low = min(marks, default=i.last)
        old = [(n, df) for n, df in i.epochs[1:] if n <= low]
        if len(old) > 1:
            merged = (old[-1][0], self._store.keep(_union(df for _, df in old)))
            i.epochs = [i.epochs[0], merged, *[x for x in i.epochs if x[0] > low]]


def missing(few: DataFrame, many: DataFrame) -> DataFrame:
    """The distinct rows of ``few`` that ``many`` lacks.  Of ``many``, only rows whose hash ``few`` has come to the exact comparison.

    What is broadcast is ``few``, and the rows of ``many`` that it may hold.
    """
    equal = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(a.columns))])
    a, b = few.toDF(*[f"a{i}" for i in range(len(few.columns))]), many.toDF(*[f"b{i}" for i in range(len(few.columns))])
    if any(t in few.schema.simpleString() for t in ("float", "double")):  # equal ones, as 0.0 and -0.0, may differ in their hashes
        there = b.join(F.broadcast(a), equal(a, b), "left_semi")
    else:
        there = b.join(F.broadcast(a.select(F.xxhash64(*a.columns).alias("h"))), F.xxhash64(*b.columns) == F.col("h"), "left_semi")
    there = there.distinct()
    return a.join(F.broadcast(there), equal(a, there), "left_anti").toDF(*few.columns)


def _key(x: Expression) -> Any:
    return x.reference if isinstance(x, View) else x.name
