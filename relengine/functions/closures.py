"""Closures over tuples become Column expressions, so that Catalyst sees into them.

A closure gets a Column for a scalar tuple and a :class:`TupleProxy` for others, and returns a Column, a proxy, a plain value,
a tuple (fields ``_1``, ``_2`` ...) or a dict (its keys).  It must be pure.  Use ``&``, ``|`` and ``~`` in place of
``and``, ``or`` and ``not``, ``F.array_contains`` in place of ``in``, and SQL ``div`` for integer division.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..schema import VALUE, is_scalar


def _name(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


class TupleProxy:
    """Fields of a tuple by attribute, name or position."""

    def __init__(self, schema: StructType, prefix: str | None = None):
        self._schema, self._prefix = schema, prefix

    def _column(self, name: str) -> Column:
        if name not in self._schema.names:
            raise AttributeError(name)
        return F.col(_name(*([self._prefix] if self._prefix else []), name))

    def __getattr__(self, name: str) -> Column:
        return self._column(name)

    def __getitem__(self, key: int | str) -> Column:
        return self._column(self._schema.names[key] if isinstance(key, int) else key)

    def __iter__(self):
        return (self._column(n) for n in self._schema.names)


def proxy(schema: StructType, prefix: str | None = None) -> Column | TupleProxy:
    """What a closure receives for tuples of ``schema`` whose columns stand in the struct ``prefix``, or at the top."""
    p = TupleProxy(schema, prefix)
    return p[VALUE] if is_scalar(schema) else p


def _value(x: Any) -> Column:
    if isinstance(x, TupleProxy):
        return F.struct(*[x[n].alias(n) for n in x._schema.names])
    if isinstance(x, tuple):
        return F.struct(*[_value(v).alias(f"_{i}") for i, v in enumerate(x, 1)])
    if isinstance(x, dict):
        return F.struct(*[_value(v).alias(k) for k, v in x.items()])
    return x if isinstance(x, Column) else F.lit(x)


def columns_of(result: Any) -> list[Column]:
    """The columns of what a closure returned."""
    if isinstance(result, TupleProxy):
        return [result[n].alias(n) for n in result._schema.names]
    if isinstance(result, tuple):
        return [_value(v).alias(f"_{i}") for i, v in enumerate(result, 1)]
    if isinstance(result, dict):
        return [_value(v).alias(k) for k, v in result.items()]
    return [_value(result).alias(VALUE)]


def pyudf(fn: Callable, returns: str | DataType) -> Callable:
    """A pure Python function of values as one of Columns, for what no built-in function expresses; batches go by Arrow."""
    return F.udf(fn, returns, useArrow=True)
