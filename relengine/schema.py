"""Tuple types as Spark schemas: a scalar is one column ``value``, a pair has ``_1`` and ``_2``, a record its own names."""

from __future__ import annotations

from enum import Enum
from typing import Any

from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StructField, StructType

VALUE = "value"


def tuple_schema(spec: str | DataType) -> StructType:
    """The schema of a DDL string, a type, or a schema.  Maps have no order and are refused."""
    if isinstance(spec, str):
        try:
            spec = StructType.fromDDL(spec)
        except Exception:
            spec = StructType.fromDDL(f"{VALUE} {spec}")
    if not isinstance(spec, StructType):
        spec = StructType([StructField(VALUE, spec)])
    if not spec.fields:
        raise TypeError("a tuple type needs a field")
    if len(set(spec.names)) < len(spec.names):
        raise TypeError(f"field names repeat: {spec.names}")
    _refuse_maps(spec)
    return spec


def _refuse_maps(t: DataType) -> None:
    if isinstance(t, MapType):
        raise TypeError("maps can't be compared; use an array of key-value structs in key order")
    if isinstance(t, ArrayType):
        _refuse_maps(t.elementType)
    if isinstance(t, StructType):
        for f in t.fields:
            _refuse_maps(f.dataType)


def shape(t: DataType) -> Any:
    """A type without nullability and metadata, for comparing."""
    if isinstance(t, StructType):
        return tuple((f.name, shape(f.dataType)) for f in t.fields)
    if isinstance(t, ArrayType):
        return ("array", shape(t.elementType))
    return t.simpleString()


def same(a: StructType, b: StructType) -> bool:
    return shape(a) == shape(b)


def is_scalar(s: StructType) -> bool:
    return s.names == [VALUE]


def either(left: str | DataType, right: str | DataType) -> StructType:
    """The type of a value of one of two types; left ones sort first."""
    types = [t if isinstance(t, DataType) else StructType.fromDDL(f"x {t}")["x"].dataType for t in (left, right)]
    return StructType([StructField("tag", IntegerType(), False), StructField("left", types[0]), StructField("right", types[1])])


def left(value: Any) -> tuple:
    """A value of the left type of :func:`either`."""
    return (0, value, None)


def right(value: Any) -> tuple:
    """A value of the right type of :func:`either`."""
    return (1, None, value)


def encoded(value: Any) -> Any:
    """A value with members of Python enumerations as their place in it, so that they sort as declared."""
    if isinstance(value, Enum):
        return list(type(value)).index(value)
    if isinstance(value, list):
        return [encoded(v) for v in value]
    if isinstance(value, tuple):
        return tuple(encoded(v) for v in value)
    return value


def as_row(value: Any, schema: StructType) -> tuple:
    """A Python value as a row of ``schema``."""
    value = {k: encoded(v) for k, v in value.items()} if isinstance(value, dict) else encoded(value)
    if is_scalar(schema):
        return (value,)
    if isinstance(value, dict):
        return tuple(value[n] for n in schema.names)
    row = tuple(value)
    if len(row) != len(schema.names):
        raise TypeError(f"{len(row)} values for {len(schema.names)} fields")
    return row


def from_row(row: Any, schema: StructType) -> Any:
    """A collected row as a Python value."""
    return row[0] if is_scalar(schema) else tuple(row)
