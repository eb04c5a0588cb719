"""Tuples from Parquet tables, DataFrames and Python values."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import as_row, same


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A table by any path that Spark reads; filters and columns used later reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def rows(spark: SparkSession, values: Iterable[Any], schema: StructType) -> DataFrame:
    """Python values as tuples of ``schema``, without repeats."""
    seen = list(dict.fromkeys(_hashable(as_row(v, schema)) for v in values))
    return spark.createDataFrame([_plain(r) for r in seen], schema)


def _hashable(v: Any) -> Any:
    return ("list", *map(_hashable, v)) if isinstance(v, list) else ("tuple", *map(_hashable, v)) if isinstance(v, tuple) else v


def _plain(v: Any) -> Any:
    if isinstance(v, tuple):
        return (list if v[0] == "list" else tuple)(map(_plain, v[1:]))
    return v


def checked(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` if it has the type of ``schema``; a null in a field declared not null raises when it is read."""
    if not same(df.schema, schema):
        raise TypeError(f"{df.schema.simpleString()} for {schema.simpleString()}")
    if all(f.nullable or not g.nullable for f, g in zip(schema.fields, df.schema.fields)):
        return df
    sure = lambda f: F.when(F.col(f"`{f.name}`").isNotNull(), F.col(f"`{f.name}`")).otherwise(F.raise_error(F.lit(f"null in {f.name}"))).cast(f.dataType)
    return df.select(*[F.col(f"`{f.name}`") if f.nullable else sure(f).alias(f.name) for f in schema.fields])
