"""Lenient casts and semantic types: everything may be text, and text that is no number counts as null."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
TRUE_WORDS, FALSE_WORDS = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.select(name).schema[0].dataType


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double; text that is not plainly a number becomes null, never an error."""
    kind, c = kind_of(df, name), F.col(name)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def as_timestamp(df: DataFrame, name: str) -> Column:
    """The column as a timestamp without zone; text must begin with a full date."""
    kind, c = kind_of(df, name), F.col(name)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = c.cast("string")
    return F.when(text.rlike(DATE), text.try_cast("timestamp_ntz"))


def as_boolean(df: DataFrame, name: str) -> Column:
    kind, c = kind_of(df, name), F.col(name)
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.NumericType):
        return c != 0
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def half_up(c: Column) -> Column:
    """Rounding to whole numbers with halves towards plus infinity."""
    return F.floor(c + 0.5)


def semantic_type(df: DataFrame, name: str) -> str:
    """geometry, boolean, temporal, identifier, numeric, categorical or unknown, tested in this order."""
    kind = kind_of(df, name)
    if isinstance(kind, T.BinaryType) or name.lower() in ("geometry", "geom", "wkb_geometry"):
        return "geometry"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "temporal"
    if re.search(r"(^|_)(id|uuid|guid|key|code)$|key$", name.lower()):
        return "identifier"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "categorical" if isinstance(kind, T.StringType) else "unknown"


def normalised_types(df: DataFrame) -> DataFrame:
    """Whole numbers as int or bigint, decimals as double; arrays, maps and unknown types are dropped."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(c.cast("int").alias(f.name))
        elif isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
            out.append(c.cast("double").alias(f.name))
        elif not isinstance(kind, (T.ArrayType, T.MapType, T.NullType)):
            out.append(c)
    return df.select(*out)


def public_columns(df: DataFrame, geometry: tuple[str, ...] = ("geometry", "geom", "wkb_geometry")) -> DataFrame:
    """Without internal (``__``) and geometry columns."""
    return df.select(*[c for c in df.columns if not c.startswith("__") and c not in geometry])


def column_subset(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in the table's order, and the geometry beside them; an error where none or an unknown one is named."""
    if not columns:
        raise ValueError("no columns chosen")
    if unknown := set(columns) - set(df.columns):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return df.select(*[c for c in df.columns if c in columns or c in ("geometry", "geom", "wkb_geometry")])
