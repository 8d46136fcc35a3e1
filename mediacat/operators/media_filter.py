"""Predicates over media records.

A filter is a list of conditions that must all hold; several filters are alternatives; without any filter all
records pass. Values are compared as the record's JSON would show them: numbers (and numeric text) as numbers
where the other side is a number, everything else as text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions.conditions import number
from mediacat.functions.naming import number_text
from mediacat.operators.predicates import EPSILON, compare_numbers, compare_text, plain_number


@dataclass(frozen=True)
class Has:
    """The field is present; ``false`` counts as absent."""

    field: str
    negate: bool = False


@dataclass(frozen=True)
class Compare:
    """``field op value`` with ``op`` one of ``= != < <= > >= ^= $= *= ~=``."""

    field: str
    op: str
    value: float | int | str
    missing_ok: bool = False
    negate: bool = False


Condition = Has | Compare
MatchFilter = Sequence[Condition]


def _value(schema: T.StructType, field: str) -> tuple[Column, T.DataType] | None:
    if field in schema.names:
        return F.col(field), schema[field].dataType
    if "extra" in schema.names:
        # The open tail; numbers are told from text by the type the variant reports.
        return F.try_variant_get(F.col("extra"), f"$['{field}']", "variant"), T.VariantType()
    return None


def _as_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return number(c)
    if isinstance(kind, T.VariantType):
        return number(F.try_variant_get(c, "$", "string"))
    return F.lit(None).cast("double")


def _as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return number_text(c, kind)
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(c, "$", "string")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _compare(c: Compare, column: Column, kind: T.DataType) -> Column:
    numeric = isinstance(c.value, (int, float))
    text = compare_text(_as_text(column, kind), c.op, plain_number(c.value) if numeric else c.value)
    if not numeric or c.op in ("^=", "$=", "*=", "~="):
        return text
    n = _as_number(column, kind)
    if c.op in ("=", "!="):
        same = F.abs(n - F.lit(float(c.value))) < EPSILON
        by_number = same if c.op == "=" else ~same
    else:
        by_number = compare_numbers(n, c.op, float(c.value))
    return F.when(n.isNotNull(), by_number).otherwise(text)


def condition(c: Condition, schema: T.StructType) -> Column:
    found = _value(schema, c.field)
    if isinstance(c, Has):
        if found is None:
            present = F.lit(False)
        elif isinstance(found[1], T.BooleanType):
            present = F.coalesce(found[0], F.lit(False))
        elif isinstance(found[1], T.VariantType):
            present = found[0].isNotNull() & F.coalesce(F.try_variant_get(found[0], "$", "string") != "false", F.lit(True))
        else:
            present = found[0].isNotNull()
        return ~present if c.negate else present
    if found is None:
        return F.lit(c.missing_ok)
    result = _compare(c, *found)
    return F.coalesce(~result if c.negate else result, F.lit(c.missing_ok))


def matches(filters: Sequence[MatchFilter], schema: T.StructType) -> Column:
    if not filters:
        return F.lit(True)
    return reduce(or_, [reduce(and_, [condition(c, schema) for c in f], F.lit(True)) for f in filters])


def match_any(df: DataFrame, filters: Sequence[MatchFilter]) -> DataFrame:
    return df.where(matches(filters, df.schema))
