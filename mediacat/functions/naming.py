"""File names put together from a record's fields.

A name is a list of parts: literal strings and ``Field`` objects. Each field is a Column expression with
fallbacks; NULL and blank text count as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions.conditions import fixed, number
from mediacat.functions.text import is_blank


@dataclass(frozen=True)
class Ref:
    """A column with accessors (keys, indexes, slices), arithmetic and a date pattern applied to it in turn.

    ``date_pattern`` is a Spark pattern (``yyyy-MM-dd``), for ``YYYYMMDD`` or ISO text and for epoch seconds.
    """

    name: str
    accessors: tuple[str | int | slice, ...] = ()
    arithmetic: tuple[tuple[str, float], ...] = ()
    date_pattern: str | None = None


@dataclass(frozen=True)
class Field:
    """The first present reference. ``default`` stands in for a missing one, ``NA`` where there is no default.

    ``kind`` is one of ``s d f j l B D S q h c U R``; ``alternate`` is the ``#`` flag.
    """

    refs: tuple[Ref, ...]
    default: str | None = None
    drop_if_missing: bool = False
    kind: str = "s"
    width: int = 0
    precision: int | None = None
    zero_pad: bool = False
    alternate: bool = False


def field(name: str, **options) -> Field:
    return Field((Ref(name),), **options)


# --- one reference --------------------------------------------------------------------------------------------


def _bound(value: int | None, length: Column, otherwise: Column) -> Column:
    if value is None:
        return otherwise
    resolved = length + value if value < 0 else F.lit(value)
    return F.least(F.greatest(resolved, F.lit(0)), length)


def _access(c: Column, kind: T.DataType, step) -> tuple[Column, T.DataType]:
    null = F.lit(None).cast("string"), T.StringType()
    if isinstance(step, slice):
        if not isinstance(kind, (T.StringType, T.ArrayType)):
            return null
        size = F.length(c) if isinstance(kind, T.StringType) else F.size(c)
        start, end = _bound(step.start, size, F.lit(0)), _bound(step.stop, size, size)
        count = F.greatest(end - start, F.lit(0))
        cut = F.substring(c, start + 1, count) if isinstance(kind, T.StringType) else F.slice(c, start + 1, count)
        return cut, kind
    if isinstance(step, int):
        if not isinstance(kind, T.ArrayType):
            return null
        return F.get(c, F.lit(step) if step >= 0 else F.size(c) + step), kind.elementType
    if isinstance(kind, T.StructType) and step in kind.names:
        return c[step], kind[step].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(c, F.lit(step)), kind.valueType
    return null


def _numeric(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return number(c)
    return F.lit(None).cast("double")


def _dated(c: Column, kind: T.DataType, pattern: str) -> Column:
    if isinstance(kind, T.IntegralType):
        return F.date_format(F.timestamp_seconds(c), pattern)
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("string")
    compact = F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    iso = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(c, F.lit("yyyy-M-d")))
    return F.date_format(F.coalesce(compact, iso), pattern)


def _resolve(ref: Ref, schema: T.StructType) -> tuple[Column, T.DataType]:
    if ref.name not in schema.names:
        return F.lit(None).cast("string"), T.StringType()
    c, kind = F.col(ref.name), schema[ref.name].dataType
    if isinstance(kind, T.StringType):
        c = F.when(~is_blank(c), c)
    for step in ref.accessors:
        c, kind = _access(c, kind, step)
    if ref.arithmetic:
        c = _numeric(c, kind)
        kind = T.DoubleType()
        for op, operand in ref.arithmetic:
            v = F.lit(float(operand))
            if op == "/":
                c = c / v if operand else F.lit(None).cast("double")
            else:
                c = {"+": c + v, "-": c - v, "*": c * v}[op]
    if ref.date_pattern:
        c, kind = _dated(c, kind, ref.date_pattern), T.StringType()
    return c, kind


# --- formatting -----------------------------------------------------------------------------------------------


def number_text(c: Column, kind: T.DataType) -> Column:
    """A number as JSON writes it: doubles keep at least one decimal."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    return c.cast("string")


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda e: as_text(e, kind.elementType)), ", ", "NA")
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.NumericType):
        return number_text(c, kind)
    return c.cast("string")


def _as_json(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    if isinstance(kind, T.StringType):
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return as_text(c, kind)


def _scaled(n: Column, base: float, units: Sequence[str], show) -> Column:
    text, value = None, n
    for i, unit in enumerate(units):
        shown = show(value, i, unit)
        if i == len(units) - 1:
            return text.otherwise(shown)
        fits = F.abs(value) < base
        text = F.when(fits, shown) if text is None else text.when(fits, shown)
        value = value / base
    return text


def _bytes(n: Column, binary: bool) -> Column:
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"] if binary else ["B", "KB", "MB", "GB", "TB", "PB"]
    return _scaled(n, 1024.0 if binary else 1000.0, units, lambda v, i, u: F.concat(fixed(v, 2 if i else 0), F.lit(u)))


def _decimal(n: Column, binary: bool) -> Column:
    def show(v: Column, i: int, unit: str) -> Column:
        if i == 0:
            return fixed(v, 0)
        text = F.when(v == F.floor(v), fixed(v, 0)).otherwise(fixed(v, 1))
        return F.concat(text, F.lit(unit))

    return _scaled(n, 1024.0 if binary else 1000.0, ["", "K", "M", "G", "T", "P"], show)


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def _replace_all(c: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _unsafe(c: Column) -> Column:
    return F.regexp_replace(c, r'[/\\:*?"<>|]', "_")


def format_value(c: Column, kind: T.DataType, spec: Field) -> Column:
    """Text of a present value under a field's kind, width and precision."""
    text = as_text(c, kind)
    as_double = F.coalesce(_numeric(c, kind), F.lit(0.0))
    as_long = c.cast("long") if isinstance(kind, T.IntegralType) else as_double.cast("long")
    k = spec.kind
    if k == "d":
        out = as_long.cast("string")
    elif k == "f":
        out = fixed(as_double, 6 if spec.precision is None else spec.precision)
    elif k == "j":
        out = F.to_json(c, {"pretty": "true"}) if spec.alternate and isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else _as_json(c, kind)
    elif k == "l" and isinstance(kind, T.ArrayType):
        out = F.array_join(F.transform(c, lambda e: as_text(e, kind.elementType)), "\n" if spec.alternate else ", ", "NA")
    elif k == "B":
        out = _bytes(as_double, spec.alternate)
    elif k == "D":
        out = _decimal(as_double, spec.alternate)
    elif k == "S":
        out = _unsafe(F.regexp_replace(text, r"\p{Cc}", ""))
        out = F.regexp_replace(out, r"[^\x00-\x7F]", "_") if spec.alternate else out
    elif k == "q":
        out = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    elif k == "h":
        out = _replace_all(text, _HTML)
    elif k == "c":
        valid = as_long.between(0, 0x10FFFF) & ~as_long.between(0xD800, 0xDFFF)
        code = F.when(valid, as_long).otherwise(F.lit(0))
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(""))
    elif k == "R":
        out = F.format_number(as_long, 0)
    else:
        out = text
    if spec.width > 0:
        pad = F.lpad(out, spec.width, "0" if spec.zero_pad else " ")
        # Text is measured in bytes, numbers in digits; both only ever grow.
        size = F.length(out) if k in "df" else F.octet_length(out)
        padded = F.when(size < spec.width, pad)
        if k in "df":
            return F.coalesce(padded, out)
        cut = F.substring(out, 1, spec.precision) if k == "s" and spec.precision is not None else out
        return F.coalesce(padded, cut)
    if k == "s" and spec.precision is not None:
        return F.substring(out, 1, spec.precision)
    return out


def render_field(spec: Field, schema: T.StructType) -> Column:
    shown = [format_value(c, kind, spec) for c, kind in (_resolve(r, schema) for r in spec.refs)]
    present = [_resolve(r, schema)[0].isNotNull() for r in spec.refs]
    if spec.drop_if_missing:
        missing = F.lit("")
    else:
        missing = format_value(F.lit("NA" if spec.default is None else spec.default), T.StringType(), spec)
    text = missing
    for p, s in zip(reversed(present), reversed(shown)):
        text = F.when(p, s).otherwise(text)
    return _unsafe(F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", ""))


def render_name(df: DataFrame, parts: Sequence[str | Field]) -> Column:
    """A name for each row of ``df``; separators in field values are replaced, those in literals kept."""
    schema = df.schema
    return F.concat(*[F.lit(p) if isinstance(p, str) else render_field(p, schema) for p in parts])
