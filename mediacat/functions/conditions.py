"""Small building blocks shared by the Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value named once.

    A Column that is used in several places is copied into each of them; where such Columns are nested, the plan
    grows exponentially. Bound to a lambda variable, the value is planned and computed once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements of a run of ``running_count``.
RUN = 64


def running_count(flags: Column) -> Column:
    """How many of an array's flags up to each element are true, by runs: work grows with the length, not with its square."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def of_runs(x: Column) -> Column:
        last = F.greatest(F.ceil(F.size(x) / RUN), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(1), last), lambda r: F.slice(x, (r - 1) * RUN + 1, RUN))
        return let(cut, lambda cut: let(F.transform(cut, total), lambda totals: F.flatten(F.transform(cut, lambda own, i: counted(own, total(F.slice(totals, F.lit(1), i)))))))

    def counted(own: Column, before: Column) -> Column:
        return let(before, lambda b: F.transform(own, lambda _, k: b + total(F.slice(own, F.lit(1), k + 1))))

    return let(F.transform(flags, lambda f: F.when(f, 1).otherwise(0)), of_runs)


def lowered(c: Column) -> Column:
    """``lower``, which costs as much as several patterns, only where a character could change."""
    return let(c, lambda x: F.when(x.rlike(r"[^!-@\[-~]"), F.lower(x)).otherwise(x))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL where there is none or where it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def number(c: Column) -> Column:
    """Decimal text to double; NULL for anything else (Spark's own cast also takes '1d' or ' 1 ')."""
    ok = c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(ok, c.try_cast("double"))


def integer(c: Column) -> Column:
    return F.when(c.rlike(r"^\+?\d+$"), c.try_cast("long"))


def fixed(c: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded as the exact binary value demands (ties to even).

    ``format_string`` and ``round`` work on the shortest decimal form, which rounds 1.15 up although the double
    lies below it; splitting the value keeps the comparison with the midpoint exact.
    """
    return let(c, lambda x: _fixed(x, digits))


def _fixed(c: Column, digits: int) -> Column:
    scale = 10**digits
    parts = F.struct(F.abs(c).alias("v"), F.floor(F.abs(c) * F.lit(float(scale))).alias("whole"))
    return let(parts, lambda s: let(_nearest(s["v"], s["whole"], scale), lambda n: _digits(c, n, digits)))


def _nearest(v: Column, whole: Column, scale: int) -> Column:
    high = F.floor(v * F.lit(float(1 << 20))) / F.lit(float(1 << 20))
    twice = F.lit(2.0 * scale)
    rest = (high * twice - (whole * F.lit(2.0) + F.lit(1.0))) + (v - high) * twice
    up = let(rest, lambda r: (r > 0) | ((r == 0) & (whole % 2 == 1)))
    return whole + F.when(up, F.lit(1)).otherwise(F.lit(0))


def _digits(c: Column, n: Column, digits: int) -> Column:
    scale = 10**digits
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        return F.concat(sign, n.cast("string"))
    units = F.floor(n / F.lit(scale)).cast("string")
    decimals = F.lpad((n % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, units, F.lit("."), decimals)
