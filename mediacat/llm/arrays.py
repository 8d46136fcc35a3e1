"""Column helpers for long arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a membership map, and elements of a run.
MAP_WORDS, RUN = 4096, 64


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is, an expression used twice need not be."""
    return F.get(F.transform(F.array(x), body), 0)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def running_totals(x: Column) -> Column:
    """Running totals of an array of integers, by runs: about the length times RUN steps."""

    def of_runs(x: Column) -> Column:
        runs = F.floor((F.size(x) + RUN - 1) / RUN).cast("int")
        cut = F.transform(F.sequence(F.lit(1), runs), lambda r: F.slice(x, (r - 1) * RUN + 1, RUN))
        return bound(cut, lambda cut: bound(F.transform(cut, _sum), lambda totals: F.flatten(F.transform(cut, lambda own, i: bound(_sum(F.slice(totals, F.lit(1), i)), lambda before: F.transform(own, lambda _, k: before + _sum(F.slice(own, F.lit(1), k + 1))))))))

    return bound(x, lambda x: F.when(F.size(x) > 0, of_runs(x)).otherwise(F.array().cast("array<long>")))


def numbers(values: list, kind: str) -> Column:
    """A constant array from one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def membership_map(hashes, name: str) -> Column:
    """A constant map of 2**18 bits of all hashes in a column; its size does not depend on how many there are."""
    word, bit = F.shiftright(F.col(name), 6).bitwiseAND(F.lit(MAP_WORDS - 1)), F.col(name).bitwiseAND(F.lit(63)).cast("int")
    rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()
    found = dict((r.word, r.bits) for r in rows)
    return numbers([found.get(i, 0) for i in range(MAP_WORDS)], "long")


def in_map(bits: Column, h: Column) -> Column:
    """False for a hash that is not among those of the map; true for all of them and for a few others."""
    word = F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(MAP_WORDS - 1)).cast("int"))
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
