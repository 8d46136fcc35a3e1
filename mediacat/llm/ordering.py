"""Rows beside their successor: ranges of an ordered key, each with a copy of the first row of the next range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds are searched in runs of this length.
RUN = 64


def bounds_of(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending keys of the table, the smallest first, that cut it into about ``parts`` equal ranges."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = df.agg(F.min(key).alias("low"), F.percentile_approx(key, shares, 10_000).alias("cuts")).first()
    return sorted({row.low, *row.cuts}) if row.low is not None else []


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds after the first are at most the key."""
    rest = bounds[1:]
    if len(rest) <= RUN:
        return F.size(F.filter(F.lit(rest), lambda b: b <= key)) if rest else F.lit(0)
    heads = rest[::RUN]
    run = F.greatest(F.size(F.filter(F.lit(heads), lambda b: b <= key)) - 1, F.lit(0))
    return run * RUN + F.size(F.filter(F.slice(F.lit(rest), run * RUN + 1, RUN), lambda b: b <= key))


def with_successors(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ranges of ``key`` (a long without nulls), sorted by ``key`` and ``text`` within.

    The first rows of each range, all those with its lowest key, are also in the range before (those of the first range
    in the last) with ``is_guest`` true, behind its own rows: the successor of every row but a guest is the next row.
    One shuffle of the rows; the bounds come from a scan of the key alone.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = bounds_of(df.select(key), key, parts)
    own = range_number(F.col(key), bounds)
    first = F.array_contains(F.lit(bounds), F.col(key)) if bounds else F.lit(False)
    before = F.when(F.col("_own") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("_own") - 1)
    places = F.when(F.col("_first"), F.array(F.struct(F.col("_own").alias("part"), F.lit(False).alias("guest")), F.struct(before.alias("part"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct(F.col("_own").alias("part"), F.lit(False).alias("guest"))))
    dealt = df.withColumns({"_own": own, "_first": first}).withColumn("_place", F.explode(places))
    dealt = dealt.withColumns({"range_no": F.col("_place.part"), "is_guest": F.col("_place.guest")}).drop("_own", "_first", "_place")
    return dealt.repartition(parts, "range_no").sortWithinPartitions("range_no", "is_guest", key, "text")
