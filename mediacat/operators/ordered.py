"""Running values over long ordered groups.

A plain window puts a whole group into one task. The functions here split every group into blocks of its
order column instead: each block is scanned on its own, the blocks' totals (one small row each) are scanned per
group, and the carried value is joined back. A group of any length is thus spread over many tasks, and the
result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 100_000


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum``, ``min``, ``max`` or ``last`` (last non-null).

    With ``exclusive`` the row's own value is left out.
    """

    kind: str
    value: Column
    exclusive: bool = False


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _windowed(spec: Running, window) -> Column:
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(window)
    return _AGG[spec.kind](spec.value).over(window)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Running],
    block: Column | int = DEFAULT_BLOCK,
) -> DataFrame:
    """Add running values over ``keys`` in the order of the ``order`` column, which is unique in its group.

    ``block`` is either a width of ``order`` (numeric) or a Column that does not decrease with ``order``.
    """
    keys = list(keys)
    block_col = F.floor(F.col(order) / F.lit(block)) if isinstance(block, int) else block
    with_block = df.withColumn("_block", block_col)
    local_keys = [*keys, "_block"]
    ordered = Window.partitionBy(*local_keys).orderBy(order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # The totals are the inclusive values of the blocks' last rows, so that both sides start from one exchange.
    local = with_block.select(
        "*",
        *[_windowed(s, before if s.exclusive else upto).alias(f"_l_{n}") for n, s in values.items()],
        *[_windowed(s, upto).alias(f"_t_{n}") for n, s in values.items()],
        F.lead(F.lit(True)).over(ordered).isNull().alias("_ends"),
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = local.where("_ends").select(
        *local_keys,
        *[
            _windowed(Running(s.kind, F.col(f"_t_{n}")), earlier).alias(f"_c_{n}")
            for n, s in values.items()
        ],
    )
    on = None
    for k in local_keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    joined = local.alias("a").join(carried.alias("b"), on, "inner")
    return joined.select(
        *[F.col(f"a.{c}") for c in df.columns],
        *[
            _combine(s.kind, F.col(f"b._c_{n}"), F.col(f"a._l_{n}")).alias(n)
            for n, s in values.items()
        ],
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "rn", block: Column | int = DEFAULT_BLOCK
) -> DataFrame:
    """``row_number`` that does not need a whole group in one task."""
    return running(df, keys, order, {name: Running("sum", F.lit(1).cast("long"))}, block)


#: Sampled rows for each partition of a shuffle, and those that make one bucket.
SAMPLES_A_PARTITION, BUCKET_SAMPLES = 64, 16


def bucketed(df: DataFrame, by: str, key: Column, tie: str, descending: bool = False, draw: Column | None = None) -> DataFrame:
    """Rows with ``_key``, and ``_bucket``, which grows in the order of ``_key`` and then ``tie`` in a group.

    A sample of a size that depends on the number of shuffle partitions alone, drawn by a hash (``draw``, or else that of
    group and tie), shows which groups hold more than a small share of all rows and where their keys lie. Every ``BUCKET_SAMPLES``-th sampled
    key of such a group is the bound of a bucket; other groups are one bucket, and ``_bounds`` is NULL. There is at most
    one bound for each ``BUCKET_SAMPLES`` sampled rows, so that all of them can be sent to all tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({"_key": key, "_tie": F.struct(F.col(tie))})
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    drawn = F.shiftrightunsigned(F.xxhash64(by, tie) if draw is None else draw, 11) / F.lit(float(1 << 53))
    sampled = keyed.where(drawn < F.lit(float(SAMPLES_A_PARTITION * parts)) / total.select("n").scalar())
    listed = sampled.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t")))).alias("_s"))
    nth = lambda x, i: (i + 1) % BUCKET_SAMPLES == 0
    bounds = listed.where(F.size("_s") >= BUCKET_SAMPLES).select(F.col(by).alias("_by"), F.filter("_s", nth).alias("_bounds"))

    def before(b: Column) -> Column:
        first = b["k"] > F.col("_key") if descending else b["k"] < F.col("_key")
        return first | ((b["k"] == F.col("_key")) & (b["t"] <= F.col("_tie")))

    placed = keyed.join(F.broadcast(bounds), F.col(by).eqNullSafe(F.col("_by")), "left")
    return placed.withColumn("_bucket", F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", before))))


def places(
    df: DataFrame, by: str, key: Column, tie: str, name: str = "place", descending: bool = False, order: Sequence[Column] = (), draw: Column | None = None
) -> DataFrame:
    """``row_number`` by ``key`` (any comparable value, also a struct) and then ``tie``, for groups of any size.

    Rows may be numbered by a finer ``order`` in which key and tie do not fall; keys go into the bounds, so that where
    an order has long texts a key holds their first letters only.

    A sort by samples in two levels: the buckets of a group are numbered in tasks of their own and take up the sizes of
    the buckets before them, of which there is a row for each.
    """
    placed = bucketed(df, by, key, tie, descending, draw)
    order = order or (F.col("_key").desc() if descending else F.col("_key").asc(), F.col(tie))
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)).cast("long"))
    sizes = placed.where(F.col("_bounds").isNotNull()).groupBy("_by", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(F.col("_by").alias("_c_by"), F.col("_bucket").alias("_c_bucket"), F.sum("_size").over(earlier).alias("_before"))
    same = F.col(by).eqNullSafe(F.col("_c_by")) & (F.col("_bucket") == F.col("_c_bucket")) & F.col("_bounds").isNotNull()
    return local.join(F.broadcast(carried), same, "left").select(*df.columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def explode_range(df: DataFrame, n: Column, name: str, step: int = 1024) -> DataFrame:
    """``n`` copies of every row, numbered from 0.

    Rows are multiplied in two steps, so that a large ``n`` never becomes one large array.
    """
    coarse = df.withColumn("_n", n.cast("long")).where(F.col("_n") > 0)
    coarse = coarse.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step))))
    top = F.least(F.lit(step - 1).cast("long"), F.col("_n") - 1 - F.col("_hi") * step)
    fine = coarse.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    return fine.withColumn(name, F.col("_hi") * step + F.col("_lo")).drop("_n", "_hi", "_lo")
