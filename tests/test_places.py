"""Places in groups of any size equal a plain window's, and a hot group is spread over tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mediacat.operators import ordered, ranking
from mediacat.plans.views import view


@pytest.mark.parametrize("descending", [False, True])
def test_hot_group(spark, descending):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 5000).alias("g"),
        F.col("id").alias("tie"),
        F.when(F.col("id") % 11 > 0, (F.hash("id") % 50).cast("double")).alias("a"),
        (F.col("id") % 2).alias("place"),
    )
    key = F.struct("a", F.hash("tie") % 3)
    got = ordered.places(rows, "g", key, "tie", "n", descending)
    order = Window.partitionBy("g").orderBy(key.desc() if descending else key.asc(), "tie")
    want = rows.withColumn("n", F.row_number().over(order).cast("long"))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r.tie) == sorted(want.collect(), key=lambda r: r.tie)


def test_buckets_of_a_hot_group_are_small(spark):
    """Though one group holds nearly all rows, no bucket, which one task sorts, holds more than a small share of them."""
    rows = spark.range(50_000).select(F.when(F.col("id") < 200, F.col("id")).otherwise(F.lit(-1)).alias("g"), F.col("id").alias("tie"), F.hash("id").alias("a"))
    found = ordered.bucketed(rows, "g", F.col("a"), "tie").groupBy("g", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("_bounds").isNull()).alias("whole")).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = sorted(r.n for r in found if r.g == -1)
    assert len(hot) > 2 * parts and hot[-1] < 3 * hot[len(hot) // 2] and hot[-1] < 50_000 / parts
    assert all(r.whole and r.n == 1 for r in found if r.g >= 0)


def test_orders_of_formats(spark, sf_dir):
    formats = view(spark, sf_dir, "formats").withColumn("media_id", F.when(F.col("media_id") % 3 == 0, 3).otherwise(F.col("media_id")))
    key = ranking.rank_key()
    for got, order in ((ranking.default_order(formats), key.desc()), (ranking.select_mergeable(formats), key.asc())):
        names = ["media_id", "ordinal", "place"]
        want = got.drop("place").withColumn("place", F.row_number().over(Window.partitionBy("media_id").orderBy(order, "ordinal")).cast("long"))
        assert sorted(got.select(names).collect()) == sorted(want.select(names).collect())
    assert ranking.default_order(formats.limit(0)).count() == 0
