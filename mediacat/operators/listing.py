"""Search listings: when to stop reading, what to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediacat.operators.playlist import cut_listing, page_totals


def listing_cutoff(
    results: DataFrame,
    pages: DataFrame,
    max_results: int | None = None,
    by: str = "query_id",
    url: str = "video_url",
) -> DataFrame:
    """The results a search reads: up to an empty page, a page that only repeats earlier URLs, the last page, or ``max_results``.

    URLs repeated on accepted pages are kept.
    """
    first_page = results.groupBy(by, url).agg(F.min("page").alias("page"))
    fresh = first_page.select(by, "page").distinct().withColumn("_fresh", F.lit(True))
    totals = page_totals(results, pages, by).join(fresh, [by, "page"], "left")
    repeats = F.col("_fresh").isNull()
    reached = F.col("before") + F.col("n")
    after = ~F.coalesce(F.col("has_more"), F.lit(False))
    after = after if max_results is None else after | (reached >= max_results)
    return cut_listing(results, totals, by, (F.col("n") == 0) | repeats, after, max_results)


def limit_per_query(results: DataFrame, n: int, by: str = "query_id") -> DataFrame:
    """The first ``n`` results of each query in listing order (cut on the map side before the shuffle)."""
    window = Window.partitionBy(by).orderBy("page", "pos")
    return results.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
