"""Queries over streams: each runs over all rows that its table holds now."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.operators import archive
from mediacat.plans.registry import query
from mediacat.sources.catalog import read_progress_stream
from mediacat.streaming import meters
from mediacat.streaming.run import run_available


def _stream(t, name):
    # A pattern, as the source takes no path that is one file.
    rows = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet")
    stream = read_progress_stream(t.spark, f"{t.sf_dir}/{name}.parquet*", rows.schema)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


@query("A8_read_progress_stream", "select event_id, user_id as transfer_id, epoch_us(ts) as us, event_type from events")
def _(t):
    rows = _stream(t, "events").select("event_id", F.col("user_id").alias("transfer_id"), F.unix_micros("ts").alias("us"), "event_type")
    return run_available(rows)


@query(
    "K3_stream_not_in_archive",
    """with a as (select distinct case o_custkey % 4 when 0 then 'alpha' else 'beta' end || ' ' || o_orderkey as key from orders where o_orderkey % 3 = 0)
       select o_orderkey, o_custkey from orders where case o_custkey % 4 when 0 then 'alpha' else 'beta' end || ' ' || o_orderkey not in (select key from a)""",
)
def _(t):
    site = F.when(F.col("o_custkey") % 4 == 0, "Alpha").otherwise("beta")
    lines = t.orders.where(F.col("o_orderkey") % 3 == 0).select(F.concat(site, F.lit(" "), F.col("o_orderkey").cast("string")).alias("value"))
    media = _stream(t, "orders").select("o_orderkey", "o_custkey", F.lower(site).alias("extractor"), F.lit(None).cast("string").alias("extractor_key"), F.col("o_orderkey").cast("string").alias("id"))
    return run_available(meters.stream_not_in_archive(media, archive.parse_archive(lines))).select("o_orderkey", "o_custkey")


@query("K4_stream_first_seen", "select distinct user_id as query_id, event_type as video_url from events")
def _(t):
    seen = _stream(t, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("video_url"), "ts")
    return run_available(meters.stream_first_seen(seen, delay="60 days").select("query_id", "video_url"))
