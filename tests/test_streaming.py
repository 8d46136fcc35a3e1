"""Streams give what the batch operators give."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediacat.operators import telemetry
from mediacat.operators.archive import parse_archive
from mediacat.plans.views import view
from mediacat.sources.catalog import read_progress_stream
from mediacat.streaming import meters


def _run(stream, tmp_path, mode="append"):
    name = f"q{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).start()
    )
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def _parts(df, tmp_path, order, n=3):
    """The rows in ``n`` files, one after another in order."""
    folder = tmp_path / "in"
    rows = df.withColumn("_p", F.ntile(n).over(Window.orderBy(order)))
    for i in range(1, n + 1):
        rows.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def _close(a, b, name):
    left, right = ({tuple(r)[:2]: r[name] for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for k, v in left.items():
        assert (v is None) == (right[k] is None), k
        assert v is None or abs(v - right[k]) <= 1e-6 * max(1.0, abs(v)), k


def test_meters_match_batch(spark, sf_dir, tmp_path):
    progress = view(spark, sf_dir, "progress").where("transfer_id < 4")
    folder = _parts(progress, tmp_path, "ts")
    stream = read_progress_stream(spark, folder, progress.schema, max_files=1)
    speed = _run(meters.speed_meter_stream(stream), tmp_path)
    _close(speed, telemetry.speed_meter(progress), "speed")
    eta = _run(meters.eta_stream(stream), tmp_path)
    _close(eta, telemetry.eta(progress), "eta")


def test_stream_not_in_archive(spark, sf_dir, tmp_path):
    media = view(spark, sf_dir, "media").select("media_id", "id", "extractor", "extractor_key")
    archive = parse_archive(view(spark, sf_dir, "archive_lines"))
    folder = _parts(media, tmp_path, "media_id")
    stream = spark.readStream.schema(media.schema).parquet(folder)
    out = _run(meters.stream_not_in_archive(stream, archive), tmp_path)
    from mediacat.operators.archive import not_in_archive

    assert {r.media_id for r in out.collect()} == {r.media_id for r in not_in_archive(media, archive).collect()}


def test_stream_first_seen(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "listings").withColumn("ts", F.timestamp_seconds(F.col("page") * 20 + F.col("pos")))
    folder = _parts(rows, tmp_path, "ts")
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    out = _run(meters.stream_first_seen(stream, delay="1 hour").select("query_id", "video_url"), tmp_path)
    expected = {tuple(r) for r in rows.select("query_id", "video_url").distinct().collect()}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_job_status_stream(spark, sf_dir, tmp_path):
    jobs = view(spark, sf_dir, "jobs")
    folder = _parts(jobs, tmp_path, "seq")
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    out = _run(meters.job_status_stream(stream), tmp_path, "complete")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in telemetry.job_status(jobs).collect()}
