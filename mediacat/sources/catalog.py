"""Catalog files: metadata, archives, cookies, pages, sessions, progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions.html import trim_space
from mediacat.operators.archive import new_keys, parse_archive
from mediacat.schema import MEDIA_SCHEMA, PROGRESS_SCHEMA, SESSION_SCHEMA

# The supported version of a session file, and the most of a page that is looked at.
SESSION_VERSION = 1


def parse_catalog(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metadata records of JSON lines: the fixed fields, and everything else as the variant ``extra``."""
    record = F.from_json(column, MEDIA_SCHEMA)
    members = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "map<string,variant>")
    tail = F.map_filter(members, lambda k, _: ~k.isin(*MEDIA_SCHEMA.names))
    extra = F.when(F.size(tail) > 0, F.try_parse_json(F.to_json(tail)))
    rows = lines.select(record.alias("_r"), extra.alias("extra"))
    return rows.where(F.col("_r.id").isNotNull()).select("_r.*", "extra")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalog(spark.read.text(path))


def catalog_json(media: DataFrame) -> DataFrame:
    """One JSON object per record, without absent fields; ``extra`` is merged back in."""
    plain = [c for c in media.columns if c != "extra"]
    whole = F.to_json(F.struct(*plain))
    if "extra" not in media.columns:
        return media.select(whole.alias("value"))
    tail = F.to_json("extra")
    body = F.substring(whole, F.lit(1), F.length(whole) - 1)
    merged = F.concat(body, F.when(body != "{", F.lit(",")).otherwise(F.lit("")), F.substring(tail, F.lit(2), F.length(tail)))
    return media.select(F.when(F.col("extra").isNull() | (tail == "{}"), whole).otherwise(merged).alias("value"))


def write_catalog(media: DataFrame, path: str, mode: str = "errorifexists") -> None:
    catalog_json(media).write.mode(mode).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return parse_archive(spark.read.text(path))


def append_archive(media: DataFrame, path: str) -> None:
    """Append the keys of media that the archive at ``path`` does not have yet.

    The archive is a folder of text files, to which every call adds its own; a repeated call adds nothing.
    """
    spark = media.sparkSession
    keys = media.sparkSession.createDataFrame([], "key string")
    if _exists(spark, path):
        keys = read_archive(spark, path)
    new_keys(media, keys).select(F.col("key").alias("value")).write.mode("append").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def parse_cookies(lines: DataFrame, column: str = "value") -> DataFrame:
    """Cookies of seven tab-separated fields; ``#HttpOnly_`` marks data, other ``#`` lines are notes."""
    line = F.regexp_replace(column, r"\r$", "")
    http_only = line.startswith("#HttpOnly_")
    body = F.when(http_only, F.substring(line, F.lit(11), F.length(line))).otherwise(line)
    staged = lines.select(body.alias("_l"), http_only.alias("http_only")).where(~F.col("_l").startswith("#"))
    f = F.split("_l", "\t")

    def at(i: int) -> Column:
        return F.get(f, F.lit(i))

    flags = at(1).isin("TRUE", "FALSE") & at(3).isin("TRUE", "FALSE")
    good = (F.size(f) == 7) & flags & (at(5) != "") & (F.regexp_replace(at(0), r"^\.", "") != "")
    return staged.where(good & at(4).rlike(r"^\d+$")).select(
        F.regexp_replace(at(0), r"^\.", "").alias("domain"),
        (at(1) == "TRUE").alias("include_subdomains"),
        at(2).alias("path"),
        (at(3) == "TRUE").alias("secure"),
        at(4).cast("long").alias("expires"),
        at(5).alias("name"),
        at(6).alias("value"),
        "http_only",
    )


def read_cookie_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_cookies(spark.read.text(path))


def cut_pages(pages: DataFrame, limit: int) -> DataFrame:
    """Pages cut at a size in bytes, at the end of a character; pages below it stay as they are."""
    data = F.substring(F.encode("html", "UTF-8"), 1, limit)
    # A character is cut off where bytes of its kind are missing at the end.
    tail = F.regexp_extract(F.hex(F.substring(data, -4, 4)), "(?:C[2-9A-F]|D.|E.(?:[89AB].)?|F[0-4](?:[89AB].){0,2})$", 0)
    whole = F.substring(data, F.lit(1), F.octet_length(data) - F.floor(F.length(tail) / 2).cast("int"))
    cut = F.decode(whole, "UTF-8")
    return pages.withColumn("html", F.when(F.octet_length("html") > limit, cut).otherwise(F.col("html")))


def read_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Whole pages, or with ``limit`` pages cut at so many bytes."""
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages if limit is None else cut_pages(pages, limit)


def parse_sessions(lines: DataFrame, column: str = "value", version: int = SESSION_VERSION) -> DataFrame:
    """Session records of the supported version; broken and foreign ones are dropped."""
    parsed = lines.select(F.from_json(column, SESSION_SCHEMA).alias("_s")).select("_s.*")
    return parsed.where(F.col("version") == version)


def read_sessions(spark: SparkSession, path: str, version: int = SESSION_VERSION) -> DataFrame:
    return spark.read.schema(SESSION_SCHEMA).json(path, mode="PERMISSIVE").where(F.col("version") == version)


def read_progress_stream(
    spark: SparkSession, path: str, schema: T.StructType = PROGRESS_SCHEMA, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
