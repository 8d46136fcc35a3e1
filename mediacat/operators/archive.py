"""The archive of what has been fetched, as a set of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col
from mediacat.functions.html import trim_space
from mediacat.functions.text import archive_key


def parse_archive(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct keys of archive lines: blank lines and ``#`` notes skipped, the word before the first space lowered.

    A line without a space is kept as it is; it matches nothing.
    """
    line = trim_space(column)
    at = F.instr(line, " ")
    lowered = F.concat(F.lower(F.substring(line, F.lit(1), at - 1)), F.substring(line, at, F.length(line)))
    kept = lines.where((line != "") & ~line.startswith("#"))
    return kept.select(F.when(at > 0, lowered).otherwise(line).alias("key")).distinct()


def media_key(extractor="extractor", media_id="id", extractor_key="extractor_key") -> Column:
    """The archive key of a media record; the stable extractor key goes before the display name."""
    return archive_key(F.coalesce(as_col(extractor_key), as_col(extractor)), media_id)


def _joined(media: DataFrame, archive: DataFrame, how: str, key: Column | None) -> DataFrame:
    keyed = media.withColumn("_key", media_key() if key is None else key)
    return keyed.join(archive.select(F.col("key").alias("_key")), "_key", how).drop("_key")


def not_in_archive(media: DataFrame, archive: DataFrame, key: Column | None = None) -> DataFrame:
    """Media not fetched yet. Spark broadcasts the keys only while they are below its size threshold."""
    return _joined(media, archive, "left_anti", key)


def in_archive(media: DataFrame, archive: DataFrame, key: Column | None = None) -> DataFrame:
    return _joined(media, archive, "left_semi", key)


def new_keys(media: DataFrame, archive: DataFrame) -> DataFrame:
    """The keys to append for media that are not in the archive yet."""
    keys = media.select(media_key().alias("key")).where(F.col("key").isNotNull()).distinct()
    return keys.join(archive.select("key"), "key", "left_anti")
