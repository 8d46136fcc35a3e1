"""What is already on disk: finished files, files in progress, missing subtitles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col
from mediacat.functions.text import sanitize_filename
from mediacat.functions.url import url_path

# The size below which a file is not taken for a finished one, endings of unfinished transport
# streams, subtitle extensions.
MIN_BYTES = 1_000_000
UNFINISHED = ("ts", "mpegts")
SUBTITLE_EXTENSIONS = ("srt", "vtt", "ass", "ssa", "lrc")


def _stem(name):
    return F.regexp_replace(as_col(name), r"(?<=.)\.[^.]*$", "")


def _ext(name):
    return F.regexp_extract(as_col(name), r".\.([^.]*)$", 1)


def find_completed(media: DataFrame, files: DataFrame, title: str = "title") -> DataFrame:
    """Media whose sanitized title names a file: ``complete`` or ``partial``.

    A finished file has the title as its stem. A file in progress has ``.part`` somewhere in its name and starts with
    the title; only these few are spread over their prefixes, of the lengths that titles have, so that both kinds are
    joins of equality.
    ``files`` has ``name`` and ``size``.
    """
    keyed = media.withColumn("_stem", sanitize_filename(title))
    ext = _ext("name")
    unfinished = ext.contains("part") | F.lower(ext).isin(*UNFINISHED)
    state = F.when(unfinished, F.lit("partial")).when(F.col("size") > MIN_BYTES, F.lit("complete"))
    whole = files.select(_stem("name").alias("_stem"), state.alias("state"))
    lengths = keyed.agg(F.collect_set(F.length("_stem")).alias("n")).select("n").scalar()
    started = files.where(F.col("name").contains(".part")).withColumn("_lengths", lengths)
    fitting = F.filter("_lengths", lambda n: (n > 0) & (n <= F.length("name")))
    parts = started.select(
        F.explode(F.transform(fitting, lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("_stem"),
        F.lit("partial").alias("state"),
    )
    # "complete" sorts before "partial".
    per_stem = (
        whole.where(F.col("state").isNotNull()).unionByName(parts).groupBy("_stem").agg(F.min("state").alias("state"))
    )
    return keyed.join(per_stem, "_stem").drop("_stem")


def missing_subtitles(
    completed: DataFrame, files: DataFrame, languages: Sequence[str], by: str = "media_id", title: str = "title"
) -> DataFrame:
    """Wanted languages of finished media for which no subtitle file lies beside them.

    A file ``<stem>.<middle>.<ext>`` has the language if the middle is it, or starts with it where it is short.
    """
    keyed = completed.select(by, sanitize_filename(title).alias("_stem"))
    wanted = keyed.select(by, "_stem", F.explode(F.array(*[F.lit(x) for x in languages])).alias("language"))
    pieces = F.split("name", r"\.")
    # The stem can end before any dot but the last one.
    cuts = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 2),
        lambda i: F.struct(
            F.array_join(F.slice(pieces, F.lit(1), i), ".").alias("stem"),
            F.array_join(F.slice(pieces, i + 1, F.size(pieces) - i - 1), ".").alias("middle"),
        ),
    )
    ext = F.element_at(pieces, -1)
    subtitles = files.where((F.size(pieces) >= 3) & F.lower(ext).isin(*SUBTITLE_EXTENSIONS)).select(
        ext.isin(*SUBTITLE_EXTENSIONS).alias("exact_ext"), F.explode(cuts).alias("c")
    )
    found = []
    for language in languages:
        hit = (F.col("c.middle") == language) & F.col("exact_ext")
        if len(language) <= 3:
            hit = hit | F.lower("c.middle").startswith(language.lower())
        found.append(F.when(hit, F.lit(language)))
    present = subtitles.select(
        F.col("c.stem").alias("_stem"), F.explode(F.array_compact(F.array(*found))).alias("language")
    ).distinct()
    return wanted.join(present, ["_stem", "language"], "left_anti").select(by, "language")


def match_by_path(left: DataFrame, right: DataFrame, left_url: str = "url", right_url: str = "url") -> DataFrame:
    """Pairs of rows of both sides that name the same content on whatever host and with whatever token.

    A path that many rows of both sides have makes as many pairs as the product of their numbers; ``path_classes`` holds
    the same matches in a row for each path.
    """
    a = left.withColumn("path", url_path(left_url))
    b = right.withColumn("path", url_path(right_url))
    return a.join(b, "path")


def path_classes(left: DataFrame, right: DataFrame, left_url: str = "url", right_url: str = "url") -> DataFrame:
    """One row for each path that both sides have: path, left_rows, right_rows. Rows are counted before the shuffle."""
    sides = left.select(url_path(left_url).alias("path"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(url_path(right_url).alias("path"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counted = sides.where(F.col("path").isNotNull()).groupBy("path").agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    return counted.where((F.col("left_rows") > 0) & (F.col("right_rows") > 0))


def path_members(side: DataFrame, classes: DataFrame, url: str = "url") -> DataFrame:
    """The rows of one side whose path is in ``classes``, with ``path``: no more rows than the side has."""
    return side.withColumn("path", url_path(url)).join(classes.select("path"), "path", "left_semi").select(*side.columns, "path")
