"""Playlists: ranges, listing cutoffs, numbering, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col
from mediacat.operators.ordered import Running, running


@dataclass(frozen=True)
class PlaylistSelection:
    """Positions from ``start`` to ``end``, and in any of the ranges ``(first, last)`` where there are ranges.

    ``None`` leaves an end open.
    """

    start: int = 1
    end: int | None = None
    ranges: tuple[tuple[int, int | None], ...] | None = None

    def wants(self, position: Column | str) -> Column:
        p = as_col(position)
        wanted = p >= self.start
        if self.end is not None:
            wanted = wanted & (p <= self.end)
        if self.ranges is not None:
            parts = [(p >= a) if b is None else p.between(a, b) for a, b in self.ranges]
            wanted = wanted & reduce(or_, parts, F.lit(False))
        return wanted

    def last_needed(self) -> int | None:
        ends = [b for _, b in self.ranges] if self.ranges else []
        last = max(ends) if ends and None not in ends else None
        bounds = [x for x in (self.end, last) if x is not None]
        return min(bounds) if bounds else None


def playlist_range(df: DataFrame, selection: PlaylistSelection, position: str = "position") -> DataFrame:
    return df.where(selection.wants(position))


def page_totals(rows: DataFrame, pages: DataFrame, by: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per listed page with the number of its rows, and of the rows and pages before it."""
    counts = rows.groupBy(by, "page").agg(F.count(F.lit(1)).alias("n"), *extra)
    totals = pages.join(counts, [by, "page"], "left").fillna(0, ["n"])
    # Pages of one list are scanned in blocks, so a long list does not end up in one task.
    counted = {"before": Running("sum", F.col("n"), exclusive=True), "_seen": Running("sum", F.lit(1).cast("long"))}
    return running(totals, [by], "page", counted, 10_000).fillna(0, ["before"])


def cut_listing(rows: DataFrame, totals: DataFrame, by: str, stop: Column, stop_after: Column, cap: int | None) -> DataFrame:
    """Rows of the pages before a list's first stop, and of these, with a ``cap``, the first ones by position.

    ``pos`` counts the rows of a page from 1. A page that is missing stops the list as well: the first page after a
    gap is the first whose number, less the pages up to it, is not that of the list's first page.
    """
    ahead = F.col("page") - F.col("_seen")
    bounds = totals.groupBy(by).agg(
        F.least(F.min(F.when(stop, F.col("page"))), F.min(F.when(stop_after, F.col("page") + 1))).alias("_stop"),
        F.min(ahead).alias("_ahead"),
    )
    # ``ahead`` never falls, so pages of the lowest value come before any gap.
    kept = totals.join(bounds, by).where((ahead == F.col("_ahead")) & (F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))))
    placed = rows.join(kept.select(by, "page", "before"), [by, "page"]).withColumn("position", F.col("before") + F.col("pos"))
    return (placed if cap is None else placed.where(F.col("position") <= cap)).drop("before")


def playlist_cutoff(
    entries: DataFrame,
    pages: DataFrame,
    last_needed: int | None = None,
    by: str = "playlist_id",
    cap: int | None = None,
) -> DataFrame:
    """The entries a listing reads: up to an empty page, the site's last page, the last needed entry, or a cap.

    Adds ``position``, counted from 1 over the pages.
    """
    totals = page_totals(entries, pages, by)
    reached = F.col("before") + F.col("n")
    after = ~F.coalesce(F.col("has_more"), F.lit(False))
    for enough in (cap, last_needed):
        after = after if enough is None else after | (reached >= enough)
    return cut_listing(entries, totals, by, F.col("n") == 0, after, cap)


def stamp_playlist(entries: DataFrame, pages: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Index, count and name of the playlist for each of its listed entries (which have a ``position``).

    The count is the site's total of page one, but never below the number of listed entries.
    """
    first = pages.where(F.col("page") == 1).groupBy(by).agg(
        F.max("total_estimate").alias("_total"), F.max("playlist_title").alias("playlist_title")
    )
    listed = entries.groupBy(by).agg(F.count(F.lit(1)).alias("_listed"))
    facts = listed.join(first, by, "left").select(
        by,
        F.greatest(F.col("_listed"), F.col("_total")).alias("playlist_count"),
        "playlist_title",
        F.coalesce("playlist_title", F.col(by).cast("string")).alias("playlist"),
    )
    return entries.join(facts, by).withColumnRenamed("position", "playlist_index")


def audio_types(media_formats: DataFrame, by: str = "playlist_id") -> DataFrame:
    """The sorted languages of a playlist's formats."""
    known = media_formats.where(F.col("language") != "")
    # Distinct pairs first: the set that is collected holds one row per language.
    return known.select(by, "language").distinct().groupBy(by).agg(
        F.array_sort(F.collect_list("language")).alias("languages")
    )


def playlist_summary(episodes: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Counts per playlist of episodes with ``status``, ``previously``, ``retried`` and ``subtitles_missing``.

    ``status`` is ``done``, ``failed`` or anything else for what remains.
    """
    done = F.col("status") == "done"
    return episodes.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("downloaded"),
        F.count_if(done & F.col("previously")).alias("previously"),
        F.count_if(done & ~F.col("previously")).alias("new"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(done & F.col("retried")).alias("recovered"),
        F.count_if(done & F.col("subtitles_missing")).alias("missing_subtitles"),
    )
