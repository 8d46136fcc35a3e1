"""Subtitle tracks: as rows, per language, by policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col

# Fixed value: extensions in order of preference.
FALLBACK_ORDER = ("srt", "vtt", "ass", "ssa", "lrc")


def union_subtitles(media: DataFrame, by: str = "id") -> DataFrame:
    """Manual and automatic tracks as rows ``(by, language, ordinal, url, ext, name, is_auto)``."""

    def rows(column: str, auto: bool) -> DataFrame:
        per_language = media.select(by, F.explode(column).alias("language", "_tracks"))
        return per_language.select(by, "language", F.posexplode("_tracks").alias("ordinal", "_t")).select(
            by, "language", "ordinal", "_t.url", "_t.ext", "_t.name", F.lit(auto).alias("is_auto")
        )

    return rows("subtitles", False).unionByName(rows("automatic_captions", True))


def subtitle_status(subtitles: Column | str = "subtitles", automatic: Column | str = "automatic_captions") -> Column:
    """Whether there are any tracks, and if not, whether the fields are missing or empty."""
    s, a = as_col(subtitles), as_col(automatic)
    any_track = (F.coalesce(F.size(s), F.lit(0)) > 0) | (F.coalesce(F.size(a), F.lit(0)) > 0)
    reason = F.when(~any_track, F.when(s.isNull() & a.isNull(), "field_missing").otherwise("empty_list"))
    return F.struct(
        F.when(any_track, "available").otherwise("not_available").alias("status"), reason.alias("reason")
    )


def merge_subtitle_maps(left: Column | str, right: Column | str) -> Column:
    """Per language the tracks of the left map and those of the right one whose URL the left does not have."""
    empty = F.array()

    def merged(_, a: Column, b: Column) -> Column:
        seen = F.transform(F.coalesce(a, empty.cast("array<struct<url:string,ext:string,name:string>>")), lambda t: t["url"])
        new = F.filter(b, lambda t: ~F.coalesce(F.array_contains(seen, t["url"]), F.lit(False)))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, new))

    l, r = as_col(left), as_col(right)
    return F.when(l.isNull(), r).when(r.isNull(), l).otherwise(F.map_zip_with(l, r, merged))


def _row(tracks: DataFrame, without: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in tracks.columns if c not in without])


def _first(tracks: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The lowest-ranked track per key, by one aggregation."""
    picked = tracks.groupBy(*keys).agg(F.min_by(_row(tracks, keys), F.struct(*rank)).alias("_t"))
    return picked.select(*keys, "_t.*")


def _format_rank(preferred: str | None, ext: Column | str = "ext") -> Column:
    e = F.lower(as_col(ext))
    rank = F.lit(len(FALLBACK_ORDER) + 1)
    for i, name in reversed(list(enumerate(FALLBACK_ORDER, 1))):
        rank = F.when(e == name, i).otherwise(rank)
    return rank if preferred is None else F.when(e == preferred.lower(), 0).otherwise(rank)


def dedup_subtitles(
    tracks: DataFrame, preferred: str | None = None, by: str = "media_id", ordinal: str = "ordinal"
) -> DataFrame:
    """One track per language: the first of the wanted format, or else the first; without a wish, manual ones first."""
    keyed = tracks.withColumn("_lang", F.lower("language"))
    better = F.col("is_auto") if preferred is None else F.lower("ext") != preferred.lower()
    return _first(keyed, [by, "_lang"], [better, F.col(ordinal)]).drop("_lang").select(*tracks.columns)


def select_subtitles(
    tracks: DataFrame,
    languages: Sequence[str],
    preferred: str | None = None,
    include_auto: bool = False,
    by: str = "media_id",
    ordinal: str = "ordinal",
) -> DataFrame:
    """Tracks of exactly the wanted languages, manual ones first; ``all`` takes every language.

    With ``all``, automatic tracks only fill in languages without a manual one.
    """
    if not languages:
        return tracks.where(F.lit(False))
    lang = F.lower("language")
    kept = tracks if include_auto else tracks.where(~F.col("is_auto"))
    if not any(x.lower() == "all" for x in languages):
        kept = kept.where(lang.isin(*[x.lower() for x in languages]))
    other_format = F.lit(0) if preferred is None else F.when(F.lower("ext") == preferred.lower(), 0).otherwise(1)
    keyed = kept.withColumn("_lang", lang)
    return _first(keyed, [by, "_lang"], [F.col("is_auto"), other_format, F.col(ordinal)]).select(*tracks.columns)


def language_matches(language: str, track_language: Column | str = "language", name: Column | str = "name") -> Column:
    """The language itself, or a track language or name that starts with a code of up to three letters."""
    wanted = language.lower()
    hits = []
    for c in (as_col(track_language), as_col(name)):
        low = F.lower(c)
        hit = low == wanted
        if len(language) <= 3:
            hit = hit | low.startswith(wanted)
        hits.append(F.coalesce(hit, F.lit(False)))
    return hits[0] | hits[1]


def match_subtitle_langs(tracks: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Tracks with each requested language they match (``requested``); the few requests become one projection."""
    hits = F.array_compact(F.array(*[F.when(language_matches(x), F.lit(x)) for x in languages]))
    return tracks.select("*", F.explode(hits).alias("requested"))


def subtitle_policy(
    tracks: DataFrame,
    media: DataFrame,
    languages: Sequence[str],
    preferred: str | None = None,
    include_auto: bool = False,
    strict: bool = False,
    by: str = "media_id",
    ordinal: str = "ordinal",
) -> DataFrame:
    """One row per media item and requested language: the chosen track, or ``warning`` where there is none.

    ``should_fail`` marks every row of an item that lacks a language in strict mode.
    """
    usable = tracks if include_auto else tracks.where(~F.col("is_auto"))
    matched = match_subtitle_langs(usable, languages)
    rank = [F.col("is_auto"), _format_rank(preferred), F.col(ordinal)]
    chosen = _first(matched, [by, "requested"], rank)
    wanted = media.select(by).distinct().select(by, F.explode(F.array(*[F.lit(x) for x in languages])).alias("requested"))
    joined = wanted.join(chosen, [by, "requested"], "left")
    lacking = F.col(ordinal).isNull()
    warning = F.when(lacking, F.concat(F.lit("Requested subtitle language '"), F.col("requested"), F.lit("' not available")))
    out = joined.withColumn("warning", warning)
    if not strict:
        return out.withColumn("should_fail", F.lit(False))
    failing = out.where(lacking).select(by).distinct().withColumn("should_fail", F.lit(True))
    return out.join(failing, by, "left").fillna(False, ["should_fail"])


def subtitle_policy_all(
    tracks: DataFrame, preferred: str | None = None, include_auto: bool = False, by: str = "media_id", ordinal: str = "ordinal"
) -> DataFrame:
    """The policy for ``all`` languages."""
    usable = tracks if include_auto else tracks.where(~F.col("is_auto"))
    return dedup_subtitles(usable, preferred, by, ordinal)
