"""HLS playlists: variants of a master playlist, segments of a media playlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.codecs import codec_kind, codec_name, infer_muxed_audio, named_codecs, segment_container
from mediacat.functions.conditions import let
from mediacat.functions.numbers import estimate_size
from mediacat.functions.url import url_join
from mediacat.operators.catalog import codec
from mediacat.operators.ordered import Running, running

# Fixed value: the codec of an undeclared audio rendition.
DEFAULT_AUDIO = "mp4a"


def attribute(attributes: Column, name: str) -> Column:
    """A value of an attribute list, quotes removed."""
    pattern = rf'(?:^|,)\s*{name}=(?:"([^"]*)"|([^,"]*))'
    value = F.concat(F.regexp_extract(attributes, pattern, 1), F.regexp_extract(attributes, pattern, 2))
    return F.when(attributes.rlike(pattern), value)


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit("\r"), F.lit(""))


def _next_uri(piece: Column) -> Column:
    """The first line after the piece's first one that is not a comment."""
    return F.btrim(F.regexp_extract(piece, r"\n([^#\s][^\n]*)", 1))


def hls_variants(playlists: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Variants and audio renditions of master playlists: ``(by, pos, url, ...)``.

    Variants of key frames only, renditions of other kinds and those without a URI are left out. Everything happens
    within the row of one playlist.
    """
    text = _clean(F.col("text"))
    pieces = F.split(text, r"(?m)^#EXT-X-STREAM-INF:")

    def variant(piece: Column) -> Column:
        a = F.regexp_extract(piece, r"^([^\n]*)", 1)
        names = named_codecs(attribute(a, "CODECS"))
        group = attribute(a, "AUDIO")
        size = attribute(a, "RESOLUTION")
        return F.struct(
            url_join(F.col("url"), _next_uri(piece)).alias("url"),
            F.regexp_extract(size, r"^(\d+)x", 1).try_cast("int").alias("width"),
            F.regexp_extract(size, r"x(\d+)$", 1).try_cast("int").alias("height"),
            names["video"].alias("video_codec"),
            infer_muxed_audio(names["video"], names["audio"], group).alias("audio_codec"),
            names["audio"].alias("declared_audio"),
            attribute(a, "FRAME-RATE").try_cast("double").alias("frame_rate"),
            F.coalesce(attribute(a, "BANDWIDTH").try_cast("long"), F.lit(0)).alias("bandwidth"),
            attribute(a, "AVERAGE-BANDWIDTH").try_cast("long").alias("average_bandwidth"),
            F.lit(False).alias("is_audio_only"),
            F.lit(None).cast("string").alias("language"),
            group.alias("audio_group_id"),
            F.lit(None).cast("string").alias("rendition_name"),
        )

    media = F.regexp_extract_all(text, F.lit(r"(?m)^#EXT-X-MEDIA:([^\n]*)"), F.lit(1))
    audio = F.filter(media, lambda m: (attribute(m, "TYPE") == "AUDIO") & attribute(m, "URI").isNotNull())
    staged = playlists.select(
        by,
        "url",
        F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), variant).alias("_variants"),
        audio.alias("_audio"),
    )

    def rendition(m: Column) -> Column:
        group = attribute(m, "GROUP-ID")
        declared = F.filter(
            F.col("_variants"), lambda v: (v["audio_group_id"] == group) & v["declared_audio"].isNotNull()
        )
        none = F.lit(None)
        return F.struct(
            url_join(F.col("url"), attribute(m, "URI")).alias("url"),
            none.cast("int").alias("width"),
            none.cast("int").alias("height"),
            none.cast("string").alias("video_codec"),
            F.coalesce(F.get(declared, F.lit(0))["declared_audio"], F.lit(DEFAULT_AUDIO)).alias("audio_codec"),
            none.cast("string").alias("declared_audio"),
            none.cast("double").alias("frame_rate"),
            F.lit(0).cast("long").alias("bandwidth"),
            none.cast("long").alias("average_bandwidth"),
            F.lit(True).alias("is_audio_only"),
            attribute(m, "LANGUAGE").alias("language"),
            group.alias("audio_group_id"),
            attribute(m, "NAME").alias("rendition_name"),
        )

    rows = F.filter(
        F.concat("_variants", F.transform("_audio", rendition)), lambda v: v["url"].isNotNull()
    )
    # Outer, so that the rows are not computed once more for the filter of an inner explode.
    exploded = staged.select(by, F.posexplode_outer(rows).alias("pos", "_v")).where(F.col("pos").isNotNull())
    return exploded.select(by, "pos", "_v.*").drop("declared_audio")


def attach_audio_codec(renditions: DataFrame, variants: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Audio renditions with the first audio codec a variant of their group declares.

    ``variants`` has ``by, pos, audio_group_id, codecs``; ``renditions`` has ``by, audio_group_id``.
    """
    declared = variants.withColumn("_a", named_codecs("codecs")["audio"]).where(F.col("_a").isNotNull())
    first = declared.groupBy(by, "audio_group_id").agg(F.min_by("_a", "pos").alias("_a"))
    joined = renditions.join(first, [by, "audio_group_id"], "left")
    return joined.withColumn("audio_codec", F.coalesce("_a", F.lit(DEFAULT_AUDIO))).drop("_a")


def _slug(tag: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(tag, "[^A-Za-z0-9]+", "-")), "^-|-$", "")


def _codec_in_id(format_id: Column, kind: str) -> Column:
    """The codec a format id names in one of its words."""
    words = F.filter(F.split(format_id, "[^A-Za-z0-9]"), lambda w: codec_kind(w) == kind)
    return codec_name(F.get(words, F.lit(0)))


def label_hls_variants(variants: DataFrame, parents: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Variants as formats, with what they inherit from the format whose playlist they come from.

    ``variants`` may carry ``total_duration``, ``has_encryption`` and ``segment_container`` of a media playlist;
    ``parents`` has ``by, format_id, vcodec, acodec, language`` and may have ``duration``.
    """

    def optional(df: DataFrame, name: str, kind: str, prefix: str) -> Column:
        return F.col(f"{prefix}.{name}") if name in df.columns else F.lit(None).cast(kind)

    joined = variants.alias("v").join(parents.alias("p"), by)
    audio = F.col("v.is_audio_only")
    height, bandwidth = F.col("v.height"), F.col("v.bandwidth")
    parent = F.col("p.format_id")
    tag = F.nullif(_slug(F.coalesce("v.language", "v.audio_group_id", "v.rendition_name")), F.lit(""))
    format_id = F.when(audio, F.concat_ws("-", parent, F.lit("audio"), tag)).when(
        height.isNotNull(), F.concat(parent, F.lit("-"), height.cast("string"), F.lit("p"))
    ).otherwise(F.concat(parent, F.lit("-"), F.floor(bandwidth / 1000).cast("string"), F.lit("k")))
    video = F.coalesce(F.col("v.video_codec"), codec("p.vcodec"), _codec_in_id(parent, "video"))
    sound = F.coalesce(F.col("v.audio_codec"), codec("p.acodec"), _codec_in_id(parent, "audio"))
    duration = F.coalesce(optional(variants, "total_duration", "double", "v"), optional(parents, "duration", "double", "p"))
    encrypted = F.coalesce(optional(variants, "has_encryption", "boolean", "v"), F.lit(False))
    note = F.when(audio, F.coalesce("v.rendition_name", F.lit("audio"))).otherwise(
        F.concat(height.cast("string"), F.lit("p"))
    )
    return joined.select(
        by,
        F.col("v.pos").alias("pos"),
        format_id.alias("format_id"),
        F.col("v.url").alias("url"),
        F.col("v.width").alias("width"),
        height.alias("height"),
        F.when(audio, None).otherwise(video).alias("vcodec"),
        F.when(audio, F.coalesce("v.audio_codec", F.lit(DEFAULT_AUDIO))).otherwise(sound).alias("acodec"),
        F.col("v.frame_rate").alias("fps"),
        F.when(bandwidth > 0, bandwidth / 1000.0).alias("tbr"),
        F.coalesce("v.language", "p.language").alias("language"),
        F.col("v.audio_group_id").alias("audio_group_id"),
        duration.alias("duration"),
        F.when(bandwidth > 0, estimate_size(bandwidth, duration)).alias("filesize_approx"),
        optional(variants, "segment_container", "string", "v").alias("container"),
        F.when(encrypted, True).alias("has_drm"),
        note.alias("format_note"),
        F.when(~audio, F.floor(height / 100).cast("int")).alias("quality"),
    )


# --- media playlists ------------------------------------------------------------------------------------------


def _segments(text: Column) -> Column:
    """Segments of a media playlist with the tags that stand between the former segment and their URI."""
    return let(F.split(text, r"(?m)^#EXTINF:"), _segments_of)


def _segments_of(pieces: Column) -> Column:
    uri_line = r"\n[^#\s][^\n]*"

    def head(piece: Column) -> Column:
        return F.regexp_extract(piece, rf"(?s)^(.*?)(?:{uri_line}|\z)", 1)

    def tail(piece: Column, i: Column) -> Column:
        return F.when(i == 0, piece).otherwise(F.regexp_extract(piece, rf"(?s)^.*?{uri_line}(.*)$", 1))

    # Every segment stands beside what was left over of the piece before it.
    tails = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p, i: tail(p, i))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(2), F.size(pieces)).alias("piece"), tails.alias("left"))
    found = F.transform(
        F.when(F.size(pieces) > 1, pairs),
        lambda t: let(
            F.concat(t["left"], F.lit("\n"), head(t["piece"])),
            lambda tags: F.struct(
                F.regexp_extract(t["piece"], r"^\s*([0-9.]+)", 1).try_cast("float").cast("double").alias("duration"),
                _next_uri(t["piece"]).alias("uri"),
                _last_tag(tags, "#EXT-X-MAP:").alias("map"),
                _last_tag(tags, "#EXT-X-BYTERANGE:").alias("byte_range"),
            ),
        ),
    )
    none = F.array().cast("array<struct<duration:double,uri:string,map:string,byte_range:string>>")
    return F.coalesce(F.filter(found, lambda s: s["uri"] != ""), none)


def _last_tag(tags: Column, name: str) -> Column:
    hits = F.regexp_extract_all(tags, F.lit(rf"(?m)^{name}([^\n]*)"), F.lit(1))
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), hits), -1)


def _keys(text: Column) -> Column:
    """The methods of the keys that stand before the last segment."""
    used = F.regexp_extract(text, r"(?s)^(.*\n)[^#\s]", 1)
    tags = F.regexp_extract_all(used, F.lit(r"(?m)^#EXT-X-KEY:([^\n]*)"), F.lit(1))
    return F.transform(tags, lambda t: attribute(t, "METHOD"))


def _live(text: Column) -> Column:
    return ~text.rlike(r"(?m)^#EXT-X-ENDLIST")


def hls_rollup(playlists: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Per media playlist: segments, total duration, whether it is live or encrypted, the container.

    One row in, one row out: nothing is shuffled.
    """
    text = _clean(F.col("text"))
    staged = playlists.select(
        by, _segments(text).alias("_s"), _live(text).alias("is_live"), (F.size(_keys(text)) > 0).alias("has_encryption")
    )
    durations = F.transform("_s", lambda s: F.coalesce(s["duration"], F.lit(0.0)))
    return staged.select(
        by,
        F.size("_s").cast("long").alias("segment_count"),
        F.aggregate(durations, F.lit(0.0), lambda acc, d: acc + d).alias("total_duration"),
        "is_live",
        "has_encryption",
        segment_container(F.get("_s", F.lit(0))["uri"]).alias("segment_container"),
    )


def _range(text: Column) -> tuple[Column, Column]:
    """Length and offset of ``length[@offset]``."""
    return (
        F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long"),
        F.regexp_extract(text, r"@(\d+)", 1).try_cast("long"),
    )


def carry_init_segment(
    segments: DataFrame, by: Sequence[str], order: str, value: str = "map", block: int | None = None
) -> DataFrame:
    """The last init segment up to every row, in place of its own.

    Without ``block`` the groups must be known to be short; with it they can be of any length.
    """
    if block is None:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return segments.withColumn(value, F.last(value, ignorenulls=True).over(window))
    carried = running(segments, by, order, {"_carried": Running("last", F.col(value))}, block)
    return carried.withColumn(value, F.col("_carried")).drop("_carried")


def chain_byte_ranges(
    segments: DataFrame,
    by: Sequence[str],
    order: str,
    length: str = "length",
    offset: str = "offset",
    block: int | None = None,
) -> DataFrame:
    """``start`` and ``end`` of byte ranges; one without an offset follows the former range.

    ``start = offset`` where one is written; the bytes before it are known from a running sum, and the last written
    offset minus that sum is carried on. ``bad_range`` marks empty ranges.
    """
    n = F.coalesce(F.col(length), F.lit(0))
    if block is None:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        summed = segments.withColumn("_sum", F.sum(n).over(window))
    else:
        summed = running(segments, by, order, {"_sum": Running("sum", n)}, block)
    before = F.col("_sum") - n
    based = summed.withColumn("_shift", F.when(F.col(length).isNotNull(), F.col(offset) - before))
    if block is None:
        shifted = based.withColumn("_shift", F.last("_shift", ignorenulls=True).over(window))
    else:
        shifted = running(based, by, order, {"_last": Running("last", F.col("_shift"))}, block).withColumn(
            "_shift", F.col("_last")
        ).drop("_last")
    start = F.when(F.col(length).isNotNull(), F.coalesce(F.col("_shift"), F.lit(0)) + before)
    out = shifted.withColumn("start", start).withColumn("end", F.col("start") + F.col(length))
    return out.withColumn("bad_range", F.coalesce(F.col("end") <= F.col("start"), F.lit(False))).drop("_sum", "_shift")


def hls_status(playlists: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Whether the segments of a media playlist can be listed, as far as one row tells: ``status`` and ``detail``."""
    return _with_status(playlists).drop("_segments")


def _with_status(playlists: DataFrame) -> DataFrame:
    text = _clean(F.col("text"))
    methods = F.filter(_keys(text), lambda m: m != "NONE")
    staged = playlists.withColumns({"_text": text, "_method": F.get(methods, F.lit(0)), "_segments": _segments(text)})
    staged = staged.withColumn("_n", F.size("_segments"))
    event = F.col("_text").rlike(r"(?m)^#EXT-X-PLAYLIST-TYPE:\s*EVENT")
    status = (
        F.when(F.col("_method").isNotNull(), "encrypted")
        .when(_live(F.col("_text")) | event, "live")
        .when(F.col("_n") == 0, "empty")
        .otherwise("ok")
    )
    return staged.withColumn("status", status).withColumn("detail", F.col("_method")).drop("_method", "_text", "_n")


def hls_segments(playlists: DataFrame, by: str = "playlist_id") -> DataFrame:
    """Segments of every playlist whose status is ``ok``.

    All segments of a playlist come out of one row, whose text bounds them; so the windows over a playlist need no blocks.
    """
    usable = F.when(F.col("status") == "ok", F.col("_segments"))
    rows = _with_status(playlists).select(by, "url", F.posexplode_outer(usable).alias("pos", "_s"))
    rows = rows.where(F.col("pos").isNotNull())
    flat = rows.select(by, "url", "pos", "_s.duration", "_s.uri", "_s.map", "_s.byte_range")
    length, offset = _range(F.col("byte_range"))
    ranged = flat.withColumns({"length": length, "offset": offset})
    chained = chain_byte_ranges(carry_init_segment(ranged, [by], "pos"), [by], "pos")
    map_length, map_offset = _range(attribute(F.col("map"), "BYTERANGE"))
    return chained.select(
        by,
        "pos",
        url_join("url", "uri").alias("url"),
        "duration",
        "start",
        "end",
        "bad_range",
        url_join("url", attribute(F.col("map"), "URI")).alias("init_url"),
        F.coalesce(map_offset, F.when(map_length.isNotNull(), F.lit(0))).alias("init_start"),
        (F.coalesce(map_offset, F.lit(0)) + map_length).alias("init_end"),
    )


def expand_playlists(playlists: DataFrame, by: str = "playlist_id") -> DataFrame:
    """One row per playlist with its final status; ``bad_range`` needs the segments."""
    segments = hls_segments(playlists, by)
    per = segments.groupBy(by).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("duration").alias("duration"),
        F.bool_or("bad_range").alias("_bad"),
    )
    joined = hls_status(playlists, by).select(by, "status", "detail").join(per, by, "left")
    status = F.when(F.col("_bad"), "bad_range").otherwise(F.col("status"))
    usable = F.col("status") == "ok"
    out = joined.withColumn("status", status)
    return out.select(
        by, "status", "detail", F.when(usable, F.col("segments")).alias("segments"), F.when(usable, F.col("duration")).alias("duration")
    )


def sum_segment_sizes(segments: DataFrame, by: str = "playlist_id", size: str = "filesize") -> DataFrame:
    """The size of all segments, NULL where fewer than half of the sizes are known."""
    known, n = F.count(size), F.count(F.lit(1))
    return segments.groupBy(by).agg(
        n.alias("segments"), known.alias("known"), F.when(known * 2 >= n, F.sum(size)).alias("total_size")
    )
