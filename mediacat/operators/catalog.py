"""Shaping of the catalog: formats as rows, derived columns, display columns, JSON lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions.conditions import as_col, fixed, let
from mediacat.functions.html import decode_html_entities, repair_url_entities
from mediacat.functions.numbers import width_from_height
from mediacat.operators.ordered import number_rows


def explode_formats(media: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """One row per format with its position; a media item without formats keeps one row of NULLs."""
    rows = media.select(*keys, F.posexplode_outer("formats").alias("ordinal", "_f"))
    return rows.select(*keys, "ordinal", "_f.*")


def codec(c: Column | str) -> Column:
    """A codec name, NULL where it says there is none."""
    c = as_col(c)
    return F.when(~F.lower(c).isin("", "none"), c)


def normalize_codecs(df: DataFrame) -> DataFrame:
    return df.withColumns({"vcodec": codec("vcodec"), "acodec": codec("acodec")})


def has_video(vcodec: Column | str = "vcodec") -> Column:
    return codec(vcodec).isNotNull()


def has_audio(acodec: Column | str = "acodec") -> Column:
    return codec(acodec).isNotNull()


def stream_flags(df: DataFrame) -> DataFrame:
    return normalize_codecs(df).withColumns(
        {
            "has_video": has_video(),
            "has_audio": has_audio(),
            "codecs_unknown": ~has_video() & ~has_audio(),
        }
    )


def resolved_filesize(exact: Column | str = "filesize", approx: Column | str = "filesize_approx") -> Column:
    return F.coalesce(as_col(exact), as_col(approx))


def resolution_string(width: Column | str = "width", height: Column | str = "height") -> Column:
    w, h = as_col(width), as_col(height)
    return F.concat(w.cast("string"), F.lit("x"), h.cast("string"))


def is_hls(protocol="protocol", url="url", ext="ext") -> Column:
    p, u, e = as_col(protocol), as_col(url), as_col(ext)
    flags = p.isin("m3u8", "m3u8_native"), u.contains(".m3u8"), e == "hls"
    return F.coalesce(flags[0], F.lit(False)) | F.coalesce(flags[1], F.lit(False)) | F.coalesce(flags[2], F.lit(False))


def is_dash(protocol="protocol", container="container") -> Column:
    return F.coalesce(as_col(protocol) == "http_dash_segments", F.lit(False)) | F.coalesce(
        as_col(container).contains("dash"), F.lit(False)
    )


def protocol_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_hls": is_hls(), "is_dash": is_dash()})


def propagate_duration(media: DataFrame) -> DataFrame:
    """Fill a missing format duration from the media item, inside the array."""
    filled = F.transform(
        "formats", lambda f: f.withField("duration", F.coalesce(f["duration"], F.col("duration")))
    )
    return media.withColumn("formats", filled)


def decode_text_fields(media: DataFrame) -> DataFrame:
    """Decode entities in display text and undo escaped ampersands in page URLs, once.

    Ids and format URLs stay as they are.
    """
    present = set(media.columns)
    new: dict[str, Column] = {}
    for c in ("webpage_url", "thumbnail", "uploader_url", "channel_url"):
        if c in present:
            new[c] = repair_url_entities(c)
    for c in "title description uploader channel playlist playlist_title artist album track".split():
        if c in present:
            new[c] = decode_html_entities(c)
    for c in ("actors", "tags", "categories"):
        if c in present:
            new[c] = F.transform(c, decode_html_entities)
    if "thumbnails" in present:
        new["thumbnails"] = F.transform("thumbnails", lambda t: t.withField("url", repair_url_entities(t["url"])))
    if "chapters" in present:
        new["chapters"] = F.transform("chapters", lambda t: t.withField("title", decode_html_entities(t["title"])))
    for c in ("subtitles", "automatic_captions"):
        if c in present:
            new[c] = F.transform_values(
                c,
                lambda _, tracks: F.transform(
                    tracks,
                    lambda t: t.withField("name", decode_html_entities(t["name"])).withField(
                        "url", repair_url_entities(t["url"])
                    ),
                ),
            )
    return media.withColumns(new)


def _minutes(duration: Column) -> Column:
    whole = F.floor(duration)
    return F.concat(
        F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")
    )


def size_text(fragments: Column | None = None) -> Column:
    """Display text of a format's size: segments and length for HLS, megabytes otherwise."""
    mib = 1024.0 * 1024.0
    duration = _minutes(F.col("duration"))
    any_mb = resolved_filesize().cast("double") / mib
    size = F.when(any_mb >= 1024.0, F.concat(fixed(any_mb / 1024.0, 1), F.lit(" GB"))).otherwise(
        F.concat(fixed(any_mb, 0), F.lit(" MB"))
    )
    segments = fragments if fragments is not None else F.lit(None).cast("int")
    segments = segments.cast("string")

    def streamed(s: Column) -> Column:
        return F.coalesce(
            F.concat(s["duration"], F.lit(" ("), segments, F.lit(" seg)")),
            F.concat(s["duration"], F.lit(" (~"), s["size"], F.lit(")")),
            s["duration"],
            F.concat(segments, F.lit(" segments")),
            F.concat(F.lit("~"), s["size"]),
            F.lit("HLS stream"),
        )

    hls = let(F.struct(duration.alias("duration"), size.alias("size")), streamed)
    exact = F.concat(
        fixed(F.col("filesize") / mib, 1),
        F.lit(" MB"),
        F.coalesce(F.concat(F.lit(" ("), duration, F.lit(")")), F.lit("")),
    )
    approx = F.concat(F.lit("~"), fixed(F.col("filesize_approx") / mib, 0), F.lit(" MB"))
    return F.when(is_hls(), hls).otherwise(F.coalesce(exact, approx, duration, F.lit("Unknown")))


def _positive(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) > 0, fixed(F.col(c), 0)), F.lit(""))


def format_listing(df: DataFrame, keys: Sequence[str] = ("media_id", "ordinal")) -> DataFrame:
    """The display columns of a format table."""
    v, a = codec("vcodec"), codec("acodec")
    base = F.coalesce(F.col("format_note"), F.lit("unknown"))
    fps = F.col("fps")
    codecs = F.coalesce(
        F.concat(v, F.lit("/"), a),
        F.concat(v, F.lit(" (video only)")),
        F.concat(a, F.lit(" (audio only)")),
        F.lit("Unknown"),
    )
    drm = F.when(F.coalesce(F.col("has_drm"), F.lit(False)), F.lit(" [DRM]")).otherwise(F.lit(""))
    return df.select(
        *keys,
        F.when((fps > 0) & (F.abs(fps - 30.0) > 1.0), F.concat(base, fixed(fps, 0))).otherwise(base).alias("quality_text"),
        F.coalesce(resolution_string(), F.lit("N/A")).alias("resolution"),
        F.when(is_hls(), F.lit("HLS")).otherwise(F.upper("ext")).alias("type"),
        size_text(F.size("fragments") if "fragments" in df.columns else None).alias("size"),
        F.concat(codecs, drm).alias("codecs"),
        _positive("fps").alias("fps_text"),
        _positive("abr").alias("abr_text"),
        _positive("vbr").alias("vbr_text"),
        F.concat_ws(", ", "dynamic_range", "language").alias("note"),
    )


def build_formats(df: DataFrame) -> DataFrame:
    """Complete ``(format_id, url, ext, height)`` rows: width, note, quality score and codecs implied by the extension."""
    h, ext = F.col("height"), F.col("ext")
    return df.withColumns(
        {
            "width": width_from_height(h),
            "format_note": F.concat(h.cast("string"), F.lit("p")),
            "quality": F.floor(h / 100).cast("int"),
            "vcodec": F.when(ext == "mp4", "h264").when(ext == "webm", "vp9"),
            "acodec": F.when(ext == "mp4", "aac").when(ext == "webm", "opus"),
            "protocol": F.lit("https"),
        }
    )


def dedup_format_ids(df: DataFrame, by: str = "media_id", order: str = "ordinal", block=1 << 40) -> DataFrame:
    """Give the second, third, ... format of one id the suffix ``-2``, ``-3``, ..."""
    numbered = number_rows(df, [by, "format_id"], order, "_n", block)
    suffixed = F.concat("format_id", F.lit("-"), F.col("_n").cast("string"))
    return numbered.withColumn("format_id", F.when(F.col("_n") > 1, suffixed).otherwise(F.col("format_id"))).drop("_n")


def explode_thumbnails(df: DataFrame, urls: str, keys: Sequence[str]) -> DataFrame:
    """Thumbnails of a list of URLs: the index stays in id and preference although empty URLs are dropped."""
    rows = df.select(*keys, F.posexplode(urls).alias("_i", "url")).where(F.col("url") != "")
    return rows.select(
        *keys,
        "url",
        F.concat(F.lit("jsonld_"), F.col("_i").cast("string")).alias("id"),
        (-F.col("_i")).alias("preference"),
    )


def merge_records(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides by key; a value of the right side wins unless it is NULL."""
    keys = list(keys)
    columns = [c for c in dict.fromkeys(left.columns + right.columns) if c not in keys]

    def value(c: str) -> Column:
        sides = [F.col(f"{n}.{c}") for n, d in (("r", right), ("l", left)) if c in d.columns]
        return F.coalesce(*sides).alias(c)

    joined = left.alias("l").join(right.alias("r"), keys, "full_outer")
    return joined.select(*keys, *[value(c) for c in columns])


# --- JSON traversal -------------------------------------------------------------------------------------------


def _step(current: Column, key, casesense: bool) -> Column:
    """All values one step below every value of an array of variants."""
    if key is Ellipsis:
        as_list = F.try_variant_get(current, "$", "array<variant>")
        as_map = F.map_values(F.try_variant_get(current, "$", "map<string,variant>"))
        return F.coalesce(as_list, as_map, F.array().cast("array<variant>"))
    if isinstance(key, int):
        as_list = F.try_variant_get(current, "$", "array<variant>")
        at = F.get(as_list, F.lit(key) if key >= 0 else F.size(as_list) + F.lit(key))
        return F.when(at.isNotNull(), F.array(at)).otherwise(F.array().cast("array<variant>"))
    entries = F.map_entries(F.try_variant_get(current, "$", "map<string,variant>"))
    same = (lambda e: e["key"] == key) if casesense else (lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.transform(F.filter(entries, same), lambda e: e["value"]), F.array().cast("array<variant>"))


def _stepper(key, casesense: bool):
    return lambda current: _step(current, key, casesense)


def traverse_json(
    value: Column | str,
    *paths: Sequence,
    expected: str = "string",
    casesense: bool = True,
) -> Column:
    """The first path that leads to a value of type ``expected``.

    A path is a list of keys, indexes (negative ones count from the end) and ``...`` for all values below. A path
    with ``...`` yields all its values (an array), one without a single value; the kinds must not be mixed.
    """
    branching = [any(k is Ellipsis for k in p) for p in paths]
    if any(branching) != all(branching):
        raise ValueError("paths with and without ... cannot be mixed")
    found = []
    for path in paths:
        level = F.array(as_col(value))
        for key in path:
            level = F.flatten(F.transform(level, _stepper(key, casesense)))
        typed = F.transform(
            F.filter(level, lambda v: F.schema_of_variant(v) == _VARIANT_NAMES[expected]) if expected in _VARIANT_NAMES else level,
            lambda v: F.try_variant_get(v, "$", expected),
        )
        typed = F.filter(typed, lambda v: v.isNotNull())
        found.append(F.when(F.size(typed) > 0, typed if all(branching) else F.get(typed, F.lit(0))))
    return F.coalesce(*found)


# The type a variant reports for each type that can be asked for exactly.
_VARIANT_NAMES = {"string": "STRING", "boolean": "BOOLEAN"}
