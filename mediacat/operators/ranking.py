"""Sort keys over formats and the picks made with them.

All keys of a row form one flat struct; more is better. A missing value is NULL, which compares below every value.
``best`` takes the last of equal formats and ``worst`` the first, whereas the N-th best or worst counts equal formats
from the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.conditions import let
from mediacat.operators.catalog import codec, has_audio, has_video
from mediacat.operators.ordered import places
from mediacat.operators.predicates import Get, not_drm

# Codec tiers (best first), protocol order (best first), HDR scores.
VIDEO_TIERS = (
    "av0?1",
    r"vp0?9\.0?2",
    "vp0?9",
    "[hx]265|he?vc?",
    "[hx]264|avc",
    "vp0?8",
    "mp4v|h263",
    "theora",
)
AUDIO_TIERS = (
    "[af]lac",
    "wav|aiff",
    "opus",
    "vorbis|ogg",
    "aac",
    "mp?4a?",
    "mp3",
    "ac-?4",
    "e-?a?c-?3",
    "ac-?3",
    "dts",
)
PROTOCOLS = ("https", "http", "m3u8_native", "m3u8", "http_dash_segments")
DEFAULT_FIELDS = "hasvid ie_pref lang quality res fps hdr vcodec channels acodec size br asr proto ext hasaud source id".split()
DEFAULT_HDR_LIMIT = 12.0

_NUMERIC = {
    "height": "height",
    "res": "height",
    "width": "width",
    "fps": "fps",
    "quality": "quality",
    "ie_pref": "quality",
    "br": "tbr",
    "tbr": "tbr",
    "vbr": "vbr",
    "abr": "abr",
    "asr": "asr",
}
_TEXT = {
    "ext": "ext",
    "vext": "ext",
    "aext": "ext",
    "id": "format_id",
    "lang": "language",
    "language": "language",
    "source": "container",
}


@dataclass(frozen=True)
class SortField:
    """One sort field. ``limit`` prefers values up to it; with ``nearest`` the value closest to it."""

    name: str
    ascending: bool = False
    limit: float | None = None
    nearest: bool = False


DEFAULT_ORDER = tuple(
    SortField(n, limit=DEFAULT_HDR_LIMIT if n == "hdr" else None) for n in DEFAULT_FIELDS
)


def number_keys(value: Column, field: SortField) -> list[Column]:
    v = value.cast("double")
    sign = -1.0 if field.ascending else 1.0
    if field.nearest:
        limit = F.lit(float(field.limit or 0.0))
        preferred = (v <= limit) if field.ascending else (v >= limit)
        return [-F.abs(v - limit), F.when(preferred, 1).otherwise(-1)]
    if field.limit is not None:
        within = v <= F.lit(float(field.limit))
        # 1 at or below the limit, 0 above it, NULL for a missing value.
        return [F.when(within, 1).when(~within, 0), F.when(within, v * sign).otherwise(v * -sign)]
    return [v * sign]


def codec_tier(name: Column, tiers: Sequence[str]) -> Column:
    """How many tiers from the end the first matching pattern stands; 0 for an unknown codec."""
    return let(name, lambda x: _codec_tier(x, tiers))


def _codec_tier(name: Column, tiers: Sequence[str]) -> Column:
    score = None
    for i, pattern in enumerate(tiers):
        value, hit = F.lit(len(tiers) - i), name.rlike(f"(?i)(?:{pattern})")
        score = F.when(hit, value) if score is None else score.when(hit, value)
    return F.when(name.isNotNull(), score.otherwise(0))


def hdr_score(dynamic_range: Column) -> Column:
    d = dynamic_range
    return (
        F.when(d.contains("DV") | F.upper(d).contains("DOVI"), 5)
        .when(d.contains("HDR10+") | d.contains("HDR10P"), 4)
        .when(d.contains("HDR10"), 3)
        .when(d.contains("HLG"), 2)
        .otherwise(1)
    )


def protocol_score(protocol: Column) -> Column:
    score = F.lit(0)
    for i, name in enumerate(reversed(PROTOCOLS)):
        score = F.when(protocol == name, i + 1).otherwise(score)
    return score


def string_rank(text: Column) -> Column:
    """The first eight UTF-8 bytes as a signed 64-bit number, as a double.

    Text of ASCII characters, which most is, is added up character by character; other text goes through hexadecimal.
    """
    # Named once: the code of all keys of a row would else be too long to be compiled.
    return let(text, _string_rank)


def _string_rank(text: Column) -> Column:
    ascii_sum = F.lit(0).cast("long")
    for i in range(8):
        ascii_sum = ascii_sum + F.ascii(F.substring(text, i + 1, 1)) * F.lit(1 << (8 * (7 - i))).cast("long")
    padded = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 8)), 16, "0")
    high = F.conv(F.substring(padded, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(padded, 9, 8), 16, 10).cast("long")
    signed = F.when(high >= (1 << 31), high - F.lit(1 << 32)).otherwise(high)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, ascii_sum).otherwise(signed * F.lit(1 << 32) + low).cast("double")


def sort_keys(field: SortField, get: Get = F.col) -> list[Column]:
    """The columns a field sorts by, most of them one."""
    sign = -1.0 if field.ascending else 1.0
    name = field.name
    if name in ("hasvid", "hasaud"):
        return [F.when(has_video(get("vcodec")) if name == "hasvid" else has_audio(get("acodec")), 1)]
    if name in _NUMERIC:
        return number_keys(get(_NUMERIC[name]), field)
    if name in ("size", "filesize"):
        return number_keys(F.coalesce(get("filesize"), get("filesize_approx")), field)
    if name == "hdr":
        return number_keys(hdr_score(get("dynamic_range")), field)
    if name in ("vcodec", "acodec"):
        return [codec_tier(codec(get(name)), VIDEO_TIERS if name == "vcodec" else AUDIO_TIERS) * int(sign)]
    if name in ("proto", "protocol"):
        return [protocol_score(get("protocol")) * int(sign)]
    if name in _TEXT:
        return [string_rank(get(_TEXT[name])) * sign]
    # Channels and unknown fields are missing in every format.
    return []


def rank_key(order: Sequence[SortField] = DEFAULT_ORDER, get: Get = F.col) -> Column:
    """All sort fields as one comparable struct."""
    keys = [k for f in dict.fromkeys(order) for k in sort_keys(f, get)]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys or [F.lit(0)])])


def row_struct(df: DataFrame, columns: Sequence[str] | None = None, without: Sequence[str] = ()) -> Column:
    return F.struct(*[F.col(c) for c in (columns or df.columns) if c not in without])


def _picked(df: DataFrame, by: str, pick: Column) -> DataFrame:
    return df.groupBy(by).agg(pick.alias("_p")).where(F.col("_p").isNotNull()).select(by, "_p.*")


def pick_best(df, order=DEFAULT_ORDER, by="media_id", ordinal="ordinal", columns=None) -> DataFrame:
    """The best row per media item in one aggregation (partial on the map side); the last of equal rows."""
    return _picked(df, by, F.max_by(row_struct(df, columns, (by,)), F.struct(rank_key(order), F.col(ordinal))))


def pick_worst(df, order=DEFAULT_ORDER, by="media_id", ordinal="ordinal", columns=None) -> DataFrame:
    return _picked(df, by, F.min_by(row_struct(df, columns, (by,)), F.struct(rank_key(order), F.col(ordinal))))


def nth(df, n: int, worst=False, order=DEFAULT_ORDER, by="media_id", ordinal="ordinal") -> DataFrame:
    """The N-th best (or worst) row; equal rows count from the first.

    The bound on the row number lets Spark cut every map partition to N rows per group before the shuffle.
    """
    key = rank_key(order)
    window = Window.partitionBy(by).orderBy(key.asc() if worst else key.desc(), F.col(ordinal).asc())
    return (
        df.withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= n)
        .where(F.col("_rn") == n)
        .drop("_rn")
    )


def sort_formats(df: DataFrame, order: Sequence[SortField] = DEFAULT_ORDER, by="media_id", ordinal="ordinal") -> DataFrame:
    """All rows with ``place``, counted from 1 for the best of a media item."""
    return places(df, by, rank_key(order), ordinal, descending=True)


def default_order(df: DataFrame, by="media_id", ordinal="ordinal") -> DataFrame:
    return sort_formats(df, DEFAULT_ORDER, by, ordinal)


def select_all_formats(df: DataFrame, by="media_id", ordinal="ordinal") -> DataFrame:
    """Every format without DRM with its ``place``, best first."""
    return sort_formats(df.where(not_drm()), DEFAULT_ORDER, by, ordinal)


def select_mergeable(df: DataFrame, by="media_id", ordinal="ordinal") -> DataFrame:
    """Every format without DRM that has video or audio with its ``place``, worst first."""
    usable = df.where(not_drm() & (has_video() | has_audio()))
    return places(usable, by, rank_key(), ordinal)


# --- picks of a whole media record, without a sorter ----------------------------------------------------------


def _best_by(df: DataFrame, keep: Column, keys: Sequence[str], by: str, ordinal: str, columns) -> DataFrame:
    # NULL is below every value in a struct comparison, as a missing value is here.
    key = F.struct(*[F.col(k) for k in keys], F.col(ordinal))
    return _picked(df.where(keep), by, F.max_by(row_struct(df, columns, (by,)), key))


def best_format(df, by="media_id", ordinal="ordinal", columns=None) -> DataFrame:
    return _best_by(df, has_video() & has_audio(), ("quality", "height", "tbr"), by, ordinal, columns)


def best_video(df, by="media_id", ordinal="ordinal", columns=None) -> DataFrame:
    return _best_by(df, has_video(), ("quality", "height", "vbr"), by, ordinal, columns)


def best_audio(df, by="media_id", ordinal="ordinal", columns=None) -> DataFrame:
    return _best_by(df, has_audio(), ("abr",), by, ordinal, columns)
