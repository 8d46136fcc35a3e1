"""Fixed schemas of the catalog tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)

BYTE_RANGE = _struct(start=_L, end=_L)

FRAGMENT = _struct(
    url=_S, byte_range=BYTE_RANGE, init_url=_S, init_byte_range=BYTE_RANGE, duration=_D, filesize=_L
)

FORMAT = _struct(
    format_id=_S,
    url=_S,
    quality=_I,
    width=_I,
    height=_I,
    fps=_D,
    tbr=_D,
    vbr=_D,
    abr=_D,
    asr=_I,
    vcodec=_S,
    acodec=_S,
    ext=_S,
    format_note=_S,
    protocol=_S,
    container=_S,
    filesize=_L,
    filesize_approx=_L,
    fragments=T.ArrayType(FRAGMENT),
    fragment_base_url=_S,
    http_headers=T.MapType(_S, _S),
    language=_S,
    audio_group_id=_S,
    dynamic_range=_S,
    has_drm=_B,
    duration=_D,
    fallback_urls=T.ArrayType(_S),
)

THUMBNAIL = _struct(url=_S, id=_S, width=_I, height=_I, preference=_I)
SUBTITLE = _struct(url=_S, ext=_S, name=_S)
CHAPTER = _struct(title=_S, start_time=_D, end_time=_D)
SUBTITLE_MAP = T.MapType(_S, T.ArrayType(SUBTITLE))

MEDIA_SCHEMA = _struct(
    id=_S,
    title=_S,
    extractor=_S,
    extractor_key=_S,
    webpage_url=_S,
    description=_S,
    duration=_D,
    thumbnail=_S,
    thumbnails=T.ArrayType(THUMBNAIL),
    uploader=_S,
    uploader_id=_S,
    uploader_url=_S,
    actors=T.ArrayType(_S),
    channel=_S,
    channel_id=_S,
    channel_url=_S,
    upload_date=_S,
    view_count=_L,
    like_count=_L,
    dislike_count=_L,
    comment_count=_L,
    average_rating=_D,
    age_limit=_I,
    tags=T.ArrayType(_S),
    categories=T.ArrayType(_S),
    formats=T.ArrayType(FORMAT),
    requested_formats=T.ArrayType(FORMAT),
    playlist=_S,
    playlist_id=_S,
    playlist_title=_S,
    playlist_index=_L,
    playlist_count=_L,
    subtitles=SUBTITLE_MAP,
    automatic_captions=SUBTITLE_MAP,
    chapters=T.ArrayType(CHAPTER),
    is_live=_B,
    was_live=_B,
    release_year=_I,
    artist=_S,
    album=_S,
    track=_S,
)

# One detected media reference on a page (the row every detection strategy returns).
DETECTION_SCHEMA = _struct(
    page_id=_L, url=_S, ext=_S, quality=_S, confidence=_I, source=_S, strategy=_I, seq=_L
)

PROGRESS_SCHEMA = _struct(
    transfer_id=_L, ts=T.TimestampType(), cumulative_bytes=_L, frac=_D
)

FAILED_EPISODE = _struct(position=_L, title=_S, last_error=_S)

# Both kinds of session (single video, playlist) in one table; ``state_type`` tells them apart.
SESSION_SCHEMA = _struct(
    state_type=_S,
    version=_I,
    source_url=_S,
    title=_S,
    format_id=_S,
    audio_format_id=_S,
    subtitle_langs=T.ArrayType(_S),
    playlist_title=_S,
    selected_audio=_S,
    selected_sub_langs=T.ArrayType(_S),
    strict_subs=_B,
    failed_episodes=T.ArrayType(FAILED_EPISODE),
    created_at=T.TimestampType(),
    updated_at=T.TimestampType(),
)
