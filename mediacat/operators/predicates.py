"""Predicates over formats.

A missing field makes a filter false, or true with ``missing_ok``; ``negate`` does not change that. So the
comparison is negated inside the ``coalesce``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.operators.catalog import codec, has_audio, has_video

Get = Callable[[str], Column]

# The fields a format filter can name, and the precision of its numeric equality.
NUMERIC_FIELDS = ("height", "width", "fps", "tbr", "vbr", "abr", "asr", "filesize")
TEXT_FIELDS = ("ext", "vcodec", "acodec", "protocol", "format_id")
EPSILON = 2.220446049250313e-16

_TEXT_ONLY = ("^=", "$=", "*=", "~=")


@dataclass(frozen=True)
class FormatFilter:
    """``field op value``; ``op`` is one of ``= != < <= > >= ^= $= *= ~=``."""

    field: str
    op: str
    value: float | int | str
    missing_ok: bool = False
    negate: bool = False


def compare_numbers(c: Column, op: str, target: float) -> Column:
    t = F.lit(float(target))
    if op == "=":
        return F.abs(c - t) < EPSILON
    if op == "!=":
        return F.abs(c - t) >= EPSILON
    return {"<": c < t, "<=": c <= t, ">": c > t, ">=": c >= t}[op]


def plain_number(value: float | int) -> str:
    """A number as text, whole numbers without a fraction."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def compare_text(c: Column, op: str, target: str) -> Column:
    if op == "^=":
        return c.startswith(target)
    if op == "$=":
        return c.endswith(target)
    if op == "*=":
        return c.contains(target)
    if op == "~=":
        return c.rlike(target) if valid_pattern(target) else c.isNotNull() & F.lit(False)
    return {"=": c == target, "!=": c != target, "<": c < target, "<=": c <= target, ">": c > target, ">=": c >= target}[op]


def _as_number(value) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _core(f: FormatFilter, get: Get) -> Column | None:
    """The comparison, NULL where the field is missing; None for a field formats do not have."""
    if f.field in NUMERIC_FIELDS:
        c = get(f.field).cast("double")
        target = _as_number(f.value)
        if f.op in _TEXT_ONLY or target is None:
            return F.when(c.isNotNull(), F.lit(False))
        return compare_numbers(c, f.op, target)
    if f.field in TEXT_FIELDS:
        c = codec(get(f.field)) if f.field in ("vcodec", "acodec") else get(f.field)
        if isinstance(f.value, str):
            return compare_text(c, f.op, f.value)
        if f.op in _TEXT_ONLY or f.op in ("=", "!="):
            return compare_text(c, f.op, plain_number(f.value))
        return F.when(c.isNotNull(), F.lit(False))
    return None


def format_filter(f: FormatFilter, get: Get = F.col) -> Column:
    core = _core(f, get)
    if core is None:
        return F.lit(f.missing_ok)
    return F.coalesce(~core if f.negate else core, F.lit(f.missing_ok))


def all_filters(filters: Sequence[FormatFilter], get: Get = F.col) -> Column:
    return reduce(and_, [format_filter(f, get) for f in filters], F.lit(True))


def not_drm(get: Get = F.col) -> Column:
    return ~F.coalesce(get("has_drm"), F.lit(False))


def drop_drm(df: DataFrame) -> DataFrame:
    return df.where(not_drm())


def stream_type_filter(stream: str, star: bool = False, get: Get = F.col) -> Column:
    """Candidates of ``any``, ``video`` or ``audio``; ``star`` admits muxed formats too.

    Formats of unknown codecs pass, except for video-only and audio-only.
    """
    v, a = has_video(get("vcodec")), has_audio(get("acodec"))
    unknown = ~v & ~a
    if stream == "any":
        return (v | a | unknown) if star else ((v & a) | unknown)
    own, other = (v, a) if stream == "video" else (a, v)
    return (own | unknown) if star else (own & ~other)


def has_combined(df: DataFrame, by: str = "media_id") -> DataFrame:
    """Per media item: is there any muxed format without DRM."""
    both = not_drm() & has_video() & has_audio()
    return df.groupBy(by).agg(F.coalesce(F.bool_or(both), F.lit(False)).alias("has_combined"))


def language_filter(language: str, formats: Column | str = "formats") -> Column:
    """The formats of one language, of an array of formats."""
    return F.filter(formats, lambda f: F.coalesce(f["language"] == language, F.lit(False)))
