"""Cleaning of text for lines, terminals and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, let

# Bidirectional controls, characters no file name may have, names Windows reserves.
BIDI = r"\u202a-\u202e\u2066-\u2069"
_UNSAFE = r'[/\\:*?"<>|]'
_RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"{n}{i}" for n in ("COM", "LPT") for i in range(1, 10)]]
# Markers of unfinished files; a title must not spell one.
MARKERS = (".mediacat-part", ".mediacat-tmp-", ".mediacat-bak")


def truncate_chars(c: Column | str, length: int) -> Column:
    return F.substring(as_col(c), 1, length)


def strip_controls(c: Column | str) -> Column:
    """Without control characters and bidirectional controls."""
    return F.regexp_replace(as_col(c), rf"[\p{{Cc}}{BIDI}]", "")


def sanitize_line(c: Column | str) -> Column:
    """Control characters become ``_``, so that the text stays one line."""
    return F.regexp_replace(as_col(c), r"\p{Cc}", "_")


def archive_key(extractor: Column | str, media_id: Column | str) -> Column:
    """Lower-case extractor, a space, and the id in its own case without control characters."""
    return F.concat(F.lower(as_col(extractor)), F.lit(" "), sanitize_line(media_id))


def subtitle_filename(stem: Column | str, language: Column | str, ext: Column | str) -> Column:
    return F.concat_ws(".", as_col(stem), as_col(language), as_col(ext))


def sanitize_filename(c: Column | str, markers: tuple[str, ...] = MARKERS, max_bytes: int | None = None) -> Column:
    """A name without what file systems do not take; never empty. ``max_bytes`` shortens longer ones, which may make them equal."""
    text = F.regexp_replace(as_col(c), rf"[\p{{Cc}}{BIDI}]", "")
    text = F.regexp_replace(text, r"(?U)\s", " ")
    text = F.regexp_replace(text, _UNSAFE, "_")
    for marker in markers:
        text = F.regexp_replace(text, rf"(?i)\.(?=\Q{marker[1:]}\E)", "_")
    text = F.regexp_replace(text, r"^[. ]+|[. ]+$", "")
    name = let(text, _not_reserved)
    return name if max_bytes is None else let(name, lambda t: F.when(F.octet_length(t) > max_bytes, _shorten(t, max_bytes)).otherwise(t))


def _not_reserved(text: Column) -> Column:
    base = F.upper(F.regexp_replace(text, r"\.[^.]*$", ""))
    prefixed = F.concat(F.lit("_"), text)
    return F.when(text == "", F.lit("unnamed")).when(base.isin(*_RESERVED), prefixed).otherwise(text)


def _shorten(text: Column, most: int) -> Column:
    ext = F.regexp_extract(text, r"^.+(\.[^.]*)$", 1)
    stem = F.substring(text, F.lit(1), F.length(text) - F.length(ext))
    short = F.concat(F.substring(stem, F.lit(1), F.lit(most) - F.octet_length(ext)), ext)
    return F.when((ext != "") & (F.octet_length(ext) < 10), short).otherwise(F.substring(text, 1, most))


def is_blank(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"(?U)\s", "") == ""
