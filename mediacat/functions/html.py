"""Entities and tags."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, let


# References of the standard library's table that end in a semicolon, as one text: name and value between marks.
_MARK, _IS = "\x01", "\x02"
_TABLE = _MARK + _MARK.join(f"{k[:-1]}{_IS}{v}" for k, v in html5.items() if k.endswith(";")) + _MARK
# Looked up first: what a serializer escapes.
_COMMON = ("amp", "lt", "gt", "quot", "nbsp")


def _named(name: Column) -> Column:
    after = F.split_part(F.lit(_TABLE), F.concat(F.lit(_MARK), name, F.lit(_IS)), F.lit(2))
    return F.nullif(F.split_part(after, F.lit(_MARK), F.lit(1)), F.lit(""))


def _code_point(code: Column, token: Column) -> Column:
    ok = (
        code.isNotNull()
        & (code <= 0x10FFFF)
        & ~code.between(0xD800, 0xDFFF)
        & ((code >= 0x20) | code.isin(9, 10, 12, 13))
    )
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(F.lit(63))), 8, "0")), "UTF-32")
    return F.when(ok, char).otherwise(token)


def _entity(token: Column) -> Column:
    decimal = F.regexp_extract(token, r"^&#(\d{1,7});$", 1)
    hexa = F.regexp_extract(token, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
    name = F.regexp_extract(token, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
    text = F.coalesce(_named(name), token)
    for n in _COMMON:
        text = F.when(name == n, F.lit(html5[f"{n};"])).otherwise(text)
    return (
        F.when(~token.startswith("&"), token)
        .when(decimal != "", _code_point(decimal.try_cast("int"), token))
        .when(hexa != "", _code_point(F.conv(hexa, 16, 10).cast("int"), token))
        .when(name != "", text)
        .otherwise(token)
    )


def decode_html_entities(c: Column | str) -> Column:
    """Named and numeric references that end in a semicolon, decoded once."""
    return let(as_col(c), _decoded)


def _decoded(c: Column) -> Column:
    tokens = F.split(c, "(?=&)|(?<=;)")
    decoded = F.array_join(F.transform(tokens, _entity), "")
    return F.when(c.contains("&") & c.contains(";"), decoded).otherwise(c)


def repair_url_entities(c: Column | str) -> Column:
    """Every reference to the ampersand, and no other."""
    return F.regexp_replace(as_col(c), "&(?:amp;|AMP;|#0*38;|#[xX]0*26;)", "&")


def clean_html_tags(c: Column | str, max_length: int | None = None) -> Column:
    text = F.btrim(F.regexp_replace(trim_space(as_col(c)), "<[^>]+>", ""))
    text = trim_space(text)
    return text if max_length is None else F.substring(text, 1, max_length)


def clean_html_text(c: Column | str) -> Column:
    """Text without tags, runs of white space collapsed.

    Every piece after a ``<`` loses what stands before its first ``>``; the piece before the first ``<`` does too.
    """
    pieces = F.split(as_col(c), "<")
    kept = F.array_join(
        F.transform(pieces, lambda p: F.when(p.contains(">"), F.substring(p, F.instr(p, ">") + 1, F.length(p))).otherwise(p)), ""
    )
    return trim_space(F.regexp_replace(kept, r"(?U)\s+", " "))


def trim_space(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")
