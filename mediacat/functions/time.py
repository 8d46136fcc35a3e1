"""Durations and dates written as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, extract, let, number
from mediacat.functions.html import trim_space
from mediacat.functions.numbers import colon_seconds

_ISO = r"^P(?:\d+D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
_ISO_SECONDS = r"^PT\d+(?:\.\d+)?S\z"


def parse_iso_duration(c: Column | str) -> Column:
    """Seconds of ``P[nD]T[nH][nM][n.nS]``; days are read and ignored."""
    return let(as_col(c), _iso_seconds)


def _iso_seconds(c: Column) -> Column:
    # Seconds alone, the usual case, take one pattern. Casts that fail are slow, so that none is tried on an empty group.
    value = lambda g: F.when(g == "", F.lit(0.0)).otherwise(F.coalesce(g.try_cast("double"), F.lit(0.0)))
    parts = [let(F.regexp_extract(c, _ISO, i), value) for i in (1, 2, 3)]
    seconds = F.substring(c, F.lit(3), F.length(c) - 3).try_cast("double")
    return F.when(c.rlike(_ISO_SECONDS), seconds).when(c.rlike(_ISO), parts[0] * 3600.0 + parts[1] * 60.0 + parts[2])


def parse_text_duration(c: Column | str) -> Column:
    """``1h 30min 5sec``: the number before the first mention of each unit; NULL for zero."""
    text = F.lower(trim_space(c))
    total, found = F.lit(0.0), F.lit(False)
    for unit, seconds in (("h", 3600.0), ("min", 60.0), ("sec", 1.0)):
        at = F.instr(text, unit)
        before = trim_space(F.substring(text, F.lit(1), at - 1))
        value = F.when(at > 0, number(F.element_at(F.split(before, r"(?U)\s+"), -1)))
        total = total + F.coalesce(value * seconds, F.lit(0.0))
        found = found | value.isNotNull()
    return F.when(found & (total > 0), total)


def parse_duration(c: Column | str) -> Column:
    """ISO, then ``h:m:s`` or ``m:s``, then text, then a plain number."""
    text = trim_space(c)
    iso = parse_iso_duration(text)
    return F.when(iso.isNotNull(), iso).when(text.contains(":"), colon_seconds(text)).otherwise(
        F.coalesce(parse_text_duration(text), number(text))
    )


def parse_iso_date(c: Column | str) -> Column:
    """``YYYYMMDD`` of a leading ``YYYY-MM-DD``."""
    c = as_col(c)
    pattern = r"^(\d{4})-(\d{2})-(\d{2})"
    return F.when(c.rlike(pattern), F.concat(*[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]))


def format_duration(c: Column | str) -> Column:
    """``h:mm:ss``, or ``m:ss`` below an hour."""
    total = F.floor(F.greatest(as_col(c).cast("double"), F.lit(0.0)))
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = [F.lpad(x.cast("long").cast("string"), 2, "0") for x in (minutes, seconds)]
    colon = F.lit(":")
    return F.when(hours > 0, F.concat(hours.cast("string"), colon, two[0], colon, two[1])).otherwise(
        F.concat(minutes.cast("string"), colon, two[1])
    )


# --- dates in many spellings ----------------------------------------------------------------------------------

# Month names and their numbers.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_LONG_MONTHS = (
    "january february march april may june july august september october november december".split()
)
_NAME = "(" + "|".join([*_LONG_MONTHS, *_MONTHS]) + ")"
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.:]\d{1,6})?)?"


def _epoch(year, month, day, hour=None, minute=None, second=None, offset=None) -> Column:
    zero = F.lit(0)
    parts = [F.coalesce(x.try_cast("int"), zero) if x is not None else zero for x in (hour, minute)]
    sec = F.coalesce(second.try_cast("int"), zero) if second is not None else zero
    ts = F.try_make_timestamp(
        year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), parts[0], parts[1], sec, F.lit("UTC")
    )
    epoch = F.unix_seconds(ts)
    return epoch - offset if offset is not None else epoch


def _groups(c: Column, pattern: str, n: int) -> list[Column]:
    return [extract(c, pattern, i) for i in range(1, n + 1)]


def _offset(zone: Column) -> Column:
    """Seconds east of UTC of ``Z``, ``GMT``, ``+HH:MM`` or ``+HHMM``."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(
        F.substring(digits, 3, 2).try_cast("int"), F.lit(0)
    ) * 60
    return F.coalesce(sign * seconds, F.lit(0))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(name, 1, 3)).cast("int")


def _year(two_or_four: Column) -> Column:
    y = two_or_four.try_cast("int")
    return F.when(F.length(two_or_four) == 2, F.when(y < 69, y + 2000).otherwise(y + 1900)).otherwise(y)


def _iso(c: Column) -> Column:
    pattern = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[t ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?(z|[+-]\d{2}(?::?\d{2})?)?)?$"
    y, m, d, h, mi, s, z = _groups(c, pattern, 7)
    return _epoch(y, m, d, h, mi, s, _offset(z))


def _rfc2822(c: Column) -> Column:
    pattern = rf"^(?:[a-z]{{3,}},?\s+)?(\d{{1,2}})[\s-]+{_NAME}[\s-]+(\d{{4}}|\d{{2}})\s+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?\s*([+-]\d{{4}}|gmt|utc|ut|z)?$"
    d, name, y, h, mi, s, z = _groups(c, pattern, 7)
    return _epoch(_year(y), _month(name), d, h, mi, s, _offset(z))


def _numeric(c: Column, day_first: bool) -> Column:
    pattern = r"^(\d{1,2})([-./])(\d{1,2})\2(\d{4}|(?<=/)\d{2})(?: (\d{1,2})[:.](\d{1,2})(?::(\d{1,2}))?)?$"
    a, _, b, y, h, mi, s = _groups(c, pattern, 7)
    d, m = (a, b) if day_first else (b, a)
    return _epoch(_year(y), m, d, h, mi, s)


def _year_first(c: Column) -> Column:
    y, _, m, d = _groups(c, r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})\.?$", 4)
    plain = _epoch(y, m, d)
    y, m, d, h, mi, s = _groups(c, rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[t ]{_CLOCK}z?)?$", 6)
    return F.coalesce(plain, _epoch(y, m, d, h, mi, s))


def _named(c: Column) -> Column:
    pattern = rf"^{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_CLOCK})?$"
    name, d, y, h, mi, s = _groups(c, pattern, 6)
    month_first = _epoch(y, _month(name), d, h, mi, s)
    d, name, y, h, mi, s = _groups(c, rf"^(\d{{1,2}})[ -]{_NAME}[ -](\d{{4}})(?: {_CLOCK})?$", 6)
    day_first = _epoch(y, _month(name), d, h, mi, s)
    h, mi, d, name, y = _groups(c, rf"^(\d{{1,2}}):(\d{{1,2}}) (\d{{1,2}})-{_NAME}-(\d{{4}})$", 5)
    return F.coalesce(month_first, day_first, _epoch(y, _month(name), d, h, mi))


def unified_timestamp(c: Column | str, day_first: bool = True) -> Column:
    """Epoch seconds of a date in one of many spellings: ISO, RFC 2822, numeric, named months."""
    text = F.lower(trim_space(c))
    return F.coalesce(
        _iso(text),
        _rfc2822(text),
        _numeric(text, day_first),
        _numeric(text, not day_first),
        _year_first(text),
        _named(text),
    )


def unified_strdate(c: Column | str, day_first: bool = True) -> Column:
    """``YYYYMMDD``; eight digits are taken as they are."""
    text = trim_space(c)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(unified_timestamp(c, day_first) / 86400).cast("int"))
    return F.when(text.rlike(r"^\d{8}$"), text).otherwise(F.date_format(day, "yyyyMMdd"))
