"""Counts, sizes, heights and rates written as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, extract, fixed, integer, number
from mediacat.functions.html import trim_space


def parse_human_count(c: Column | str) -> Column:
    """``1,234``, ``1.5K``, ``2M views``, ``3B``."""
    text = F.lower(trim_space(c))
    text = F.regexp_replace(F.regexp_replace(text, "[,  ]", ""), "views", "")
    text = trim_space(text)
    digits = F.regexp_replace(text, "[kmb]$", "")
    factor = F.when(text.endswith("k"), 1e3).when(text.endswith("m"), 1e6).when(text.endswith("b"), 1e9).otherwise(1.0)
    value = number(digits) * factor
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))).try_cast("long")


def _power(unit: Column, binary: Column) -> Column:
    exponent = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).when(unit == "P", 5)
    return F.when(exponent.isNotNull(), F.pow(F.when(binary, 1024.0).otherwise(1000.0), exponent))


def parse_size(c: Column | str) -> Column:
    """``500M`` and ``500MB`` are decimal, ``1.5GiB`` and ``1.5Gi`` binary."""
    c = as_col(c)
    pattern = r"^([^A-Za-z]+)([A-Za-z])(|B|i|iB)$"
    value = number(F.regexp_extract(c, pattern, 1))
    unit = F.upper(F.regexp_extract(c, pattern, 2))
    factor = _power(unit, F.regexp_extract(c, pattern, 3).startswith("i"))
    size = value * factor
    return F.when((value >= 0) & (size <= 9.2e18), F.floor(size).cast("long"))


def parse_filter_number(c: Column | str) -> Column:
    """A plain number, one with a decimal suffix, or ``H:M:S``."""
    c = as_col(c)
    suffix = F.upper(F.substring(c, -1, 1))
    scaled = number(F.substring(c, F.lit(1), F.length(c) - 1)) * F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(
        suffix == "G", 1e9
    ).when(suffix == "B", 1.0)
    return F.coalesce(number(c), scaled, colon_seconds(c))


def colon_seconds(c: Column | str) -> Column:
    parts = F.split(as_col(c), ":")
    at = [number(F.get(parts, F.lit(i))) for i in range(3)]
    return F.when(F.size(parts) == 2, at[0] * 60.0 + at[1]).when(
        F.size(parts) == 3, at[0] * 3600.0 + at[1] * 60.0 + at[2]
    )


def parse_height(c: Column | str) -> Column:
    """``720p`` to 720."""
    return integer(F.regexp_replace(as_col(c), "[pP]+$", "")).cast("int")


def height_from_url(c: Column | str) -> Column:
    return integer(extract(as_col(c), r"(\d+)[pP]")).try_cast("int")


# The width that goes with each usual height.
_WIDTHS = {240: 426, 360: 640, 480: 854, 720: 1280, 1080: 1920, 1440: 2560, 2160: 3840}


def width_from_height(c: Column | str) -> Column:
    h = as_col(c)
    width = None
    for height, w in _WIDTHS.items():
        width = F.when(h == height, w) if width is None else width.when(h == height, w)
    return width.otherwise(F.floor(h * 16 / 9)).cast("int")


def parse_frame_rate(c: Column | str) -> Column:
    """``30000/1001`` or ``25``."""
    text = trim_space(c)
    parts = F.split(text, "/", 2)
    above, below = (number(trim_space(F.get(parts, F.lit(i)))) for i in range(2))
    return F.when(F.size(parts) == 2, F.when(below != 0, above / below)).otherwise(number(text))


def parse_sampling_rate(c: Column | str) -> Column:
    """The first number of a list."""
    return integer(F.get(F.split(trim_space(c), r"(?U)\s+"), F.lit(0))).try_cast("int")


def _sized(c: Column | str, base: int, units: str) -> Column:
    n = as_col(c)
    text = None
    for power, unit in ((3, "G"), (2, "M"), (1, "K")):
        scale = base**power
        shown = F.concat(fixed(n / float(scale), 1), F.lit(f" {unit}{units}"))
        text = F.when(n >= scale, shown) if text is None else text.when(n >= scale, shown)
    return text.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_filesize(c: Column | str) -> Column:
    return _sized(c, 1024, "iB")


def format_filesize_decimal(c: Column | str) -> Column:
    return _sized(c, 1000, "B")


def chunk_size(c: Column | str) -> Column:
    """A 1024th of the file, between 64 KiB and 8 MiB, rounded up to a power of two."""
    low, high = 64 * 1024, 8 * 1024 * 1024
    target = F.least(F.greatest(F.floor(as_col(c) / 1024), F.lit(low)), F.lit(high))
    size = F.lit(high)
    step = high // 2
    while step >= low:
        size = F.when(target <= step, F.lit(step)).otherwise(size)
        step //= 2
    return F.when(as_col(c).isNotNull(), size).cast("long")


def estimate_size(bandwidth: Column | str, duration: Column | str) -> Column:
    """Bytes of a stream of so many bits per second."""
    return F.floor(as_col(bandwidth) * as_col(duration) / 8).cast("long")

