"""Fill-in-middle: a text becomes prefix, suffix and middle between markers, cut by one counted regular expression.

``regexp_count`` gives the ``n`` units of a text. Two draws from the digest of seed and ``doc_id`` give the cuts ``a`` and
``b``, and a pattern of the row's own, with the possessive groups ``unit{a}`` and ``unit{b-a}``, captures prefix, middle
and suffix in one match, whose replacement is the output. Possessive counts neither recurse nor go back, so that a text
of a million units takes one step for each.

A text that holds a marker, is empty, or that the third draw leaves out stays as it is (form ``plain``); the fourth draw
chooses between ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle). ``restore`` rebuilds the text.

Rows: a null text is empty; a null ``doc_id`` draws as an empty id; repeated rows are cut alike; an empty table gives no
rows. All columns stay in the struct ``row``, so that none clashes with the new ones. Everything happens inside a row, as
DataFrame functions; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transformation:
    """``unit`` must match any text from left to right without gaps and never the empty text; it must have no groups."""

    unit: str = r"[^\n]*\n|[^\n]+"
    seed: int = 7
    percent: int = 100
    percent_spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        joined = [a[i:] for a in marks for i in range(1, len(a))]
        if not all(marks) or len(set(marks)) < 3 or any(b.startswith(x) for x in joined for b in marks) or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("markers must be three texts of which none holds or overlaps another or itself")


def draws(seed: int, key: Column) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:key`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _quoted(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def transform(documents: DataFrame, how: Transformation = Transformation()) -> DataFrame:
    """``row`` with all columns, ``text`` (null as empty), ``n``, ``first_cut``, ``second_cut``, ``form``, ``output``."""
    p, s, m = how.prefix, how.suffix, how.middle
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(how.seed, F.col("doc_id")))))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(how.unit)).cast("long"))
    rows = rows.withColumns({"_a": F.col("h0") % (F.col("n") + 1), "_b": F.col("h1") % (F.col("n") + 1)})
    marked = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.col("h2") % 100 >= how.percent), "plain").when(F.col("h3") % 100 < how.percent_spm, "spm").otherwise("psm")
    rows = rows.withColumns({"first_cut": F.least("_a", "_b"), "second_cut": F.greatest("_a", "_b"), "form": form})
    counted = lambda k: F.concat(F.lit(f"((?:{how.unit}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), counted(F.col("first_cut")), counted(F.col("second_cut") - F.col("first_cut")), F.lit(r"((?s:.*+))\z"))
    shape = F.when(F.col("form") == "psm", F.lit(f"{_quoted(p)}$1{_quoted(s)}$3{_quoted(m)}$2")).otherwise(F.lit(f"{_quoted(s)}$3{_quoted(p)}$1{_quoted(m)}$2"))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, shape))
    return rows.select("row", "text", "n", "first_cut", "second_cut", "form", output.alias("output"))


def parts(output: Column, form: Column, how: Transformation = Transformation()) -> Column:
    """Prefix, middle and suffix of an output that is not plain, as a struct; null if plain."""
    cut = F.split(output, "|".join(re.escape(x) for x in (how.prefix, how.suffix, how.middle)), -1)
    psm = F.struct(F.get(cut, F.lit(1)).alias("prefix"), F.get(cut, F.lit(3)).alias("middle"), F.get(cut, F.lit(2)).alias("suffix"))
    spm = F.struct(F.get(cut, F.lit(2)).alias("prefix"), F.get(cut, F.lit(3)).alias("middle"), F.get(cut, F.lit(1)).alias("suffix"))
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restored(output: Column, form: Column, cut: Column) -> Column:
    """The text again, from output and form; ``cut`` holds the ``parts`` of them."""
    return F.when(form == "plain", output).otherwise(F.concat(cut["prefix"], cut["middle"], cut["suffix"]))


def restore(rows: DataFrame, how: Transformation = Transformation()) -> DataFrame:
    """Add ``parts`` and ``restored`` to rows with ``output`` and ``form``."""
    out = rows.withColumn("parts", parts(F.col("output"), F.col("form"), how))
    return out.withColumn("restored", restored(F.col("output"), F.col("form"), F.col("parts")))
