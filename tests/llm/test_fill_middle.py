"""Fill-in-middle against a plain reading: units by a Python pattern, cuts by hashlib, texts joined by hand."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mediacat.llm import fill_middle
from mediacat.llm.fill_middle import Transformation


def expected(doc_id, text, how):
    text = text or ""
    units = [m[0] for m in re.finditer(how.unit, text)]
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (how.prefix, how.suffix, how.middle)) or h3 % 100 >= how.percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < how.percent_spm:
        return len(units), "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m
    return len(units), "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m


ODD = ["\n", "\n\n\n", "a\n" * 50_000, "x" * 300_000, "<P>", "a<S", "S>\n<", "<\nP>\n<M\n>", "a$1\\\n$", "\r\n\r\n", "\U0001f600\n\U0001f600", "\x00\n\x00", "one line", "end\n"]


@pytest.mark.parametrize("how", [Transformation(), Transformation(unit=r"[^ ]* |[^ ]+", seed=3, percent=60, percent_spm=20, prefix="<|$p|>", suffix="<|s\\|>", middle="<|m|>")])
def test_against_plain_reading(spark, docs, rows, no_docs, how):
    rnd = random.Random(5)
    more = [(10_000 + i, x) for i, x in enumerate(ODD)] + [(20_000 + i, "".join(rnd.choices("ab \né\U0001f600<P>", k=rnd.randint(0, 40)))) for i in range(300)]
    small = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = fill_middle.restore(fill_middle.transform(small, how), how)
    got = out.select("row.doc_id", "row.text", "n", "form", F.char_length("parts.prefix"), F.char_length("parts.middle"), "output", "restored").collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert tuple(r)[2:7] == expected(r.doc_id, r.text, how), r.doc_id
        assert r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(no_docs, how), how).count() == 0


def test_clashing_columns_stay(docs):
    out = fill_middle.transform(docs.withColumn("form", F.lit(1)))
    assert out.select("row.*").columns == [*docs.columns, "form"]


def test_markers_must_be_told_apart():
    for marks in ({"prefix": ""}, {"prefix": "<S>"}, {"prefix": "<S", "suffix": "<S>"}, {"prefix": "aba"}, {"prefix": "ab", "suffix": "bc"}):
        with pytest.raises(ValueError):
            Transformation(**marks)
