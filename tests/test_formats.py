"""Selection rules on small tables written out by hand."""

import pytest
from pyspark.sql import functions as F

from mediacat.operators import ranking, selection
from mediacat.operators.predicates import FormatFilter
from mediacat.operators.ranking import SortField
from mediacat.operators.selection import AllFormats, Group, Merge, Mergeable, Pick

COLUMNS = (
    "media_id long, ordinal long, format_id string, ext string, vcodec string, acodec string, height int, width int, "
    "quality int, tbr double, vbr double, abr double, fps double, asr int, filesize long, filesize_approx long, "
    "protocol string, container string, language string, dynamic_range string, has_drm boolean"
)


def fmt(i, format_id, vcodec=None, acodec=None, height=None, quality=None, media_id=1, **more):
    row = dict.fromkeys([c.split()[0] for c in COLUMNS.split(", ")])
    row.update(media_id=media_id, ordinal=i, format_id=format_id, ext="mp4", vcodec=vcodec, acodec=acodec, height=height, quality=quality, protocol="https")
    row.update(more)
    return row


@pytest.fixture(scope="module")
def nine(spark):
    rows = [fmt(i, f"c{h}", "avc1", "mp4a", h, h // 100, tbr=float(h)) for i, h in enumerate((360, 720, 1080))]
    rows += [fmt(3 + i, f"v{h}", "vp9", None, h, h // 100, vbr=float(h)) for i, h in enumerate((720, 1080, 1440))]
    rows += [fmt(6 + i, f"a{b}", "none", "opus", abr=float(b)) for i, b in enumerate((64, 128, 256))]
    return spark.createDataFrame(rows, COLUMNS)


def ids(df, target, **options):
    rows = selection.select_formats(df, target, **options).collect()
    return [r.format_id for r in sorted(rows, key=lambda r: (r.part is not None, r.part))]


def test_picks(nine):
    assert ids(nine, (Pick("any"),)) == ["c1080"]
    assert ids(nine, (Pick("video"),)) == ["v1440"]
    assert ids(nine, (Pick("any", worst=True),)) == ["c360"]
    assert ids(nine, (Pick("video", star=True, n=2),)) in (["c1080"], ["v1080"])
    assert ids(nine, (Pick(format_id="a64"),)) == ["a64"]
    assert ids(nine, (Pick("any", filters=(FormatFilter("height", "<=", 720),)),)) == ["c720"]


def test_default_merges_and_falls_back(nine):
    # The default order does not look at abr; the id decides between the audio formats.
    assert ids(nine, selection.BEST_VIDEO_PLUS_AUDIO) == ["v1440", "a64"]
    muxed = nine.where(F.col("format_id").startswith("c"))
    assert ids(muxed, selection.BEST_VIDEO_PLUS_AUDIO) == ["c1080"]
    streams = nine.where(~F.col("format_id").startswith("c"))
    assert ids(streams, (Pick("any"),)) == ["v1440"]
    assert ids(streams, (Pick("any", worst=True),)) == []


def test_group_filters_and_bulk(nine):
    group = Group(((Pick("video"),), (Pick("any"),)), (FormatFilter("height", "=", 1080),))
    assert ids(nine, (group,)) == ["c1080"]
    assert len(ids(nine, (AllFormats(),))) == 9
    assert len(ids(nine, (Pick(ext="webm"), Mergeable()))) == 9
    bulk = Group(((AllFormats(),),), (FormatFilter("vcodec", "^=", "vp9"),))
    assert sorted(ids(nine, (bulk,))) == ["v1080", "v1440", "v720"]


def test_merge_needs_both(nine):
    assert ids(nine, (Merge(Pick("video"), Pick("audio", filters=(FormatFilter("abr", ">", 999),))),)) == []


def test_ties(spark):
    rows = [fmt(i, f"t{i}", "avc1", "mp4a", 720) for i in range(3)]
    df = spark.createDataFrame(rows, COLUMNS)
    same = (SortField("res"),)
    assert ids(df, (Pick("any"),), order=same) == ["t2"]
    assert ids(df, (Pick("any", n=1),), order=same) == ["t0"]
    assert ids(df, (Pick("any", worst=True),), order=same) == ["t0"]


def test_sorted_best_first(nine):
    order = [r.format_id for r in ranking.sort_formats(nine, (SortField("res", ascending=True), SortField("abr"))).collect()]
    assert order[:1] == ["c360"] and order[-3:] == ["a256", "a128", "a64"]


def test_string_rank(spark):
    texts = ["", "a", "abcdefgh", "abcdefghi", "é", "日本語文字", "zz"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ranking.string_rank(F.col("t")).alias("r"))
    for r in rows.collect():
        data = r.t.encode()[:8].ljust(8, b"\0")
        assert r.r == float(int.from_bytes(data, "big", signed=True))


def test_heuristic_paths_agree(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for m in range(20):
        for i in range(30):
            pick = lambda *xs: rnd.choice(xs)
            rows.append(fmt(i, f"x{i}", "avc1", "mp4a", pick(None, 720, 1080), pick(None, 1, 2), m, tbr=pick(None, 1.0, 2.0), fps=pick(None, 30.0, 60.0), abr=pick(None, 1.0, 2.0), asr=pick(None, 1, 2), vbr=pick(None, 1.0, 2.0)))
    df = spark.createDataFrame(rows, COLUMNS)

    def fold(rows_, stream, worst):
        strict, loose, last = selection._HEURISTIC[stream]
        best = None
        for r in rows_:
            if best is None:
                best = r
                continue
            cmp = 0
            for c in (*strict, *loose, *last):
                a, b = best[c], r[c]
                if c in loose and (a is None or b is None):
                    continue
                a, b = (-1 if x is None else x for x in (a, b))
                if a != b:
                    cmp = -1 if a < b else 1
                    break
            if cmp > 0 if worst else cmp <= 0:
                best = r
        return best["format_id"]

    for stream in ("any", "video", "audio"):
        for worst in (False, True):
            expected = {m: fold([r for r in rows if r["media_id"] == m], stream, worst) for m in range(20)}
            got = selection.heuristic_best(df, stream, worst, columns=["format_id"])
            assert {r.media_id: r.format_id for r in got.collect()} == expected, (stream, worst)


def test_heuristic_pick_does_not_depend_on_group_size(spark):
    """NaN is a value, numbers above 2**53 stay exact, and 10 000 losers change nothing."""
    nan, big = float("nan"), 9007199254740995
    few = [("a", 1, 720, nan, 30.0, big), ("a", 2, 720, 5.0, 30.0, 1), ("a", 3, 720, None, 30.0, 2)]
    many = [("b", *r[1:]) for r in few] + [("b", 10 + i, 480, 9.0, 60.0, 3) for i in range(10_000)]
    df = spark.createDataFrame(few + many, "media_id string, ordinal long, height int, vbr double, fps double, filesize long")
    got = {r.media_id: (r.ordinal, r.filesize) for r in selection.heuristic_best(df, "video", columns=["ordinal", "filesize"]).collect()}
    assert got["a"] == got["b"]
    one = df.where("ordinal = 1")
    assert {r.filesize for r in selection.heuristic_best(one, "video").collect()} == {big}
