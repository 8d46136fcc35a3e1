"""Periods of DASH manifests: starts and lengths that are stated, worked out from neighbours, or unknown."""

import pytest
from pyspark.sql import functions as F

from mediacat.operators import dash

TEMPLATE = '<SegmentTemplate timescale="2" duration="8" startNumber="5" initialization="i-$Bandwidth$.mp4" media="$RepresentationID$-$Number$.m4s"/>'


def mpd(*periods, attributes=""):
    return f'<MPD type="static" {attributes}>' + "".join(f"<Period {a}>{body}</Period>" for a, body in periods) + "</MPD>"


def video(inner="", rep=""):
    return f'<AdaptationSet mimeType="video/mp4">{inner}<Representation id="v" bandwidth="9">{rep}</Representation></AdaptationSet>'


def frame(spark, *texts):
    return spark.createDataFrame([(i, "https://h/x/m.mpd", x) for i, x in enumerate(texts)], "mpd_id int, url string, text string")


@pytest.mark.parametrize(
    ("starts", "lengths", "total", "expected"),
    [
        ([None], [None], None, [(0.0, 0.0)]),
        ([None], [None], 40.0, [(0.0, 40.0)]),
        ([None, 20.0], [None, None], 50.0, [(0.0, 20.0), (20.0, 30.0)]),
        ([None, None, None], [10.0, 5.0, None], 18.0, [(0.0, 10.0), (10.0, 5.0), (15.0, 3.0)]),
        ([None, None, 30.0], [None, 4.0, None], None, [(0.0, 0.0), (None, 4.0), (30.0, 0.0)]),
        ([5.0, None], [10.0, None], 12.0, [(5.0, 10.0), (15.0, 0.0)]),
        ([None, 8.0], [10.0, 2.0], 99.0, [(0.0, 10.0), (8.0, 2.0)]),
    ],
)
def test_starts_and_lengths(spark, starts, lengths, total, expected):
    df = spark.createDataFrame([(starts, lengths, total)], "s array<double>, d array<double>, total double")
    timed = df.withColumn("at", dash.period_starts(F.col("s"), F.col("d"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("s") - 1)))
    rows = timed.select("i", F.get("at", F.col("i")), dash.period_seconds(F.col("at"), F.col("d"), F.col("total"), F.col("i"))).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == expected


def test_two_periods_without_lengths(spark):
    body = video(TEMPLATE)
    df = frame(spark, mpd(("", body), ('start="PT9S"', body), attributes='mediaPresentationDuration="PT14S"'))
    rows = dash.dash_segments_template(df).orderBy("period", "pos").collect()
    assert [(r.period, r.pos, r.url.rsplit("/", 1)[1], r.duration, r.start) for r in rows] == [
        (0, 0, "i-9.mp4", None, None), (0, 1, "v-5.m4s", 4.0, 0.0), (0, 2, "v-6.m4s", 4.0, 4.0), (0, 3, "v-7.m4s", 4.0, 8.0),
        (1, 0, "i-9.mp4", None, None), (1, 1, "v-5.m4s", 4.0, 9.0), (1, 2, "v-6.m4s", 4.0, 13.0),
    ]


def test_levels_of_base_urls_and_templates(spark):
    inner = '<SegmentTemplate timescale="1" duration="5" media="own.m4s"/>'
    text = mpd(
        ('duration="PT5S"', f"<BaseURL>p/</BaseURL>{TEMPLATE}{video()}"),
        ('duration="PT5S"', f"{TEMPLATE}{video('<BaseURL>/a/</BaseURL>' + inner, '<BaseURL>r/</BaseURL>')}"),
        ('duration="PT5S"', f"<BaseURL>https://other/</BaseURL>{video(TEMPLATE, inner)}"),
    ).replace('type="static" >', 'type="static"><BaseURL>m/</BaseURL>')
    urls = {(r.period, r.pos): r.url for r in dash.dash_segments_template(frame(spark, text)).collect()}
    assert urls == {
        (0, 0): "https://h/x/m/p/i-9.mp4", (0, 1): "https://h/x/m/p/v-5.m4s", (0, 2): "https://h/x/m/p/v-6.m4s",
        (1, 0): "https://h/a/r/own.m4s", (2, 0): "https://other/own.m4s",
    }


def test_timeline_times_are_the_presentations(spark):
    line = '<SegmentTemplate timescale="10" presentationTimeOffset="100" initialization="i.mp4" media="$Time$"><SegmentTimeline><S t="120" d="10" r="1"/><S d="5"/></SegmentTimeline></SegmentTemplate>'
    empty = '<SegmentTemplate timescale="10" initialization="i.mp4" media="$Time$"><SegmentTimeline/></SegmentTemplate>'
    df = frame(spark, mpd(('duration="PT7S"', video(empty)), ("", video(line))), mpd(("", ""), ("", "<AdaptationSet/>")), "<MPD/>", None, "no manifest")
    rows = dash.dash_segments_timeline(df).orderBy("period", "pos").collect()
    assert [(r.period, r.pos, r.url.rsplit("/", 1)[1], r.duration, r.start) for r in rows] == [
        (0, 0, "i.mp4", None, None), (1, 0, "i.mp4", None, None), (1, 1, "120", 1.0, 9.0), (1, 2, "130", 1.0, 10.0), (1, 3, "140", 0.5, 11.0)
    ]
    assert {r.period for r in dash.dash_formats(df).collect()} == {0, 1}


def test_cap_is_for_each_period(spark):
    two = f'<AdaptationSet mimeType="video/mp4">{TEMPLATE}<Representation id="a" bandwidth="1"/><Representation id="b" bandwidth="2"/></AdaptationSet>'
    df = frame(spark, mpd(('duration="PT8S"', two), ('duration="PT8S"', two)))
    assert sorted((r.period, r.format_id) for r in dash.dash_formats(df, cap=1).collect()) == [(0, "b"), (1, "b")]
    assert dash.dash_formats(df).count() == 4


def test_names_are_resolved_once_for_a_representation(spark):
    names = ["n-$Number%03d$-$RepresentationID$.m4s", "$Number$-$Number%2d$", "../$Number$/x", "$Number$:x", "one.mp4", "a $Number$", "$$$Number$", "$Time$-$Number$", ".$Number$"]
    body = '<SegmentTemplate timescale="1" duration="4" startNumber="-1" initialization="i-$Number%2d$" media="{}"/>'
    df = frame(spark, *[mpd(('duration="PT9S"', video(body.format(n)))) for n in names])
    found = dash.dash_segments_template(df)
    assert "AS pattern" in found._jdf.queryExecution().optimizedPlan().toString()
    urls = {(r.mpd_id, r.pos): r.url.removeprefix("https://h/") for r in found.collect()}
    assert [urls[i, 0] for i in range(len(names))] == ["x/i-00"] * len(names)
    assert [urls[i, 1] for i in range(len(names))] == ["x/n-0-1-v.m4s", "x/-1--1", "-1/x", "x/-1:x", "x/one.mp4", "x/a%20-1", "x/$-1", "x/0--1", "x/.-1"]
    assert [urls[i, 3] for i in range(len(names))] == ["x/n-001-v.m4s", "x/1-01", "1/x", "x/1:x", "x/one.mp4", "x/a%201", "x/$1", "x/0-1", "x/.1"]


def test_times_are_put_into_names_resolved_before(spark):
    line = '<SegmentTemplate timescale="1" media="{}"><SegmentTimeline><S t="5" d="10" r="1"/><S/></SegmentTimeline></SegmentTemplate>'
    df = frame(spark, *[mpd(('duration="PT9S"', video(line.format(n)))) for n in ("t-$Time%04d$.m4s", "$Number$/$Time$", "$Time$?$Time$")])
    found = dash.dash_segments_timeline(df)
    assert "AS pattern" in found._jdf.queryExecution().optimizedPlan().toString()
    urls = {(r.mpd_id, r.pos): r.url.removeprefix("https://h/x/") for r in found.collect()}
    assert [[urls[i, k] for k in range(3)] for i in range(3)] == [["t-0005.m4s", "t-0015.m4s", "t-.m4s"], ["0/5", "0/15", "0/"], ["5?5", "15?15", "m.mpd?"]]
