"""Operators on small tables: literal cases, long groups cut into blocks, files written and read."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from mediacat.functions import numbers, text, time, url
from mediacat.operators import archive, dash, hls, net_safety, pages, telemetry
from mediacat.operators.media_filter import Compare, Has, match_any
from mediacat.operators.ordered import Running, explode_range, number_rows, running
from mediacat.operators.playlist import PlaylistSelection, playlist_cutoff
from mediacat.sources import catalog as files


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_running_in_blocks_equals_window(spark):
    rnd = random.Random(3)
    # One key holds most of the rows.
    rows = [("hot" if rnd.random() < 0.8 else f"k{i % 5}", i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    w = Window.partitionBy("k").orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    specs = {f"{k}_{e}": Running(k, F.col("v"), e) for k in kinds for e in (False, True)}
    got = running(df, ["k"], "pos", specs, block=17)
    expected = df.select("*", *[kinds[s.kind]("v").over(before if s.exclusive else upto).alias(n) for n, s in specs.items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(*got.columns).collect()))
    numbered = number_rows(df, ["k"], "pos", "n", 17).select("k", "pos", "n")
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, df.select("k", "pos", F.row_number().over(w)).collect()))


def test_explode_range(spark):
    df = spark.createDataFrame([("a", 2500), ("b", 1), ("c", 0)], "k string, n long")
    got = explode_range(df, F.col("n"), "i").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    assert {tuple(r) for r in got.collect()} == {("a", 2500, 2499), ("b", 1, 0)}


def test_averages_in_blocks(spark):
    rows = [("t", i + 1, float((i * 37) % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, n long, x double")
    got = {r.n: r.e for r in telemetry.linear_average(df, ["k"], "n", "x", "e", block_rows=300).collect()}
    e = None
    for _, n, x in rows:
        e = x if e is None else 0.3 * x + 0.7 * e
        assert abs(got[n] - e) < 1e-9
    tail = telemetry.trailing(df, ["k"], "n", "x", 4, "v", block_rows=10)
    for r in tail.collect():
        assert r.v == [x for _, n, x in rows if r.n - 4 < n <= r.n]


def test_chunk_prefix_over_blocks(spark):
    rows = [("a", i, 10, 10) for i in range(50) if i != 33] + [("b", i, 10, 10 if i != 7 else 3) for i in range(20)] + [("c", 0, 5, 5)]
    df = spark.createDataFrame(rows, "download_id string, chunk_id long, recorded_len long, on_disk_len long")
    got = {r[0]: tuple(r)[1:] for r in telemetry.chunk_prefix(df, block=8).collect()}
    assert got == {"a": (33, 330, 33, 16), "b": (7, 70, 7, 12), "c": (1, 5, None, 0)}


def test_durations_and_sizes(spark):
    assert values(spark, time.parse_duration, "PT1H2M30S", "1:30", "28min 18sec", "893", "x") == [3750.0, 90.0, 1698.0, 893.0, None]
    assert values(spark, numbers.parse_size, "500M", "1.5GiB", "12", "M") == [500_000_000, 1_610_612_736, None, None]
    mb = 1024 * 1024
    sizes = [str(n * mb) for n in (5, 200, 1024, 5 * 1024)]
    assert values(spark, lambda c: numbers.chunk_size(c.cast("long")), *sizes) == [65536, 262144, mb, 8 * mb]


def test_redaction(spark):
    shown = ["https://a:b@host/p?token=secret", "for uri (https://x/?sig=ab(c))", "monkey=1 token=a&token=b"]
    assert values(spark, url.redact, *shown) == [
        "https://*:*@host/p?token=***", "for uri (https://x/?sig=***))", "monkey=1 token=***&token=***"
    ]


def test_private_hosts(spark):
    private = ["127.0.0.1", "10.1.2.3", "192.168.0.9", "169.254.1.1", "[::ffff:127.0.0.1]", "localhost", "a.local", "0x7f.1", "2130706433", "LOCALHOST."]
    public = ["example.com", "8.8.8.8", "192.0.0.9", "[2606:4700::1]", "localhost2.com"]
    assert values(spark, net_safety.private_host, *private) == [True] * len(private)
    assert values(spark, net_safety.private_host, *public) == [False] * len(public)
    assert values(spark, lambda c: net_safety.url_safety(c, max_bytes=8192), "https://x/" + "a" * 9000) == ["too_long"]
    assert values(spark, net_safety.url_safety, "https://x/" + "a" * 9000) == [None]


def test_url_join_keeps_to_the_rules(spark):
    base = F.lit("https://h.example.org/a/b/c?q=1")
    refs = ["../x", "./", "g;x=1/../y", "http://É.org/ü", "//o/x", "mailto:a@b", "#f", "a'b?c'd"]
    assert values(spark, lambda c: url.url_join(base, c), *refs) == [
        "https://h.example.org/a/x", "https://h.example.org/a/b/", "https://h.example.org/a/b/y", "http://%C3%A9.org/%C3%BC",
        "https://o/x", "mailto:a@b", "https://h.example.org/a/b/c?q=1#f", "https://h.example.org/a/b/a'b?c%27d",
    ]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=50), min_size=40, max_size=80))
def test_filenames_are_valid(spark, names):
    names = [n.encode("utf-8", "ignore").decode() for n in names]
    for out in values(spark, text.sanitize_filename, *names):
        assert out and not set('/\\:*?"<>|\0') & set(out) and len(out.encode()) <= 800
        assert out == "unnamed" or out.strip(". ") == out


def test_predicates_on_missing_and_false(spark):
    df = spark.createDataFrame([(1, "", None, False), (2, None, 6000.0, True), (3, "12", 5.0, None)], "i int, title string, duration double, live boolean")
    run = lambda *f: sorted(r.i for r in match_any(df, f).collect())
    assert run((Has("title"),)) == [1, 3]
    assert run((Has("live"),)) == [2] and run((Has("live", negate=True),)) == [1, 3]
    assert run((Compare("duration", ">", 100, missing_ok=True),)) == [1, 2]
    assert run((Compare("title", ">", 9),)) == [3]
    assert run() == [1, 2, 3]


def test_playlist_ranges(spark):
    selection = PlaylistSelection(ranges=((1, 1), (3, 5), (8, 9), (12, None)))
    rows = spark.range(1, 501).where(selection.wants("id")).collect()
    assert [r.id for r in rows] == [i for i in range(1, 501) if i in (1, 3, 4, 5, 8, 9) or i >= 12]
    assert PlaylistSelection(end=7, ranges=((2, 20),)).last_needed() == 7


def test_timeline_and_template(spark):
    entries = spark.createDataFrame([("m", 0, 0, 4000, 2), ("m", 1, None, 2000, 0)], "k string, entry long, t long, d long, r long")
    for block in (None, 1):
        starts = sorted((r.entry, r.start) for r in dash.timeline_starts(entries, ["k"], block=block).collect())
        assert starts == [(0, 0), (1, 12000)]
    mpd = (
        '<MPD type="static"><Period duration="PT40S"><AdaptationSet mimeType="video/mp4"><Representation id="v" bandwidth="1" codecs="avc1">'
        '<SegmentTemplate timescale="1" duration="4" initialization="i.mp4" media="$Number%03d$.m4s"/></Representation></AdaptationSet></Period></MPD>'
    )
    drm = mpd.replace("<Representation", "<ContentProtection/><Representation")
    df = spark.createDataFrame([(1, "https://h/x/m.mpd", mpd), (2, "https://h/m.mpd", drm), (3, "https://h/m.mpd", mpd.replace("static", "dynamic"))], "mpd_id int, url string, text string")
    rows = sorted((r.pos, r.url) for r in dash.dash_segments_template(df).collect())
    assert len(rows) == 11 and rows[0] == (0, "https://h/x/i.mp4") and rows[1] == (1, "https://h/x/001.m4s") and rows[-1][1].endswith("010.m4s")
    assert [r.mpd_id for r in dash.dash_formats(df).collect()] == [1]


@pytest.mark.parametrize("method,status", [("AES-128", "encrypted"), ("SAMPLE-AES", "encrypted"), ("NONE", "ok")])
def test_encryption(spark, method, status):
    body = f"#EXTM3U\r\n#EXT-X-KEY:METHOD={method}\r\n#EXTINF:4,\r\ns.ts\r\n#EXT-X-ENDLIST\r\n"
    df = spark.createDataFrame([(1, "https://h/p.m3u8", body)], "playlist_id int, url string, text string")
    row = hls.expand_playlists(df).collect()[0]
    assert (row.status, row.detail) == (status, None if status == "ok" else method)


def test_page_rules(spark):
    html = (
        '<base href="https://b.example.org/d/"><meta property="og:video:type" content="text/html"><meta property="og:video" content="/v.mp4">'
        '<meta property="og:audio:secure_url" content="x.mp3"><video><source src="q.webm"></video><!-- <source src="no.mp4"> -->'
        '<a href="z&amp;y">l</a>'
    )
    df = spark.createDataFrame([(1, "https://a.example.org/p", html)], "page_id long, url string, html string")
    got = {(r.url, r.source) for r in pages.detect_media(df).collect()}
    assert got == {("https://b.example.org/d/x.mp3", "og:audio"), ("https://b.example.org/d/q.webm", "video>source")}
    assert [r.link for r in pages.page_links(df).collect()] == ["https://a.example.org/z&y"]


def test_cut_pages_ends_at_a_character(spark):
    df = spark.createDataFrame([("aé日b",), ("ab",)], "html string")
    for limit, expected in ((1, "a"), (2, "a"), (3, "aé"), (5, "aé"), (6, "aé日"), (7, "aé日b")):
        assert files.cut_pages(df, limit).collect()[0].html == expected


def test_archive_append_is_idempotent(spark, tmp_path):
    media = spark.createDataFrame([("A", None, "1"), ("b", "Key", "2")], "extractor string, extractor_key string, id string")
    path = str(tmp_path / "archive")
    files.append_archive(media, path)
    files.append_archive(media, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == ["a 1", "key 2"]
    assert archive.not_in_archive(media, files.read_archive(spark, path)).count() == 0


def test_catalog_round_trip(spark, tmp_path):
    lines = ['{"id":"1","title":"t","duration":1.5,"formats":[{"format_id":"f","height":720}],"odd":{"a":[1,2]},"n":null}', "broken", '{"id":"2","title":"u"}']
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(src)
    files.write_catalog(files.read_catalog(spark, src), out)
    again = {r.id: r for r in files.read_catalog(spark, out).select("id", "duration", "formats", F.to_json("extra").alias("extra")).collect()}
    assert again["1"].extra == '{"n":null,"odd":{"a":[1,2]}}' and again["1"].formats[0].height == 720 and again["2"].extra is None
    assert '"uploader"' not in "".join(r.value for r in spark.read.text(out).collect())


def test_nothing_is_capped(spark):
    lines = "".join(f"#EXTINF:4,\ns{i}.ts\n" for i in range(10_001))
    playlist = spark.createDataFrame([(1, "http://h.example/p.m3u8", "#EXTM3U\n" + lines + "#EXT-X-ENDLIST\n")], "playlist_id int, url string, text string")
    assert hls.hls_segments(playlist).count() == 10_001
    entries = spark.createDataFrame([(1, 1 + i // 10, 1 + i % 10) for i in range(2000)], "playlist_id int, page long, pos long")
    listed = spark.createDataFrame([(1, p, True) for p in range(1, 201)], "playlist_id int, page long, has_more boolean")
    assert playlist_cutoff(entries, listed).count() == 2000 and playlist_cutoff(entries, listed, cap=15).count() == 15
    names = ["n" * 210 + "a", "n" * 210 + "b"]
    assert values(spark, text.sanitize_filename, *names) == names


def test_missing_page_stops_a_list(spark):
    entries = spark.createDataFrame([(1, p, 1) for p in (1, 2, 4, 5)], "playlist_id int, page long, pos long")
    listed = spark.createDataFrame([(1, p, True) for p in (1, 2, 4, 5)], "playlist_id int, page long, has_more boolean")
    assert sorted(r.page for r in playlist_cutoff(entries, listed).collect()) == [1, 2]


def test_classify_ip_with_a_hot_block(spark, monkeypatch):
    """Nine of ten addresses in one block: broadcast blocks and salted addresses agree."""
    df = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.lit(10 << 24) + F.col("id")).otherwise(F.col("id") * 2_000_003).alias("ip"))
    blocks = net_safety.blocks_table(spark)
    run = lambda: sorted(map(str, net_safety.classify_ip(df, blocks).collect()))
    small = run()
    monkeypatch.setattr(net_safety, "BROADCAST_BLOCKS", 0)
    assert run() == small and sum("10.0.0.0/8" in x for x in small) >= 1800
