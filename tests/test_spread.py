"""Work a row and how it is dealt to tasks: cookies, manifests, URLs, listings."""

from pyspark.sql import functions as F

from mediacat.functions.conditions import fixed, lowered
from mediacat.functions.url import url_join
from mediacat.operators.catalog import codec, format_listing
from mediacat.operators.cookies import match_cookies
from mediacat.operators.dash import representations
from mediacat.operators.ranking import AUDIO_TIERS, codec_tier, string_rank
from mediacat.plans.views import SCAN_PARTITIONS, view


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_cookies_of_one_path_are_shared_out(spark):
    urls = [(i % 7, f"http{'s' * (i % 2)}://a.example.com/x/{i % 3}") for i in range(40)] + [(None, None), (1, "https://10.0.0.1/x")]
    jar = [(".Example.com", f"n{i}", "v", "/", i % 2 == 0) for i in range(40)] + [("example.com", "n1", "v", "/x", None), ("0.0.1", "no", "v", "/", False)]
    u = spark.createDataFrame(urls, "url_id long, url string")
    c = spark.createDataFrame(jar, "domain string, name string, value string, path string, secure boolean")
    found = match_cookies(u, c)
    assert "_share" in _plan(found)
    want = [(i, url, n) for i, url in urls if url and "example" in url for _, n, _, p, s in jar[:41] if (p == "/" or url.split("/")[3] == "x") and (s is False or url.startswith("https:"))]
    assert sorted((r.url_id, r.url, r.name) for r in found.collect()) == sorted(want)


def test_manifests_are_walked_in_their_row(spark):
    adapt = '<AdaptationSet mimeType="video/mp4">{}</AdaptationSet>'
    text = (
        '<MPD type="static"><BaseURL>b/</BaseURL><Period duration="PT5S"><BaseURL>one/</BaseURL>'
        + adapt.format('<ContentProtection schemeIdUri="x"/><Representation id="no"/>')
        + adapt.format('<Representation id="p"><ContentProtection schemeIdUri="x"/></Representation><Representation id="v" frameRate="25"><BaseURL>../c/</BaseURL></Representation>')
        + "</Period><Period/><Period>" + adapt.format("") + adapt.format('<Representation id="w"/>') + "</Period></MPD>"
    )
    rows = [(1, "https://h/m.mpd", text), (2, "https://h/m.mpd", text.replace("static", "dynamic")), (3, "https://h/m.mpd", None), (4, "https://h/m.mpd", "<MPD/>")]
    found = representations(spark.createDataFrame(rows, "mpd_id long, url string, text string"))
    assert _plan(found).count("Generate ") == 1
    got = [(r.mpd_id, r.period, r.adapt, r.repr, r.repr_id, r.base_url, r.period_start, r.period_seconds, r.fps) for r in found.collect()]
    assert got[0] == (1, 0, 1, 1, "v", "https://h/b/c/", 0.0, 5.0, 25.0)
    assert [g[:2] + g[4:6] for g in got[1:]] == [(1, 2, "w", "https://h/b/")]


def test_manifests_are_dealt_without_a_local_session(spark, sf_dir):
    before = spark.conf.get(SCAN_PARTITIONS)
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        assert all("Repartition" in _plan(view(spark, sf_dir, n)) for n in ("mpd_text", "mpd_periods", "hls_text", "hls_masters"))
    finally:
        spark.conf.set(SCAN_PARTITIONS, before)


def test_joined_urls_match_each_part_once(spark):
    base = "HTTPS://Us:er@Host.Org/a/b/c?q=1#f"
    want = {
        "x.mp4": "https://Us:er@Host.Org/a/b/x.mp4", " ../x ": "https://Us:er@Host.Org/a/x", "": None, "?k='v'": "https://Us:er@Host.Org/a/b/c?k=%27v%27",
        "#g": "https://Us:er@Host.Org/a/b/c?q=1#g", "/r/{i}^": "https://Us:er@Host.Org/r/%7Bi%7D%5E", "HTTP://Other.ORG": "http://other.org/",
        "//o/x": "https://o/x", "mailto:x": "mailto:x", "data:x": None, "a b\u00e9": "https://Us:er@Host.Org/a/b/a%20b%C3%A9", "x://": "https://Us:er@Host.Org/",
    }
    rows = spark.createDataFrame([(base, r) for r in want], "b string, r string")
    joined = rows.select("r", url_join("b", "r").alias("u"))
    plan = _plan(joined)
    assert plan.count("RLIKE") + plan.count("regexp_") < 30
    del want["x://"]  # its parts are only said to be text
    assert {r.r: r.u for r in joined.collect() if r.r in want} == want
    assert spark.createDataFrame([(None, "x"), ("no url", "x"), (base, None)], "b string, r string").select(url_join("b", "r").alias("u")).where("u is not null").count() == 0


def test_case_and_codecs(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "none", "NoNe", "none ", "avc1", "\u0130A", None, "a-z")], "c string")
    got = [tuple(r) for r in rows.select(codec("c"), lowered(F.col("c")).eqNullSafe(F.lower("c"))).collect()]
    assert got == [(None, True), (None, True), (None, True), ("none ", True), ("avc1", True), ("\u0130A", True), (None, True), ("a-z", True)]


def test_listing_names_repeated_values_once(spark):
    rows = spark.createDataFrame([(x,) for x in (1.15, 0.5, 1.5, 2.5, -0.25, 1e6, None)], "v double")
    got = [tuple(r) for r in rows.select(fixed(F.col("v"), 1), fixed(F.col("v"), 0)).collect()]
    assert got == [("1.1", "1"), ("0.5", "0"), ("1.5", "2"), ("2.5", "2"), ("-0.2", "-0"), ("1000000.0", "1000000"), (None, None)]
    table = "media_id long, ordinal long, format_note string, fps double, width int, height int, protocol string, url string, ext string, duration double, filesize long, filesize_approx long, vcodec string, acodec string, has_drm boolean, abr double, vbr double, dynamic_range string, language string"
    assert _plan(format_listing(spark.createDataFrame([], table))).count("1048576.0") < 60


def test_rank_keys_name_their_text_once(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "a", "mp4a", "é", None)], "c string")
    ranked = rows.select(string_rank(F.col("c")).alias("r"), codec_tier(F.col("c"), AUDIO_TIERS).alias("t"))
    assert _plan(ranked).count("c#") < 12
    assert [tuple(r) for r in ranked.collect()] == [(0.0, 0), (float(97 << 56), 0), (float(int.from_bytes(b"mp4a\0\0\0\0")), 6), (float(0xC3A9 - (1 << 16) << 48), 0), (None, None)]
