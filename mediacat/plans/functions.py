"""Queries of the Column functions, over texts made of whole table columns."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.functions import codecs, html, naming, numbers, text, time, url
from mediacat.functions.conditions import fixed
from mediacat.functions.naming import Field, Ref, field
from mediacat.operators.dash import fill_segment_template
from mediacat.plans.registry import query

S = F.lit


def _s(c):
    return F.col(c).cast("string")


# --- time -----------------------------------------------------------------------------------------------------


@query(
    "I1_parse_iso_duration",
    """select event_id, case event_id % 4 when 0 then (event_id % 30) * 3600.0::double + event_id % 60 * 60 + event_id % 61
         when 1 then event_id % 60 * 60.0::double when 2 then (event_id % 61)::double + 0.5 end as seconds from events""",
)
def _(t):
    e = F.col("event_id")
    h, m, s = (e % 30).cast("string"), (e % 60).cast("string"), (e % 61).cast("string")
    iso = (
        F.when(e % 4 == 0, F.concat(S("P3DT"), h, S("H"), m, S("M"), s, S("S")))
        .when(e % 4 == 1, F.concat(S("PT"), m, S("M")))
        .when(e % 4 == 2, F.concat(S("PT"), s, S(".5S")))
        .otherwise(F.concat(S("P"), h))
    )
    return t.events.select("event_id", time.parse_iso_duration(iso).alias("seconds"))


@query(
    "I2_parse_duration",
    """select event_id, case event_id % 6 when 0 then (event_id % 90) * 60.0::double when 1 then event_id % 9 * 60.0::double + event_id % 60
         when 2 then event_id % 30 * 3600.0::double + 65 when 3 then event_id % 50 * 60.0::double + 18
         when 4 then (event_id % 5000)::double end as seconds from events""",
)
def _(t):
    e = F.col("event_id")
    n = lambda k: (e % k).cast("string")
    shown = (
        F.when(e % 6 == 0, F.concat(S(" PT"), n(90), S("M ")))
        .when(e % 6 == 1, F.concat(n(9), S(":"), n(60)))
        .when(e % 6 == 2, F.concat(n(30), S(":1:5")))
        .when(e % 6 == 3, F.concat(n(50), S("min 18sec")))
        .when(e % 6 == 4, n(5000))
        .otherwise(F.concat(n(7), S(":a")))
    )
    return t.events.select("event_id", time.parse_duration(shown).alias("seconds"))


@query(
    "I3_parse_text_duration",
    """select event_id, nullif(case event_id % 4 when 0 then event_id % 5 * 3600.0::double + event_id % 60 * 60 + 5
         when 1 then event_id % 60 * 60.0::double when 2 then (event_id % 61)::double end, 0) as seconds from events""",
)
def _(t):
    e = F.col("event_id")
    n = lambda k: (e % k).cast("string")
    shown = (
        F.when(e % 4 == 0, F.concat(n(5), S("h "), n(60), S("min 5sec")))
        .when(e % 4 == 1, F.concat(n(60), S(" Minutes")))
        .when(e % 4 == 2, F.concat(S("about "), n(61), S("sec")))
        .otherwise(S("soon"))
    )
    return t.events.select("event_id", time.parse_text_duration(shown).alias("seconds"))


@query(
    "I5_parse_iso_date",
    """select o_orderkey, case when o_orderkey % 3 < 2 then strftime(o_orderdate, '%Y%m%d') end as day from orders""",
)
def _(t):
    k = F.col("o_orderkey")
    shown = (
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    )
    return t.orders.select("o_orderkey", time.parse_iso_date(shown).alias("day"))


_DATES = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss '+0200'", "d/M/yyyy", "yyyy/MM/dd", "MMMM d, yyyy",
          "MMM d yyyy 'at' HH:mm", "d MMM yyyy HH:mm:ss", "yyyyMMdd", "d-MMM-yyyy", "HH:mm d-MMM-yyyy", "'no date'")


@query(
    "I6_unified_timestamp",
    """select event_id, case event_id % 11 when 0 then s when 1 then s - 7200 when 5 then s // 60 * 60 when 6 then s
         when 9 then s // 60 * 60 when 10 then null else s // 86400 * 86400 end as epoch,
         case when event_id % 11 = 10 then null when event_id % 11 = 1
           then strftime(make_timestamp((s - 7200) * 1000000), '%Y%m%d') else strftime(ts, '%Y%m%d') end as day
       from (select *, epoch_us(ts) // 1000000 as s from events)""",
)
def _(t):
    e, shown = F.col("event_id"), None
    for i, pattern in enumerate(_DATES):
        value = F.date_format("ts", pattern)
        shown = F.when(e % 11 == i, value) if shown is None else shown.when(e % 11 == i, value)
    return t.events.select(
        "event_id", time.unified_timestamp(shown).alias("epoch"), time.unified_strdate(shown).alias("day")
    )


@query(
    "I12_format_duration",
    """select o_orderkey, case when s >= 3600 then s // 3600 || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' ||
         lpad((s % 60)::varchar, 2, '0') else s // 60 || ':' || lpad((s % 60)::varchar, 2, '0') end as shown
       from (select o_orderkey, floor(o_totalprice / 40)::bigint as s from orders)""",
)
def _(t):
    return t.orders.select("o_orderkey", time.format_duration(F.col("o_totalprice") / 40).alias("shown"))


# --- numbers --------------------------------------------------------------------------------------------------


@query(
    "I4_parse_human_count",
    """select o_orderkey, case o_orderkey % 5 when 0 then o_custkey + 1000000 when 1 then (o_orderkey % 100 + 0.5) * 1000
         when 2 then o_orderkey % 9 * 1000000 when 3 then o_orderkey % 3 * 1000000000 end::bigint as n from orders""",
)
def _(t):
    k = F.col("o_orderkey")
    shown = (
        F.when(k % 5 == 0, F.concat(F.format_number(F.col("o_custkey") + 1_000_000, 0), S(" views")))
        .when(k % 5 == 1, F.concat((k % 100).cast("string"), S(".5K")))
        .when(k % 5 == 2, F.concat((k % 9).cast("string"), S("M Views")))
        .when(k % 5 == 3, F.concat(S(" "), (k % 3).cast("string"), S("b")))
        .otherwise(S("many"))
    )
    return t.orders.select("o_orderkey", numbers.parse_human_count(shown).alias("n"))


@query(
    "I7_parse_size",
    """select o_orderkey, case o_orderkey % 5 when 0 then o_custkey * 1000000 when 1 then (o_custkey + 0.5) * 1073741824
         when 2 then o_custkey * 1000 when 3 then o_custkey * 1099511627776 end::bigint as bytes from orders""",
)
def _(t):
    k, c = F.col("o_orderkey"), _s("o_custkey")
    shown = (
        F.when(k % 5 == 0, F.concat(c, S("M")))
        .when(k % 5 == 1, F.concat(c, S(".5GiB")))
        .when(k % 5 == 2, F.concat(c, S("kB")))
        .when(k % 5 == 3, F.concat(c, S("Ti")))
        .otherwise(F.concat(c, S("Mb")))
    )
    return t.orders.select("o_orderkey", numbers.parse_size(shown).alias("bytes"))


@query(
    "I8_parse_filter_number",
    """select o_orderkey, case o_orderkey % 6 when 0 then o_totalprice when 1 then o_custkey * 1000.0::double
         when 2 then o_custkey::double when 3 then o_custkey % 9 * 60.0::double + 5 when 4 then o_custkey % 9 * 3600.0::double + 125
         end as n from orders""",
)
def _(t):
    k, c, c9 = F.col("o_orderkey"), _s("o_custkey"), (F.col("o_custkey") % 9).cast("string")
    shown = (
        F.when(k % 6 == 0, _s("o_totalprice"))
        .when(k % 6 == 1, F.concat(c, S("k")))
        .when(k % 6 == 2, F.concat(c, S("B")))
        .when(k % 6 == 3, F.concat(c9, S(":05")))
        .when(k % 6 == 4, F.concat(c9, S(":02:05")))
        .otherwise(S("x"))
    )
    return t.orders.select("o_orderkey", numbers.parse_filter_number(shown).alias("n"))


@query(
    "I9_heights_and_widths",
    """select o_orderkey, case when o_orderkey % 3 < 2 then o_custkey end as height, o_custkey as from_url,
         case o_custkey when 240 then 426 when 360 then 640 when 480 then 854 when 720 then 1280 when 1080 then 1920
           when 1440 then 2560 when 2160 then 3840 else o_custkey * 16 // 9 end as width from orders""",
)
def _(t):
    k, c = F.col("o_orderkey"), _s("o_custkey")
    shown = F.concat(c, F.when(k % 3 == 0, "p").when(k % 3 == 1, "").otherwise("i"))
    link = F.concat(S("https://x.example.org/v_"), c, S("P_4000K.mp4?q=12p"))
    return t.orders.select(
        "o_orderkey",
        numbers.parse_height(shown).alias("height"),
        numbers.height_from_url(link).alias("from_url"),
        numbers.width_from_height("o_custkey").alias("width"),
    )


@query(
    "I10_rates",
    """select o_orderkey, case o_orderkey % 4 when 0 then (o_custkey * 1000) / 1001.0::double when 1 then o_custkey::double
         when 2 then null end as fps, case when o_orderkey % 4 < 3 then o_custkey + 8000 end as asr from orders""",
)
def _(t):
    k, c = F.col("o_orderkey"), _s("o_custkey")
    rate = F.when(k % 4 == 0, F.concat(c, S("000/1001"))).when(k % 4 == 1, F.concat(S(" "), c)).when(k % 4 == 2, F.concat(c, S("/0")))
    sampling = F.when(k % 4 < 3, F.concat((F.col("o_custkey") + 8000).cast("string"), S(" 44100"))).otherwise(S("high"))
    return t.orders.select(
        "o_orderkey", numbers.parse_frame_rate(rate).alias("fps"), numbers.parse_sampling_rate(sampling).alias("asr")
    )


@query(
    "I11_format_filesize",
    """select l_orderkey, l_linenumber, l_partkey, n,
         case when n >= 1073741824 then printf('%.1f GiB', n / 1073741824.0::double) when n >= 1048576 then printf('%.1f MiB', n / 1048576.0::double)
           when n >= 1024 then printf('%.1f KiB', n / 1024.0::double) else n || ' B' end as shown,
         case when n >= 1000000000 then printf('%.1f GB', n / 1e9) when n >= 1000000 then printf('%.1f MB', n / 1e6)
           when n >= 1000 then printf('%.1f KB', n / 1e3) else n || ' B' end as shown_decimal
       from (select *, case l_linenumber % 4 when 0 then floor(l_extendedprice * 100)::bigint * 1000 when 1 then l_partkey
               when 2 then floor(l_extendedprice)::bigint * 50 else floor(l_extendedprice)::bigint * 256 end as n from lineitem)""",
)
def _(t):
    k, price = F.col("l_linenumber"), F.col("l_extendedprice")
    n = (
        F.when(k % 4 == 0, F.floor(price * 100) * 1000)
        .when(k % 4 == 1, F.col("l_partkey"))
        .when(k % 4 == 2, F.floor(price) * 50)
        .otherwise(F.floor(price) * 256)
    )
    sized = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n"))
    return sized.withColumns(
        {"shown": numbers.format_filesize("n"), "shown_decimal": numbers.format_filesize_decimal("n")}
    )


@query(
    "I37_chunk_size",
    """select o_orderkey, least(greatest(pow(2, ceil(log2(greatest(least(n // 1024, 8388608), 65536))))::bigint, 65536), 8388608) as chunk
       from (select o_orderkey, floor(o_totalprice)::bigint * (o_custkey + 1) * 64 as n from orders)""",
)
def _(t):
    n = F.floor("o_totalprice") * (F.col("o_custkey") + 1) * 64
    return t.orders.select("o_orderkey", numbers.chunk_size(n).alias("chunk"))


# --- text and HTML --------------------------------------------------------------------------------------------

_ENTITIES = ("&amp;", "&lt;", "&quot;", "&#39;", "&#x41;", "&eacute;", "&nbsp;", "&bogus;", "&copy", "&#8364;", "& ", "&amp;amp;")
_DECODED = ("&", "<", '"', "'", "A", "é", html5["nbsp;"], "&bogus;", "&copy", "€", "& ", "&amp;")


def _cases_sql(key: str, values) -> str:
    whens = " ".join(f"when {i} then '" + v.replace("'", "''") + "'" for i, v in enumerate(values))
    return f"case {key} {whens} end"


@query(
    "I13_decode_html_entities",
    f"select doc_id, left(text, 0) || {_cases_sql('doc_id % 12', _DECODED)} || replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as decoded from documents",
)
def _(t):
    prefix = None
    for i, e in enumerate(_ENTITIES):
        prefix = F.when(F.col("doc_id") % 12 == i, S(e)) if prefix is None else prefix.when(F.col("doc_id") % 12 == i, S(e))
    return t.documents.select("doc_id", html.decode_html_entities(F.concat(prefix, "text")).alias("decoded"))


@query(
    "I14_repair_url_entities",
    """select page_id, url || case page_id % 5 when 4 then '&amp=1' else '&b=2&lt;c' end as repaired from pages""",
)
def _(t):
    forms = F.array(*[S(x) for x in ("&amp;b=2&lt;c", "&#038;b=2&lt;c", "&#x26;b=2&lt;c", "&AMP;b=2&lt;c", "&amp=1")])
    shown = F.concat("url", F.get(forms, F.col("page_id") % 5))
    return t.pages.select("page_id", html.repair_url_entities(shown).alias("repaired"))


@query(
    "I15_clean_html",
    r"""select page_id, left(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), 200) as short,
         length(regexp_replace(html, '<[^>]+>', '', 'g')) as length from pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        html.clean_html_tags("html", 200).alias("short"),
        F.length(html.clean_html_tags("html")).cast("long").alias("length"),
    )


@query(
    "I15_clean_html_text",
    r"""select page_id, trim(regexp_replace(array_to_string(list_transform(string_split(html, '<'),
         lambda p: case when contains(p, '>') then substr(p, position('>' in p) + 1) else p end), ''), '[\s\x{00a0}]+', ' ', 'g')) as cleaned
       from pages""",
)
def _(t):
    return t.pages.select("page_id", html.clean_html_text("html").alias("cleaned"))


@query("I16_truncate_chars", "select doc_id, left(text, 120) as short from documents")
def _(t):
    return t.documents.select("doc_id", text.truncate_chars("text", 120).alias("short"))


@query(
    "I28_controls",
    """select doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]', '', 'g') || 'x' as stripped,
         regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '_', 'g') || '_' || chr(8238) || 'x' as line
       from documents""",
)
def _(t):
    shown = F.concat("text", S("\x1b\u202ex"))
    return t.documents.select("doc_id", text.strip_controls(shown).alias("stripped"), text.sanitize_line(shown).alias("line"))


_NAMES = ("CON", "a/b:c", "  .dots. ", "nul.txt", "", "x.mediacat-part", "clip " + "y" * 210 + ".webm")
_SAFE = ("_CON", "a_b_c", "dots", "_nul.txt", "unnamed", "x_mediacat-part", "clip " + "y" * 190 + ".webm")


@query(
    "I29_sanitize_filename",
    f"""select o_orderkey, case when o_orderkey % 8 < 7 then {_cases_sql('o_orderkey % 8', _SAFE)}
         else o_orderpriority || ' _' || o_custkey || '_' end as name from orders""",
)
def _(t):
    k = F.col("o_orderkey") % 8
    names = F.array(*[S(n) for n in _NAMES], F.concat("o_orderpriority", S(" ?"), _s("o_custkey"), S("|.")))
    return t.orders.select("o_orderkey", text.sanitize_filename(F.get(names, k), max_bytes=200).alias("name"))


@query(
    "I33_subtitle_filename",
    "select media_id, ordinal, 'clip ' || media_id || '.' || language || '.' || ext as name from {subtitle_tracks}",
)
def _(t):
    stem = F.concat(S("clip "), _s("media_id"))
    return t.subtitle_tracks.select("media_id", "ordinal", text.subtitle_filename(stem, "language", "ext").alias("name"))


@query(
    "I34_archive_key",
    "select media_id, lower(extractor) || ' ' || id || '_X' as key from {media}",
)
def _(t):
    return t.media.select("media_id", text.archive_key("extractor", F.concat("id", S("\nX"))).alias("key"))


@query(
    "I35_sniff_image",
    """select p_partkey, case p_partkey % 8 when 0 then 'jpeg' when 1 then 'png' when 2 then 'gif' when 3 then 'bmp' when 4 then 'tiff'
         when 5 then 'webp' end as kind from part""",
)
def _(t):
    heads = ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "424D0102030400000000", "4D4D002A", "52494646000000005745425000",
             "52494646000000005741564500", "424D0102030400000001")
    head = F.get(F.array(*[S(h) for h in heads]), F.col("p_partkey") % 8)
    data = F.unhex(F.concat(head, F.hex(F.encode("p_name", "UTF-8"))))
    return t.part.select("p_partkey", codecs.sniff_image(data).alias("kind"))


# --- URLs -----------------------------------------------------------------------------------------------------

_ORIGIN = r"regexp_extract(url, '^(https?://[^/]+)', 1)"
_DIR = r"regexp_extract(url, '^(https?://[^?#]*/)', 1)"


@query(
    "I17_url_join",
    f"""select page_id, {_ORIGIN} || '/a/b.mp4?x=1' as absolute_path, {_DIR} || 'b%20c.mp4#t' as relative,
         {_ORIGIN} || '/y/z' as dotted, 'https://cdn.example.net/x' as scheme_relative,
         regexp_extract(url, '^([^?#]*)', 1) || '?q=2' as query_only, cast(null as varchar) as none,
         'http://example.org/' as absolute from pages""",
)
def _(t):
    u = F.col("url")
    return t.pages.select(
        "page_id",
        url.url_join(u, S("/a/b.mp4?x=1")).alias("absolute_path"),
        url.url_join(u, S("  b c.mp4#t ")).alias("relative"),
        url.url_join(u, S("/x/../y/./z")).alias("dotted"),
        url.url_join(u, S("//cdn.example.net/x")).alias("scheme_relative"),
        url.url_join(u, S("?q=2")).alias("query_only"),
        F.coalesce(url.url_join(u, S("javascript:void(0)")), url.url_join(u, S("data:x")), url.url_join(u, S(" "))).alias("none"),
        url.url_join(u, S("HTTP://Example.ORG")).alias("absolute"),
    )


_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(
    "I18_ext_from_url",
    f"""select url_id, case when e in ('mp4', 'webm', 'mkv', 'm3u8') then e end as media_ext, nullif(e, '') as any_ext
        from (select url_id, lower(regexp_extract({_PATH}, '\\.([^./]+)$', 1)) as e from {{urls}})""",
)
def _(t):
    return t.urls.select("url_id", url.media_ext_from_url("url").alias("media_ext"), url.ext_from_url("url").alias("any_ext"))


@query(
    "I19_url_parts",
    r"""select url_id, regexp_extract(url, '^([^?#]*)', 1) as normalized,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
         case when starts_with(url, 'http') then regexp_extract(url, '^https?://([^/]*)', 1) end as cdn_host from {urls}""",
)
def _(t):
    return t.urls.select(
        "url_id", url.normalize_url("url").alias("normalized"), url.url_path("url").alias("path"), url.cdn_host("url").alias("cdn_host")
    )


@query(
    "I20_protocol_for_url",
    r"""select url_id, case when contains(url, '.m3u8') then 'm3u8' else regexp_extract(url, '^([a-z]+):', 1) end as protocol from {urls}""",
)
def _(t):
    return t.urls.select("url_id", url.protocol_for_url("url").alias("protocol"))


_MIMES = ("video/mp4", "Video/WebM; codecs=vp9", "application/x-mpegURL", "application/dash+xml", "text/html; charset=utf-8", "audio/mpeg",
          "video/unknown", "application/xhtml+xml", "text/html; profile=mp2t")
_MIME_EXT = ("mp4", "webm", "m3u8", "mpd", "", "mp3", "", "", "")


@query(
    "I21_ext_from_mime",
    f"select p_partkey, nullif({_cases_sql('p_partkey % 9', _MIME_EXT)}, '') as ext from part",
)
def _(t):
    mime = F.get(F.array(*[S(m) for m in _MIMES]), F.col("p_partkey") % 9)
    return t.part.select("p_partkey", url.ext_from_mime(mime).alias("ext"))


@query(
    "C12_is_media_type",
    """select p_partkey, p_partkey % 9 in (0, 1, 2, 3, 5, 6) as media, p_partkey % 9 in (4, 7, 8) as html,
         case p_partkey % 9 when 2 then 'm3u8' when 3 then 'mpd' end as manifest, p_partkey % 2 = 0 as media_ext from part""",
)
def _(t):
    mime = F.get(F.array(*[S(m) for m in _MIMES]), F.col("p_partkey") % 9)
    link = F.concat(S("https://x.example.org/"), _s("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".MKV?x=.jpg").otherwise(".jpg?x=.mp4"))
    return t.part.select(
        "p_partkey",
        url.is_media_content_type(mime).alias("media"),
        url.is_html_content_type(mime).alias("html"),
        url.manifest_ext(mime).alias("manifest"),
        url.has_media_extension(link).alias("media_ext"),
    )


@query(
    "I22_extract_id",
    r"""select url_id, coalesce(nullif(regexp_extract(url, '/video/(\d+)', 1), ''), nullif(regexp_extract(url, 'v=(\d+)', 1), '')) as id
       from {urls}""",
)
def _(t):
    return t.urls.select("url_id", url.extract_id("url", r"/video/(\d+)|[?&]v=(\d+)", 1, 2).alias("id"))


_TOKENS = ("avc1.640028", "hvc1.1.6.L93.B0", "av01.0.08M.08", "vp09.00.10.08", "mp4a.40.2", "mp4a.40.34", "mp4a.6B", "mp4a.a5",
           "Opus", "ec-3", "fLaC", "h265", "VP8", "mp4a", "xyz1", "mp4a.40.99")
_TOKEN_NAMES = ("h264", "hevc", "av1", "vp9", "aac", "mp3", "mp3", "", "opus", "eac3", "flac", "hevc", "vp8", "aac", "", "")
_TOKEN_KINDS = ("video",) * 4 + ("audio",) * 7 + ("video", "video", "audio", "", "audio")


@query(
    "I23_codec_identity",
    f"""select o_orderkey, nullif({_cases_sql('o_orderkey % 16', _TOKEN_NAMES)}, '') as name,
         nullif({_cases_sql('o_orderkey % 16', _TOKEN_KINDS)}, '') as kind from orders""",
)
def _(t):
    token = F.get(F.array(*[S(x) for x in _TOKENS]), F.col("o_orderkey") % 16)
    identity = codecs.codec_identity(token)
    return t.orders.select("o_orderkey", identity["name"].alias("name"), identity["kind"].alias("kind"))


@query(
    "I24_split_codecs",
    f"""with c as (select o_orderkey, {_cases_sql('o_orderkey % 16', _TOKENS)} as a, {_cases_sql('o_custkey % 16', _TOKENS)} as b,
           nullif({_cases_sql('o_orderkey % 16', _TOKEN_KINDS)}, '') as ka, nullif({_cases_sql('o_custkey % 16', _TOKEN_KINDS)}, '') as kb from orders)
        select o_orderkey, case when ka = 'video' then a when kb = 'video' then b end as vcodec,
          case when ka = 'audio' then a when kb = 'audio' then b end as acodec from c""",
)
def _(t):
    all_tokens = F.array(*[S(x) for x in _TOKENS])
    listed = F.concat(F.get(all_tokens, F.col("o_orderkey") % 16), S(", "), F.get(all_tokens, F.col("o_custkey") % 16))
    split = codecs.split_codecs(listed)
    return t.orders.select("o_orderkey", split["vcodec"].alias("vcodec"), split["acodec"].alias("acodec"))


@query(
    "I25_infer_muxed_audio",
    """select media_id, ordinal, coalesce(nullif(acodec, 'none'), case when vcodec <> 'none' and container is null then 'aac' end) as acodec
       from {formats}""",
)
def _(t):
    none = lambda c: F.when(F.col(c) != "none", F.col(c))
    return t.formats.select(
        "media_id", "ordinal", codecs.infer_muxed_audio(none("vcodec"), none("acodec"), "container").alias("acodec")
    )


@query(
    "I26_segment_container",
    r"""select url_id, nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)), '') as container from {urls}""",
)
def _(t):
    return t.urls.select("url_id", codecs.segment_container("url").alias("container"))


@query(
    "I27_redact",
    r"""select url_id, regexp_replace(regexp_replace(url, '//[^@\s/]+@', '//*:*@'), '([?&])(token|api_key)=[^&\s]+', '\1\2=***', 'g')
         || ' (see ?sig=***) X-Amz-Signature=*** monkey=1' as redacted from {urls}""",
)
def _(t):
    shown = F.concat("url", S(" (see ?sig=a(b)c) X-Amz-Signature=zz monkey=1"))
    return t.urls.select("url_id", url.redact(shown).alias("redacted"))


@query(
    "I30_percent",
    """select doc_id, url_encode(text) as encoded, text as decoded from documents""",
)
def _(t):
    coded = t.documents.select("doc_id", url.percent_encode("text").alias("encoded"))
    return coded.withColumn("decoded", url.percent_decode("encoded"))


@query(
    "I36_fill_segment_template",
    """select o_orderkey, 'v' || o_custkey || '/' || lpad((o_orderkey % 12345)::varchar, greatest(5, length((o_orderkey % 12345)::varchar))::int, '0')
         || '-' || o_custkey * 90 || '-' || o_orderkey * 2000 || '$-$Other$.m4s' as filled from orders""",
)
def _(t):
    template = S("$RepresentationID$/$Number%05d$-$Time$-$Bandwidth$$$-$Other$.m4s")
    filled = fill_segment_template(
        template, F.concat(S("v"), _s("o_custkey")), F.col("o_orderkey") * 2000, F.col("o_orderkey") % 12345, F.col("o_custkey") * 90
    )
    return t.orders.select("o_orderkey", filled.alias("filled"))


@query("I38_stable_id", "select url_id, 'generic-' || left(md5(url), 16) as id from {urls}")
def _(t):
    return t.urls.select("url_id", url.stable_id("url").alias("id"))


# --- names ----------------------------------------------------------------------------------------------------


@query(
    "I31_render_name",
    """select media_id, uploader || '/' || replace(title, '/', '_') || ' [' || id || '] ' || coalesce(extractor_key, 'plain') || ' '
         || substr(upload_date, 1, 4) || '-' || substr(upload_date, 5, 2) || ' ' || coalesce(floor(duration / 60)::bigint::varchar, 'NA')
         || ' ' || lpad(coalesce(view_count, 0)::varchar, greatest(8, length(coalesce(view_count, 0)::varchar))::int, '0')
         || ' ' || substr(title, 1, 3) || '.mp4' as name
       from {media}""",
)
def _(t):
    media = t.media.withColumn("views", F.coalesce("view_count", F.lit(0)))
    parts = [
        field("uploader"),
        "/",
        field("title"),
        " [",
        field("id"),
        "] ",
        Field((Ref("missing"), Ref("extractor_key")), default="plain"),
        " ",
        Field((Ref("upload_date", date_pattern="yyyy-MM"),)),
        " ",
        Field((Ref("minutes"),), kind="s"),
        " ",
        field("views", kind="d", width=8, zero_pad=True),
        " ",
        Field((Ref("title", accessors=(slice(0, 3),)),)),
        ".mp4",
    ]
    media = media.withColumn("minutes", F.floor(F.col("duration") / 60))
    return media.select("media_id", naming.render_name(media, parts).alias("name"))


@query(
    "I32_format_value",
    """select media_id, coalesce(duration::bigint::varchar, 'x') as as_int, coalesce(printf('%.2f', duration / 7), 'x') as as_float,
         '"' || title || '"' as as_json, title || ', ' || uploader as as_list, coalesce(case when view_count < 1000 then view_count || 'B'
           when view_count < 1000000 then printf('%.2fKB', view_count / 1000.0::double) else printf('%.2fMB', view_count / 1000000.0::double) end, 'x') as as_bytes,
         '''' || title || '''' as quoted, coalesce(format('{:,}', view_count), 'x') as thousands, substr(title, 1, 5) as cut,
         lpad(id, 12, ' ') as padded, coalesce(case when view_count < 1000 then view_count::varchar when view_count < 1000000 then
           case when view_count % 1000 = 0 then view_count // 1000 || 'K' else printf('%.1fK', view_count / 1000.0::double) end
           when view_count % 1000000 = 0 then view_count // 1000000 || 'M' else printf('%.1fM', view_count / 1000.0::double / 1000.0::double) end, 'x') as decimal_short,
         replace(title || '<&', '<&', '&lt;&amp;') as escaped, chr((65 + media_id % 26)::int) as char
       from {media}""",
)
def _(t):
    media = t.media
    kind = {n: media.schema[n].dataType for n in media.columns}
    def show(c, k, **options):
        return F.when(c.isNotNull(), naming.format_value(c, k, Field((), **options))).otherwise(S("x"))

    listed = F.array("title", "uploader")
    return media.select(
        "media_id",
        show(F.col("duration"), kind["duration"], kind="d").alias("as_int"),
        show(F.col("duration") / 7, T.DoubleType(), kind="f", precision=2).alias("as_float"),
        show(F.col("title"), kind["title"], kind="j").alias("as_json"),
        show(listed, T.ArrayType(T.StringType()), kind="l").alias("as_list"),
        show(F.col("view_count"), kind["view_count"], kind="B").alias("as_bytes"),
        show(F.col("title"), kind["title"], kind="q").alias("quoted"),
        show(F.col("view_count"), kind["view_count"], kind="R").alias("thousands"),
        show(F.col("title"), kind["title"], precision=5).alias("cut"),
        show(F.col("id"), kind["id"], width=12).alias("padded"),
        show(F.col("view_count"), kind["view_count"], kind="D").alias("decimal_short"),
        show(F.concat("title", S("<&")), T.StringType(), kind="h").alias("escaped"),
        show(F.col("media_id") % 26 + 65, T.LongType(), kind="c").alias("char"),
    )


@query(
    "I_fixed_text",
    """select l_orderkey, l_linenumber, l_partkey, printf('%.1f', l_extendedprice / 1000) as one, printf('%.0f', l_quantity / 4) as whole,
         printf('%.2f', l_extendedprice * l_discount) as two from lineitem""",
)
def _(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        fixed(price / 1000, 1).alias("one"),
        fixed(F.col("l_quantity") / 4, 0).alias("whole"),
        fixed(price * F.col("l_discount"), 2).alias("two"),
    )
