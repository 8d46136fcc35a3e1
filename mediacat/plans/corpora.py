"""Queries over page sources and manifests. Most checks derive the expected rows from how the view is made."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.functions.numbers import estimate_size
from mediacat.operators import dash, hls, pages
from mediacat.plans.registry import query

_ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
_N = "page_id"

# --- J1, J2, E8: metadata -------------------------------------------------------------------------------------


@query(
    "J1_page_metadata",
    """select page_id, url, case page_id % 10 when 1 then 'OG & ' || page_id when 2 then 'TW ' || page_id else nullif(trim(t), '') end as title,
         case when page_id % 10 = 1 then 'About ' || page_id end as description,
         case page_id % 10 when 1 then '/img/' || page_id || '.jpg' when 2 then 'https://i.example.org/' || page_id || '.png' end as thumbnail
       from (select *, replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as t from {rich_pages})""",
)
def _(t):
    return pages.page_metadata(t.rich_pages)


@query(
    "J2_json_ld_videos",
    """select page_id, 'Video ' || page_id as name, 'About ' || page_id as description, 65.0::double as duration, '20240115' as upload_date,
         '/media/' || page_id || '.mp4' as content_url, 'https://player.example.org/' || page_id as embed_url, page_id as view_count, 7::bigint as like_count,
         'a|b|c' as tags, 'Docs' as categories, 't' || page_id || '.jpg|' as thumbnails from pages where page_id % 10 = 0""",
)
def _(t):
    v = pages.json_ld_videos(t.rich_pages)
    joined = {"tags": "tags", "categories": "categories", "thumbnails": "thumbnail_urls"}
    return v.select(
        "page_id", "name", "description", "duration", "upload_date", "content_url", "embed_url", "view_count", "like_count",
        *[F.array_join(c, "|").alias(n) for n, c in joined.items()],
    )


@query(
    "E8_age_limit",
    "select page_id, case page_id % 10 when 8 then 18 when 9 then 21 when 2 then 18 end as age from pages",
)
def _(t):
    return t.rich_pages.select("page_id", pages.age_limit("html").alias("age"))


# --- J3, F2, F11, U1, E9: detection ---------------------------------------------------------------------------

# url, ext, quality, confidence, source, page class
_FOUND = (
    (f"{_ORIGIN} || '/media/' || {_N} || '.mp4'", "mp4", None, 2, "json-ld:contentUrl", 0),
    (f"'https://cdn.example.org/og/video/' || {_N} || '.mp4'", "mp4", None, 2, "og:video", 1),
    (f"{_ORIGIN} || '/a/' || {_N}", "mp3", None, 2, "og:audio", 1),
    (f"'https://cdn.example.org/twitter/' || {_N} || '.mp4'", "mp4", None, 1, "twitter:player:stream", 2),
    (f"'https://cdn.example.org/jw/' || {_N} || '/index.m3u8'", "m3u8", None, 1, "jwplayer.setup", 3),
    (f"'https://cdn.example.org/jwconfig/' || {_N} || '.mp4'", "mp4", None, 1, "jwplayer.options", 3),
    (f"'https://cdn.example.org/kvs/long/' || {_N} || '.mp4'", "mp4", "480p", 1, "kvs.video_url", 4),
    (f"{_ORIGIN} || '/kvs/' || {_N} || '_720.mp4'", "mp4", "720p", 1, "kvs.video_alt_url", 4),
    (f"'https://cdn.example.org/vjs/long/' || {_N} || '.webm'", "webm", None, 1, "videojs", 5),
    (f"{_ORIGIN} || '/vjs/' || {_N} || '_b.mp4'", "mp4", None, 1, "videojs.data-setup", 5),
    (f"'https://cdn.example.org/js/' || {_N} || '.flv'", "flv", None, 0, "js.param", 6),
    (f"{_ORIGIN} || '/v/' || {_N} || '.mp4'", "mp4", None, 1, "video[src]", 7),
    (f"'https://cdn.example.org/v/long/' || {_N} || '_hd.webm'", "webm", "HD", 1, "video>source", 7),
    (f"{_ORIGIN} || '/loose/' || {_N} || '.ogg'", "ogg", None, 0, "source", 7),
    (f"'https://files.example.org/download/' || {_N} || '/movie.mp4'", "mp4", None, 0, "link_scan", 9),
)


def _found_sql(*sources: str) -> str:
    parts = []
    for url, ext, quality, confidence, source, page_class in _FOUND:
        if not sources or source.startswith(sources):
            q = f"'{quality}'" if quality else "null::varchar"
            parts.append(
                f"select page_id, {url} as url, '{ext}' as ext, {q} as quality, {confidence} as confidence, '{source}' as source "
                f"from pages where page_id % 10 = {page_class}"
            )
    return " union all ".join(parts)


_COLUMNS = ("page_id", "url", "ext", "quality", "confidence", "source")


@query("J3_detect_media", _found_sql())
def _(t):
    return pages.detect_media(t.rich_pages).select(*_COLUMNS)


# The scans for parameters and links alone also see what the players' configurations hold.
_JS_SQL = (
    f"select page_id, 'https://cdn.example.org/jw/' || {_N} || '/index.m3u8' as url, 'm3u8' as ext, null::varchar as quality, 0 as confidence, 'js.param' as source "
    f"from pages where page_id % 10 = 3 union all select page_id, 'https://cdn.example.org/kvs/long/' || {_N} || '.mp4', 'mp4', null, 0, 'js.param' "
    f"from pages where page_id % 10 = 4 union all {_found_sql('js.param')}"
)
_LINKS = (1, 3, 4, 6, 8, 12, 14)


def _links_sql() -> str:
    rows = [_FOUND[i] for i in (1, 3, 4, 5, 6, 8, 12, 14)]
    return " union all ".join(
        f"select page_id, {url} as url, '{ext}' as ext, null::varchar as quality, 0 as confidence, 'link_scan' as source from pages where page_id % 10 = {c}"
        for url, ext, _, _, _, c in rows
    )


for _name, _strategy, _sql in (
    ("J3a_json_ld", "json_ld", _found_sql("json-ld")),
    ("J3b_open_graph", "open_graph", _found_sql("og:")),
    ("J3c_twitter_player", "twitter_player", _found_sql("twitter")),
    ("J3d_jw_player", "jw_player", _found_sql("jwplayer")),
    ("J3e_kvs_player", "kvs_player", _found_sql("kvs")),
    ("J3f_video_js", "video_js", _found_sql("videojs")),
    ("J3g_js_parameters", "js_parameters", _JS_SQL),
    ("J3h_html5_video", "html5_video", _found_sql("video[", "video>", "source")),
    ("J3j_direct_links", "direct_links", _links_sql()),
):

    @query(_name, _sql)
    def _(t, only=_strategy):
        return pages.detections(t.rich_pages, [only]).select(*_COLUMNS)


@query(
    "J3i_embedded_players",
    "select page_id, 'youtube.com' as host, 'https://www.youtube.com/embed/' || page_id as src from pages where page_id % 10 = 8",
)
def _(t):
    return pages.embedded_players(t.rich_pages).select("page_id", "host", "src")


@query(
    "F2_dedup_by_confidence",
    f"select page_id, url, max(confidence) as confidence from ({_found_sql()} union all {_JS_SQL} union all {_links_sql()}) group by 1, 2",
)
def _(t):
    return pages.dedup_by_confidence(pages.detections(t.rich_pages)).select("page_id", "url", "confidence")


@query(
    "F11_bind_og_properties",
    f"""select page_id, 'video' as kind, 'https://cdn.example.org/og/video/' || {_N} || '.mp4' as root, 'video/mp4' as type from pages where page_id % 10 = 1
        union all select page_id, 'video', 'https://cdn.example.org/embed/' || {_N}, 'text/html' from pages where page_id % 10 = 1
        union all select page_id, 'audio', '/a/' || {_N}, 'audio/mpeg' from pages where page_id % 10 = 1""",
)
def _(t):
    return pages.bind_og_properties(t.rich_pages).select("page_id", "kind", "root", "type")


@query(
    "U1_union_detections",
    f"select page_id, url, source from ({_found_sql()} union all {_JS_SQL.split(' union all ')[0]} union all {_JS_SQL.split(' union all ')[1]} union all {_links_sql()}) "
    "qualify row_number() over (partition by page_id, url, source order by 1) = 1",
)
def _(t):
    return pages.detections(t.rich_pages).select("page_id", "url", "source")


_YIELD = {0: {0: 1}, 1: {1: 2}, 2: {2: 1}, 3: {3: 2}, 4: {4: 2}, 5: {5: 2}, 6: {3: 1, 4: 1, 6: 1}, 7: {7: 3}, 9: {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 7: 1, 9: 1}}


@query(
    "E9_strategy_yield",
    " union all ".join(
        f"select {s} as strategy, sum(case page_id % 10 {' '.join(f'when {c} then {n}' for c, n in per.items())} else 0 end)::bigint as n from pages"
        for s, per in _YIELD.items()
    ),
)
def _(t):
    return pages.strategy_yield(pages.detections(t.rich_pages))


@query(
    "V1_register_strategy",
    f"{_found_sql('og:')} union all select page_id, url || '#feed' as url, 'xml' as ext, null as quality, 0 as confidence, 'feed' as source "
    "from pages where contains(url, 'utm_source=feed')",
)
def _(t):
    def feeds(p):
        found = pages.media_row(F.concat(p["url"], F.lit("#feed")), F.lit("xml"), source="feed")
        return F.when(p["url"].contains("utm_source=feed"), F.array(found))

    pages.register_strategy("feeds", feeds)
    try:
        return pages.detections(t.rich_pages, ["open_graph", "feeds"]).select(*_COLUMNS)
    finally:
        pages.unregister_strategy("feeds")


@query(
    "J4_page_links",
    rf"""with tags as (select page_id, url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'), '<a href="([^"]*)"', 1)) as href from {{rich_pages}})
         select page_id, {_ORIGIN} || array_to_string(list_transform(string_split(href, '/'), lambda p: replace(replace(url_encode(p), '%2C', ','), '%27', '''')), '/') as link
         from tags where starts_with(href, '/') and not starts_with(href, '//')""",
)
def _(t):
    return pages.page_links(t.rich_pages).select("page_id", "link")


# --- J5, D8, B14: master playlists ----------------------------------------------------------------------------

_MASTER = """select o_orderkey as playlist_id, 'https://cdn.example.net/hls/' || o_orderkey || '/v720/index.m3u8' as url, 1280 as width, 720 as height, 'h264' as video_codec,
    'aac' as audio_codec, 29.97::double as frame_rate, o_custkey * 1000 + 500000 as bandwidth, o_custkey * 900 + 1 as average_bandwidth, false as is_audio_only,
    null as language, 'aud' as audio_group_id, null as rendition_name from orders
  union all select o_orderkey, 'https://cdn.example.net/low/' || o_orderkey || '.m3u8', null, null, 'hevc', 'aac', null, o_custkey * 100 + 64000, null, false, null, null, null from orders
  union all select o_orderkey, 'https://cdn.example.net/hls/' || o_orderkey || '/audio/en.m3u8', null, null, null, 'aac', null, 0, null, true, 'en', 'aud', 'English (5.1)' from orders
  union all select o_orderkey, 'https://cdn.example.net/hls/' || o_orderkey || '/audio/sv.m3u8', null, null, null, 'mp4a', null, 0, null, true, null, 'other', 'Svenska' from orders where o_orderkey % 2 = 0"""


@query("J5_hls_variants", _MASTER)
def _(t):
    return hls.hls_variants(t.hls_masters).drop("pos")


@query(
    "D8_attach_audio_codec",
    """with v as (select l_orderkey as playlist_id, l_suppkey % 3 as g, (l_linenumber * 100000 + l_partkey) as pos,
           case l_returnflag when 'A' then 'aac' when 'N' then 'ac3' end as a from lineitem),
         f as (select playlist_id, g, a from v where a is not null qualify row_number() over (partition by playlist_id, g order by pos) = 1)
       select o_orderkey as playlist_id, 'g' || r.g as audio_group_id, coalesce(a, 'mp4a') as audio_codec
       from orders, (values (0), (1)) r(g) left join f on f.playlist_id = o_orderkey and f.g = r.g""",
)
def _(t):
    group = F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string"))
    flag = F.col("l_returnflag")
    variants = t.lineitem.select(
        F.col("l_orderkey").alias("playlist_id"),
        group.alias("audio_group_id"),
        (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"),
        F.when(flag == "A", "avc1.640028, mp4a.40.2").when(flag == "N", "ac-3,mp4a.a5").otherwise("avc1.640028").alias("codecs"),
    )
    renditions = t.orders.select(
        F.col("o_orderkey").alias("playlist_id"), F.explode(F.array(F.lit("g0"), F.lit("g1"))).alias("audio_group_id")
    )
    return hls.attach_audio_codec(renditions, variants).select("playlist_id", "audio_group_id", "audio_codec")


@query(
    "B14_label_hls_variants",
    f"""with v as ({_MASTER})
        select playlist_id, url, 'hls-av1-' || playlist_id % 4 || case when is_audio_only then '-audio-' || coalesce(language, audio_group_id) when height is not null
            then '-720p' else '-' || bandwidth // 1000 || 'k' end as format_id,
          case when not is_audio_only then video_codec end as vcodec, audio_codec as acodec,
          case when bandwidth > 0 then bandwidth / 1000.0::double end as tbr, coalesce(language, 'fr') as language,
          case when bandwidth > 0 then floor(bandwidth * 60.5::double / 8)::bigint end as filesize_approx,
          case when is_audio_only then rendition_name when height is not null then '720p' end as format_note, case when height is not null then 7 end as quality from v""",
)
def _(t):
    variants = hls.hls_variants(t.hls_masters).withColumn("total_duration", F.lit(60.5))
    key = F.col("playlist_id")
    parents = t.hls_masters.select(
        "playlist_id",
        F.concat(F.lit("hls-av1-"), (key % 4).cast("string")).alias("format_id"),
        F.lit(None).cast("string").alias("vcodec"),
        F.lit("none").alias("acodec"),
        F.lit("fr").alias("language"),
    )
    labeled = hls.label_hls_variants(variants, parents)
    return labeled.select(
        "playlist_id", "url", "format_id", "vcodec", "acodec", "tbr", "language", "filesize_approx", "format_note", "quality"
    )


# --- J6, E5 to E7, F7, F8: media playlists --------------------------------------------------------------------

_STATUS = """case when n > 0 and o_orderkey % 11 = 0 then 'encrypted' when o_orderkey % 13 = 0 or o_orderkey % 29 = 0 then 'live' when n = 0 then 'empty' else 'ok' end"""
_SEGMENTS = f"""base as (select *, o_orderkey % 7 as n from orders),
  seg as (select o_orderkey as playlist_id, i, o_custkey % 9 + i + 0.5::double as duration, {_STATUS} as status,
      case when o_orderkey % 2 = 0 then case when o_orderkey % 17 = 0 and i = 2 then 0 else o_custkey + 100 * i end end as length,
      case when o_orderkey % 2 = 0 then case i when 1 then 1000 when 4 then 50000 end end as "offset",
      case when o_orderkey % 3 = 0 then case when i >= 4 then 4 else 1 end end as init
    from base, range(1, 7) r(i) where i <= n),
  chained as (select *, case when i >= 4 then 50000 else 1000 end + coalesce(sum(length) over (partition by playlist_id, i >= 4 order by i rows between unbounded preceding and 1 preceding), 0) as s
    from seg)"""


@query(
    "J6_hls_segments",
    f"""with {_SEGMENTS}
        select playlist_id, i - 1 as pos, 'https://cdn.example.net/hls/' || playlist_id || '/seg-' || playlist_id || '-' || i || '.m4s?x=1' as url, duration,
          case when length is not null then s end::bigint as start, (s + length)::bigint as "end", coalesce(length = 0, false) as bad_range,
          case when init is not null then 'https://cdn.example.net/hls/' || playlist_id || '/init' || init || '.mp4' end as init_url,
          case when init is not null then playlist_id end as init_start, case when init is not null then playlist_id + 100 end as init_end
        from chained where status = 'ok'""",
)
def _(t):
    return hls.hls_segments(t.hls_text)


@query(
    "J6_hls_status",
    f"""with {_SEGMENTS}, per as (select playlist_id, count(*) as segments, sum(duration) as duration, bool_or(coalesce(length = 0, false)) as bad from seg group by 1),
          st as (select o_orderkey, {_STATUS} as s from base)
        select o_orderkey as playlist_id, case when s = 'ok' and bad then 'bad_range' else s end as status, case when s = 'encrypted' then 'AES-128' end as detail,
          case when s = 'ok' and not bad then segments end as segments, case when s = 'ok' and not bad then duration end as duration
        from st left join per on playlist_id = o_orderkey""",
)
def _(t):
    return hls.expand_playlists(t.hls_text)


@query(
    "E5_hls_rollup",
    f"""with {_SEGMENTS}
        select o_orderkey as playlist_id, count(i) as segment_count, coalesce(sum(duration), 0)::double as total_duration, o_orderkey % 13 = 0 as is_live,
          o_orderkey % 11 < 2 and o_orderkey % 7 > 0 as has_encryption, case when count(i) > 0 then 'm4s' end as segment_container
        from orders left join seg on playlist_id = o_orderkey group by o_orderkey""",
)
def _(t):
    return hls.hls_rollup(t.hls_text)


@query(
    "E6_estimate_size",
    "select media_id, ordinal, floor(tbr * 1000 * duration / 8)::bigint as size from {formats}",
)
def _(t):
    return t.formats.select("media_id", "ordinal", estimate_size(F.col("tbr") * 1000, "duration").alias("size"))


@query(
    "E7_sum_segment_sizes",
    """select media_id as playlist_id, count(*) as segments, count(filesize) as known, case when count(filesize) * 2 >= count(*) then sum(filesize)::bigint end as total_size
       from {formats} group by 1""",
)
def _(t):
    return hls.sum_segment_sizes(t.formats.withColumnRenamed("media_id", "playlist_id"))


# Long groups of rows, scanned in blocks: a device's events are its segments.
_EVENTS = "(select user_id as stream_id, event_id as pos, case when event_id % 37 = 0 then 'init' || event_id end as map, floor(value)::bigint as length, case when event_id % 23 = 0 then event_id * 10 end as \"offset\" from events)"


def _events(t):
    e = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("stream_id"),
        e.alias("pos"),
        F.when(e % 37 == 0, F.concat(F.lit("init"), e.cast("string"))).alias("map"),
        F.floor("value").alias("length"),
        F.when(e % 23 == 0, e * 10).alias("offset"),
    )


@query(
    "F7_carry_init_segment",
    f"select stream_id, pos, last_value(map ignore nulls) over (partition by stream_id order by pos) as map from {_EVENTS}",
)
def _(t):
    rows = hls.carry_init_segment(_events(t), ["stream_id"], "pos", block=256)
    return rows.select("stream_id", "pos", "map")


@query(
    "F8_chain_byte_ranges",
    f"""with g as (select *, count("offset") over (partition by stream_id order by pos) as island from {_EVENTS}),
          s as (select stream_id, pos, length, coalesce(first_value("offset") over (partition by stream_id, island order by pos), 0)
            + coalesce(sum(length) over (partition by stream_id, island order by pos rows between unbounded preceding and 1 preceding), 0) as start from g)
        select stream_id, pos, start::bigint as start, (start + length)::bigint as "end", length = 0 as bad_range from s""",
)
def _(t):
    rows = hls.chain_byte_ranges(_events(t), ["stream_id"], "pos", block=256)
    return rows.select("stream_id", "pos", "start", "end", "bad_range")


# --- J7 to J10, F9, H11: manifests ----------------------------------------------------------------------------

_MPD = """m as (select o_orderkey as mpd_id, o_custkey, o_orderkey % 3 as kind, 'https://cdn.example.net/dash/' || o_orderkey || '/media/' as root,
    o_custkey % 50 + 10 as period, o_orderkey % 8 <> 7 and o_orderkey % 6 <> 5 as video from orders where o_orderkey % 10 <> 9)"""


@query(
    "J7_dash_formats",
    f"""with {_MPD}
        select mpd_id, 'v1' as format_id, 'avc1.640028' as vcodec, null as acodec, 'mp4' as ext, case when o_custkey > 0 then o_custkey::double end as tbr, 1080 as height,
          30000 / 1001.0::double as fps, null as asr, null as language, root || 'v/' as fragment_base_url from m where video
        union all select mpd_id, 'dash_a_1_0', null, 'mp4a.40.2', 'm4a', 128.0, null, null, 48000, 'en', root from m""",
)
def _(t):
    return dash.dash_formats(t.mpd_text).select(
        "mpd_id", "format_id", "vcodec", "acodec", "ext", "tbr", "height", "fps", "asr", "language", "fragment_base_url"
    )


@query("J7_dash_subtitles", f"with {_MPD} select mpd_id, 'sv' as language, root || 'subs.vtt' as url, 'vtt' as ext from m")
def _(t):
    return dash.dash_subtitles(t.mpd_text).select("mpd_id", "language", "url", "ext")


@query(
    "J8_dash_segments_template",
    f"""with {_MPD}
        select mpd_id, 0::bigint as pos, root || 'v/init-v1.mp4' as url, null::double as duration from m where video and kind = 0
        union all select mpd_id, i + 1, root || 'v/seg-' || lpad((o_custkey % 5 + i)::varchar, 3, '0') || '.m4s', 4.0 from m, range(0, 20) r(i)
        where video and kind = 0 and i < ceil(period / 4.0)""",
)
def _(t):
    return dash.dash_segments_template(t.mpd_text).select("mpd_id", "pos", "url", "duration")


@query(
    "J9_dash_segments_timeline",
    f"""with {_MPD}
        select mpd_id, i as pos, root || 'v/t-' || case when i < 3 then i * 4000 when i = 3 then 12000 else 90000 end || '.m4s' as url,
          case when i < 3 then 4.0::double when i = 3 then (o_custkey + 1) / 1000.0::double else 0.01::double end as duration from m, range(0, 5) r(i) where video and kind = 1""",
)
def _(t):
    return dash.dash_segments_timeline(t.mpd_text).select("mpd_id", "pos", "url", "duration")


@query(
    "J10_dash_segments_list",
    f"""with {_MPD}
        select mpd_id, i as pos, root || 'v/' || case i when 0 then 'head.mp4' when 1 then 'a' || mpd_id || '.m4s' else 'b.m4s' end as url from m, range(0, 3) r(i) where video and kind = 2
        union all select mpd_id, 0, root || 'a.m4s' from m""",
)
def _(t):
    return dash.dash_segments_list(t.mpd_text).select("mpd_id", "pos", "url")


# Manifests of three periods, of which one states its start and its length.
_PERIODS = """m as (select o_orderkey as mpd_id, o_custkey, 'https://cdn.example.net/p/' || o_orderkey || '/' as root, o_custkey % 20 + 20 as second, o_custkey % 50 + 100 as total from orders),
    p as (select *, 0 as period, 0::double as begins, second::double as seconds, root || 'one/' as base from m
      union all select *, 1, second, 12.5, root || 'two/' from m union all select *, 2, second + 12.5, total - second - 12.5, root || 'three/' from m)"""


@query(
    "J7_dash_periods",
    f"""with {_PERIODS}
        select mpd_id, period, begins as period_start, seconds as period_seconds, 'v' as format_id, (period + 1) * 1000.0::double as tbr, base as fragment_base_url from p
        union all select mpd_id, 1, second, 12.5, 'a', 64.0, root || 'manifest.mpd' from m""",
)
def _(t):
    return dash.dash_formats(t.mpd_periods).select("mpd_id", "period", "period_start", "period_seconds", "format_id", "tbr", "fragment_base_url")


@query(
    "J8_dash_periods_template",
    f"""with {_PERIODS}
        select mpd_id, period, 0::bigint as pos, base || 'i.mp4' as url, null::double as duration, null::double as start from p where period <> 1
        union all select mpd_id, period, i + 1, base || 'n-' || (i + 1) || '.m4s', 4.0, begins + 4 * i from p, range(0, 50) r(i) where period <> 1 and i < ceil(seconds / 4.0)""",
)
def _(t):
    return dash.dash_segments_template(t.mpd_periods).select("mpd_id", "period", "pos", "url", "duration", "start")


@query(
    "J9_dash_periods_timeline",
    f"""with {_PERIODS}
        select mpd_id, period, i as pos, base || 't-' || (500 + o_custkey % 7 * 10 + 40 * i) || '.m4s' as url, case when i < 2 then 4.0::double else 4.5::double end as duration,
          begins + (o_custkey % 7 * 10 + 40 * i) / 10.0::double as start from p, range(0, 3) r(i) where period = 1""",
)
def _(t):
    return dash.dash_segments_timeline(t.mpd_periods).select("mpd_id", "period", "pos", "url", "duration", "start")


@query(
    "J10_dash_periods_list",
    f"with {_PERIODS} select mpd_id, 1 as period, i as pos, root || case i when 0 then 'h.mp4' else 'a.m4s' end as url from m, range(0, 2) r(i)",
)
def _(t):
    return dash.dash_segments_list(t.mpd_periods).select("mpd_id", "period", "pos", "url")


@query(
    "F9_timeline_starts",
    """with e as (select user_id as stream_id, event_id as entry, case when event_id % 19 = 0 then event_id * 1000 end as t, floor(value)::bigint + 1 as d, event_id % 7 - 2 as r from events),
         g as (select *, greatest(r, 0) + 1 as repeats, count(t) over (partition by stream_id order by entry) as island from e)
       select stream_id, entry, repeats, (coalesce(first_value(t) over (partition by stream_id, island order by entry), 0)
         + coalesce(sum(d * repeats) over (partition by stream_id, island order by entry rows between unbounded preceding and 1 preceding), 0))::bigint as start,
         coalesce(sum(repeats) over (partition by stream_id order by entry rows between unbounded preceding and 1 preceding), 0)::bigint as index from g""",
)
def _(t):
    e = F.col("event_id")
    entries = t.events.select(
        F.col("user_id").alias("stream_id"),
        e.alias("entry"),
        F.when(e % 19 == 0, e * 1000).alias("t"),
        (F.floor("value") + 1).alias("d"),
        (e % 7 - 2).alias("r"),
    )
    rows = dash.timeline_starts(entries, ["stream_id"], "entry", block=256)
    return rows.select("stream_id", "entry", "repeats", "start", "index")


@query(
    "H11_cap_renditions",
    """select l_suppkey as mpd_id, l_orderkey as adapt, l_partkey * 10 + l_linenumber as repr from lineitem
       qualify row_number() over (partition by l_suppkey order by case when l_tax > 0 then l_extendedprice end desc nulls last, l_orderkey, l_partkey * 10 + l_linenumber) <= 50""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("mpd_id"),
        F.col("l_orderkey").alias("adapt"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("repr"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("tbr"),
    )
    return dash.cap_renditions(rows, cap=50).select("mpd_id", "adapt", "repr")
