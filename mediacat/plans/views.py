"""Views that turn the driver's tables into catalog tables.

Every view is one row-wise projection (no shuffle, columns pruned at the scan). The text is shared by Spark and
DuckDB; the few functions that differ are named in ``{...}`` and filled in per dialect.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# How each dialect spells a function.
_DIALECTS = {
    "spark": {
        "ymd": "date_format({0}, 'yyyyMMdd')",
        "days": "datediff({0}, date'1970-01-01')",
        "micros": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0})",
        "str": "cast({0} as string)",
        "micros_ts": "timestamp_micros({0})",
    },
    "duckdb": {
        "ymd": "strftime({0}, '%Y%m%d')",
        "days": "date_diff('day', timestamp '1970-01-01', {0})",
        "micros": "epoch_us({0})",
        "str": "cast({0} as varchar)",
        "micros_ts": "make_timestamp({0})",
    },
}

VIEWS: dict[str, str] = {}

VIEWS["media"] = """
select o_orderkey as media_id,
  @str[o_orderkey] as id,
  case o_custkey % 4 when 0 then 'alpha' when 1 then 'Beta' when 2 then 'gamma' else 'generic' end as extractor,
  case when o_custkey % 7 = 0 then 'Key' || @str[o_custkey % 3] end as extractor_key,
  o_orderpriority || ' clip ' || @str[o_orderkey] as title,
  'Customer ' || @str[o_custkey] as uploader,
  'https://host' || @str[o_custkey % 50] || '.example.org/watch/' || @str[o_orderkey] as webpage_url,
  @ymd[o_orderdate] as upload_date,
  case when o_orderkey % 11 <> 0 then cast(cast(floor(o_totalprice) as bigint) % 7200 as double) end as duration,
  case when o_orderkey % 13 <> 0 then cast(floor(o_totalprice * 10) as bigint) end as view_count,
  o_orderstatus = 'P' as is_live,
  o_custkey as playlist_id
from {orders}"""

VIEWS["formats"] = """
select l_orderkey as media_id,
  ((((cast(l_linenumber as bigint) * 51 + cast(l_quantity as bigint)) * 11
     + cast(round(l_discount * 100) as bigint)) * 9 + cast(round(l_tax * 100) as bigint)) * 20000000
     + cast(round(l_extendedprice * 100) as bigint)) * 20000 + cast(@days[l_shipdate] as bigint) as ordinal,
  'f' || @str[l_linenumber] as format_id,
  'https://cdn' || @str[l_suppkey % 20] || '.example.net/v/' || @str[l_orderkey] || '/' || @str[l_linenumber]
    || case when l_suppkey % 5 = 3 then '/index.m3u8' else '/file' end || '?token=' || @str[l_partkey] as url,
  cast(case when l_partkey % 4 <> 0 then l_partkey % 3 end as integer) as quality,
  case when l_returnflag <> 'R' then cast(case cast(floor(l_quantity) as bigint) % 6 when 0 then 240 when 1 then 360
    when 2 then 480 when 3 then 720 when 4 then 1080 else 2160 end as integer) end as height,
  case when l_returnflag <> 'R' and l_linenumber % 3 <> 0 then cast(case cast(floor(l_quantity) as bigint) % 6
    when 0 then 426 when 1 then 640 when 2 then 854 when 3 then 1280 when 4 then 1920 else 3840 end as integer)
    end as width,
  case when l_returnflag <> 'R' then cast(case when l_suppkey % 2 = 0 then 60 else 30 end as double) end as fps,
  case when l_tax <> 0 then l_extendedprice / 10 end as tbr,
  case when l_returnflag <> 'R' and l_tax > 0.01 then floor(l_extendedprice / 16) end as vbr,
  case when l_linestatus <> 'F' and l_tax <> 0.02 then cast(64 * (1 + l_partkey % 5) as double) end as abr,
  cast(case when l_linestatus <> 'F' then case when l_suppkey % 3 = 0 then 48000 else 44100 end end as integer) as asr,
  case l_returnflag when 'A' then 'av01.0.08M.08' when 'N' then 'avc1.640028' else 'none' end as vcodec,
  case l_linestatus when 'O' then 'mp4a.40.2' else 'none' end as acodec,
  case l_partkey % 3 when 0 then 'mp4' when 1 then 'webm' else 'm4a' end as ext,
  case when l_linenumber % 2 = 0 then @str[l_linenumber] || 'p' end as format_note,
  case l_suppkey % 5 when 0 then 'https' when 1 then 'http' when 2 then 'm3u8_native' when 3 then 'm3u8'
    else 'http_dash_segments' end as protocol,
  case when l_suppkey % 7 = 0 then 'mp4_dash' when l_suppkey % 7 = 1 then 'webm' end as container,
  case when l_tax > 0.04 then cast(floor(l_extendedprice * 1000) as bigint) end as filesize,
  case when l_tax <= 0.04 and l_tax > 0.00 then cast(floor(l_extendedprice * 1000) as bigint) end as filesize_approx,
  case l_suppkey % 4 when 0 then 'en' when 1 then 'ja' when 2 then 'sv' end as language,
  case l_partkey % 11 when 0 then 'HDR10' when 1 then 'HLG' when 2 then 'HDR10+' when 3 then 'DV' when 4 then 'SDR'
    end as dynamic_range,
  case when l_discount <> 0 then l_discount >= 0.095 end as has_drm,
  case when l_linenumber % 4 = 0 then l_quantity * 10.5 end as duration
from {lineitem}"""

VIEWS["archive_lines"] = """
select value from (
  select case o_custkey % 4 when 0 then 'ALPHA' when 1 then 'beta' when 2 then 'Gamma' else 'generic' end
    || ' ' || @str[o_orderkey] as value from {orders} where o_orderkey % 5 = 0
  union all select '  Alpha ' || @str[o_orderkey] || ' ' as value from {orders} where o_orderkey % 5 = 1
  union all select case when o_orderkey % 2 = 0 then '# note ' || @str[o_orderkey] else '   ' end as value
    from {orders} where o_orderkey % 5 > 2
  union all select 'Beta' || chr(9) || @str[o_orderkey] as value from {orders} where o_orderkey % 5 = 2
) lines"""

VIEWS["playlist_entries"] = """
select cast(floor(o_orderkey / 40) as bigint) as playlist_id,
  cast(floor((o_orderkey % 40) / 10) as bigint) + 1
    + case when cast(floor(o_orderkey / 40) as bigint) % 5 = 2 and o_orderkey % 40 >= 30 then 2 else 0 end as page,
  o_orderkey % 10 + 1 as pos,
  'https://host.example.org/e/' || @str[o_orderkey] as url,
  case when o_orderkey % 3 <> 0 then 'Entry ' || @str[o_orderkey] end as title,
  @str[o_orderkey] as id
from {orders}"""

VIEWS["playlist_pages"] = """
select distinct cast(floor(o_orderkey / 40) as bigint) as playlist_id,
  cast(floor((o_orderkey % 40) / 10) as bigint) + 1 as page,
  not (cast(floor(o_orderkey / 40) as bigint) % 7 = 3 and cast(floor((o_orderkey % 40) / 10) as bigint) = 1)
    as has_more,
  case when o_orderkey % 40 < 10 and cast(floor(o_orderkey / 40) as bigint) % 4 <> 1
    then cast(25 + floor(o_orderkey / 40) % 30 as bigint) end as total_estimate,
  'List ' || @str[cast(floor(o_orderkey / 40) as bigint)] as playlist_title
from {orders}"""

VIEWS["listings"] = """
select cast(floor(o_orderkey / 500) as bigint) as query_id,
  cast(floor((o_orderkey % 500) / 20) as bigint) + 1
    + case when cast(floor(o_orderkey / 500) as bigint) % 9 = 4 and cast(floor((o_orderkey % 500) / 20) as bigint) = 6 then 100 else 0 end as page,
  o_orderkey % 20 + 1 as pos,
  'https://host.example.org/v/' || @str[o_custkey % (15 + 60 * (cast(floor(o_orderkey / 500) as bigint) % 6)) ]
    as video_url,
  o_orderpriority as title
from {orders}"""

VIEWS["listing_pages"] = """
select distinct cast(floor(o_orderkey / 500) as bigint) as query_id,
  cast(floor((o_orderkey % 500) / 20) as bigint) + 1 as page,
  not (cast(floor(o_orderkey / 500) as bigint) % 4 = 1 and cast(floor((o_orderkey % 500) / 20) as bigint) = 9)
    as has_more
from {orders}"""

VIEWS["progress"] = """
select user_id as transfer_id, event_id,
  @micros_ts[1704067200000000 + cast(floor((@micros[ts] - 1704067200000000) / 25000) as bigint)] as ts,
  cast(floor((@micros[ts] - 1704067200000000) / 1000000.0) as bigint) * (1000 + user_id % 7 * 100) as cumulative_bytes,
  cast(@micros[ts] - 1704067200000000 as double) / 2.6e12 as frac
from {events}"""

VIEWS["attempts"] = """
select user_id as transfer_id, event_id,
  cast(case event_id % 8 when 0 then 200 when 1 then 206 when 2 then 403 when 3 then 404 when 4 then 429
    when 5 then 500 when 6 then 503 end as integer) as status,
  user_id % 45 as fragments
from {events}"""

VIEWS["jobs"] = """
select user_id as job_id, event_id as seq, @micros[ts] as ts_us,
  case event_type when 'signup' then 'queued' when 'click' then 'running' when 'view' then 'paused'
    when 'purchase' then 'completed' else 'failed' end as status
from {events}"""

VIEWS["samples"] = """
select cast(floor(event_id / 64) as bigint) as transfer_id, event_id % 64 as seq,
  cast(floor(value * 1000) as bigint) as throughput
from {events}"""

VIEWS["chunks"] = """
select cast(floor(event_id / 8) as bigint) as download_id,
  event_id % 8 + case when cast(floor(value) as bigint) % 13 = 5 and event_id % 8 > 1 then 100 else 0 end as chunk_id,
  cast(65536 as bigint) as recorded_len,
  cast(case when floor(value) % 17 = 3 then 60000 else 65536 end as bigint) as on_disk_len
from {events}"""

VIEWS["subtitle_tracks"] = """
select conv_id as media_id, turn as ordinal,
  case (turn + conv_id) % 5 when 0 then 'en' when 1 then 'en-US' when 2 then 'ja' when 3 then 'sv' else 'fr' end
    as language,
  case (turn + length(text)) % 4 when 0 then 'srt' when 1 then 'vtt' when 2 then 'ass' else 'ttml' end as ext,
  'https://subs.example.org/' || @str[conv_id] || '/' || @str[turn] as url,
  case when turn % 3 = 0 then case (turn + conv_id) % 5 when 0 then 'English' when 1 then 'English (US)'
    when 2 then 'Japanese' when 3 then 'Swedish' else 'French' end end as name,
  role = 'assistant' as is_auto
from {conversations}"""

VIEWS["urls"] = """
select o_orderkey as url_id,
  case o_orderkey % 16
    when 0 then 'https://cdn' || @str[o_custkey % 9] || '.example.net/videos/' || @str[o_custkey] || '/master.m3u8?token=t'
      || @str[o_orderkey]
    when 1 then 'http://user:pw' || @str[o_orderkey] || '@media.example.org/a/b.mp4#frag'
    when 2 then 'http://' || @str[o_custkey % 224] || '.' || @str[o_orderkey % 256] || '.' || @str[o_custkey % 200]
      || '.7/clip.webm'
    when 3 then 'http://10.' || @str[o_orderkey % 256] || '.0.1/private.mp4'
    when 4 then 'http://192.168.' || @str[o_orderkey % 256] || '.9:8080/x'
    when 5 then 'http://169.254.' || @str[o_orderkey % 256] || '.169/latest'
    when 6 then 'http://localhost:9000/x'
    when 7 then 'ftp://files.example.org/' || @str[o_orderkey]
    when 8 then 'http://[::ffff:10.0.0.' || @str[o_orderkey % 256] || ']/x'
    when 9 then 'http://[2001:4860::' || @str[o_orderkey % 9999] || ']/x'
    when 10 then 'https://www.alpha.example.com/video/' || @str[o_orderkey] || '?q=a%20b'
    when 11 then 'https://beta.example.com/watch?v=' || @str[o_orderkey] || '&api_key=secret' || @str[o_custkey]
    when 12 then 'http://192.0.' || @str[o_orderkey % 4] || '.' || @str[o_custkey % 256] || '/pool'
    when 13 then 'http://100.' || @str[o_custkey % 256] || '.1.1/cgn.mkv'
    when 14 then 'http://203.0.113.' || @str[o_custkey % 256] || '/doc.MP4'
    else 'http://2130706433/decimal-' || @str[o_orderkey] end as url
from {orders}"""

_N = "@str[page_id]"
# What is spliced into a page's head, by page_id % 10, so that every strategy finds something.
_SNIPPETS = {
    0: """<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"WebPage","name":"x"},"""
    """{"@type":["Thing","VideoObject"],"name":"Video #N#","description":"About #N#","duration":"PT1M5S","""
    """"uploadDate":"2024-01-15T10:00:00Z","contentUrl":"/media/#N#.mp4","embedUrl":"https://player.example.org/#N#","""
    """"interactionStatistic":[{"@type":"InteractionCounter","interactionType":"https://schema.org/WatchAction","""
    """"userInteractionCount":#N#},{"interactionType":{"@type":"LikeAction"},"userInteractionCount":"7"}],"""
    """"keywords":"a, b,,c","genre":"Docs","thumbnailUrl":["t#N#.jpg",""]}]}</script>""",
    1: """<meta property="og:video" content="https://cdn.example.org/og/video/#N#.mp4"><meta property="og:video:type" """
    """content="video/mp4"><meta property="og:video" content="https://cdn.example.org/embed/#N#"><meta """
    """property="og:video:type" content="text/html"><meta property="og:audio" content="/a/#N#"><meta """
    """property="og:audio:type" content="audio/mpeg"><meta property="og:title" content="OG &amp; #N#"><meta """
    """property="og:description" content="About #N#"><meta property="og:image" content="/img/#N#.jpg">""",
    2: """<meta name="twitter:player:stream" content="https://cdn.example.org/twitter/#N#.mp4"><meta """
    """name="twitter:title" content="TW #N#"><meta name="twitter:image" content="https://i.example.org/#N#.png">"""
    """<b> 18 U.S.C. 2257</b>""",
    3: """<script>jwplayer("player").setup({ file: "https://cdn.example.org/jw/#N#/index.m3u8", width: 1 }); """
    """var jwConfig = { x: 1, "file": \'\'https://cdn.example.org/jwconfig/#N#.mp4\'\' };</script>""",
    4: """<script src="/player/kt_player.js"></script><script>var flashvars = { video_url: """
    """\'\'https://cdn.example.org/kvs/long/#N#.mp4\'\', video_url_text: \'\'480p\'\', video_alt_url: \'\'/kvs/#N#_720.mp4\'\', """
    """video_alt_url_text: \'\'720p\'\' };</script>""",
    5: """<script>videojs(\'\'p\'\', { controls: 1, sources: [ { src: "https://cdn.example.org/vjs/long/#N#.webm" } ] });</script>"""
    """<div data-setup=\'\'{"src": "/vjs/#N#_b.mp4"}\'\'></div>""",
    6: """<script>var videoUrl = "https://cdn.example.org/js/#N#.flv";</script>""",
    7: """<video src="/v/#N#.mp4"><source src="https://cdn.example.org/v/long/#N#_hd.webm" type="video/webm" label="HD">"""
    """</video><source src="/loose/#N#.ogg"><!-- <video src="/hidden.mp4"></video> -->""",
    8: """<iframe src="https://www.youtube.com/embed/#N#"></iframe><iframe src="https://ads.example.org/#N#"></iframe>"""
    """<meta name="rating" content="RTA-5042-1996-1400-1577-RTA">""",
    9: """<a href="https://files.example.org/download/#N#/movie.mp4">x</a><a href="https://files.example.org/preview/#N#.mp4">"""
    """y</a><p>you acknowledge you are at least 21 years old</p>""",
}


def _snippet(text: str) -> str:
    quoted = text.replace("\\'\\'", "''").replace("#N#", f"' || {_N} || '")
    return f"'{quoted}'"


VIEWS["rich_pages"] = (
    "select page_id, url, replace(html, '</head>', case page_id % 10 "
    + " ".join(f"when {i} then {_snippet(s)}" for i, s in _SNIPPETS.items())
    + " end || '</head>') as html from {pages}"
)

# --- manifests ------------------------------------------------------------------------------------------------

_K = "@str[o_orderkey]"


def _lines(*parts: str) -> str:
    """SQL of the parts, each of which is an expression of whole lines."""
    return " || ".join(parts)


def _line(text: str) -> str:
    return f"{text} || chr(10)"


def _if(condition: str, text: str) -> str:
    return f"case when {condition} then {_line(text)} else '' end"


def _hls_segment(i: int) -> str:
    length = f"case when o_orderkey % 17 = 0 and {i} = 2 then '0' else @str[o_custkey + {100 * i}] end"
    offset = {1: "'@1000'", 4: "'@50000'"}.get(i, "''")
    inside = _lines(
        *([_if("o_orderkey % 3 = 0", f"'#EXT-X-MAP:URI=\"init{i}.mp4\",BYTERANGE=\"100@' || {_K} || '\"'")] if i in (1, 4) else []),
        _line(f"'#EXTINF:' || @str[o_custkey % 9 + {i}] || '.5,'"),
        _if("o_orderkey % 2 = 0", f"'#EXT-X-BYTERANGE:' || {length} || {offset}"),
        _line(f"'seg-' || {_K} || '-{i}.m4s?x=1'"),
    )
    return f"case when o_orderkey % 7 >= {i} then {inside} else '' end"


VIEWS["hls_text"] = f"""
select o_orderkey as playlist_id, 'https://cdn.example.net/hls/' || {_K} || '/media.m3u8' as url,
  {_lines(
      _line("'#EXTM3U'"),
      _line("'#EXT-X-VERSION:7'"),
      _if("o_orderkey % 29 = 0", "'#EXT-X-PLAYLIST-TYPE:EVENT'"),
      _if("o_orderkey % 11 = 0", "'#EXT-X-KEY:METHOD=AES-128,URI=' || chr(34) || 'k.bin' || chr(34)"),
      _if("o_orderkey % 11 = 1", "'#EXT-X-KEY:METHOD=NONE'"),
      *[_hls_segment(i) for i in range(1, 7)],
      _if("o_orderkey % 13 <> 0", "'#EXT-X-ENDLIST'"),
  )} as text
from {{orders}}"""

VIEWS["hls_masters"] = f"""
select o_orderkey as playlist_id, 'https://cdn.example.net/hls/' || {_K} || '/master.m3u8' as url,
  {_lines(
      _line("'#EXTM3U'"),
      _line("'#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"aud\",NAME=\"English (5.1)\",LANGUAGE=\"en\",URI=\"audio/en.m3u8\"'"),
      _if("o_orderkey % 2 = 0", "'#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"other\",NAME=\"Svenska\",URI=\"audio/sv.m3u8\"'"),
      _line("'#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID=\"subs\",NAME=\"en\",URI=\"subs/en.m3u8\"'"),
      _line("'#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"aud\",NAME=\"in band\"'"),
      _line(
          "'#EXT-X-STREAM-INF:BANDWIDTH=' || @str[o_custkey * 1000 + 500000] || ',AVERAGE-BANDWIDTH=' || @str[o_custkey * 900 + 1] || "
          "',RESOLUTION=1280x720,CODECS=\"avc1.640028,mp4a.40.2\",FRAME-RATE=29.97,AUDIO=\"aud\"'"
      ),
      _line("'v720/index.m3u8'"),
      _line("'#EXT-X-STREAM-INF:BANDWIDTH=' || @str[o_custkey * 100 + 64000] || ',CODECS=\"hvc1.1.6.L93.B0\"'"),
      _line("'# a note'"),
      _line("'/low/' || " + _K + " || '.m3u8'"),
      _line("'#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=1,URI=\"iframes.m3u8\"'"),
  )} as text
from {{orders}}"""


def _mpd(kind: int) -> str:
    video = {
        0: "<SegmentTemplate timescale=\"1000\" duration=\"4000\" startNumber=\"' || @str[o_custkey % 5] || '\" "
        "initialization=\"init-$RepresentationID$.mp4\" media=\"seg-$Number%03d$.m4s\"/>",
        1: "<SegmentTemplate timescale=\"1000\" media=\"t-$Time$.m4s\"><SegmentTimeline><S t=\"0\" d=\"4000\" r=\"2\"/>"
        "<S d=\"' || @str[o_custkey + 1] || '\"/><S t=\"90000\" d=\"10\" r=\"-1\"/></SegmentTimeline></SegmentTemplate>",
        2: "<SegmentList><Initialization sourceURL=\"head.mp4\"/><SegmentURL media=\"a' || @str[o_orderkey] || '.m4s\"/>"
        "<SegmentURL media=\"b.m4s\"/></SegmentList>",
    }[kind]
    return (
        "'<?xml version=\"1.0\"?><MPD xmlns=\"urn:mpeg:dash:schema:mpd:2011\" type=\"' || case when o_orderkey % 10 = 9 then 'dynamic' "
        "else 'static' end || '\"><BaseURL>media/</BaseURL><Period duration=\"PT' || @str[o_custkey % 50 + 10] || 'S\"><AdaptationSet "
        "mimeType=\"video/mp4\">' || case when o_orderkey % 8 = 7 then '<ContentProtection schemeIdUri=\"urn:x\"/>' else '' end || "
        "'<Representation id=\"v1\" bandwidth=\"' || @str[o_custkey * 1000] || '\" codecs=\"avc1.640028\" width=\"1920\" height=\"1080\" "
        "frameRate=\"30000/1001\"><BaseURL>' || case when o_orderkey % 6 = 5 then 'http://10.0.0.1/' else 'v/' end || '</BaseURL>"
        + video
        + "</Representation></AdaptationSet><AdaptationSet mimeType=\"audio/mp4\" lang=\"en\" codecs=\"mp4a.40.2\"><Representation "
        "bandwidth=\"128000\" audioSamplingRate=\"48000 44100\"><SegmentList><SegmentURL media=\"a.m4s\"/></SegmentList></Representation>"
        "</AdaptationSet><AdaptationSet mimeType=\"text/vtt\" lang=\"sv\"><Representation id=\"s\"><BaseURL>subs.vtt</BaseURL></Representation>"
        "</AdaptationSet></Period></MPD>'"
    )


VIEWS["mpd_text"] = f"""
select o_orderkey as mpd_id, 'https://cdn.example.net/dash/' || {_K} || '/manifest.mpd' as url,
  case o_orderkey % 3 when 0 then {_mpd(0)} when 1 then {_mpd(1)} else {_mpd(2)} end as text
from {{orders}}"""

_TEMPLATE_4S = "<SegmentTemplate timescale=\"1000\" duration=\"4000\" initialization=\"i.mp4\" media=\"n-$Number$.m4s\"/>"

#: Three periods: the first states neither start nor length, the second both, the third neither.
VIEWS["mpd_periods"] = f"""
select o_orderkey as mpd_id, 'https://cdn.example.net/p/' || {_K} || '/manifest.mpd' as url,
  '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT' || @str[o_custkey % 50 + 100] || 'S">'
  || '<Period><BaseURL>one/</BaseURL>{_TEMPLATE_4S}<AdaptationSet mimeType="video/mp4"><Representation id="v" bandwidth="1000000"/></AdaptationSet></Period>'
  || '<Period start="PT' || @str[o_custkey % 20 + 20] || 'S" duration="PT12.5S"><AdaptationSet mimeType="video/mp4"><BaseURL>two/</BaseURL>'
  || '<SegmentTemplate timescale="10" presentationTimeOffset="500" media="t-$Time$.m4s"><SegmentTimeline><S t="' || @str[o_custkey % 7 * 10 + 500] || '" d="40" r="1"/><S d="45"/></SegmentTimeline></SegmentTemplate>'
  || '<Representation id="v" bandwidth="2000000"/></AdaptationSet><AdaptationSet mimeType="audio/mp4"><Representation id="a" bandwidth="64000">'
  || '<SegmentList><Initialization sourceURL="h.mp4"/><SegmentURL media="a.m4s"/></SegmentList></Representation></AdaptationSet></Period>'
  || '<Period><AdaptationSet mimeType="video/mp4">{_TEMPLATE_4S}<Representation id="v" bandwidth="3000000"><BaseURL>three/</BaseURL></Representation></AdaptationSet></Period></MPD>' as text
from {{orders}}"""

_ORDER = re.compile(r"\{(\w+)\}")
_CALL = re.compile(r"@(\w+)\[")


def _render(text: str, dialect: str) -> str:
    """Fill in the ``@name[argument]`` spellings of one dialect."""
    names = _DIALECTS[dialect]
    while True:
        m = None
        for m in _CALL.finditer(text):
            pass
        if m is None:
            return text
        depth, i = 1, m.end()
        while depth:
            depth += {"[": 1, "]": -1}.get(text[i], 0)
            i += 1
        arg = text[m.end() : i - 1]
        text = text[: m.start()] + names[m.group(1)].replace("{0}", arg) + text[i:]


def _inputs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(_ORDER.findall(text)) if n in VIEWS or n in TABLES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that local runs read from one file of one row group, and the key their rows belong together by.
_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "pages": "page_id"}
#: Views of long texts that take much work a row: their table is dealt by key, as one file of one row group is one task's.
_SPREAD = ("hls_text", "hls_masters", "mpd_text", "mpd_periods")
#: Set by the session of local runs; on a cluster the splits of the files decide.
SCAN_PARTITIONS = "spark.mediacat.scanPartitions"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    if name in TABLES:
        rows, parts = table(spark, sf_dir, name), spark.conf.get(SCAN_PARTITIONS, None)
        return rows.repartition(int(parts), _KEYS[name]) if parts and name in _KEYS else rows
    text = VIEWS[name]
    names = _inputs(text)
    inputs = {n: view(spark, sf_dir, n) for n in names}
    if name in _SPREAD and not spark.conf.get(SCAN_PARTITIONS, None):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        inputs = {n: rows.repartition(parts, _KEYS[n]) for n, rows in inputs.items()}
    # All braces but those around names are text.
    escaped = re.sub(r"[{}]", lambda m: m.group(0) * 2, _render(text, "spark"))
    for n in names:
        escaped = escaped.replace("{{" + n + "}}", "{" + n + "}")
    return spark.sql(escaped, **inputs)


def _needed(name: str) -> list[str]:
    if name in TABLES:
        return []
    below = [_needed(n) for n in _inputs(VIEWS[name])]
    return list(dict.fromkeys(reduce(list.__add__, below, []) + [name]))


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the views it names as ``{view}``."""
    names = list(dict.fromkeys(n for v in _inputs(sql) for n in _needed(v)))

    def bare(text: str) -> str:
        return _ORDER.sub(lambda m: m.group(1) if m.group(1) in VIEWS or m.group(1) in TABLES else m.group(0), text)

    plain = bare(sql).strip()
    if not names:
        return plain
    ctes = ",\n".join(f"{n} as ({bare(_render(VIEWS[n], 'duckdb'))})" for n in names)
    for start in ("with recursive", "with"):
        if plain.lower().startswith(start):
            return f"{start} {ctes},\n{plain[len(start):].lstrip()}"
    return f"with {ctes}\n{plain}"
