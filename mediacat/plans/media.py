"""Queries over media records: predicates, archive, playlists, listings, library, subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.operators import archive, catalog, library, listing, playlist, subtitles
from mediacat.operators.media_filter import Compare, Has, condition, match_any
from mediacat.operators.playlist import PlaylistSelection
from mediacat.plans.registry import query
from mediacat.sources import catalog as files

# --- A: catalog files -----------------------------------------------------------------------------------------


@query(
    "A1_parse_catalog",
    """select media_id::varchar as id, title, duration, view_count, is_live, 'v' || media_id as extra_text, media_id % 7 as extra_number
       from {media}""",
)
def _(t):
    media = t.media
    line = F.to_json(
        F.struct(
            "id", "title", "extractor", "webpage_url", "duration", "view_count", "is_live",
            F.concat(F.lit("v"), "id").alias("site_note"),
            F.struct((F.col("media_id") % 7).alias("n")).alias("site"),
        )
    )
    # A broken line and one without an id are no records.
    broken = F.when(F.col("media_id") % 10 == 0, F.array(line, F.lit("{broken"), F.lit('{"title":"x"}'))).otherwise(F.array(line))
    lines = media.select(F.explode(broken).alias("value"))
    parsed = files.parse_catalog(lines)
    return parsed.select(
        "id", "title", "duration", "view_count", "is_live",
        F.try_variant_get("extra", "$.site_note", "string").alias("extra_text"),
        F.try_variant_get("extra", "$.site.n", "long").alias("extra_number"),
    )


@query(
    "A2_catalog_json",
    """select '{"id":"' || id || '","title":"' || title || '"' || coalesce(',"duration":' || duration::bigint || '.0', '')
         || coalesce(',"view_count":' || view_count, '') || ',"is_live":' || is_live || '}' as value from {media}""",
)
def _(t):
    return files.catalog_json(t.media.select("id", "title", "duration", "view_count", "is_live"))


_ARCHIVE = """archive as (select distinct case when contains(l, ' ') then lower(split_part(l, ' ', 1)) || substr(l, position(' ' in l)) else l end as key
    from (select trim(value) as l from {archive_lines}) where l <> '' and not starts_with(l, '#'))"""
_KEY = "lower(coalesce(extractor_key, extractor)) || ' ' || id"


@query("A3_read_archive", f"with {_ARCHIVE} select key from archive")
def _(t):
    return archive.parse_archive(t.archive_lines)


@query(
    "A4_new_archive_keys",
    f"with {_ARCHIVE} select distinct {_KEY} as key from {{media}} where {_KEY} not in (select key from archive)",
)
def _(t):
    return archive.new_keys(t.media, archive.parse_archive(t.archive_lines))


@query(
    "A5_parse_cookies",
    """select 's' || c_custkey % 40 || '.example.org' as domain, true as include_subdomains, '/' as path, c_custkey % 3 = 0 as secure,
         (c_custkey + 1700000000)::bigint as expires, 'k' || c_custkey as name, c_mktsegment as value, c_custkey % 4 = 0 as http_only
       from customer where c_custkey % 5 < 4""",
)
def _(t):
    k, tab = F.col("c_custkey"), F.lit("\t")
    line = F.concat_ws(
        "\t",
        F.concat(F.when(k % 4 == 0, "#HttpOnly_").otherwise(""), F.when(k % 2 == 0, ".").otherwise(""), F.lit("s"), (k % 40).cast("string"), F.lit(".example.org")),
        F.lit("TRUE"),
        F.lit("/"),
        F.when(k % 3 == 0, "TRUE").otherwise("FALSE"),
        (k + 1_700_000_000).cast("string"),
        F.concat(F.lit("k"), k.cast("string")),
        "c_mktsegment",
    )
    bad = F.when(k % 2 == 0, F.concat(F.lit("# note"), tab, "c_name")).otherwise(F.lit("too\tfew\tfields"))
    return files.parse_cookies(t.customer.select(F.when(k % 5 < 4, line).otherwise(bad).alias("value")))


# The longest start of whole characters of at most 1 001 bytes.
@query(
    "A6_cut_pages",
    """with cut as (select page_id, html, (select max(n) from range(0, 1002) r(n) where n <= length(html) and strlen(left(html, n)) <= 1001) as n from pages)
       select page_id, left(html, n) as html, strlen(left(html, n))::bigint as bytes from cut""",
)
def _(t):
    cut = files.cut_pages(t.pages, 1001)
    return cut.select("page_id", "html", F.octet_length("html").cast("long").alias("bytes"))


@query(
    "A7_parse_sessions",
    """select '/e/' || o_orderkey as source_url, 'f' || o_custkey % 9 as format_id, 1 as version,
         case when o_orderkey % 2 = 0 then 'single_video' else 'playlist' end as state_type from orders where o_orderkey % 4 < 2""",
)
def _(t):
    k = F.col("o_orderkey")
    line = F.to_json(
        F.struct(
            F.when(k % 2 == 0, "single_video").otherwise("playlist").alias("state_type"),
            F.when(k % 4 < 2, 1).otherwise(2).alias("version"),
            F.concat(F.lit("/e/"), k.cast("string")).alias("source_url"),
            F.concat(F.lit("f"), (F.col("o_custkey") % 9).cast("string")).alias("format_id"),
        )
    )
    lines = t.orders.select(F.when(k % 4 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    return files.parse_sessions(lines).select("source_url", "format_id", "version", "state_type")


# --- C6 to C9: predicates -------------------------------------------------------------------------------------


@query(
    "C6_media_comparisons",
    """select media_id, coalesce(duration > 3600, false) as f1, coalesce(view_count >= 1000000, true) as f2,
         coalesce(not (upload_date::double < 19980101), false) as f3, starts_with(title, '5') as f4, coalesce(duration = 1200, false) as f5,
         coalesce(contains(duration::bigint || '.0', '00.0'), false) as f6, extractor >= 'b' as f7, true as f8, uploader <> 'Customer 5' as f9
       from {media}""",
)
def _(t):
    media = t.media
    c = [
        Compare("duration", ">", 3600),
        Compare("view_count", ">=", 1_000_000, missing_ok=True),
        Compare("upload_date", "<", 19980101, negate=True),
        Compare("title", "^=", "5"),
        Compare("duration", "=", 1200),
        Compare("duration", "*=", "00.0"),
        Compare("extractor", ">=", "b"),
        Compare("nothing", "=", 1, missing_ok=True),
        Compare("uploader", "!=", "Customer 5"),
    ]
    return media.select("media_id", *[condition(x, media.schema).alias(f"f{i}") for i, x in enumerate(c, 1)])


@query(
    "C7_media_presence",
    """select media_id, is_live as live, not is_live as not_live, duration is not null as has_duration,
         extractor_key is null as no_key from {media}""",
)
def _(t):
    media = t.media
    c = {"live": Has("is_live"), "not_live": Has("is_live", True), "has_duration": Has("duration"), "no_key": Has("extractor_key", True)}
    return media.select("media_id", *[condition(x, media.schema).alias(n) for n, x in c.items()])


@query(
    "C8_match_any",
    """select media_id from {media} where (not is_live and coalesce(duration < 600, false)) or (view_count is null and contains(title, 'HIGH'))""",
)
def _(t):
    filters = [
        (Has("is_live", negate=True), Compare("duration", "<", 600)),
        (Has("view_count", negate=True), Compare("title", "*=", "HIGH")),
    ]
    return match_any(t.media, filters).select("media_id")


@query(
    "C9_playlist_range",
    """select id from {playlist_entries} where (page - 1) * 10 + pos >= 2 and (page - 1) * 10 + pos <= 38
         and ((page - 1) * 10 + pos = 1 or (page - 1) * 10 + pos between 3 and 5 or (page - 1) * 10 + pos between 8 and 9 or (page - 1) * 10 + pos >= 12)""",
)
def _(t):
    entries = t.playlist_entries.withColumn("position", (F.col("page") - 1) * 10 + F.col("pos"))
    selection = PlaylistSelection(2, 38, ((1, 1), (3, 5), (8, 9), (12, None)))
    return playlist.playlist_range(entries, selection).select("id")


# --- D1: archive ----------------------------------------------------------------------------------------------


@query("D1_not_in_archive", f"with {_ARCHIVE} select media_id from {{media}} where {_KEY} not in (select key from archive)")
def _(t):
    return archive.not_in_archive(t.media, archive.parse_archive(t.archive_lines)).select("media_id")


@query("D1_in_archive", f"with {_ARCHIVE} select media_id from {{media}} where {_KEY} in (select key from archive)")
def _(t):
    return archive.in_archive(t.media, archive.parse_archive(t.archive_lines)).select("media_id")


# --- F3, F6, E4, E10: playlists -------------------------------------------------------------------------------

_PLAYLIST = """totals as (select playlist_id, page, has_more, count(e.pos) as n
      from {playlist_pages} p left join {playlist_entries} e using (playlist_id, page) group by all),
    summed as (select *, coalesce(sum(n) over (partition by playlist_id order by page rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from totals),
    stops as (select playlist_id, min(case when n = 0 then page when not has_more or before + n >= NEEDED then page + 1 end) as stop from summed group by 1),
    listed as (select e.*, before + pos as position from {playlist_entries} e join summed using (playlist_id, page) join stops using (playlist_id)
      where (stop is null or page < stop))"""


@query("F6_playlist_cutoff", f"with {_PLAYLIST.replace('NEEDED', '15')} select playlist_id, position, id from listed")
def _(t):
    cut = playlist.playlist_cutoff(t.playlist_entries, t.playlist_pages, last_needed=15)
    return cut.select("playlist_id", "position", "id")


@query(
    "F3_stamp_playlist",
    f"""with {_PLAYLIST.replace('NEEDED', '1e18')}
       select l.playlist_id, l.id, l.position as playlist_index, greatest(count(*) over (partition by l.playlist_id), p.total_estimate) as playlist_count,
         p.playlist_title as playlist from listed l join {{playlist_pages}} p on p.playlist_id = l.playlist_id and p.page = 1""",
)
def _(t):
    listed = playlist.playlist_cutoff(t.playlist_entries, t.playlist_pages)
    stamped = playlist.stamp_playlist(listed, t.playlist_pages)
    return stamped.select("playlist_id", "id", "playlist_index", "playlist_count", "playlist")


@query(
    "E4_audio_types",
    """select playlist_id, string_agg(distinct language, ',' order by language) as languages
       from {media} join {formats} using (media_id) where language <> '' group by 1""",
)
def _(t):
    joined = t.media.select("media_id", "playlist_id").join(t.formats.select("media_id", "language"), "media_id")
    return playlist.audio_types(joined).select("playlist_id", F.array_join("languages", ",").alias("languages"))


@query(
    "E10_playlist_summary",
    """select o_custkey as playlist_id, count(*) as total, count(*) filter (o_orderstatus = 'F') as downloaded,
         count(*) filter (o_orderstatus = 'F' and o_orderkey % 3 = 0) as previously,
         count(*) filter (o_orderstatus = 'F' and o_orderkey % 3 <> 0) as new, count(*) filter (o_orderstatus = 'P') as failed,
         count(*) filter (o_orderstatus = 'F' and o_orderkey % 5 = 0) as recovered,
         count(*) filter (o_orderstatus = 'F' and o_orderkey % 7 = 0) as missing_subtitles from orders group by 1""",
)
def _(t):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    episodes = t.orders.select(
        F.col("o_custkey").alias("playlist_id"),
        F.when(s == "F", "done").when(s == "P", "failed").otherwise("open").alias("status"),
        (k % 3 == 0).alias("previously"),
        (k % 5 == 0).alias("retried"),
        (k % 7 == 0).alias("subtitles_missing"),
    )
    return playlist.playlist_summary(episodes)


# --- F5, H12: listings ----------------------------------------------------------------------------------------


@query(
    "F5_listing_cutoff",
    """with seen as (select query_id, page, pos, video_url, min(page) over (partition by query_id, video_url) as first_page from {listings}),
         totals as (select query_id, page, has_more, count(s.pos) as n, coalesce(bool_or(s.first_page = page), false) as fresh
           from {listing_pages} p left join seen s using (query_id, page) group by all),
         summed as (select *, coalesce(sum(n) over (partition by query_id order by page rows between unbounded preceding and 1 preceding), 0)::bigint as before from totals),
         stops as (select query_id, least(min(case when n = 0 or not fresh then page end), min(case when not has_more or before + n >= 230 then page + 1 end)) as stop
           from summed group by 1)
       select query_id, before + pos as position, video_url from {listings} join summed using (query_id, page) join stops using (query_id)
       where (stop is null or page < stop) and before + pos <= 230""",
)
def _(t):
    cut = listing.listing_cutoff(t.listings, t.listing_pages, max_results=230)
    return cut.select("query_id", "position", "video_url")


@query(
    "H12_limit_per_query",
    """select query_id, page, pos, video_url from {listings} qualify row_number() over (partition by query_id order by page, pos) <= 25""",
)
def _(t):
    return listing.limit_per_query(t.listings, 25).select("query_id", "page", "pos", "video_url")


# --- D7, D11, D12: library ------------------------------------------------------------------------------------


@query(
    "D7_match_by_path",
    r"""with p as (select url_id, url, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) as path from {urls})
       select a.url_id, b.o_orderkey as other from p a join orders b on a.path = '/videos/' || b.o_orderkey || '/master.m3u8'""",
)
def _(t):
    left = t.urls
    key = F.col("o_orderkey")
    right = t.orders.select(
        key.alias("other"),
        F.concat(F.lit("https://edge"), (key % 7).cast("string"), F.lit(".example.com/videos/"), key.cast("string"), F.lit("/master.m3u8?s="), key.cast("string")).alias("other_url"),
    )
    return library.match_by_path(left, right, "url", "other_url").select("url_id", "other")


# Half of the events have the path "/", of which pairs would be millions.
_HOT = "select {k} as id, case when {k} % 2 = 0 then '/' else '/v/' || ({k} % {m}) end as path from {{{t}}}"


def _hot_paths(t):
    def side(df, key, modulus, host):
        k = F.col(key)
        tail = F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("v/"), (k % modulus).cast("string")))
        return df.select(k.alias("id"), F.concat(F.lit(f"https://{host}/"), tail, F.lit("?t="), k.cast("string")).alias("url"))

    return side(t.events, "event_id", 97, "a.example"), side(t.orders, "o_orderkey", 61, "b.example:8443")


_BOTH = f"with a as ({_HOT.format(k='event_id', m=97, t='events')}), b as ({_HOT.format(k='o_orderkey', m=61, t='orders')})"


@query(
    "D7_path_classes",
    f"""{_BOTH} select path, x.n as left_rows, y.n as right_rows from (select path, count(*) as n from a group by path) x join (select path, count(*) as n from b group by path) y using (path)""",
)
def _(t):
    return library.path_classes(*_hot_paths(t))


@query("D7_path_members", f"{_BOTH} select id, path from a where path in (select path from b)")
def _(t):
    left, right = _hot_paths(t)
    return library.path_members(left, library.path_classes(left, right)).select("id", "path")


def _files(t):
    k = F.col("o_orderkey")
    stem = F.concat("o_orderpriority", F.lit(" clip "), k.cast("string"))
    names = F.array(
        F.when(k % 6 == 0, F.concat(stem, F.lit(".mp4"))),
        F.when(k % 6 == 1, F.concat(stem, F.lit(".mp4.part3"))),
        F.when(k % 6 == 2, F.concat(stem, F.lit(".ts"))),
        F.when(k % 6 == 3, F.concat(stem, F.lit(".webm"))),
        F.when(k % 4 == 0, F.concat(stem, F.lit(".en.vtt"))),
        F.when(k % 4 == 1, F.concat(stem, F.lit(".English (US).srt"))),
        F.when(k % 4 == 2, F.concat(stem, F.lit(".sv.forced.VTT"))),
    )
    size = F.when(k % 6 == 3, F.lit(999)).otherwise(F.lit(5_000_000)).cast("long")
    return t.orders.select(F.explode(F.array_compact(names)).alias("name"), size.alias("size"))


# A title that starts another one ("clip 1", "clip 12") is partial wherever the longer one is.
_STATES = """parts as (select o_orderpriority || ' clip ' || o_orderkey || '.mp4.part3' as name from orders where o_orderkey % 6 = 1),
  prefixes as (select distinct left(name, n::int) as stem from parts, range(1, 60) r(n) where n <= length(name)),
  states as (select media_id, title, case when media_id % 6 = 0 then 'complete' when media_id % 6 = 2
     or title in (select stem from prefixes) then 'partial' end as state from {media})"""


@query("D11_find_completed", f"with {_STATES} select media_id, state from states where state is not null")
def _(t):
    return library.find_completed(t.media.select("media_id", "title"), _files(t)).select("media_id", "state")


@query(
    "D12_missing_subtitles",
    """select media_id, l.language from {media}, (values ('en'), ('sv'), ('ja')) l(language)
       where media_id % 6 = 0 and not (l.language = 'en' and media_id % 4 in (0, 1)) and not (l.language = 'sv' and media_id % 4 = 2)""",
)
def _(t):
    files = _files(t)
    done = library.find_completed(t.media.select("media_id", "title"), files).where(F.col("state") == "complete")
    return library.missing_subtitles(done, files, ["en", "sv", "ja"])


# --- D10, F12, U4 to U7: subtitles ----------------------------------------------------------------------------

_MATCH = """(lower(language) = L or (length(L) <= 3 and starts_with(lower(language), L)) or coalesce(lower(name) = L, false)
  or (length(L) <= 3 and coalesce(starts_with(lower(name), L), false)))"""


@query(
    "D10_match_subtitle_langs",
    f"""select media_id, ordinal, r.l as requested from {{subtitle_tracks}}, (values ('en'), ('Swedish'), ('fra'), ('ja')) r(l)
        where {_MATCH.replace('L', 'lower(r.l)')}""",
)
def _(t):
    matched = subtitles.match_subtitle_langs(t.subtitle_tracks, ["en", "Swedish", "fra", "ja"])
    return matched.select("media_id", "ordinal", "requested")


@query(
    "F12_dedup_subtitles",
    """select media_id, ordinal, language, ext from {subtitle_tracks}
       qualify row_number() over (partition by media_id, lower(language) order by is_auto, ordinal) = 1""",
)
def _(t):
    return subtitles.dedup_subtitles(t.subtitle_tracks).select("media_id", "ordinal", "language", "ext")


@query(
    "F12_dedup_subtitles_preferred",
    """select media_id, ordinal, language, ext from {subtitle_tracks}
       qualify row_number() over (partition by media_id, lower(language) order by ext <> 'vtt', ordinal) = 1""",
)
def _(t):
    return subtitles.dedup_subtitles(t.subtitle_tracks, "vtt").select("media_id", "ordinal", "language", "ext")


def _maps(t):
    """Media records with their two maps of tracks."""
    tracks = t.subtitle_tracks
    track = F.struct("url", "ext", "name")

    def one(auto: bool, name: str):
        rows = tracks.where(F.col("is_auto") == auto)
        per = rows.groupBy("media_id", "language").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", track.alias("t")))), lambda x: x["t"]).alias("ts")
        )
        return per.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("language", "ts"))).alias(name))

    return one(False, "subtitles").join(one(True, "automatic_captions"), "media_id", "full")


@query(
    "U4_union_subtitles",
    """select media_id, language, url, ext, is_auto, 'available' as status,
         row_number() over (partition by media_id, language, is_auto order by ordinal)::int - 1 as ordinal from {subtitle_tracks}""",
)
def _(t):
    media = _maps(t)
    rows = subtitles.union_subtitles(media, "media_id")
    status = media.select("media_id", subtitles.subtitle_status()["status"].alias("status"))
    return rows.join(status, "media_id").select("media_id", "language", "url", "ext", "is_auto", "status", "ordinal")


@query(
    "U5_select_subtitles",
    """select media_id, ordinal, language, ext, is_auto from {subtitle_tracks} where lower(language) in ('en', 'en-us', 'sv')
       qualify row_number() over (partition by media_id, lower(language) order by is_auto, ext <> 'srt', ordinal) = 1""",
)
def _(t):
    chosen = subtitles.select_subtitles(t.subtitle_tracks, ["EN", "en-US", "sv"], "srt", include_auto=True)
    return chosen.select("media_id", "ordinal", "language", "ext", "is_auto")


@query(
    "U5_select_subtitles_all",
    """select media_id, ordinal, language, ext, is_auto from {subtitle_tracks} where not is_auto
       qualify row_number() over (partition by media_id, lower(language) order by ordinal) = 1""",
)
def _(t):
    return subtitles.select_subtitles(t.subtitle_tracks, ["all"]).select("media_id", "ordinal", "language", "ext", "is_auto")


@query(
    "U6_subtitle_policy",
    f"""with w as (select distinct media_id, l as requested from {{subtitle_tracks}}, (values ('en'), ('ja'), ('de')) r(l)),
         m as (select t.*, r.l as requested from {{subtitle_tracks}} t, (values ('en'), ('ja'), ('de')) r(l) where {_MATCH.replace('L', 'r.l')}
           qualify row_number() over (partition by media_id, r.l order by is_auto,
             case ext when 'vtt' then 0 when 'srt' then 1 when 'ass' then 3 else 6 end, ordinal) = 1),
         j as (select w.media_id, w.requested, ordinal, ext, case when ordinal is null then 'Requested subtitle language ''' || w.requested || ''' not available' end as warning
           from w left join m using (media_id, requested))
       select *, bool_or(ordinal is null) over (partition by media_id) as should_fail from j""",
)
def _(t):
    rows = subtitles.subtitle_policy(
        t.subtitle_tracks, t.subtitle_tracks, ["en", "ja", "de"], "vtt", include_auto=True, strict=True
    )
    return rows.select("media_id", "requested", "ordinal", "ext", "warning", "should_fail")


@query(
    "U7_merge_subtitle_maps",
    """select media_id, language, string_agg(url, ' ' order by is_auto, ordinal) as urls from {subtitle_tracks} group by 1, 2""",
)
def _(t):
    media = _maps(t)
    # The right map holds the left one's tracks again; these are dropped.
    doubled = F.when(F.col("subtitles").isNull(), F.col("automatic_captions")).otherwise(
        subtitles.merge_subtitle_maps("subtitles", "automatic_captions")
    )
    merged = media.select("media_id", subtitles.merge_subtitle_maps("subtitles", doubled).alias("m"))
    rows = merged.select("media_id", F.explode("m").alias("language", "ts"))
    return rows.select("media_id", "language", F.array_join(F.transform("ts", lambda x: x["url"]), " ").alias("urls"))


# --- B7, B11: nested text -------------------------------------------------------------------------------------


@query(
    "B7_decode_text_fields",
    """select media_id, title || ' & "x"' as title, webpage_url || '?a=1&b=2' as webpage_url, '&amp;' || id as id, uploader || ' <3' as tag,
         webpage_url || '?c&d' as thumbnail from {media}""",
)
def _(t):
    m = t.media
    raw = m.select(
        "media_id",
        F.concat("title", F.lit(" &amp; &quot;x&quot;")).alias("title"),
        F.concat("webpage_url", F.lit("?a=1&amp;b=2")).alias("webpage_url"),
        F.concat(F.lit("&amp;"), "id").alias("id"),
        F.array(F.concat("uploader", F.lit(" &lt;3"))).alias("tags"),
        F.array(F.struct(F.concat("webpage_url", F.lit("?c&#38;d")).alias("url"))).alias("thumbnails"),
    )
    decoded = catalog.decode_text_fields(raw)
    return decoded.select(
        "media_id", "title", "webpage_url", "id", F.get("tags", F.lit(0)).alias("tag"), F.get("thumbnails", F.lit(0))["url"].alias("thumbnail")
    )


@query(
    "B11_explode_thumbnails",
    """select media_id, 't' || media_id || case i when 0 then 'a' else 'c' end as url, 'jsonld_' || i as id, -i as preference
       from {media}, (values (0), (2)) x(i) where not (i = 0 and media_id % 3 = 0)""",
)
def _(t):
    k = F.col("media_id")
    base = F.concat(F.lit("t"), k.cast("string"))
    urls = F.array(F.when(k % 3 == 0, "").otherwise(F.concat(base, F.lit("a"))), F.lit(""), F.concat(base, F.lit("c")))
    return catalog.explode_thumbnails(t.media.select("media_id", urls.alias("urls")), "urls", ["media_id"])
