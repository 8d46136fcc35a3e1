"""Queries over format tables: shaping, filters, ranking, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.operators import catalog, predicates, ranking, selection
from mediacat.operators.predicates import FormatFilter, all_filters, format_filter
from mediacat.operators.ranking import SortField
from mediacat.operators.selection import AllFormats, Group, Merge, Mergeable, Pick
from mediacat.plans.registry import query

# --- SQL shared by several checks -----------------------------------------------------------------------------

_V = "nullif(vcodec, 'none')"
_A = "nullif(acodec, 'none')"
_HV, _HA = f"({_V} is not null)", f"({_A} is not null)"
_UNKNOWN = f"(not {_HV} and not {_HA})"
_NOT_DRM = "not coalesce(has_drm, false)"


def _rank_text(c: str) -> str:
    """SQL of the first eight bytes as a number; all the view's texts are ASCII."""
    terms = [
        f"(case when length({c}) > {i} then ascii(substr({c}, {i + 1}, 1)) else 0 end)::bigint * {256 ** (7 - i)}::bigint"
        for i in range(8)
    ]
    return f"({' + '.join(terms)})::double"


def _tier(c: str, patterns) -> str:
    n = len(patterns)
    whens = " ".join(f"when regexp_matches(lower({c}), '{p}') then {n - i}" for i, p in enumerate(patterns))
    return f"(case {whens} else 0 end)"


_NUM = "(case when {0} is null then -10 else 0 end, coalesce({0}, 0)::double)"
_SQL_KEYS = [
    f"(case when {_HV} then 1 else 0 end)",
    "coalesce(quality::double, -1)",
    f"(case when language is null then -1 else {_rank_text('language')} end)",
    "coalesce(height::double, -1)",
    "coalesce(fps, -1)",
    "(case when dynamic_range like '%DV%' then 5 when dynamic_range like '%HDR10+%' then 4 when dynamic_range like '%HDR10%'"
    " then 3 when dynamic_range like '%HLG%' then 2 else 1 end)",
    f"(case when {_HV} then {_tier('vcodec', ranking.VIDEO_TIERS)} else -1 end)",
    f"(case when {_HA} then {_tier('acodec', ranking.AUDIO_TIERS)} else -1 end)",
    "coalesce(filesize, filesize_approx, -1)::double",
    "coalesce(tbr, -1)",
    "coalesce(asr::double, -1)",
    "(case protocol when 'https' then 5 when 'http' then 4 when 'm3u8_native' then 3 when 'm3u8' then 2"
    " when 'http_dash_segments' then 1 else 0 end)",
    _rank_text("ext"),
    f"(case when {_HA} then 1 else 0 end)",
    f"(case when container is null then -1 else {_rank_text('container')} end)",
    _rank_text("format_id"),
]
_DESC = ", ".join(f"{k} desc" for k in _SQL_KEYS)
_ASC = ", ".join(f"{k} asc" for k in _SQL_KEYS)


def _best_sql(where: str, direction: str = "best", rn: int | None = None, cols: str = "format_id, ordinal") -> str:
    if direction == "best":
        order = f"{_DESC}, ordinal {'desc' if rn is None else 'asc'}"
    else:
        order = f"{_ASC}, ordinal asc"
    return (
        f"select media_id, {cols} from {{formats}} where {where} "
        f"qualify row_number() over (partition by media_id order by {order}) = {rn or 1}"
    )


# --- B: shaping -----------------------------------------------------------------------------------------------


def _nested(t, n, fields):
    """Media records with an array of ``n`` formats (none: NULL), all from the columns of one order."""
    numbers = F.sequence(F.lit(1).cast("long"), n)
    row = F.col("o_orderkey").alias("media_id")
    formats = F.when(n > 0, F.transform(numbers, lambda i: F.struct(*fields(i)))).alias("formats")
    return t.orders.select(row, formats, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("duration"))


def _format_id(i):
    return F.concat(F.lit("f"), i.cast("string"), F.lit("-"), F.col("o_custkey").cast("string")).alias("format_id")


@query(
    "B1_explode_formats",
    """select o_orderkey as media_id, (i - 1)::int as ordinal, 'f' || i || '-' || o_custkey as format_id from orders, range(1, 4) r(i) where i <= o_orderkey % 4
       union all select o_orderkey, null, null from orders where o_orderkey % 4 = 0""",
)
def _(t):
    media = _nested(t, F.col("o_orderkey") % 4, lambda i: [_format_id(i)]).select("media_id", "formats")
    return catalog.explode_formats(media, ["media_id"])


@query(
    "B2_stream_flags",
    f"select media_id, ordinal, {_V} as vcodec, {_A} as acodec, {_HV} as has_video, {_HA} as has_audio, "
    f"{_UNKNOWN} as codecs_unknown from {{formats}}",
)
def _(t):
    flags = catalog.stream_flags(t.formats)
    return flags.select("media_id", "ordinal", "vcodec", "acodec", "has_video", "has_audio", "codecs_unknown")


@query(
    "B3_resolved_filesize",
    "select media_id, ordinal, coalesce(filesize, filesize_approx) as size from {formats}",
)
def _(t):
    return t.formats.select("media_id", "ordinal", catalog.resolved_filesize().alias("size"))


@query(
    "B4_resolution_string",
    "select media_id, ordinal, width || 'x' || height as resolution from {formats}",
)
def _(t):
    return t.formats.select("media_id", "ordinal", catalog.resolution_string().alias("resolution"))


@query(
    "B5_protocol_flags",
    """select media_id, ordinal,
         protocol in ('m3u8', 'm3u8_native') or contains(url, '.m3u8') or ext = 'hls' as is_hls,
         protocol = 'http_dash_segments' or coalesce(contains(container, 'dash'), false) as is_dash
       from {formats}""",
)
def _(t):
    return catalog.protocol_flags(t.formats).select("media_id", "ordinal", "is_hls", "is_dash")


@query(
    "B6_propagate_duration",
    """select o_orderkey as media_id, count(*) as formats, count(coalesce(own, d)) as with_duration, round(sum(coalesce(own, d)), 3) as total
       from (select o_orderkey, case when i % 2 = 0 then i * 10.5::double end as own, case when o_orderkey % 5 <> 0 then o_totalprice end as d
         from orders, range(1, 6) r(i) where i <= o_orderkey % 4 + 1) group by 1""",
)
def _(t):
    own = lambda i: F.when(i % 2 == 0, i * 10.5).cast("double").alias("duration")
    media = _nested(t, F.col("o_orderkey") % 4 + 1, lambda i: [_format_id(i), own(i)])
    filled = catalog.propagate_duration(media)
    known = F.filter(F.transform("formats", lambda f: f["duration"]), lambda d: d.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, d: acc + d)
    return filled.select(
        "media_id",
        F.size("formats").cast("long").alias("formats"),
        F.size(known).cast("long").alias("with_duration"),
        F.when(F.size(known) > 0, F.round(total, 3)).alias("total"),
    )


@query(
    "B8_format_listing",
    f"""select media_id, ordinal,
         coalesce(format_note, 'unknown') || case when fps > 0 and abs(fps - 30) > 1 then printf('%.0f', fps) else '' end
           as quality_text,
         coalesce(width || 'x' || height, 'N/A') as resolution,
         case when hls then 'HLS' else upper(ext) end as type,
         case when hls then coalesce(
             dur || ' (~' || case when mb >= 1024 then printf('%.1f GB', mb / 1024) else printf('%.0f MB', mb) end || ')', dur,
             '~' || case when mb >= 1024 then printf('%.1f GB', mb / 1024) else printf('%.0f MB', mb) end, 'HLS stream')
           else coalesce(printf('%.1f MB', filesize / 1048576.0::double) || coalesce(' (' || dur || ')', ''),
             printf('~%.0f MB', filesize_approx / 1048576.0::double), dur, 'Unknown') end as size,
         coalesce({_V} || '/' || {_A}, {_V} || ' (video only)', {_A} || ' (audio only)', 'Unknown')
           || case when coalesce(has_drm, false) then ' [DRM]' else '' end as codecs,
         coalesce(printf('%.0f', fps), '') as fps_text, coalesce(printf('%.0f', abr), '') as abr_text,
         coalesce(printf('%.0f', vbr), '') as vbr_text, concat_ws(', ', dynamic_range, language) as note
       from (select *, protocol in ('m3u8', 'm3u8_native') or contains(url, '.m3u8') as hls,
               coalesce(filesize, filesize_approx) / 1048576.0::double as mb,
               floor(floor(duration) / 60)::int || ':' || lpad((floor(duration) % 60)::int::varchar, 2, '0') as dur
             from {{formats}})""",
)
def _(t):
    return catalog.format_listing(t.formats)


@query(
    "B9_build_formats",
    """select media_id, ordinal, case height when 240 then 426 when 360 then 640 when 480 then 854 when 720 then 1280
         when 1080 then 1920 when 1440 then 2560 when 2160 then 3840 else height * 16 // 9 end as width,
         height || 'p' as format_note, height // 100 as quality,
         case ext when 'mp4' then 'h264' when 'webm' then 'vp9' end as vcodec,
         case ext when 'mp4' then 'aac' when 'webm' then 'opus' end as acodec, 'https' as protocol
       from (select media_id, ordinal, ext, case when media_id % 3 = 0 then height + 10 else height end as height
             from {formats})""",
)
def _(t):
    height = F.when(F.col("media_id") % 3 == 0, F.col("height") + 10).otherwise(F.col("height"))
    rows = t.formats.select("media_id", "ordinal", "format_id", "url", "ext", height.alias("height"))
    built = catalog.build_formats(rows)
    return built.select("media_id", "ordinal", "width", "format_note", "quality", "vcodec", "acodec", "protocol")


@query(
    "B10_dedup_format_ids",
    """select media_id, ordinal, format_id || case when n > 1 then '-' || n else '' end as format_id
       from (select *, row_number() over (partition by media_id, format_id order by ordinal) as n from {formats})""",
)
def _(t):
    return catalog.dedup_format_ids(t.formats.select("media_id", "ordinal", "format_id"))


@query(
    "B12_merge_records",
    """select coalesce(m.media_id, a.media_id) as media_id, coalesce(a.title, m.title) as title,
         coalesce(a.duration, m.duration) as duration, m.uploader, a.note
       from (select media_id, title, duration, uploader from {media}) m full join
         (select l_orderkey as media_id, case when min(l_linenumber) > 2 then 'renamed ' || l_orderkey end as title,
            case when max(l_tax) > 0.05 then max(l_quantity) end as duration, min(l_returnflag) as note
          from lineitem group by 1) a using (media_id)""",
)
def _(t):
    left = t.media.select("media_id", "title", "duration", "uploader")
    key = F.col("l_orderkey")
    right = (
        t.lineitem
        .groupBy(key.alias("media_id"))
        .agg(
            F.when(F.min("l_linenumber") > 2, F.concat(F.lit("renamed "), F.first(key).cast("string"))).alias("title"),
            F.when(F.max("l_tax") > 0.05, F.max("l_quantity")).alias("duration"),
            F.min("l_returnflag").alias("note"),
        )
    )
    return catalog.merge_records(left, right, ["media_id"])


@query(
    "B13_traverse_json",
    """select event_id, (props->>'$.k')::bigint as k, (props->>'$.k')::bigint as any_case,
         event_type as kind, (props->>'$.k')::bigint + user_id as total
       from events""",
)
def _(t):
    # Three shapes of the same record: nested, listed, and flat in other case.
    nested = F.concat(
        F.lit('{"data":{"items":['), F.col("props"), F.lit(',{"k":'), F.col("user_id").cast("string"),
        F.lit('}]},"KIND":"'), F.col("event_type"), F.lit('"}'),
    )
    doc = F.try_parse_json(nested)
    rows = t.events.select("event_id", doc.alias("doc"))
    every = catalog.traverse_json("doc", ("data", "items", ..., "k"), expected="long")
    return rows.select(
        "event_id",
        catalog.traverse_json("doc", ("missing", "k"), ("data", "items", 0, "k"), expected="long").alias("k"),
        catalog.traverse_json("doc", ("DATA", "Items", -2, "K"), expected="long", casesense=False).alias("any_case"),
        catalog.traverse_json("doc", ("kind",), ("KIND",), expected="string").alias("kind"),
        F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


# --- C: filters -----------------------------------------------------------------------------------------------


@query(
    "C1_numeric_filters",
    """select media_id, ordinal,
         coalesce(height >= 720, false) as f1, coalesce(abs(fps - 60) < 2.220446049250313e-16, true) as f2,
         coalesce(abs(asr - 48000) >= 2.220446049250313e-16, false) as f3, coalesce(filesize < 50000000, false) as f4,
         coalesce(not (tbr <= 4000), false) as f5, coalesce(case when abr is not null then false end, true) as f6
       from {formats}""",
)
def _(t):
    f = [
        FormatFilter("height", ">=", 720),
        FormatFilter("fps", "=", 60, missing_ok=True),
        FormatFilter("asr", "!=", 48000),
        FormatFilter("filesize", "<", 50_000_000),
        FormatFilter("tbr", "<=", 4000, negate=True),
        FormatFilter("abr", "^=", "12", missing_ok=True),
    ]
    return t.formats.select(
        "media_id", "ordinal", *[format_filter(x).alias(f"f{i}") for i, x in enumerate(f, 1)]
    )


@query(
    "C2_text_filters",
    f"""select media_id, ordinal, ext = 'mp4' as f1, coalesce(starts_with({_V}, 'avc'), false) as f2,
         coalesce(suffix({_A}, '.2'), true) as f3, contains(protocol, 'm3u8') as f4,
         regexp_matches(format_id, '^f[1-3]$') as f5, false as f6, coalesce(not ({_V} < 'avb'), false) as f7
       from {{formats}}""",
)
def _(t):
    f = [
        FormatFilter("ext", "=", "mp4"),
        FormatFilter("vcodec", "^=", "avc"),
        FormatFilter("acodec", "$=", ".2", missing_ok=True),
        FormatFilter("protocol", "*=", "m3u8"),
        FormatFilter("format_id", "~=", "^f[1-3]$"),
        FormatFilter("format_id", "~=", "(unclosed"),
        FormatFilter("vcodec", "<", "avb", negate=True),
    ]
    return t.formats.select(
        "media_id", "ordinal", *[format_filter(x).alias(f"f{i}") for i, x in enumerate(f, 1)]
    )


@query(
    "C3_missing_and_negation",
    """select media_id, ordinal from {formats}
       where coalesce(not (height < 480), true) and coalesce(not starts_with(ext, 'w'), false)""",
)
def _(t):
    f = [
        FormatFilter("height", "<", 480, missing_ok=True, negate=True),
        FormatFilter("ext", "^=", "w", negate=True),
        FormatFilter("frames", "=", 1, missing_ok=True),
    ]
    return t.formats.where(all_filters(f)).select("media_id", "ordinal")


@query("C4_drop_drm", f"select media_id, ordinal from {{formats}} where {_NOT_DRM}")
def _(t):
    return predicates.drop_drm(t.formats).select("media_id", "ordinal")


_STREAMS = {
    "any": f"({_HV} and {_HA}) or {_UNKNOWN}",
    "any_star": "true",
    "video": f"{_HV} and not {_HA}",
    "video_star": f"{_HV} or {_UNKNOWN}",
    "audio": f"{_HA} and not {_HV}",
    "audio_star": f"{_HA} or {_UNKNOWN}",
}


@query(
    "C5_stream_type_filter",
    "select media_id, ordinal, " + ", ".join(f'({v}) as "{k}"' for k, v in _STREAMS.items()) + " from {formats}",
)
def _(t):
    return t.formats.select(
        "media_id",
        "ordinal",
        *[predicates.stream_type_filter(k.split("_")[0], k.endswith("star")).alias(k) for k in _STREAMS],
    )


@query(
    "C10_language_filter",
    """select o_orderkey as media_id, count(*) filter (language = 'ja') as kept, min('f' || i || '-' || o_custkey) filter (language = 'ja') as first_id
       from (select *, case (i + o_custkey) % 3 when 0 then 'ja' when 1 then 'en' end as language from orders, range(1, 6) r(i) where i <= o_orderkey % 5 + 1) group by 1""",
)
def _(t):
    language = lambda i: F.when((i + F.col("o_custkey")) % 3 == 0, "ja").when((i + F.col("o_custkey")) % 3 == 1, "en").alias("language")
    per_media = _nested(t, F.col("o_orderkey") % 5 + 1, lambda i: [_format_id(i), language(i)])
    kept = per_media.withColumn("formats", predicates.language_filter("ja"))
    ids = F.transform("formats", lambda f: f["format_id"])
    return kept.select("media_id", F.size("formats").cast("long").alias("kept"), F.array_min(ids).alias("first_id"))


# --- E: picks of a media record -------------------------------------------------------------------------------


def _record_sql(where: str, keys: str) -> str:
    order = ", ".join(f"{k.strip()} desc nulls last" for k in keys.split(","))
    return (
        f"select media_id, format_id, ordinal from {{formats}} where {where} "
        f"qualify row_number() over (partition by media_id order by {order}, ordinal desc) = 1"
    )


@query("E1_best_format", _record_sql(f"{_HV} and {_HA}", "quality, height, tbr"))
def _(t):
    return ranking.best_format(t.formats, columns=["format_id", "ordinal"])


@query("E2_best_video", _record_sql(_HV, "quality, height, vbr"))
def _(t):
    return ranking.best_video(t.formats, columns=["format_id", "ordinal"])


@query("E3_best_audio", _record_sql(_HA, "abr"))
def _(t):
    return ranking.best_audio(t.formats, columns=["format_id", "ordinal"])


@query(
    "E14_has_combined",
    f"select media_id, bool_or({_NOT_DRM} and {_HV} and {_HA}) as has_combined from {{formats}} group by 1",
)
def _(t):
    return predicates.has_combined(t.formats)


# --- F, H: ranking --------------------------------------------------------------------------------------------


@query("F1_nth_best", _best_sql("true", rn=2))
def _(t):
    return ranking.nth(t.formats, 2).select("media_id", "format_id", "ordinal")


@query("F1_nth_worst", _best_sql(_NOT_DRM, "worst", rn=3))
def _(t):
    return ranking.nth(predicates.drop_drm(t.formats), 3, worst=True).select("media_id", "format_id", "ordinal")


_NUMBERED = f"row_number() over (partition by media_id order by {_DESC}, ordinal)"


@query(
    "H1_default_order",
    f"select media_id, ordinal, format_id, {_NUMBERED} as place from {{formats}}",
)
def _(t):
    return ranking.default_order(t.formats).select("media_id", "ordinal", "format_id", "place")


@query(
    "H2_sort_formats",
    """select media_id, ordinal, format_id, row_number() over (partition by media_id order by coalesce(height::double, 1e9), coalesce(tbr, -1) desc, ordinal) as place
       from {formats}""",
)
def _(t):
    order = (SortField("res", ascending=True), SortField("br"))
    return ranking.sort_formats(t.formats, order).select("media_id", "ordinal", "format_id", "place")


@query(
    "H3_preferred_limit",
    """select media_id, format_id, ordinal from {formats}
       qualify row_number() over (partition by media_id order by
         case when height is null then -10 when height <= 720 then 0 else -1 end desc,
         case when height is null then 0 when height <= 720 then height else -height end desc, ordinal desc) = 1""",
)
def _(t):
    return ranking.pick_best(t.formats, (SortField("res", limit=720),), columns=["format_id", "ordinal"])


@query(
    "H4_nearest",
    """select media_id, format_id, ordinal from {formats}
       qualify row_number() over (partition by media_id order by
         case when height is null then -10 else 0 end desc, coalesce(-abs(height - 600.0), 0) desc,
         case when height is null then 0 when height >= 600 then 1 else -1 end desc, ordinal desc) = 1""",
)
def _(t):
    return ranking.pick_best(t.formats, (SortField("res", limit=600, nearest=True),), columns=["format_id", "ordinal"])


@query(
    "H5_codec_tiers",
    f"""select media_id, ordinal, case when {_HV} then {_tier('vcodec', ranking.VIDEO_TIERS)} end as video_tier,
         case when {_HA} then {_tier('acodec', ranking.AUDIO_TIERS)} end as audio_tier from {{formats}}""",
)
def _(t):
    return t.formats.select(
        "media_id",
        "ordinal",
        ranking.codec_tier(catalog.codec("vcodec"), ranking.VIDEO_TIERS).alias("video_tier"),
        ranking.codec_tier(catalog.codec("acodec"), ranking.AUDIO_TIERS).alias("audio_tier"),
    )


@query(
    "H6_hdr_and_protocol_scores",
    f"select media_id, ordinal, {_SQL_KEYS[5]} as hdr, {_SQL_KEYS[11]} as protocol_score from {{formats}}",
)
def _(t):
    return t.formats.select(
        "media_id",
        "ordinal",
        ranking.hdr_score(F.col("dynamic_range")).alias("hdr"),
        ranking.protocol_score(F.col("protocol")).alias("protocol_score"),
    )


@query(
    "H7_string_rank",
    f"select p_partkey, {_rank_text('p_name')} as score, {_rank_text('p_brand')} as brand_score from part",
)
def _(t):
    return t.part.select(
        "p_partkey",
        ranking.string_rank(F.col("p_name")).alias("score"),
        ranking.string_rank(F.col("p_brand")).alias("brand_score"),
    )


@query("H8_pick_best", _best_sql(_NOT_DRM))
def _(t):
    return ranking.pick_best(predicates.drop_drm(t.formats), columns=["format_id", "ordinal"])


@query("H8_pick_worst", _best_sql(_NOT_DRM, "worst"))
def _(t):
    return ranking.pick_worst(predicates.drop_drm(t.formats), columns=["format_id", "ordinal"])


@query(
    "H9_select_all_formats",
    f"select media_id, ordinal, {_NUMBERED} as place from {{formats}} where {_NOT_DRM}",
)
def _(t):
    return ranking.select_all_formats(t.formats).select("media_id", "ordinal", "place")


@query(
    "H10_select_mergeable",
    f"""select media_id, ordinal, row_number() over (partition by media_id order by {_ASC}, ordinal) as place
        from {{formats}} where {_NOT_DRM} and ({_HV} or {_HA})""",
)
def _(t):
    return ranking.select_mergeable(t.formats).select("media_id", "ordinal", "place")


# --- H13: the pick without a sorter; the check walks the formats of an item one by one ------------------------


def _fold_sql(where: str, equal_or_better: str, cols: str) -> str:
    return f"""with recursive f as (
        select *, row_number() over (partition by media_id order by ordinal) as n from {{formats}} where {where}),
      walk as (
        select media_id, n, ordinal, format_id, {cols} from f where n = 1
        union all
        select w.media_id, x.n,
          {', '.join(f'case when {equal_or_better} then x.{c} else w.{c} end as {c}' for c in ['ordinal', 'format_id', *[y.strip() for y in cols.split(',')]])}
        from walk w join f x on x.media_id = w.media_id and x.n = w.n + 1)
      select media_id, format_id, ordinal from walk qualify row_number() over (partition by media_id order by n desc) = 1"""


def _not_worse(strict: list[str], loose: list[str]) -> str:
    """SQL of "x is at least as good as w"."""
    out = "true"
    for c in reversed(loose):
        out = f"case when w.{c} < x.{c} then true when w.{c} > x.{c} then false else {out} end"
    for c in reversed(strict):
        a, b = f"coalesce(w.{c}, -1)", f"coalesce(x.{c}, -1)"
        out = f"case when {a} < {b} then true when {a} > {b} then false else {out} end"
    return f"({out})"


@query(
    "H13_heuristic_best",
    _fold_sql(
        f"{_NOT_DRM} and {_HV}",
        _not_worse(["height"], ["vbr", "fps"]),
        "height, vbr, fps",
    ),
)
def _(t):
    rows = t.formats.where(predicates.not_drm() & catalog.has_video())
    return selection.heuristic_best(rows, "video", columns=["format_id", "ordinal"])


@query(
    "H13_heuristic_best_any",
    _fold_sql(_NOT_DRM, _not_worse(["quality", "height"], ["tbr", "fps"]), "quality, height, tbr, fps"),
)
def _(t):
    return selection.heuristic_best(predicates.drop_drm(t.formats), "any", columns=["format_id", "ordinal"])


# --- D9, F4, U2, U3: selection --------------------------------------------------------------------------------

_PAIR = f"""v as ({_best_sql(f"{_NOT_DRM} and ({_STREAMS['video_star']})")}),
  a as ({_best_sql(f"{_NOT_DRM} and {_STREAMS['audio']}")}),
  pair as (select v.media_id, 0 as part, v.format_id, v.ordinal from v join a using (media_id)
           union all select a.media_id, 1, a.format_id, a.ordinal from v join a using (media_id))"""

_BEST_WITH_FALLBACK = f"""own as ({_best_sql(f"{_NOT_DRM} and ({_STREAMS['any']})")}),
  streams as ({_best_sql(f"{_NOT_DRM} and ({_HV} or {_HA})")}),
  muxed as (select media_id from {{formats}} group by 1 having bool_or({_NOT_DRM} and {_HV} and {_HA})),
  best as (select * from own union all select * from streams
           where media_id not in (select media_id from own) and media_id not in (select media_id from muxed))"""


@query("D9_merge_video_audio", f"with {_PAIR} select * from pair")
def _(t):
    return selection.merge_video_audio(t.formats, columns=["format_id", "ordinal"])


@query(
    "F4_first_non_empty",
    f"""with b as (select media_id, ordinal, 1 as branch from {{formats}} where ext = 'webm' and height >= 1080
         union all select media_id, ordinal, 2 from {{formats}} where ext = 'mp4'
         union all select media_id, ordinal, 3 from {{formats}})
       select media_id, ordinal, branch from b qualify branch = min(branch) over (partition by media_id)""",
)
def _(t):
    f = t.formats.select("media_id", "ordinal", "ext", "height")
    branches = [(F.col("ext") == "webm") & (F.col("height") >= 1080), F.col("ext") == "mp4", F.lit(True)]
    # One scan feeds all branches.
    tagged = f.select(
        "media_id",
        "ordinal",
        F.explode(F.filter(F.array(*[F.when(c, i) for i, c in enumerate(branches, 1)]), lambda b: b.isNotNull())).alias("branch"),
    )
    return selection.first_non_empty(tagged)


@query(
    "U2_select_targets",
    f"""with {_PAIR}, {_BEST_WITH_FALLBACK},
       w as ({_best_sql(f"{_NOT_DRM} and ({_STREAMS['any_star']})", "worst")}),
       second as ({_best_sql(f"{_NOT_DRM} and ({_STREAMS['video_star']})", rn=2)})
       select media_id, 0 as target, part, format_id, ordinal from pair
       union all select media_id, 1, 0, format_id, ordinal from best
       union all select media_id, 2, 0, format_id, ordinal from w
       union all select media_id, 3, 0, format_id, ordinal from second""",
)
def _(t):
    targets = [
        (Merge(Pick("video", star=True), Pick("audio")),),
        (Pick("any"),),
        (Pick("any", worst=True, star=True),),
        (Pick("video", star=True, n=2),),
    ]
    return selection.select_targets(t.formats, targets, columns=["format_id", "ordinal"])


@query(
    "U3_select_formats",
    f"""with {_PAIR}, {_BEST_WITH_FALLBACK}
       select media_id, part, format_id, ordinal from pair
       union all select media_id, 0, format_id, ordinal from best where media_id not in (select media_id from pair)""",
)
def flagship(t):
    """Best video plus best audio, or else the best muxed format."""
    return selection.select_formats(t.formats, columns=["format_id", "ordinal"])


@query(
    "U3_select_group",
    f"""with small as ({_best_sql(f"{_NOT_DRM} and ({_STREAMS['video_star']}) and coalesce(height <= 480, false)", cols="format_id, ordinal, ext")}),
       id1 as ({_best_sql(f"{_NOT_DRM} and format_id = 'f1'", cols="format_id, ordinal, ext")}),
       g as (select *, 0 as b from small where ext = 'mp4' union all select *, 1 from id1 where ext = 'mp4'
             and media_id not in (select media_id from small where ext = 'mp4')),
       rest as (select media_id, format_id, ordinal, 2 as b from {{formats}} where {_NOT_DRM} and ({_HV} or {_HA})
             and media_id not in (select media_id from g))
       select media_id, format_id, ordinal from g union all select media_id, format_id, ordinal from rest""",
)
def _(t):
    small = Pick("video", star=True, filters=(FormatFilter("height", "<=", 480),))
    group = Group(((small,), (Pick(format_id="f1"),)), (FormatFilter("ext", "=", "mp4"),))
    return selection.select_formats(t.formats, (group, Mergeable()), columns=["format_id", "ordinal"]).drop("part")


@query(
    "U3_select_all_fallback",
    f"""with first as ({_best_sql(f"{_NOT_DRM} and ext = 'webm'")})
       select * from first union all
       select media_id, format_id, ordinal from {{formats}} where {_NOT_DRM} and media_id not in (select media_id from first)""",
)
def _(t):
    target = (Pick(ext="webm"), AllFormats())
    return selection.select_formats(t.formats, target, columns=["format_id", "ordinal"]).drop("part")
