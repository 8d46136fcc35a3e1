"""Metadata and media references out of page sources.

Pages are scanned for tags, not parsed into a tree. Comments and scripts are cut out first where only markup
counts. Patterns that look for one thing after another are split into steps, so no page is scanned twice from the
same place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, let, running_count
from mediacat.functions.html import decode_html_entities, trim_space
from mediacat.functions.time import parse_duration, parse_iso_date
from mediacat.functions.url import ext_from_mime, is_media_content_type, media_ext_from_url, url_join
from mediacat.operators.dispatch import same_origin

# The age of the adult label, hosts of embedded players.
ADULT_AGE = 18
PLAYER_HOSTS = (
    "youtube.com youtu.be player.vimeo.com dailymotion.com twitch.tv facebook.com streamable.com vidyard.com "
    "wistia.com brightcove.net"
).split()
LOW, MEDIUM, HIGH = 0, 1, 2


def markup(html: Column | str) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(
        as_col(html), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " "
    )


def tags(source: Column, name: str) -> Column:
    """All start tags of a name, in order."""
    return F.regexp_extract_all(source, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def attr(tag: Column, name: str) -> Column:
    """An attribute's value, entities decoded; NULL if the tag does not have it."""
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    def value(t: Column) -> Column:
        found = F.concat(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])
        return F.when(t.rlike(pattern), decode_html_entities(found))

    return let(tag, value)


def _first_meta(metas: Column, key: str, name: str) -> Column:
    """The content of the first meta tag whose ``key`` attribute is ``name``, if it has one."""
    same = F.filter(metas, lambda t: (attr(t, key) == name) & attr(t, "content").isNotNull())
    content = trim_space(attr(F.get(same, F.lit(0)), "content"))
    return F.nullif(content, F.lit(""))


def _text_of(source: Column, name: str) -> Column:
    inner = F.regexp_extract(source, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    text = decode_html_entities(F.regexp_replace(inner, "<[^>]*>", ""))
    return F.nullif(trim_space(text), F.lit(""))


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description and thumbnail of a page, from the most specific source that has one."""
    staged = pages.withColumn("_m", markup(html)).withColumn("_t", tags(F.col("_m"), "meta"))
    m, t = F.col("_m"), F.col("_t")
    title = F.coalesce(
        _first_meta(t, "property", "og:title"),
        _first_meta(t, "name", "twitter:title"),
        _text_of(m, "title"),
        _text_of(m, "h1"),
    )
    description = F.coalesce(_first_meta(t, "property", "og:description"), _first_meta(t, "name", "description"))
    thumbnail = F.coalesce(_first_meta(t, "property", "og:image"), _first_meta(t, "name", "twitter:image"))
    return staged.select(
        *[c for c in pages.columns if c != html],
        title.alias("title"),
        description.alias("description"),
        thumbnail.alias("thumbnail"),
    )


def age_limit(html: Column | str) -> Column:
    """The highest age any marker of adult content gives; the label in a meta tag settles it."""
    h = as_col(html)
    meta = h.rlike(r'(?i)<meta\s+name="rating"\s+content="RTA-5042-1996-1400-1577-RTA"')
    label = h.contains('Proudly Labeled <a href="http://www.rtalabel.org/" title="Restricted to Adults">RTA</a>')
    stated = F.regexp_extract(h, r">[^<]*you acknowledge you are at least (\d+) years old", 1)
    age = stated.try_cast("int")
    record = h.rlike(r">\s*(?:18\s+U(?:\.S\.C\.|SC)\s+)?(?:§+\s*)?2257\b")
    highest = F.greatest(
        F.when(label, ADULT_AGE),
        F.when(stated != "", F.when(age < 256, age).otherwise(ADULT_AGE)),
        F.when(record, ADULT_AGE),
    )
    return F.when(meta, ADULT_AGE).otherwise(highest)


# --- JSON-LD --------------------------------------------------------------------------------------------------


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _text(v: Column, key: str) -> Column:
    """A string member; other types count as missing."""
    return F.when(F.schema_of_variant(_get(v, key)) == "STRING", _get(v, key, "string"))


def _is_video(v: Column) -> Column:
    one = F.coalesce(_text(v, "@type") == "VideoObject", F.lit(False))
    return one | F.coalesce(F.array_contains(_get(v, "@type", "array<string>"), "VideoObject"), F.lit(False))


def _first_video(html: Column) -> Column:
    blocks = F.regexp_extract_all(
        html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script"""), F.lit(1)
    )
    roots = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    members = F.transform(
        roots, lambda v: F.filter(F.coalesce(_get(v, "@graph", "array<variant>"), F.array(v)), _is_video)
    )
    return F.when(html.contains("ld+json"), F.get(F.flatten(members), F.lit(0)))


def _count(video: Column, action: str) -> Column:
    statistics = _get(video, "interactionStatistic")
    entries = F.coalesce(F.try_variant_get(statistics, "$", "array<variant>"), F.array(statistics))

    def fits(e: Column) -> Column:
        kinds = (
            _text(e, "@type") == action,
            _text(e, "interactionType").contains(action),
            _text(_get(e, "interactionType"), "@type") == action,
        )
        return F.coalesce(kinds[0], F.lit(False)) | F.coalesce(kinds[1], F.lit(False)) | F.coalesce(kinds[2], F.lit(False))

    first = F.get(F.filter(F.filter(entries, lambda e: e.isNotNull()), fits), F.lit(0))
    shown = F.btrim(_get(first, "userInteractionCount", "string"))
    return F.when(shown.rlike(r"^\+?\d+$"), shown.try_cast("long"))


def _list(video: Column, key: str, split: bool) -> Column:
    single = _text(video, key)
    parts = F.filter(F.transform(F.split(single, ","), trim_space), lambda t: t != "") if split else F.array(single)
    return F.when(single.isNotNull(), parts).otherwise(_get(video, key, "array<string>"))


def thumbnail_urls(video: Column) -> Column:
    single = _text(video, "thumbnailUrl")
    inner = _text(_get(video, "thumbnailUrl"), "url")
    return (
        F.when(single.isNotNull(), F.array(single))
        .when(_get(video, "thumbnailUrl", "array<string>").isNotNull(), _get(video, "thumbnailUrl", "array<string>"))
        .when(inner.isNotNull(), F.array(inner))
    )


def json_ld_videos(pages: DataFrame, html: str = "html") -> DataFrame:
    """The first video a page describes in JSON-LD; pages without one have no row."""
    found = pages.withColumn("_v", _first_video(F.col(html))).where(F.col("_v").isNotNull())
    v = F.col("_v")
    return found.select(
        *[c for c in pages.columns if c != html],
        _text(v, "name").alias("name"),
        _text(v, "description").alias("description"),
        parse_duration(_text(v, "duration")).alias("duration"),
        parse_iso_date(_text(v, "uploadDate")).alias("upload_date"),
        _text(v, "contentUrl").alias("content_url"),
        _text(v, "encodingFormat").alias("encoding_format"),
        _text(v, "embedUrl").alias("embed_url"),
        thumbnail_urls(v).alias("thumbnail_urls"),
        _count(v, "WatchAction").alias("view_count"),
        _count(v, "LikeAction").alias("like_count"),
        _list(v, "keywords", True).alias("tags"),
        _list(v, "genre", False).alias("categories"),
    )


# --- detection ------------------------------------------------------------------------------------------------


def _row(
    raw: Column,
    confidence: int,
    source: Column | str,
    declared: Column | None = None,
    mime: Column | None = None,
    quality: Column | None = None,
    once: bool = False,
) -> Column:
    """A reference as a page spells it. ``declared`` is an extension that goes before the URL's own, ``mime`` one that
    goes after it; ``once`` drops the row if the strategy has found the URL before."""
    none = F.lit(None).cast("string")
    return F.struct(
        raw.alias("raw"),
        (none if declared is None else declared).alias("declared"),
        (none if mime is None else mime).alias("mime"),
        (none if quality is None else quality).alias("quality"),
        F.lit(confidence).alias("confidence"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        F.lit(once).alias("once"),
    )


_ROWS = (
    "array<struct<raw:string,declared:string,mime:string,quality:string,confidence:int,source:string,once:boolean>>"
)


def _none() -> Column:
    return F.array().cast(_ROWS)


def _each(urls: Column, confidence: int, source: str) -> Column:
    return F.transform(urls, lambda u: _row(u, confidence, source, once=True))


def _resolvable(raw: Column) -> Column:
    text = trim_space(raw)
    return F.coalesce((text != "") & ~text.startswith("data:") & ~text.startswith("javascript:"), F.lit(False))


def _steps(html: Column, *patterns: str) -> Column:
    """Group 1 of the last pattern wherever all patterns follow one another, in one scan over the page."""
    tokens = F.regexp_extract_all(html, F.lit("|".join(f"(?:{p})" for p in _without_groups(patterns))), F.lit(0))
    last = len(patterns) - 1
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        state = acc["state"]
        advanced = state
        for i, p in enumerate(_without_groups(patterns[:-1])):
            advanced = F.when((state == i) & token.rlike(f"^(?:{p})$"), i + 1).otherwise(advanced)
        hit = (state == last) & token.rlike(f"^(?:{_without_groups(patterns[-1:])[0]})$")
        found = F.when(hit, F.concat(acc["found"], F.array(F.regexp_extract(token, patterns[-1], 1)))).otherwise(acc["found"])
        return F.struct(F.when(hit, 0).otherwise(advanced).alias("state"), found.alias("found"))

    return F.aggregate(tokens, start, step)["found"]


def _without_groups(patterns: Sequence[str]) -> list[str]:
    return [p.replace("([^", "(?:[^") for p in patterns]


# What announces a player's configuration, and its keys.
_FILE = r"""["']?file["']?\s*:\s*["']([^"']+)["']"""
_JW = {
    "jwplayer.setup": (r"""jwplayer\s*\(\s*["']?\w+["']?\s*\)\s*\.\s*setup\s*\(\s*\{""", _FILE),
    "jwplayer.options": (r"(?:JWPlayerOptions|jwConfig|playerInstance)\s*=\s*\{", _FILE),
    "jwplayer.flashvars": (
        r"""flashvars\s*[=:]\s*[{"]""",
        r"""["']?file["']?\s*[=:]\s*["']([^"']+)["']""",
    ),
}
_JW_MARKERS = {
    "jwplayer.setup": "jwplayer",
    "jwplayer.options": "JWPlayerOptions|jwConfig|playerInstance",
    "jwplayer.flashvars": "flashvars",
}
_VIDEOJS = (
    r"""videojs\s*\(\s*["']?\w+["']?""",
    r"sources\s*:\s*\[\s*\{",
    r"""src\s*:\s*["']([^"']+)["']""",
)
_DATA_SETUP = (r"data-setup\s*=\s*'", r""""src"\s*:\s*"([^"]+)\"""")
_JS_PARAMETER = (
    r"""(?:file|source|video_url|videoUrl|videoSrc|mp4|hls_url)\s*[:=]\s*["']"""
    r"""(https?://[^"'\s]+\.(?:mp4|m3u8|webm|flv|mkv|mov)(?:\?[^"'\s]*)?)["']"""
)
_DIRECT_LINK = r"""["'](https?://[^"'\s]+\.(?:mp4|m3u8|webm)(?:\?[^"'\s]*)?)["']"""
_NOT_MEDIA = "/thumb|/poster|/preview|/pixel|/beacon|/track"
MIN_LINK = 30
_SOURCE_TYPES = {
    "video/mp4": "mp4",
    "video/webm": "webm",
    "audio/webm": "webm",
    "video/ogg": "ogg",
    "audio/ogg": "ogg",
    "video/x-flv": "flv",
    "video/x-matroska": "mkv",
    "video/quicktime": "mov",
    "video/mp2t": "ts",
    "audio/mpeg": "mp3",
    "audio/mp4": "m4a",
    "audio/wav": "wav",
    "audio/flac": "flac",
    "application/vnd.apple.mpegurl": "m3u8",
    "application/x-mpegurl": "m3u8",
    "application/dash+xml": "mpd",
}


def _detect_json_ld(p) -> Column:
    # Only the bytes themselves count; a player's page (embedUrl) is no media.
    row = _row(
        _text(p["video"], "contentUrl"), HIGH, "json-ld:contentUrl", mime=ext_from_mime(_text(p["video"], "encodingFormat"))
    )
    return F.when(p["video"].isNotNull(), F.array(row))


def bind_og(metas: Column) -> Column:
    """Roots of ``og:video`` and ``og:audio`` with the secure URL and type that follow them.

    A property belongs to the last root of its kind before it. A secure URL before any root is a root itself; a type
    before any root goes to every root of its kind without one.
    """
    raw = F.transform(metas, lambda t: F.struct(attr(t, "property").alias("p"), attr(t, "content").alias("content")))
    known = F.filter(
        raw, lambda t: t["content"].isNotNull() & t["p"].rlike("^og:(video|audio)(:url|:secure_url|:type)?$")
    )
    og = F.transform(
        known,
        lambda t, i: F.struct(
            i.alias("i"),
            F.regexp_extract(t["p"], "^og:(video|audio)", 1).alias("kind"),
            F.regexp_extract(t["p"], "(secure_url|type)$", 1).alias("role"),
            t["content"].alias("content"),
        ),
    )
    both = let(og, lambda tags_: F.concat(*[let(F.filter(tags_, lambda t: t["kind"] == kind), _og_of_kind) for kind in ("video", "audio")]))  # noqa: B023
    return F.transform(F.array_sort(both), lambda r: F.struct(r["kind"].alias("kind"), r["root"].alias("root"), r["secure_url"].alias("secure_url"), r["type"].alias("type")))


def _og_of_kind(og: Column) -> Column:
    """The roots among the tags of one kind, by their place, with what is bound to them.

    Each tag gets the number of roots up to it; the last tag of each number and role is found by sorting.
    """
    first = F.array_min(F.transform(F.filter(og, lambda t: t["role"] != "type"), lambda t: t["i"]))

    def roots_of(first: Column) -> Column:
        opens = lambda t: (t["role"] == "") | (t["i"] == first)
        numbers = running_count(F.transform(og, opens))
        return let(numbers, lambda n: _og_bound(F.zip_with(og, n, lambda t, k: F.struct(k.alias("n"), opens(t).alias("opens"), t.alias("t")))))

    return F.when(first.isNotNull(), let(first, roots_of)).otherwise(F.array())


def _og_bound(numbered: Column) -> Column:
    """Roots with the last secure URL and type of their number; types before any root are those of all without one."""
    roots = F.filter(numbered, lambda x: x["opens"])

    def last_of(role: str) -> Column:
        """The last content of the role by number of root, from 0: one element for each."""
        place = lambda n: F.struct(n.alias("n"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("content"))
        said = F.filter(numbered, lambda x: (x["t"]["role"] == role) & ~x["opens"])
        if role == "type":  # an empty one says nothing
            said = F.filter(said, lambda x: F.btrim(x["t"]["content"]) != "")
        tags_ = F.transform(said, lambda x: F.struct(x["n"].alias("n"), x["t"]["i"].alias("i"), x["t"]["content"].alias("content")))
        placed = F.concat(F.array(place(F.lit(0))), F.transform(roots, lambda x: place(x["n"])), tags_)
        ends = let(F.array_sort(placed), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["n"] != x["n"], F.lit(True))))
        return F.transform(ends, lambda x: x["content"])

    def bound(secure: Column, types: Column) -> Column:
        return F.transform(
            roots,
            lambda x: F.struct(
                x["t"]["i"].alias("i"),
                x["t"]["kind"].alias("kind"),
                x["t"]["content"].alias("root"),
                F.get(secure, x["n"]).alias("secure_url"),
                F.coalesce(F.get(types, x["n"]), F.get(types, F.lit(0))).alias("type"),
            ),
        )

    return let(last_of("secure_url"), lambda secure: let(last_of("type"), lambda types: bound(secure, types)))


def _detect_open_graph(p) -> Column:
    media = F.filter(bind_og(p["metas"]), lambda e: e["type"].isNull() | is_media_content_type(e["type"]))
    rows = F.transform(
        media,
        lambda e: _row(
            F.when(_resolvable(e["secure_url"]), e["secure_url"]).otherwise(e["root"]),
            HIGH,
            F.concat(F.lit("og:"), e["kind"]),
            mime=ext_from_mime(e["type"]),
        ),
    )
    return F.when(p["html"].contains("og:"), rows)


def _detect_twitter(p) -> Column:
    name = "twitter:player:stream"
    own = F.filter(p["metas"], lambda t: (attr(t, "name") == name) | (attr(t, "property") == name))
    return F.when(p["html"].contains(name), F.transform(own, lambda t: _row(attr(t, "content"), MEDIUM, name)))


def _detect_jw(p) -> Column:
    found = []
    for source, steps in _JW.items():
        here = p["html"].rlike(_JW_MARKERS[source])
        found.append(F.when(here, _each(_steps(p["html"], *steps), MEDIUM, source)).otherwise(_none()))
    return F.concat(*found)


# The variables that hold URLs; each may have one with "_text" after its name.
_KVS_URLS = ("video_url", "video_alt_url", "video_alt_url2", "video_alt_url3", "video_alt_url4", "video_alt_url5")


def _detect_kvs(p) -> Column:
    loaded = p["html"].rlike(r"""<script[^>]+src=["'][^"']*kt_player\.js""")
    block = F.regexp_extract(p["html"], r"(?:var\s+)?flashvars\s*=\s*\{([^}]*)\}", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"\w+\s*:\s*'[^']*'"), F.lit(0))
    entries = F.transform(
        pairs,
        lambda t: F.struct(
            F.regexp_extract(t, r"^(\w+)", 1).alias("key"), F.regexp_extract(t, "'([^']*)'", 1).alias("value")
        ),
    )
    names = F.array(*[F.lit(k) for k in _KVS_URLS])

    def rows(variables: Column) -> Column:
        def value(key: Column) -> Column:
            same = F.filter(variables, lambda e: e["key"] == key)
            return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(same, lambda e: e["value"])), -1)

        def row(key: Column) -> Column:
            source = F.when(key == _KVS_URLS[0], "kvs.video_url").otherwise("kvs.video_alt_url")
            return _row(value(key), MEDIUM, source, quality=value(F.concat(key, F.lit("_text"))))

        return F.transform(names, row)

    return F.when(p["html"].contains("kt_player.js") & loaded, let(entries, rows))


def _detect_videojs(p) -> Column:
    setup = _each(_steps(p["html"], *_VIDEOJS), MEDIUM, "videojs")
    data = _each(_steps(p["html"], *_DATA_SETUP), MEDIUM, "videojs.data-setup")
    return F.when(p["html"].contains("videojs") | p["html"].contains("data-setup"), F.concat(setup, data))


def _detect_js_parameters(p) -> Column:
    return _each(F.regexp_extract_all(p["html"], F.lit(_JS_PARAMETER), F.lit(1)), LOW, "js.param")


def _detect_html5(p) -> Column:
    blocks = F.regexp_extract_all(p["markup"], F.lit(r"(?is)<video\b[^>]*>(?:.*?)(?:</video\s*>|\z)"), F.lit(0))

    def of_source(tag: Column) -> Column:
        quality = F.coalesce(attr(tag, "label"), attr(tag, "data-quality"))
        return _row(attr(tag, "src"), MEDIUM, "video>source", _by_type(attr(tag, "type")), quality=quality)

    def of_block(b: Column) -> Column:
        own = _row(attr(F.get(tags(b, "video"), F.lit(0)), "src"), MEDIUM, "video[src]")
        return F.concat(F.array(own), F.transform(tags(b, "source"), of_source))

    # Sources outside of any <video> count where none inside has their URL.
    loose = F.transform(
        tags(p["markup"], "source"),
        lambda tag: _row(attr(tag, "src"), LOW, "source", _by_type(attr(tag, "type")), once=True),
    )
    rows = F.concat(F.flatten(F.transform(blocks, of_block)), loose)
    return F.when(p["markup"].rlike("(?i)<(?:video|source)\\b"), rows)


def _by_type(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _SOURCE_TYPES.items() for x in pair])
    return F.try_element_at(table, F.lower(mime))


def _detect_direct_links(p) -> Column:
    urls = F.regexp_extract_all(p["html"], F.lit(_DIRECT_LINK), F.lit(1))
    likely = F.filter(urls, lambda u: ~F.lower(u).rlike(_NOT_MEDIA) & (F.octet_length(u) > MIN_LINK))
    return _each(likely, LOW, "link_scan")


# The strategies in their order; the place in it breaks ties of confidence. 8 is the advisory scan for players.
STRATEGIES: dict[str, tuple[int, Callable]] = {
    "json_ld": (0, _detect_json_ld),
    "open_graph": (1, _detect_open_graph),
    "twitter_player": (2, _detect_twitter),
    "jw_player": (3, _detect_jw),
    "kvs_player": (4, _detect_kvs),
    "video_js": (5, _detect_videojs),
    "js_parameters": (6, _detect_js_parameters),
    "html5_video": (7, _detect_html5),
    "direct_links": (9, _detect_direct_links),
}
_registered: dict[str, Callable[[dict[str, Column]], Column]] = {}


def register_strategy(name: str, detect: Callable[[dict[str, Column]], Column]) -> None:
    """Add a strategy after the built-in ones.

    ``detect`` gets the staged columns of a page (``url``, ``html``, ``markup``, ``metas``, ``base``, ``video``) and gives
    an array of ``media_row`` or NULL; all strategies are parts of one projection.
    """
    _registered[name] = detect


def media_row(url: Column, ext: Column | None = None, quality: Column | None = None, confidence: int = LOW, source: str = "") -> Column:
    """A reference as strategies give it; the extension is taken from the URL where there is none."""
    return _row(url, confidence, source, declared=ext, quality=quality)


def unregister_strategy(name: str) -> None:
    _registered.pop(name, None)


def base_url(page_url: Column, source: Column) -> Column:
    href = attr(F.get(F.filter(tags(source, "base"), lambda t: attr(t, "href").isNotNull()), F.lit(0)), "href")
    return F.coalesce(url_join(page_url, href), page_url)


def detections(pages: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Every media reference any strategy finds: one scan of the pages, one row per reference.

    ``pages`` has ``page_id, url, html``.
    """
    staged = pages.select("page_id", F.col("url").alias("_url"), "html", markup("html").alias("_m"))
    staged = staged.withColumns(
        {
            "_metas": F.when(F.col("html").rlike("og:|twitter:"), tags(F.col("_m"), "meta")),
            "_base": F.when(F.col("_m").rlike("(?i)<base\\b"), base_url(F.col("_url"), F.col("_m"))).otherwise(F.col("_url")),
            "_video": _first_video(F.col("html")),
        }
    )
    p = {"html": F.col("html"), "markup": F.col("_m"), "metas": F.col("_metas"), "base": F.col("_base"), "video": F.col("_video"), "url": F.col("_url")}
    added = {name: (len(STRATEGIES) + 1 + i, detect) for i, (name, detect) in enumerate(_registered.items())}
    found = []
    for name, (number, detect) in {**STRATEGIES, **added}.items():
        if only is None or name in only:
            found.append(_numbered(F.coalesce(detect(p).cast(_ROWS), _none()), number))
    rows = let(F.concat(*found), lambda all_: let(_resolved_rows(F.col("_base"), all_), _without_repeats))
    # An outer explode with a filter on its result: the filter an inner one implies would compute the rows twice.
    exploded = staged.select("page_id", F.explode_outer(rows).alias("_r")).where(F.col("_r").isNotNull())
    return exploded.select("page_id", *[F.col(f"_r.{c}").alias(c) for c in _RESULT])


_RESULT = ("url", "ext", "quality", "confidence", "source", "strategy", "seq")


def _numbered(rows: Column, strategy: int) -> Column:
    return F.transform(
        rows,
        lambda r, i: F.struct(r.alias("row"), F.lit(strategy).alias("strategy"), i.cast("long").alias("seq")),
    )


def _resolved_rows(base: Column, found: Column) -> Column:
    """All references resolved against the page, those that cannot be left out."""

    def resolved(f: Column) -> Column:
        r = f["row"]
        return let(
            url_join(base, r["raw"]),
            lambda url: F.struct(
                url.alias("url"),
                F.coalesce(r["declared"], media_ext_from_url(url), r["mime"]).alias("ext"),
                r["quality"].alias("quality"),
                r["confidence"].alias("confidence"),
                r["source"].alias("source"),
                f["strategy"].alias("strategy"),
                f["seq"].alias("seq"),
                r["once"].alias("once"),
            ),
        )

    return F.filter(F.transform(found, resolved), lambda r: r["url"].isNotNull())


def _without_repeats(rows: Column) -> Column:
    """Rows marked ``once`` only where their strategy has no earlier row of the URL; sorted twice, not compared pairwise."""
    key = lambda r: F.concat_ws(" ", r["strategy"].cast("string"), r["url"])
    keyed = F.array_sort(F.transform(rows, lambda r, i: F.struct(key(r).alias("key"), i.alias("at"))))

    def marked(by_key: Column) -> Column:
        new = lambda j: (j == 0) | (F.get(by_key, j - 1)["key"] != F.get(by_key, j)["key"])
        return F.array_sort(F.transform(by_key, lambda k, j: F.struct(k["at"].alias("at"), new(j).alias("first"))))

    return let(let(keyed, marked), lambda first: F.filter(rows, lambda r, i: ~r["once"] | F.get(first, i)["first"]))


def dedup_by_confidence(rows: DataFrame) -> DataFrame:
    """Per page and URL the most confident row, of these the one of the earliest strategy."""
    keys = ["page_id", "url"]
    row = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    best = rows.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col("confidence"), F.col("strategy"), F.col("seq"))).alias("_r"))
    return best.select(*keys, "_r.*")


def detect_media(pages: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    return dedup_by_confidence(detections(pages, only))


def strategy_yield(rows: DataFrame) -> DataFrame:
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def embedded_players(pages: DataFrame) -> DataFrame:
    """Frames of known video hosts, as advice; they are never media themselves."""
    frames = pages.where(F.lower("html").contains("<iframe")).select(
        "page_id", F.posexplode(tags(markup("html"), "iframe")).alias("pos", "_t")
    )
    src = attr(F.col("_t"), "src")
    host = F.coalesce(*[F.when(src.contains(h), F.lit(h)) for h in PLAYER_HOSTS])
    return frames.select("page_id", "pos", host.alias("host"), src.alias("src")).where(F.col("host").isNotNull())


def bind_og_properties(pages: DataFrame) -> DataFrame:
    """The bound OpenGraph roots of each page as rows."""
    bound = bind_og(tags(markup("html"), "meta"))
    return pages.where(F.col("html").contains("og:")).select("page_id", F.posexplode(bound).alias("pos", "_e")).select(
        "page_id", "pos", "_e.*"
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Links of a page to its own origin, resolved, in order."""
    links = pages.select("page_id", "url", F.posexplode(tags(markup("html"), "a")).alias("pos", "_t"))
    resolved = links.select("page_id", "url", "pos", url_join("url", attr(F.col("_t"), "href")).alias("link"))
    own = resolved.where(F.coalesce(same_origin("link", "url"), F.lit(False)))
    return own.select("page_id", "pos", "link")
