"""DASH manifests: formats and subtitles of all periods, and the segments of their representations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, let
from mediacat.functions.numbers import parse_frame_rate, parse_sampling_rate
from mediacat.functions.time import parse_iso_duration
from mediacat.functions.url import plain_name, url_join
from mediacat.operators.net_safety import url_safety
from mediacat.operators.ordered import Running, explode_range, running

# Codecs of subtitle tracks.
TEXT_CODECS = ("stpp", "wvtt", "ttml", "dfxp")

_TEMPLATE = (
    "struct<_initialization:string,_media:string,_startNumber:bigint,_duration:double,_timescale:bigint,_presentationTimeOffset:bigint,"
    "Initialization:struct<_sourceURL:string>,"
    "SegmentTimeline:struct<S:array<struct<_t:bigint,_d:bigint,_r:bigint>>>>"
)
_LIST = "struct<Initialization:struct<_sourceURL:string>,SegmentURL:array<struct<_media:string>>>"
_PROTECTION = "array<struct<_schemeIdUri:string>>"
_REPRESENTATION = (
    "struct<_id:string,_bandwidth:bigint,_width:int,_height:int,_codecs:string,_mimeType:string,_frameRate:string,"
    f"_audioSamplingRate:string,ContentProtection:{_PROTECTION},BaseURL:array<string>,"
    f"SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST}>"
)
_ADAPTATION = (
    "struct<_mimeType:string,_codecs:string,_lang:string,_audioSamplingRate:string,"
    f"ContentProtection:{_PROTECTION},BaseURL:array<string>,SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST},"
    f"Representation:array<{_REPRESENTATION}>>"
)
_PERIOD = (
    f"struct<_start:string,_duration:string,BaseURL:array<string>,SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST},"
    f"AdaptationSet:array<{_ADAPTATION}>>"
)
MPD_SCHEMA = f"_type string, _mediaPresentationDuration string, BaseURL array<string>, Period array<{_PERIOD}>"


def period_starts(starts: Column, durations: Column) -> Column:
    """Start of each period in seconds, from its own statement or else where the former one ends; NULL if neither is known.

    Both arguments are arrays of seconds, with NULL for what a period does not state. The first period starts at 0.
    """
    states = F.zip_with(starts, durations, lambda s, d: F.struct(s.cast("double").alias("start"), d.cast("double").alias("length")))
    first = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<double>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        return let(F.coalesce(x["start"], acc["end"]), lambda at: F.struct((at + x["length"]).alias("end"), F.concat(acc["found"], F.array(at)).alias("found")))

    return F.aggregate(states, first, step, lambda acc: acc["found"])


def period_seconds(starts: Column, durations: Column, total: Column, period: Column) -> Column:
    """Length of a period: stated, or up to the next one's start, or up to the presentation's end; 0 if unknown."""
    at, following = F.get(starts, period), F.get(starts, period + 1)
    ends = F.when(period + 1 < F.size(starts), following).otherwise(total)
    return F.coalesce(F.get(durations, period), F.greatest(ends - at, F.lit(0.0)), F.lit(0.0))


def representations(manifests: DataFrame, by: str = "mpd_id", kind: str | None = None) -> DataFrame:
    """One row per representation of every period of every static manifest, without protected ones.

    ``manifests`` has ``by, url, text``. Periods count from 0; a period, an adaptation set and a representation each may
    have a base URL, and a segment template or list that the inner ones replace. With a ``kind`` of addressing, only
    those whose segments are given so, before URLs are resolved.
    """
    rows = let(F.from_xml("text", MPD_SCHEMA), lambda m: _flat(m, F.col("url"), kind))
    # Outer, as else a filter on the array would be moved down and parse the text again.
    found = manifests.select(by, F.col("url").alias("mpd_url"), rows.alias("_rows")).select(by, "mpd_url", F.explode_outer("_rows").alias("_x"))
    return found.where(F.col("_x.repr").isNotNull()).select(
        by,
        "mpd_url",
        *[F.col(f"_x.{c}") for c in ("period", "adapt", "repr", "period_start", "period_seconds", "base_url", "mime", "codecs", "language")],
        *[F.col(f"_x.{c}") for c in ("repr_id", "bandwidth", "width", "height")],
        parse_frame_rate(F.col("_x.frame_rate")).alias("fps"),
        parse_sampling_rate(F.col("_x.sampling_rate")).alias("asr"),
        "_x.template",
        "_x.list",
    )


def _flat(m: Column, url: Column, kind: str | None = None) -> Column:
    """One struct per representation that is not protected, of all periods of a parsed manifest.

    The tree is walked inside the row, so that it is neither copied nor written level by level.
    """
    static = F.coalesce(m["_type"] != "dynamic", F.lit(True))
    periods = m["Period"]
    seconds = lambda name: F.transform(periods, lambda p: parse_iso_duration(p[name]).cast("double"))
    first = lambda x: F.get(x, F.lit(0))
    all_of = lambda x: F.flatten(F.filter(x, lambda y: y.isNotNull()))
    clear = lambda x: F.coalesce(F.size(x["ContentProtection"]), F.lit(0)) <= 0
    inner = lambda name, r, a, p: F.coalesce(r[name], a[name], p[name])

    def of_periods(t: Column) -> Column:
        def of_period(p: Column, i: Column) -> Column:
            own = F.struct(
                F.get(t["starts"], i).alias("start"),
                period_seconds(t["starts"], t["lengths"], t["total"], i).alias("seconds"),
            )

            def of_set(o: Column, a: Column, j: Column) -> Column:
                def wanted(r: Column) -> Column:
                    if kind is None:
                        return clear(r)
                    return clear(r) & F.coalesce(_kind(inner("SegmentTemplate", r, a, p), inner("SegmentList", r, a, p)) == kind, F.lit(False))

                def one(r: Column, k: Column) -> Column:
                    levels = F.array(*[first(x["BaseURL"]) for x in (m, p, a, r)])
                    return F.struct(
                        i.alias("period"),
                        j.alias("adapt"),
                        k.alias("repr"),
                        o["start"].alias("period_start"),
                        o["seconds"].alias("period_seconds"),
                        F.aggregate(levels, url, _resolved).alias("base_url"),
                        F.coalesce(r["_mimeType"], a["_mimeType"], F.lit("")).alias("mime"),
                        F.coalesce(r["_codecs"], a["_codecs"]).alias("codecs"),
                        a["_lang"].alias("language"),
                        r["_id"].alias("repr_id"),
                        F.coalesce(r["_bandwidth"], F.lit(0)).alias("bandwidth"),
                        r["_width"].alias("width"),
                        r["_height"].alias("height"),
                        r["_frameRate"].alias("frame_rate"),
                        F.coalesce(r["_audioSamplingRate"], a["_audioSamplingRate"]).alias("sampling_rate"),
                        inner("SegmentTemplate", r, a, p).alias("template"),
                        inner("SegmentList", r, a, p).alias("list"),
                    )

                rows = F.transform(a["Representation"], lambda r, k: F.when(wanted(r), one(r, k)))
                return F.when(clear(a), F.filter(rows, lambda x: x.isNotNull()))

            return let(own, lambda o: all_of(F.transform(p["AdaptationSet"], lambda a, j: of_set(o, a, j))))

        return all_of(F.transform(periods, of_period))

    def timed(s: Column) -> Column:
        return F.struct(
            parse_iso_duration(m["_mediaPresentationDuration"]).cast("double").alias("total"),
            s["lengths"].alias("lengths"),
            period_starts(s["stated"], s["lengths"]).alias("starts"),
        )

    stated = F.struct(seconds("_start").alias("stated"), seconds("_duration").alias("lengths"))
    return F.when(static, let(stated, lambda s: let(timed(s), of_periods)))


def _resolved(base: Column, level: Column) -> Column:
    return F.when(level.isNull(), base).otherwise(let(base, lambda b: F.coalesce(url_join(b, level), b)))


def mime_class(mime: Column | str = "mime", codecs: Column | str = "codecs") -> Column:
    m = as_col(mime)
    text = m.startswith("text/") | ((m == "application/mp4") & F.coalesce(as_col(codecs).isin(*TEXT_CODECS), F.lit(False)))
    return F.when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio").when(text, "text")


def _init_of(template: Column) -> Column:
    return F.coalesce(
        F.nullif(template["_initialization"], F.lit("")), F.nullif(template["Initialization"]["_sourceURL"], F.lit(""))
    )


def _kind(t: Column, s: Column) -> Column:
    """How the segments of a representation are given: ``template``, ``timeline``, ``list`` or NULL."""
    complete = t["_media"].isNotNull() & t["_timescale"].isNotNull()
    return (
        F.when(complete & t["_duration"].isNotNull(), "template")
        .when(complete & t["SegmentTimeline"].isNotNull(), "timeline")
        .when(s.isNotNull(), "list")
    )


def _addressing(df: DataFrame) -> DataFrame:
    t, s = F.col("template"), F.col("list")
    kind = _kind(t, s)
    listed = F.filter(F.transform(s["SegmentURL"], lambda u: u["_media"]), lambda m: m.isNotNull())
    return df.withColumns(
        {
            "addressing": kind,
            "media": t["_media"],
            "init": F.when(kind == "list", s["Initialization"]["_sourceURL"]).otherwise(_init_of(t)),
            "timescale": t["_timescale"],
            "segment_ticks": F.floor(t["_duration"]).cast("long"),
            "start_number": F.coalesce(t["_startNumber"], F.lit(1)),
            "time_offset": F.coalesce(t["_presentationTimeOffset"], F.lit(0)),
            "timeline": t["SegmentTimeline"]["S"],
            "urls": F.coalesce(listed, F.array().cast("array<string>")),
        }
    )


def _has_segments() -> Column:
    kind = F.col("addressing")
    template = (F.col("segment_ticks") > 0) & (F.col("timescale") > 0) & (F.col("period_seconds") > 0)
    some = F.col("init").isNotNull()
    timeline = (F.col("timescale") > 0) & (some | (F.coalesce(F.size("timeline"), F.lit(0)) > 0))
    listed = some | (F.size("urls") > 0)
    held = F.when(kind == "template", template).when(kind == "timeline", timeline).when(kind == "list", listed)
    return F.coalesce(held, F.lit(False))


def _safe_segments() -> Column:
    """The URLs the segments resolve to may be fetched.

    Relative names stay on the host of the base URL, which has been checked; templates only differ in file names.
    """
    names = F.array_compact(
        F.concat(
            F.array("init"), F.when(F.col("addressing") == "list", F.col("urls")).otherwise(F.array("media"))
        )
    )
    elsewhere = F.filter(names, lambda u: u.rlike("^(?://|[A-Za-z][A-Za-z0-9+.-]*:)"))
    absolute = F.transform(elsewhere, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    return (F.size(elsewhere) == 0) | F.forall(absolute, lambda u: url_safety(u).isNull())


def _usable(manifests: DataFrame, by: str, among: Column, kind: str | None = None) -> DataFrame:
    # Patterns on URLs come last, for the rows that are left.
    rows = _addressing(representations(manifests, by, kind)).withColumn("class", mime_class())
    rows = rows.where(among).where(url_safety("base_url").isNull())
    synth = F.concat_ws("_", F.concat(F.lit("dash_"), F.substring("class", 1, 1)), "adapt", "repr")
    return rows.withColumn("format_id", F.coalesce("repr_id", synth))


def _av(manifests: DataFrame, by: str, kind: str | None = None) -> DataFrame:
    among = F.col("class").isin("video", "audio") & _has_segments() & _safe_segments()
    return _usable(manifests, by, among if kind is None else (F.col("addressing") == kind) & among, kind)


def cap_renditions(formats: DataFrame, by: str | Sequence[str] = "mpd_id", cap: int | None = None) -> DataFrame:
    """With a ``cap``, so many formats of the highest bitrate per manifest; equal ones in order (cut before the shuffle too)."""
    if cap is None:
        return formats
    window = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc_nulls_last("tbr"), "adapt", "repr")
    return formats.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= cap).drop("_rn")


def dash_formats(manifests: DataFrame, by: str = "mpd_id", cap: int | None = None) -> DataFrame:
    """Video and audio formats of every period of static manifests; ``cap`` bounds those of a period."""
    rows = _av(manifests, by)
    video = F.col("class") == "video"
    ext = F.when(F.col("mime").isin("video/webm", "audio/webm"), "webm").when(F.col("mime") == "audio/mp4", "m4a").otherwise("mp4")
    codecs = F.coalesce("codecs", F.lit(""))
    formats = rows.select(
        by,
        "period",
        "period_start",
        "period_seconds",
        "adapt",
        "repr",
        "format_id",
        F.col("mpd_url").alias("url"),
        F.when(video, codecs).alias("vcodec"),
        F.when(~video, codecs).alias("acodec"),
        ext.alias("ext"),
        F.concat(ext, F.lit("_dash")).alias("container"),
        F.lit("http_dash_segments").alias("protocol"),
        F.when(F.col("bandwidth") > 0, F.col("bandwidth") / 1000.0).alias("tbr"),
        "width",
        "height",
        "fps",
        F.when(~video, F.col("asr")).alias("asr"),
        "language",
        F.col("base_url").alias("fragment_base_url"),
    )
    return cap_renditions(formats, [by, "period"], cap)


def dash_subtitles(manifests: DataFrame, by: str = "mpd_id") -> DataFrame:
    """Text tracks that are one file."""
    rows = _usable(manifests, by, (F.col("class") == "text") & ~_has_segments())
    vtt = (F.col("mime") == "text/vtt") | ((F.col("mime") == "application/mp4") & (F.col("codecs") == "wvtt"))
    ext = F.when(vtt, "vtt").otherwise("ttml")
    return rows.select(by, "period", "adapt", "repr", "language", F.col("base_url").alias("url"), ext.alias("ext"))


def fill_segment_template(
    template: Column | str,
    representation: Column | str,
    bandwidth: Column | str,
    number: Column | None = None,
    time: Column | None = None,
) -> Column:
    """A template with its ``$...$`` tokens filled in, from left to right; unknown tokens stay."""
    t = as_col(template)
    zero = F.lit(0).cast("long")
    numbers = {"Number": zero if number is None else number, "Time": zero if time is None else time}
    fill = lambda p: _fill_piece(p, as_col(representation), as_col(bandwidth), numbers)
    return F.when(t.contains("$"), F.array_join(F.transform(_pieces(t), fill), "")).otherwise(t)


def _pieces(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\$[^$]*\$|[^$]+|\$"), F.lit(0))


def _is_number(p: Column, name: str) -> Column:
    return p.startswith(f"${name}") & p.rlike(rf"^\${name}(%[^$]*)?\$$")


def _width(p: Column, name: str) -> Column:
    # A cast that fails costs more than the pattern, so that none is tried without digits.
    return F.when(p.contains("%"), let(F.regexp_extract(p, rf"^\${name}%(\d+)d*\$$", 1), lambda w: F.when(w != "", w.try_cast("int"))))


def _padded(text: Column, width: Column) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, F.lit("0"))).otherwise(text)


def _fill_piece(p: Column, representation: Column, bandwidth: Column, numbers: dict[str, Column]) -> Column:
    out = F.when(~p.startswith("$"), p).when(p == "$$", F.lit("$")).when(p == "$RepresentationID$", representation).when(
        p == "$Bandwidth$", bandwidth.cast("string")
    )
    for name, value in numbers.items():
        out = out.when(_is_number(p, name), _padded(value.cast("string"), _width(p, name)))
    return out.otherwise(p)


_KEYS = ("period", "adapt", "repr", "format_id")
#: What ``_filled`` takes of a representation.
_NAMES = ("base_url", "media", "bandwidth", "init_url", "pattern")


def _with_names(rows: DataFrame, token: str) -> DataFrame:
    """The URLs of a representation's segments, as far as they are the same: that of the init segment, and ``pattern``.

    A pattern is what stands before and behind the one number (``token``) of a template: filled in and resolved once, as
    far as the number cannot change how the name is resolved. It is NULL for other templates, which are filled in for
    each segment.
    """
    representation, bandwidth = F.col("format_id"), F.col("bandwidth")
    init_url = F.when(F.col("init").isNotNull(), url_join("base_url", fill_segment_template("init", representation, bandwidth)))
    others = {name: F.lit(0).cast("long") for name in ("Number", "Time") if name != token}

    def split(pieces: Column) -> Column:
        places = F.transform(pieces, lambda p, i: F.when(_is_number(p, token), i))
        return let(F.filter(places, lambda i: i.isNotNull()), lambda found: F.when(F.size(found) == 1, let(F.get(found, F.lit(0)), lambda at: parts(pieces, at))))

    def parts(pieces: Column, at: Column) -> Column:
        filled = lambda some: F.array_join(F.transform(some, lambda p: _fill_piece(p, representation, bandwidth, others)), "")
        return F.struct(
            filled(F.slice(pieces, F.lit(1), at)).alias("head"),
            filled(F.slice(pieces, at + 2, F.size(pieces))).alias("tail"),
            _width(F.get(pieces, at), token).alias("width"),
        )

    def resolved(s: Column) -> Column:
        folder = let(url_join("base_url", F.lit("x")), lambda u: F.substr(u, F.lit(1), F.length(u) - 1))
        return F.when(plain_name(F.concat(s["head"], F.lit("0"), s["tail"])), F.struct(F.concat(folder, s["head"]).alias("head"), s["tail"].alias("tail"), s["width"].alias("width")))

    return rows.withColumns({"init_url": init_url, "pattern": let(let(_pieces(F.col("media")), split), resolved)})


def _filled(rows: DataFrame, by: str, token: str, value: Column, index: Column, duration: Column, start: Column) -> DataFrame:
    """Segments by their ``value`` of the template's ``token``; where ``is_init`` holds it is the init segment, which has no time."""
    head, tail, width = (F.col("pattern")[c] for c in ("head", "tail", "width"))
    number, time = (value if token == name else None for name in ("Number", "Time"))
    each = url_join("base_url", fill_segment_template("media", "format_id", "bandwidth", number, time))
    whole = F.concat(head, _padded(value.cast("string"), width), tail)
    url = F.when(F.col("is_init"), F.col("init_url")).when(head.isNotNull() & value.isNotNull(), whole).otherwise(each)
    timed = lambda x: F.when(~F.col("is_init"), x.cast("double"))
    return rows.select(by, *_KEYS, index.cast("long").alias("pos"), url.alias("url"), timed(duration).alias("duration"), timed(start).alias("start"))


def dash_segments_template(manifests: DataFrame, by: str = "mpd_id") -> DataFrame:
    """Segments numbered from the start number, with their time in the presentation; an init segment comes first."""
    rows = _with_names(_av(manifests, by, "template"), "Number").withColumn("first", F.when(F.col("init").isNotNull(), 1).otherwise(0))
    rows = rows.select(by, *_KEYS, *_NAMES, "first", "segment_ticks", "timescale", "period_seconds", "period_start", "start_number")
    seconds = F.col("segment_ticks") / F.col("timescale")
    numbered = explode_range(rows, F.ceil(F.col("period_seconds") / seconds) + F.col("first"), "_i")
    nth = F.col("_i") - F.col("first")
    numbered = numbered.withColumn("is_init", nth < 0)
    return _filled(numbered, by, "Number", F.col("start_number") + nth, F.col("_i"), seconds, F.col("period_start") + nth * seconds)


def timeline_starts(
    entries: DataFrame, keys: Sequence[str], order: str = "entry", block: int | None = 100_000
) -> DataFrame:
    """Start time and number of the first segment of each timeline entry ``(t, d, r)``.

    An entry stands for ``r + 1`` segments of length ``d`` and starts at ``t``, or where the former one ended.
    Without ``block`` a group's entries are scanned in one window, which is right where they come from one row.
    """
    repeats = F.greatest(F.coalesce(F.col("r"), F.lit(0)), F.lit(0)) + 1
    counted = entries.withColumn("repeats", repeats)
    if block is None:
        ordered = Window.partitionBy(*keys).orderBy(order)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        ticks = F.coalesce(F.sum(F.col("d") * F.col("repeats")).over(before), F.lit(0))
        index = F.coalesce(F.sum("repeats").over(before), F.lit(0))
        summed = counted.withColumns({"_ticks": ticks, "index": index})
        shifted = summed.withColumn("_shift", F.col("t") - F.col("_ticks"))
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        last = F.last("_shift", ignorenulls=True).over(upto)
        return shifted.withColumn("start", F.coalesce(last, F.lit(0)) + F.col("_ticks")).drop("_ticks", "_shift")
    summed = running(
        counted,
        keys,
        order,
        {
            "_ticks": Running("sum", F.col("d") * F.col("repeats"), exclusive=True),
            "index": Running("sum", F.col("repeats"), exclusive=True),
        },
        block,
    ).fillna(0, ["_ticks", "index"])
    based = summed.withColumn("_shift", F.col("t") - F.col("_ticks"))
    carried = running(based, keys, order, {"_base": Running("last", F.col("_shift"))}, block)
    start = F.coalesce(F.col("_base"), F.lit(0)) + F.col("_ticks")
    return carried.withColumn("start", start).drop("_ticks", "_shift", "_base")


def dash_segments_timeline(manifests: DataFrame, by: str = "mpd_id") -> DataFrame:
    """Segments of explicit timelines, with their time in the presentation; an init segment comes first."""
    rows = _with_names(_av(manifests, by, "timeline"), "Time")
    keys = [by, *_KEYS]
    entry = "struct<_t:bigint,_d:bigint,_r:bigint>"
    first = F.struct(F.lit(None).alias("_t"), F.lit(0).alias("_d"), F.lit(0).alias("_r")).cast(entry)  # takes a place and no time
    given = F.coalesce("timeline", F.array().cast(f"array<{entry}>"))
    listed = F.when(F.col("init").isNotNull(), F.concat(F.array(first), given)).otherwise(given)
    entries = rows.select(
        *keys, *_NAMES, F.col("init").isNotNull().alias("has_init"), "timescale", "time_offset", "period_start", F.posexplode(listed).alias("entry", "_s")
    ).select("*", F.col("_s._t").alias("t"), F.col("_s._d").alias("d"), F.col("_s._r").alias("r")).drop("_s")
    expanded = explode_range(timeline_starts(entries, keys, block=None), F.col("repeats"), "_k")
    expanded = expanded.withColumn("is_init", (F.col("entry") == 0) & F.col("has_init"))
    time = F.col("start") + F.col("_k") * F.col("d")
    shown = F.col("period_start") + (time - F.col("time_offset")) / F.col("timescale")
    return _filled(expanded, by, "Time", time, F.col("index") + F.col("_k"), F.col("d") / F.col("timescale"), shown)


def dash_segments_list(manifests: DataFrame, by: str = "mpd_id") -> DataFrame:
    """Segments that are listed by name; these are no templates."""
    rows = _av(manifests, by, "list")
    names = F.when(F.col("init").isNotNull(), F.concat(F.array("init"), "urls")).otherwise(F.col("urls"))
    listed = rows.select(by, *_KEYS, "base_url", F.posexplode(names).alias("pos", "_u"))
    none = F.lit(None).cast("double")
    return listed.select(by, *_KEYS, F.col("pos").cast("long").alias("pos"), url_join("base_url", "_u").alias("url"), none.alias("duration"), none.alias("start"))
