"""URLs: parts, resolution, extensions, protocols, percent-encoding, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, extract, let, lowered
from mediacat.functions.html import trim_space

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# Extensions of media files and manifests.
MEDIA_EXTENSIONS = "mp4 webm mkv m3u8 mpd ts flv avi mov m4v mp3 m4a ogg opus wav flac aac".split()


def is_url(c: Column | str) -> Column:
    return as_col(c).rlike(_URL)


def scheme(c: Column | str) -> Column:
    return lowered(extract(as_col(c), _URL, 1))


def authority(c: Column | str) -> Column:
    return extract(as_col(c), _URL, 2)


def host(c: Column | str) -> Column:
    """Host without user info and port, lower case; IPv6 addresses keep their brackets."""
    bare = F.regexp_replace(authority(c), "^.*@", "")
    return F.nullif(lowered(F.regexp_replace(bare, r":\d*$", "")), F.lit(""))


def port(c: Column | str) -> Column:
    """The port, the scheme's own where none is written."""
    written = extract(authority(c), r":(\d+)$").try_cast("int")
    return F.coalesce(written, F.when(scheme(c) == "https", 443).when(scheme(c) == "http", 80))


def path(c: Column | str) -> Column:
    c = as_col(c)
    found = F.regexp_extract(c, _URL, 3)
    return F.when(is_url(c), F.when(found == "", F.lit("/")).otherwise(found))


def query(c: Column | str) -> Column:
    return F.substring(extract(as_col(c), _URL, 4), 2, 1 << 30)


def url_path(c: Column | str) -> Column:
    """The path only: the same content on other hosts and with other tokens has the same one."""
    c = as_col(c)
    bare = F.regexp_extract(c, r"^[^?]*?://[^/?]*(/[^?]*)", 1)
    return F.coalesce(path(c), F.nullif(bare, F.lit("")), c)


def cdn_host(c: Column | str) -> Column:
    """What stands between ``http(s)://`` and the next slash."""
    c = as_col(c)
    return F.when(c.rlike("^https?://"), F.regexp_extract(c, "^https?://([^/]*)", 1))


def normalize_url(c: Column | str) -> Column:
    """Without query and fragment."""
    c = as_col(c)
    whole = F.concat(scheme(c), F.lit("://"), authority(c), path(c))
    return F.when(authority(c).isNotNull(), whole).otherwise(F.get(F.split(c, r"\?", 2), F.lit(0)))


def _encode(c: Column) -> Column:
    """Percent-encode what no part of a URL may hold: white space, quotes, angle brackets, non-ASCII characters."""
    unsafe = r"""[^!-~]|["<>`]"""
    runs = F.regexp_extract_all(c, F.lit(r"""(?:[^!-~]|["<>`])+|[!#-;=?-_a-~]+"""), F.lit(0))
    coded = F.transform(
        runs, lambda r: F.when(r.rlike(unsafe), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))).otherwise(r)
    )
    return F.when(c.rlike(unsafe), F.array_join(coded, "")).otherwise(c)


def _remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path."""
    parts = F.split(p, "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    last = F.element_at(parts, -1)
    tail = F.when(last.isin(".", "..") , F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(folded, "/"), tail)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


# URLs and references without a character or a part that resolving would change: no dots in front of a name, nothing to encode.
_PLAIN_BASE = r"^[a-z][a-z0-9+.-]*://[A-Za-z0-9._:@-]*/[A-Za-z0-9._~!$&()*+,;=@%:/-]*\z"
_PLAIN_NAME = r"^[A-Za-z0-9_~!$&()*+,;=@%-][A-Za-z0-9._~!$&()*+,;=@%/-]*\z"


def plain_name(c: Column) -> Column:
    """A relative path that resolving puts behind the folder of the base URL as it is."""
    return c.rlike(_PLAIN_NAME) & ~c.contains("/.")


def url_join(base: Column | str, reference: Column | str) -> Column:
    """Resolve a reference against a page URL (RFC 3986).

    NULL for blank references, ``data:`` and ``javascript:``; ``//host`` becomes https.
    """
    both = F.struct(as_col(base).alias("base"), as_col(reference).alias("ref"))
    trimmed = lambda s: F.struct(s["base"].alias("base"), _trimmed(s["ref"]).alias("ref"))
    return let(both, lambda s: F.when(_plain(s["base"], s["ref"]), _put_behind(s["base"], s["ref"])).otherwise(let(trimmed(s), lambda t: _join(t["base"], t["ref"]))))


def _plain(base: Column, ref: Column) -> Column:
    return plain_name(ref) & base.rlike(_PLAIN_BASE) & ~base.contains("/.")


def _put_behind(base: Column, ref: Column) -> Column:
    return F.concat(_upto_slash(base), ref)


def _trimmed(c: Column) -> Column:
    """``trim_space``, whose pattern is tried where the first or the last character is white space only."""
    return F.when(F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(r"(?U)\s"), trim_space(c)).otherwise(c)


def _join(base: Column, ref: Column) -> Column:
    # Each part is matched once and named; the cheap tests in front keep most references from the patterns.
    kind = F.struct((ref.contains("://") & is_url(ref)).alias("absolute"), (ref.contains("?") | ref.contains("#")).alias("tail"))
    joined = let(kind, lambda k: _resolve(base, ref, k["absolute"], k["tail"]))
    other = ref.contains(":") & ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~(ref.contains("://") & is_url(ref))
    return (
        F.when((ref == "") | ref.startswith("data:") | ref.startswith("javascript:"), None)
        .when(ref.startswith("//"), F.concat(F.lit("https:"), ref))
        .when(other, ref)
        .otherwise(let(joined, _encode))
    )


def _resolve(base: Column, ref: Column, absolute: Column, tail: Column) -> Column:
    # The parts of the result: those of the reference, or of the base where the reference leaves them out.
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    p = F.when(tail | ref.contains("://"), F.regexp_extract(ref, parts, 1)).otherwise(ref)
    q, fragment = (F.when(tail, F.regexp_extract(ref, parts, i)).otherwise(F.lit("")) for i in (2, 3))
    of_base = F.regexp_extract(base, _URL, 3)

    def put(s: Column) -> Column:
        p, q = s["p"], s["q"]
        merged = F.when(absolute | p.startswith("/"), p).when(p == "", of_base).otherwise(F.concat(let(of_base, _folder), p))
        own_query = F.when((p == "") & (q == "") & ~absolute, F.regexp_extract(base, _URL, 4)).otherwise(q)
        return F.concat(
            F.when(s["scheme"] != "", lowered(s["scheme"])),
            F.lit("://"),
            F.when(absolute, lowered(s["site"])).otherwise(s["site"]),
            F.replace(F.replace(F.replace(let(merged, _clean_path), F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D")), F.lit("^"), F.lit("%5E")),
            F.replace(own_query, F.lit("'"), F.lit("%27")),
            s["fragment"],
        )

    def found(whole: Column) -> Column:
        scheme, site = (F.regexp_extract(whole, _URL, i) for i in (1, 2))
        return F.struct(scheme.alias("scheme"), site.alias("site"), p.alias("p"), q.alias("q"), fragment.alias("fragment"))

    return let(F.when(absolute, ref).otherwise(base), lambda whole: let(found(whole), put))


def _folder(p: Column) -> Column:
    """A path up to its last slash."""
    return F.when(p == "", F.lit("/")).otherwise(_upto_slash(p))


def _upto_slash(p: Column) -> Column:
    return F.substr(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)))


def _clean_path(p: Column) -> Column:
    return F.when(p == "", F.lit("/")).when(p.contains("/.") & p.rlike(r"/\.\.?(/|$)"), _remove_dots(p)).otherwise(p)


def _extension(c: Column | str) -> Column:
    return F.lower(extract(path(c), r"\.([^./]*)$"))


def media_ext_from_url(c: Column | str) -> Column:
    """The extension if it is one of a media file."""
    ext = _extension(c)
    return F.when(ext.isin(*MEDIA_EXTENSIONS), ext)


def ext_from_url(c: Column | str, max_bytes: int | None = None) -> Column:
    """Any extension, or with ``max_bytes`` one that is not longer."""
    ext = _extension(c)
    return ext if max_bytes is None else F.when(F.octet_length(ext) <= max_bytes, ext)


def protocol_for_url(c: Column | str) -> Column:
    return F.when(_extension(c).isin("m3u8", "m3u"), F.lit("m3u8")).otherwise(
        F.coalesce(scheme(c), F.lower(extract(as_col(c), "^([A-Za-z][A-Za-z0-9+.-]*):")))
    )


# Markers of manifest types, and the extension each media type implies.
MANIFEST_MARKERS = {"mpegurl": "m3u8", "dash+xml": "mpd"}
MIME_EXTENSIONS = {
    "video/mp4": "mp4",
    "video/x-mp4-fragmented": "mp4",
    "video/webm": "webm",
    "video/x-matroska": "mkv",
    "video/quicktime": "mov",
    "video/x-m4v": "m4v",
    "video/mp2t": "ts",
    "video/x-flv": "flv",
    "video/x-msvideo": "avi",
    "video/3gpp": "3gp",
    "video/mpeg": "mpg",
    "video/x-ms-wmv": "wmv",
    "video/x-ms-asf": "asf",
    "video/ogg": "ogg",
    "application/mxf": "mxf",
    "audio/mp4": "m4a",
    "audio/x-m4a": "m4a",
    "audio/mpeg": "mp3",
    "audio/ogg": "ogg",
    "audio/opus": "opus",
    "audio/flac": "flac",
    "audio/x-flac": "flac",
    "audio/wav": "wav",
    "audio/x-wav": "wav",
    "audio/wave": "wav",
    "audio/aac": "aac",
    "audio/aacp": "aac",
    "audio/x-aac": "aac",
    "audio/webm": "webm",
    "audio/x-matroska": "mka",
    "audio/x-ms-wma": "wma",
    "audio/aiff": "aiff",
    "audio/x-aiff": "aiff",
    "audio/ac3": "ac3",
}


def essence(content_type: Column | str) -> Column:
    """``type/subtype``, lower case, without parameters."""
    return F.lower(F.btrim(F.get(F.split(as_col(content_type), ";", 2), F.lit(0))))


def manifest_ext(content_type: Column | str) -> Column:
    e = essence(content_type)
    return F.coalesce(*[F.when(e.contains(marker), ext) for marker, ext in MANIFEST_MARKERS.items()])


def ext_from_mime(content_type: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair])
    return F.coalesce(manifest_ext(content_type), F.try_element_at(table, essence(content_type)))


def is_media_content_type(content_type: Column | str) -> Column:
    e = essence(content_type)
    return (
        e.startswith("video/")
        | e.startswith("audio/")
        | manifest_ext(content_type).isNotNull()
        | e.contains("x-flv")
        | e.contains("mp2t")
    )


def is_html_content_type(content_type: Column | str) -> Column:
    e = essence(content_type)
    return e.contains("text/html") | e.contains("application/xhtml")


def has_media_extension(c: Column | str) -> Column:
    bare = F.get(F.split(as_col(c), r"\?", 2), F.lit(0))
    return F.lower(F.element_at(F.split(bare, r"\."), -1)).isin(*MEDIA_EXTENSIONS)


def extract_id(c: Column | str, pattern: str, *groups: int) -> Column:
    """The first non-empty of several groups of a pattern."""
    return F.coalesce(*[extract(as_col(c), pattern, g) for g in (groups or (1,))])


def percent_encode(c: Column | str) -> Column:
    """All but unreserved characters."""
    coded = F.url_encode(as_col(c))
    return F.replace(F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decode(c: Column | str) -> Column:
    """NULL where the bytes are not UTF-8; ``+`` stays, and so does a ``%`` without two hex digits."""
    c = as_col(c)
    kept = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(kept)
    broken = decoded.contains("�") & ~F.upper(c).contains("%EF%BF%BD") & ~c.contains("�")
    return F.when(~c.contains("%"), c).when(~broken, decoded)


def stable_id(c: Column | str) -> Column:
    """A stable id of a URL: the first 16 digits of its MD5."""
    return F.concat(F.lit("generic-"), F.substring(F.md5(as_col(c)), 1, 16))


# Credential parameters; the first three are matched as written, the others in any case and only
# where a parameter starts.
_EXACT_PARAMETERS = ("X-Amz-Security-Token", "X-Amz-Signature", "X-Amz-Credential")
_PARAMETERS = (
    "access_token client_secret id_token api_key otp_code authorization token key password secret bearer signature "
    "sig hmac auth session code otp"
).split()


def redact(c: Column | str) -> Column:
    """User info and the values of credential parameters become ``***``; closing parentheses at the end stay."""
    text = F.regexp_replace(as_col(c), r"(?U)//[^@\s/]+@", "//*:*@")
    for name in _EXACT_PARAMETERS:
        text = F.regexp_replace(text, rf"(?U){name}=(?=[^&\s])([^&\s]*[^&\s)])?(\)*)", f"{name}=***$2")
    for name in _PARAMETERS:
        text = F.regexp_replace(
            text, rf"(?Ui)(^|[?&\s]){name}=(?=[^&\s])([^&\s]*[^&\s)])?(\)*)", f"$1{name}=***$3"
        )
    found = as_col(c).rlike("//[^@]+@|=")
    return F.when(found, text).otherwise(as_col(c))
