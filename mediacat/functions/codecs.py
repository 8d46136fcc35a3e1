"""Codec tokens of manifests (RFC 6381) and image signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, extract
from mediacat.functions.html import trim_space

# First component of a codec token -> codec name.
VIDEO_CODECS = {
    "avc1": "h264",
    "avc2": "h264",
    "avc3": "h264",
    "avc4": "h264",
    "dva1": "h264",
    "dvav": "h264",
    "hvc1": "hevc",
    "hev1": "hevc",
    "dvh1": "hevc",
    "dvhe": "hevc",
    "av01": "av1",
    "vp08": "vp8",
    "vp09": "vp9",
    "h264": "h264",
    "avc": "h264",
    "hevc": "hevc",
    "h265": "hevc",
    "av1": "av1",
    "vp9": "vp9",
    "vp8": "vp8",
}
AUDIO_CODECS = {
    "opus": "opus",
    "ac-3": "ac3",
    "ec-3": "eac3",
    "flac": "flac",
    "aac": "aac",
    "ac3": "ac3",
    "eac3": "eac3",
    "vorbis": "vorbis",
    "mp3": "mp3",
}
# Object types of mp4a (hexadecimal) and MPEG-4 audio object types (decimal).
_OBJECT_TYPES = {0x66: "aac", 0x67: "aac", 0x68: "aac", 0x69: "mp3", 0x6B: "mp3", 0xAD: "opus"}
_MPEG4_AUDIO = 0x40
_AAC_TYPES = (1, 2, 3, 4, 5, 6, 17, 19, 20, 23, 29, 39, 42)
_AUDIO_OBJECT_TYPES = {32: "mp1", 33: "mp2", 34: "mp3", 36: "mp4als"}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _mp4a(object_type: Column, audio_type: Column) -> Column:
    hexa = F.regexp_extract(object_type, r"^\+?([0-9a-fA-F]+)$", 1)
    oti = F.when(F.length(F.regexp_replace(hexa, "^0+(?=.)", "")).between(1, 2), F.conv(hexa, 16, 10).cast("int"))
    aot = F.when(audio_type.rlike(r"^\+?\d+$"), audio_type.try_cast("int"))
    mpeg4 = F.when(audio_type.isNull() | aot.isin(*_AAC_TYPES), F.lit("aac")).otherwise(_lookup(_AUDIO_OBJECT_TYPES, aot))
    return (
        F.when(object_type.isNull(), F.lit("aac"))
        .when(oti == _MPEG4_AUDIO, mpeg4)
        .otherwise(_lookup(_OBJECT_TYPES, oti))
    )


def codec_kind(token: Column | str) -> Column:
    """``video``, ``audio``, or NULL for a token that is not known."""
    code = F.lower(F.get(F.split(trim_space(token), r"\."), F.lit(0)))
    return F.when(code.isin(*VIDEO_CODECS), F.lit("video")).when(
        code.isin("mp4a", *AUDIO_CODECS), F.lit("audio")
    )


def codec_name(token: Column | str) -> Column:
    """The codec a token names; NULL for an unknown token or an audio codec without a name."""
    parts = F.split(trim_space(token), r"\.")
    code = F.lower(F.get(parts, F.lit(0)))
    mp4a = _mp4a(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    return F.when(code == "mp4a", mp4a).otherwise(_lookup(VIDEO_CODECS | AUDIO_CODECS, code))


def codec_identity(token: Column | str) -> Column:
    return F.struct(codec_name(token).alias("name"), codec_kind(token).alias("kind"))


def _tokens(codecs: Column | str, kind: str) -> Column:
    return F.filter(F.transform(F.split(as_col(codecs), ","), trim_space), lambda t: codec_kind(t) == kind)


def split_codecs(codecs: Column | str) -> Column:
    """The first video and the first audio token of a list, as written."""
    return F.struct(
        F.get(_tokens(codecs, "video"), F.lit(0)).alias("vcodec"),
        F.get(_tokens(codecs, "audio"), F.lit(0)).alias("acodec"),
    )


def named_codecs(codecs: Column | str) -> Column:
    """The names of the first video codec and of the first audio codec that has one."""

    def first(kind: str) -> Column:
        names = F.filter(F.transform(_tokens(codecs, kind), codec_name), lambda n: n.isNotNull())
        return F.get(names, F.lit(0))

    return F.struct(first("video").alias("video"), first("audio").alias("audio"))


def infer_muxed_audio(video: Column | str, audio: Column | str, audio_group: Column | str) -> Column:
    """The declared audio codec, or aac where a video stream has no audio of its own elsewhere."""
    return F.coalesce(
        as_col(audio), F.when(as_col(video).isNotNull() & as_col(audio_group).isNull(), F.lit("aac"))
    )


def segment_container(uri: Column | str) -> Column:
    """The extension of a segment's file name."""
    bare = F.regexp_replace(as_col(uri), r"[?#].*$", "")
    return F.lower(extract(bare, r"\.([^./]+)$"))


# Signatures as (offset, hex bytes).
_SIGNATURES = (
    (((0, "FFD8FF"),), "jpeg"),
    (((0, "89504E470D0A1A0A"),), "png"),
    (((0, "474946383761"),), "gif"),
    (((0, "474946383961"),), "gif"),
    (((0, "424D"), (6, "00000000")), "bmp"),
    (((0, "49492A00"),), "tiff"),
    (((0, "4D4D002A"),), "tiff"),
    (((0, "52494646"), (8, "57454250")), "webp"),
)


def sniff_image(data: Column | str) -> Column:
    """The image format of the first bytes of a file."""
    head = F.hex(F.substring(as_col(data), 1, 16))
    found = None
    for fragments, name in _SIGNATURES:
        same = F.lit(True)
        for offset, pattern in fragments:
            same = same & (F.substring(head, offset * 2 + 1, len(pattern)) == pattern)
        found = F.when(same, name) if found is None else found.when(same, name)
    return found
