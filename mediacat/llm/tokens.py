"""Token ids of texts with public tokenizer files, one piece of text at a time.

A tokenizer of this kind cuts a text at white space and between letters and marks before it merges symbols, so that the
ids of a text are the ids of its pieces in order. Pieces repeat far more than texts: each worker encodes a piece once
and keeps its ids. Arrow's functions cut the texts of a batch, number its distinct pieces and put their ids in a row;
Python sees each distinct piece of a batch once. The pieces are cut only where the tokenizer itself always cuts:

* ``words``: white space is dropped by the tokenizer and letters are lowered; pieces are what lies between spaces and
  line feeds.
* ``bytes``: white space goes with what follows it; a piece starts at a space or line feed after a code that is no white
  space.
* both: a full stop or comma after a letter or digit starts a piece, in texts that have none after anything else. For
  ``words`` a letter counts as what its composed and lowered form ends with: some end with a mark (``İ``), which joins
  the full stop.

The tokenizer's added tokens in a text (``<|endoftext|>``) are found before all else and are one id each, as its own call
gives them; what stands before and after one is a text of its own. With ``added=False`` they are spelled out.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in each of a worker's two generations, by default: when the younger is full it becomes the older, whose unused ones go.
KEPT_PIECES = 500_000

#: Bytes of text that are cut at a time, by default, and new pieces that are encoded at a time.
PART_BYTES, PART_PIECES = 4 << 20, 20_000

_BEFORE_WHITE = re.compile(r"(?<=\S)(?=\s)")
_ODD_MARKS = re.compile(r"[\W_][.,]")
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@lru_cache(maxsize=1)
def odd_endings() -> re.Pattern:
    """Full stops and commas after what the tokenizer holds for no letter and no digit once it has composed and lowered it."""
    letters = (c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and (unicodedata.decomposition(c) or c.lower() != c))
    ending_in_marks = "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1].isalnum())
    return re.compile(rf"[\W_{ending_in_marks}][.,]")


@lru_cache(maxsize=2)
def _odd(marks: re.Pattern) -> str:
    """``marks`` for Arrow, whose letters are other codes than Python's: the codes before a mark as ranges."""
    runs = re.finditer(marks.pattern.removesuffix("[.,]") + "+", "".join(map(chr, range(sys.maxunicode + 1))))
    return "[" + "".join(rf"\x{{{m.start():x}}}-\x{{{m.end() - 1:x}}}" for m in runs) + "][.,]"


def _before_marks(texts: pa.Array, cut: str, marks: re.Pattern) -> pa.Array:
    """``cut`` put before full stops and commas, in texts where each follows a letter or digit."""
    found = pc.replace_substring(pc.replace_substring(texts, ".", f"{cut}."), ",", f"{cut},")
    return pc.if_else(pc.match_substring_regex(texts, _odd(marks)), texts, found)


def word_pieces(texts: pa.Array) -> pa.ListArray:
    texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
    return pc.split_pattern(pc.replace_substring(_before_marks(texts, " ", odd_endings()), "\n", " "), " ")


def byte_pieces(texts: pa.Array) -> pa.ListArray:
    """Of texts without the code 0, which marks the cuts."""
    marked = _before_marks(texts, "\0", _ODD_MARKS)
    found = pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n")
    after_white = pc.match_substring_regex(texts, f"[{_WHITE}][ \n]")
    if pc.any(after_white).as_py():
        found = pc.replace_with_mask(found, after_white, pc.replace_substring_regex(marked.filter(after_white), f"([^{_WHITE}\\x00])([ \n])", "\\1\0\\2"))
    return pc.split_pattern(found, "\0")


def bytes_of_one(text: str) -> list[str]:
    return _BEFORE_WHITE.split(text)


def words_of_one(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def is_word(piece: str) -> bool:
    return piece.isalpha()


def is_spaced(piece: str) -> bool:
    return piece[:1] in (" ", "\n") and piece.split() == [piece[1:]]


#: How texts are cut, how one text is in which that finds no cuts, and patterns of such texts.
CUTS = {"words": (word_pieces, words_of_one, []), "bytes": (byte_pieces, bytes_of_one, [r"\x00"])}
#: Pieces that can be encoded as one text, what goes between them, and which ids then end (or else start) a piece.
JOINED = {"words": (is_word, " ", True, lambda token: token.endswith("</w>")), "bytes": (is_spaced, "", False, lambda token: token.startswith(("Ġ", "Ċ")))}


class Encoder:
    """Encodes texts to lists of their ids."""

    def __init__(self, path: str, pieces: str, added: bool = False, kept_pieces: int | None = None, part_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # no piece is an added token, though one can be spelled like it when letters are lowered
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or not t.special for t in tokens.values()):
            raise ValueError(f"added tokens of {path} depend on what stands around them")
        self.kept_pieces, self.part_bytes = kept_pieces, part_bytes
        self.pieces, self.pieces_of_one, alone = CUTS[pieces]
        names = sorted((t.content for t in tokens.values()), key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.alone = "|".join([*map(re.escape, names), *alone])
        self.ids = {"": b""} | {f"{t.content} ": array("I", [i]).tobytes() for i, t in tokens.items()}  # no piece ends with a space after a mark
        self.known, self.older = dict(self.ids), {}
        self.can_join, self.between, self.at_ends, is_edge = JOINED[pieces]
        self.edges = np.array([is_edge(str(self.tokenizer.id_to_token(i))) for i in range(self.tokenizer.get_vocab_size())])

    def cut_one(self, text: str) -> list[str]:
        """The pieces of a text; an added token has a space behind it."""
        if self.at_added is None:
            return self.pieces_of_one(text)
        cut: list[str] = []
        for i, part in enumerate(self.at_added.split(text)):
            cut += [f"{part} "] if i % 2 else self.pieces_of_one(part)
        return cut

    def cut(self, texts: pa.Array) -> pa.ListArray:
        alone = np.flatnonzero(pc.match_substring_regex(texts, self.alone).to_numpy(zero_copy_only=False)) if self.alone else []
        if not len(alone):
            return self.pieces(texts)
        rest = np.ones(len(texts), bool)
        rest[alone] = False
        found = self.pieces(texts.filter(pa.array(rest)))
        places = np.argsort(np.append(np.flatnonzero(rest), alone))
        return pa.concat_arrays([found, pa.array(map(self.cut_one, texts.take(pa.array(alone)).to_pylist()), found.type)]).take(pa.array(places))

    def parts(self, texts: pa.Array, end: int | None = None) -> Iterator[pa.ListArray]:
        """The ids of texts (null: empty) in order, so many lists at a time as texts are cut; ``end`` goes behind each."""
        texts = texts.fill_null("")
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (self.part_bytes or PART_BYTES) + (sizes[at - 1] if at else 0), "right")))
            yield self._lists(texts.slice(at, to - at).cast(pa.string()), end)
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text's ids, little-endian and four bytes each."""
        return [x.tobytes() for part in self.parts(pa.array(texts, pa.string())) for x in arrays(part)]

    def _lists(self, texts: pa.Array, end: int | None) -> pa.ListArray:
        cut = self.cut(texts)
        pieces = cut.flatten().dictionary_encode()
        ids = self._ids_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        found = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))).take(pieces.indices)
        at, values = np.asarray(found.offsets)[np.asarray(cut.offsets) - cut.offsets[0].as_py()], np.asarray(found.values)
        if end is not None:
            at, values = at + np.arange(len(at), dtype=np.int32), np.insert(values, at[1:], end)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values))

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > (self.kept_pieces or KEPT_PIECES):
            self.known, self.older = dict(self.ids), self.known
        known, older = self.known, self.older
        ids = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None]
        wanted = [pieces[i] for i in missing]
        known.update((p, older[p]) for p in wanted if p in older)
        new = [p for p in wanted if p not in known]
        for at in range(0, len(new), PART_PIECES):
            part = self._encode_joined(new[at : at + PART_PIECES])
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        for i, p in zip(missing, wanted, strict=True):
            ids[i] = known[p]
        return ids

    def _encode_joined(self, new: list[str]) -> list[str]:
        """Encode what can be joined as one text, where ids show each piece's end or start; returns the pieces not encoded."""
        joined = [p for p in new if self.can_join(p)]
        if not joined:
            return new
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(joined)], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.edges[ids])
        at = np.append(0, edges + 1) if self.at_ends else np.append(edges, len(ids))
        if len(at) != len(joined) + 1 or at[0] != 0 or at[-1] != len(ids):  # some piece is more than one word to the tokenizer
            return new
        raw, at = ids.tobytes(), (4 * at).tolist()
        self.known.update(zip(joined, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        return [p for p in new if not self.can_join(p)]


def arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The values of each list, without a copy."""
    at, values = np.asarray(lists.offsets).tolist(), np.asarray(lists.values)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, pieces: str, kept_pieces: int | None = None, part_bytes: int | None = None) -> Encoder:
    return Encoder(path, pieces, added=True, kept_pieces=kept_pieces, part_bytes=part_bytes)


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)
