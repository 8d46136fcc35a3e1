"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. For each of ``samples`` coordinates a term of
weight ``S`` draws ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)`` from its hash, and with ``t = floor(ln S / r + b)`` has the
value ``ln c - r (t - b) - r``; the term of the lowest value and its ``t`` are the coordinate. Two texts agree in a
coordinate with the probability of their generalised Jaccard similarity, the sum of smaller over the sum of larger
weights. A coordinate is kept as 16 bits of the hash of ``(term, t)``, four hexadecimal digits of the fingerprint.

The gamma quantiles are tabulated once for 2**16 probabilities. A term's draws depend on its hash alone, so all workers
agree; within a run of texts each pair of term and weight is drawn once.

Rows: a null text is empty; a text without words has the empty fingerprint, which is like (1.0) another empty one and
unlike (0.0) any other. A null ``doc_id`` sorts first, rows of the same ``doc_id`` by text. The only row of a table is
its own successor. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.ordering import with_successors
from mediacat.llm.shared import id_key
from mediacat.llm.words import WHITE, hash_words, mix, slices

SAMPLES = 64
#: Pairs of term and weight that draw at a time.
DRAWN = 4096


@lru_cache(maxsize=1)
def gamma_table() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), at 2**16 probabilities."""
    x = np.concatenate([np.geomspace(1e-4, 1, 40_000), np.linspace(1, 20, 60_000)[1:]])
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    r = np.interp(p, -np.expm1(-x + np.log1p(x)), x).astype(np.float32)
    return r, np.log(r)


def draw_keys(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each pair and coordinate a number that orders by value and ends in 16 bits of the hash of (term, t)."""
    quantile, log_quantile = gamma_table()
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64))
    h = (terms[:, None] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    r = quantile[(h & np.uint64(0xFFFF)).astype(np.int64)]
    log_c = log_quantile[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
    b = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(1 << 16)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    value = log_c - r * (t - b) - r
    bits = value.view(np.uint32)
    order = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # floats as ascending integers
    tag = (h >> np.uint64(40)) + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (order << np.uint64(32)) | ((tag ^ (tag >> np.uint64(32))) & np.uint64(0xFFFFFFFF))


def signatures(words: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """The coordinates, one row of 16-bit numbers for each document; rows of documents without words are of no use."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    by_word = np.argsort(words, kind="stable")  # then documents ascend within a word
    w, d = words[by_word], doc[by_word]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(fresh)
    weight = np.diff(np.append(at, len(w)))
    term, owner = w[at], d[at]
    pair = np.lexsort((weight, term)) if len(term) else np.zeros(0, np.int64)
    new = np.ones(len(pair), bool)
    new[1:] = (term[pair][1:] != term[pair][:-1]) | (weight[pair][1:] != weight[pair][:-1])
    best = np.full((n, samples), np.iinfo(np.uint64).max, np.uint64)
    heads = np.append(np.flatnonzero(new), len(pair))
    for i in range(0, len(heads) - 1, DRAWN):
        first, last = heads[i], heads[min(i + DRAWN, len(heads) - 1)]
        rows = pair[first:last]
        distinct = pair[heads[i : i + DRAWN][heads[i : i + DRAWN] < last]]
        keys = draw_keys(term[distinct], weight[distinct], samples)
        which = np.cumsum(new[first:last]) - 1
        by_owner = np.argsort(owner[rows], kind="stable")
        owners, starts = np.unique(owner[rows][by_owner], return_index=True)
        best[owners] = np.minimum(best[owners], np.minimum.reduceat(keys[which[by_owner]], starts, axis=0))
    return (best & np.uint64(0xFFFF)).astype(">u2")


def fingerprint_texts(texts: list[str], samples: int = SAMPLES) -> list[str]:
    """Fingerprints of whole texts; empty for a text without words."""
    out: list[str] = []
    for _, _, raw, offsets in slices(pa.array(texts, pa.large_string())):
        words, bounds = hash_words(raw, offsets, WHITE)
        for row, some in zip(signatures(words, bounds, samples), np.diff(bounds), strict=True):
            out.append(row.tobytes().hex() if some else "")
    return out


def likeness(a: str, b: str) -> float:
    """The share of coordinates in which two fingerprints agree."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """The last half replaced by as many first code points of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Texts compared at a time.
BATCH = 256


def _compared(samples: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(part: list[tuple]) -> pa.RecordBatch:
        """All rows of a part but the last, each compared with the one behind it."""
        own = fingerprint_texts([x[2] for x in part], samples)
        changed = [edited(a[2], b[2]) for a, b in zip(part[:-1], part[1:], strict=True)]
        other = fingerprint_texts(changed, samples)
        keep = [i for i in range(len(part) - 1) if not part[i][3]]
        columns = [
            [part[i][1] for i in keep],
            [len(part[i][2]) for i in keep],
            [hashlib.sha256(changed[i].encode()).hexdigest() for i in keep],
            [own[i] for i in keep],
            [other[i] for i in keep],
            [likeness(own[i], other[i]) for i in keep],
            [likeness(own[i], own[i + 1]) for i in keep],
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                held += zip(*(part.column(c).to_pylist() for c in ("range_no", "doc_id", "text", "is_guest")), strict=True)
                if len(held) > 1:
                    yield rows(held)
                    held = held[-1:]

    return run


def fingerprint_documents(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likeness to the edited and to the next text."""
    docs = documents.select(id_key().alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = with_successors(docs, "_key").select("range_no", "doc_id", "text", "is_guest")
    return dealt.mapInArrow(_compared(samples), SCHEMA)
