"""Cost-balanced packing of token ids into sequences of a fixed length.

The cost of a piece of ``n`` tokens is ``linear * n + quadratic * n * n``: attention stays within a piece. Each input
split is packed on its own, in blocks of bounded size, without a shuffle. In a block

1. whole sequences are cut off each document; such a piece fills a sequence by itself;
2. the remainders, by descending cost, each go to the sequence of lowest cost that has room; a piece longer than the
   room is cut, and its rest goes on at once to the sequence that is then cheapest;
3. the block's last tokens, fewer than one sequence, fill sequences whose lengths are powers of two.

So every sequence is full or a power of two, and none is padded. Sequence ids hold the split's number above 2**31 times
and a count below it: they are unique, and the same when a lost task runs again on its split.

Rows: a null text is empty and holds the end id alone; rows with repeated or null ``doc_id`` are packed like any other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.tokens import arrays, encoder, tokenizer_path

#: Documents after which a block may end.
BATCH = 256


@dataclass(frozen=True)
class PackingPlan:
    """``block`` documents are packed together, a worker keeps two times ``kept_pieces`` encoded pieces and cuts ``part_bytes``
    of text at a time; these bound a task's memory, and the last two change no result (none: the encoder's own)."""

    tokenizer: str = "byte_bpe_50k.json"
    pieces: str = "bytes"
    end_id: int = 0
    capacity: int = 1024
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    block: int = 8192
    kept_pieces: int | None = None
    part_bytes: int | None = None

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


@dataclass
class Piece:
    doc: int  # row in the block
    start: int
    ids: np.ndarray
    sequence: int = -1
    offset: int = 0


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def balance(rests: list[Piece], plan: PackingPlan) -> tuple[list[Piece], int]:
    """Assign pieces shorter than a sequence: placed pieces with sequences from 0, and the number of sequences."""
    total = sum(len(x.ids) for x in rests)
    sizes = [plan.capacity] * (total // plan.capacity) + powers_of_two(total % plan.capacity)
    filled, placed = [0] * len(sizes), []
    heap = [(0.0, s) for s in range(len(sizes))]  # already a heap: costs are equal and the numbers ascend
    for piece in sorted(rests, key=lambda x: (-plan.cost(len(x.ids)), x.doc, x.start)):
        doc, start, ids = piece.doc, piece.start, piece.ids
        while len(ids):
            cost, s = heapq.heappop(heap)
            n = min(len(ids), sizes[s] - filled[s])
            placed.append(Piece(doc, start, ids[:n], s, filled[s]))
            filled[s] += n
            if filled[s] < sizes[s]:
                heapq.heappush(heap, (cost + plan.cost(n), s))
            start, ids = start + n, ids[n:]
    return placed, len(sizes)


def pack_block(texts: list[np.ndarray], plan: PackingPlan) -> tuple[list[Piece], int]:
    """All pieces of a block of documents, and the number of its sequences."""
    whole, rests = [], []
    for doc, ids in enumerate(texts):
        full = len(ids) - len(ids) % plan.capacity
        whole += [Piece(doc, at, ids[at : at + plan.capacity]) for at in range(0, full, plan.capacity)]
        if full < len(ids):
            rests.append(Piece(doc, full, ids[full:]))
    placed, n = balance(rests, plan)
    for i, piece in enumerate(whole):
        piece.sequence = n + i
    return whole + placed, n + len(whole)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(plan: PackingPlan, path: str):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(ids: list, texts: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        pieces, n = pack_block(texts, plan)
        columns = [
            [ids[x.doc] for x in pieces],
            [x.start for x in pieces],
            [len(x.ids) for x in pieces],
            [zlib.crc32(x.ids) for x in pieces],
            [len(texts[x.doc]) for x in pieces],
            [first + x.sequence for x in pieces],
            [x.offset for x in pieces],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first = encoder(path, plan.pieces, plan.kept_pieces, plan.part_bytes).parts, TaskContext.get().partitionId() << 31
        ids, texts, held = [], [], 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            new = (x for part in parts(batch.column("text"), plan.end_id) for x in arrays(part))
            for row, (doc_id, text) in enumerate(zip(doc_ids, new, strict=True), 1):
                ids.append(doc_id)
                texts.append(text)
                held += text.nbytes - 4
                if (row % BATCH == 0 or row == len(doc_ids)) and (len(ids) >= plan.block or held >= plan.block * plan.capacity * 4):
                    out, first = rows(ids, texts, first)
                    yield out
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts, first)[0]
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return run


def pack_documents(documents: DataFrame, plan: PackingPlan = PackingPlan()) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_packed(plan, tokenizer_path(plan.tokenizer)), SCHEMA)
