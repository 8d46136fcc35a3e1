"""Near-duplicate documents by an inverted join over MinHash coordinates, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct runs of five words (of all its words if it has fewer). Its
signature has ``COORDINATES`` minima. Texts with equal sets are one class, found by grouping sums over the sets.

1. *Post.* A class is posted under its (coordinate, value) pairs. Values that no other class has are dropped; a class
   needs ``m`` shared ones to reach any other. Of its ``r`` shared pairs, rarest first, only the first
   ``r - m + 1`` are posted (prefix): two classes with enough agreements share one of these, and pairs that half
   the corpus has, from a common passage, are not posted at all.
2. *Count.* Long lists are cut into blocks, and each pair of blocks is a group of its own in some task. There the
   agreeing coordinates of two classes are counted; from those with ``m`` or more a task keeps a spanning forest,
   so that what it returns grows with its rows and not with their pairs (skip: what is already connected is not told).
3. *Confirm.* The components of these candidates hold every possible link. Each component's full sets meet once (in
   pairs of blocks if it is large): a product of incidence matrices gives all intersections, and pairs with
   ``100 * intersection >= threshold * union`` are links; a task again returns a spanning forest of them.
4. The components of the links give the result.

Two sets at the threshold agree in each coordinate with a probability of ``threshold`` in 100. ``matches`` takes the
largest ``m`` that such pairs miss with a probability of ``MISSED`` at most: 15 of 32 at 85 (8.2e-8, once in 1.2 * 10**7
pairs), 12 at 80 (2.6e-8). No list, block or component is capped.

A class is named by a hash of its set, never by an id, so that texts which share an id are told apart. The smallest
``doc_id`` of a component names it; the row of that id is kept, of several texts with it the one of the least hash. So
every component keeps exactly one text.

Rows: a null or empty text has the empty set, links with nothing and is kept; a repeated ``doc_id`` has a row for each
text, each in the component of its text, and rows equal in id and text are kept or not together; a null ``doc_id`` sorts
first, so that its row is kept, and comes back as null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.components import components, local_labels, whole_runs
from mediacat.llm.shared import NO_ID, id_key, materialize
from mediacat.llm.words import WHITE, hash_words, mix, segment_sums, slices, text_column

SIZE = 5
COORDINATES = 32
#: The default threshold, in hundredths, and the probability that a pair at a threshold has too few agreements.
THRESHOLD, MISSED = 85, 1e-7
#: Classes in a block of a list; classes and shingles in a block of a component.
LIST_BLOCK, SET_BLOCK, SHINGLE_BLOCK = 1024, 256, 2_000_000
#: Members of a run that are compared row by row.
SHORT = 16

_ODD = mix(np.arange(1, 100, dtype=np.uint64)) | np.uint64(1)


def matches(threshold: int) -> int:
    """The agreeing coordinates that candidates need: the most that pairs at the threshold fall short of with ``MISSED`` at most."""
    p, m, missed = threshold / 100, 1, (1 - threshold / 100) ** COORDINATES
    while m < COORDINATES and (missed := missed + comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= MISSED:
        m += 1
    return m


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within documents, and where each document's begin."""
    count = np.diff(bounds)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    values = sum(padded[j : j + len(words)] * _ODD[j] for j in range(size))
    left = np.repeat(bounds[1:], count) - np.arange(len(words))
    used = left >= size
    short = np.flatnonzero((count > 0) & (count < size))
    whole = np.full(len(short), 0, np.uint64)
    for j in range(size - 1):
        has = count[short] > j
        whole[has] += words[bounds[short[has]] + j] * _ODD[size + j]
    values[bounds[short]] = whole + count[short].astype(np.uint64)
    used[bounds[short]] = True
    return mix(values[used]), np.concatenate([[0], np.cumsum(used)])[bounds]


def distinct_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents: first and last row, their sorted distinct shingles, where each document's begin."""
    for first, last, raw, offsets in slices(column):
        h, bounds = shingles(*hash_words(raw, offsets, WHITE))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        fresh[bounds[:-1][bounds[:-1] < len(h)]] = True
        yield first, last, h[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The posting keys of each non-empty document, coordinate by coordinate: number from 1, then the minimum."""
    some = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(some), COORDINATES), np.int64)
    for k in range(COORDINATES):
        if len(some):
            low = np.minimum.reduceat((h * _ODD[k + 20]) >> np.uint64(32), some)
            out[:, k] = ((k + 1) << 32) + low.astype(np.int64)
    return out


SKETCH = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, posts array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), text_column(batch.column("text"))
        for first, last, h, bounds in distinct_sets(texts):
            n = np.diff(bounds)
            posts = minima(h, bounds)
            ends = np.concatenate([[0], np.cumsum((n > 0) * COORDINATES)]).astype(np.int32)
            columns = [
                ids.slice(first, last - first),
                batch.column("text_hash").slice(first, last - first),
                pa.array(n.astype(np.int64)),
                pa.array(segment_sums(mix(h ^ np.uint64(0xA5A5A5A5)), bounds).view(np.int64)),
                pa.array(segment_sums(mix(h + np.uint64(0x5C5C5C5C)), bounds).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(posts.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "posts"])


def sketch(documents: DataFrame) -> DataFrame:
    """Per row: the size of its set, two sums that identify the set, its posting keys."""
    docs = documents.select(id_key().alias("doc_id"), text_key().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_sketched, SKETCH)


def text_key() -> Column:
    """With the id, what tells documents apart."""
    return F.xxhash64(F.col("text").cast("string"))


def in_block_pairs(df: DataFrame, group: str, member: str, blocks: Column) -> DataFrame:
    """Each member once for every pair of blocks of its group that holds its block, under the pair's key ``run``."""
    df = df.withColumn("_blocks", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    run = F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("run", run).drop("_blocks", "_own", "_other").repartition(parts, "run").sortWithinPartitions("run")


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges between nodes that connect what the edges between rows a and b connect."""
    distinct, place = np.unique(nodes, return_inverse=True)
    label = local_labels(place[a], place[b], len(distinct))
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    return pa.RecordBatch.from_arrays([pa.array(distinct[moved]), pa.array(distinct[label[moved]])], ["a", "b"])


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "run"):
            runs, nodes = table.column("run").to_numpy(), table.column("node").to_numpy()
            lists = table.column("shared").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            at, keys = np.asarray(lists.offsets), np.asarray(lists.values)
            keys, row = keys[at[0] : at[-1]], np.repeat(np.arange(len(runs)), np.diff(at))
            grid = np.zeros((len(runs), COORDINATES), np.int64)
            grid[row, (keys >> 32) - 1] = keys
            heads = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            sizes = np.diff(np.append(heads, len(runs)))
            left, right, shift = [], [], 1
            for first, n in zip(heads[sizes > SHORT], sizes[sizes > SHORT], strict=True):  # all pairs of a long run at once
                same = np.zeros((n, n), np.int8)
                for k in range(COORDINATES):
                    column = grid[first : first + n, k]
                    same += (column[:, None] == column) & (column != 0)
                i, j = np.nonzero(np.triu(same >= least, 1))
                left.append(i + first)
                right.append(j + first)
            here = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))  # rows of all short runs, each with the next, the next but one ...
            while len(here := here[here + shift < len(runs)]) and len(here := here[runs[here] == runs[here + shift]]):
                for i in range(0, len(here), 1 << 14):
                    some = here[i : i + (1 << 14)]
                    same = ((grid[some] == grid[some + shift]) & (grid[some] != 0)).sum(axis=1)
                    left.append(some[same >= least])
                    right.append(some[same >= least] + shift)
                shift += 1
            if left:
                yield _forest(nodes, np.concatenate(left), np.concatenate(right))

    return run


def candidates(classes: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) between classes (node, posts) whose components hold every pair with ``least`` agreements."""
    posts = classes.select("node", F.explode("posts").alias("post"))
    often = posts.groupBy("post").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = posts.join(often, "post").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "post"))).alias("ranked"))
    ranked = ranked.where(F.size("ranked") >= least).select("node", F.transform("ranked", lambda x: x["post"]).alias("shared"))
    prefix = F.slice("shared", F.lit(1), F.size("shared") - (least - 1))
    posted = materialize(ranked.select("node", "shared", F.explode(prefix).alias("post")), "posted")
    lengths = posted.groupBy("post").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    lists = in_block_pairs(posted.join(lengths, "post"), "post", "node", F.ceil(F.col("length") / LIST_BLOCK))
    return lists.select("run", "node", "shared").mapInArrow(_agreeing(least), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, h, bounds in distinct_sets(text_column(batch.column("text"))):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, last - first) for c in ("node", "label", "blocks")] + [lists], ["node", "label", "blocks", "shingles"])


def linked(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with ``100 * intersection >= threshold * union``."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column, wide = row[keep], number[column[keep]], int((count > 1).sum())
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    common, step = np.zeros((n, n), np.float64), max(256, (4 << 20) // n)
    for at in range(0, wide, step):
        a, b = np.searchsorted(column, [at, at + step])
        has = np.zeros((n, min(step, wide - at)), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        common += has @ has.T
    inter = common.astype(np.int64)
    i, j = np.nonzero(np.triu(100 * inter >= threshold * (size[:, None] + size - inter), 1))
    return i, j


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "run"):
            runs, nodes = table.column("run").to_numpy(), table.column("node").to_numpy()
            lists = table.column("shingles").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            at, values = np.asarray(lists.offsets), np.asarray(lists.values)
            heads = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            left, right = [], []
            for first, last in zip(heads, np.append(heads[1:], len(runs)), strict=True):
                if last - first > 1:
                    i, j = linked([values[at[k] : at[k + 1]] for k in range(first, last)], threshold)
                    left.append(i + first)
                    right.append(j + first)
            if left:
                yield _forest(nodes, np.concatenate(left), np.concatenate(right))

    return run


def links(documents: DataFrame, classes: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """Edges that connect the true links within groups (node, label) of classes; one text stands for a class."""
    members = groups.join(classes.select("node", "n_shingles", "low"), "node")
    sized = members.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("members") / SET_BLOCK), F.ceil(F.col("total") / SHINGLE_BLOCK)).cast("int")
    wanted = members.join(sized.select("label", blocks.alias("blocks")), "label").select("node", "label", "blocks", F.col("low.doc_id").alias("_id"), F.col("low.text_hash").alias("_text"))
    docs = documents.select(id_key().alias("_id"), text_key().alias("_text"), F.col("text").cast("string").alias("text"))
    texts = docs.join(wanted, ["_id", "_text"]).dropDuplicates(["_id", "_text"])
    sets = texts.select("node", "label", "blocks", "text").mapInArrow(_sets, "node long, label long, blocks int, shingles array<long>")
    dealt = in_block_pairs(sets, "label", "node", F.col("blocks"))
    return dealt.select("run", "node", "shingles").mapInArrow(_confirmed(threshold), "a long, b long")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id (the smallest id reachable over links), kept.

    ``threshold`` is in hundredths.
    """
    sketches = materialize(sketch(documents), "sketches")
    some, own = sketches.where("n_shingles > 0"), ["n_shingles", "set_a", "set_b"]
    classes = some.groupBy(*own).agg(F.min(F.struct("doc_id", "text_hash")).alias("low"), F.first("posts").alias("posts"))
    classes = materialize(classes.withColumn("node", F.xxhash64(*own)), "classes")
    groups = components(candidates(classes, matches(threshold)))
    found = components(links(documents, classes, groups, threshold))
    lows = classes.select("node", *own, "low")
    lowest = found.join(lows, "node").groupBy("label").agg(F.min("low").alias("lowest"))
    placed = lows.join(found.join(lowest, "label").select("node", "lowest"), "node", "left").select(*own, F.coalesce("lowest", "low").alias("lowest"))
    rows = some.drop("posts").join(placed, own).withColumn("kept", F.struct("doc_id", "text_hash") == F.col("lowest"))
    rows = rows.select("doc_id", "text_hash", "n_shingles", F.col("lowest.doc_id").alias("component_id"), "kept")
    alone = sketches.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return rows.unionByName(alone).select(real("doc_id"), "text_hash", "n_shingles", real("component_id"), "kept")
