"""Connected components of large graphs with joins, and of small ones inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import materialize


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n-1 the least node of their component under edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for all nodes of ``edges`` (columns a, b): nodes of one component have one label.

    Each round every node moves to the neighbour of the least random rank, or stays; edges between what remains go into
    the next round. Ranks are hashes, so that no order of ids makes a long chain, and stay, so that what has moved to the
    least node of a star is done. A round reads and writes only edges that still join different nodes; each is a table in
    the shared folder.
    """
    spark, maps, rank = edges.sparkSession, [], F.xxhash64
    edges = materialize(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    while not edges.isEmpty():
        near = edges.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("x"))).alias("m"))
        moved = F.least(F.col("m"), F.struct(rank("a").alias("r"), F.col("a").alias("x")))["x"]
        step = materialize(near.select(F.col("a").alias("node"), moved.alias("label")), "labels")
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("label").alias("la")), step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = materialize(edges.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "node long, label long")
    found = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("label"), F.col("label").alias("later"))
        found = found.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label"))
    return found


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of batches sorted by ``key``, cut so that no value of it is in two of them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
