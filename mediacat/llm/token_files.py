"""Token ids in Parquet: list columns with delta encoding, small row groups and page indexes.

``write_token_files`` deals documents out by ranges of ``doc_id``, encodes each range in one pass and writes it as one
file in ascending order, so that the files in order of their numbers hold the corpus. ``tokens`` is a list of int32
without a dictionary, so that the writer's second version packs it by deltas; ``doc_id`` and the counts are sorted and
delta-packed too, and row groups and pages are kept small. A reader that wants one document prunes by the row groups'
and pages' ranges of ``doc_id``; one that wants counts reads no ids at all.

Rows: a null text is empty and holds the end id alone; a null ``doc_id`` sorts first; repeated ids are kept, ordered by
text. An empty table gives files without rows. Other columns of the documents are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.llm.shared import id_key, shared_path
from mediacat.llm.tokens import encoder, tokenizer_path


@dataclass(frozen=True)
class TokenFormat:
    """A tokenizer file, how its texts are cut, and the layout of the files."""

    tokenizer: str = "word_bpe_49k.json"
    pieces: str = "words"
    end_id: int = 1
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10

    def writer_options(self) -> dict[str, str]:
        return {
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "false",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.write-checksum.enabled": "true",
            "parquet.columnindex.truncate.length": "64",
            "compression": "zstd",
        }


SCHEMA = "doc_id long, tokens array<int>, n_tokens long, start_in_file long"


def _encoded(form: TokenFormat, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, parts = 0, encoder(path, form.pieces).parts
        for batch in batches:
            row = 0
            for lists in parts(batch.column("text"), form.end_id):
                at = np.asarray(lists.offsets).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(lists)), lists, pa.array(np.diff(at)), pa.array(before + at[:-1])], ["doc_id", "tokens", "n_tokens", "start_in_file"])
                row, before = row + len(lists), before + int(at[-1])

    return run


def write_token_files(documents: DataFrame, path: str, form: TokenFormat = TokenFormat()) -> None:
    """Encode every whole text and write the ids below ``path`` in ascending order of ``doc_id``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, id_key()).sortWithinPartitions(id_key(), "text")
    ordered.mapInArrow(_encoded(form, tokenizer_path(form.tokenizer)), SCHEMA).write.options(**form.writer_options()).parquet(path)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        at, ids = np.asarray(lists.offsets), np.ascontiguousarray(np.asarray(lists.values), "<i4").view(np.uint8)
        sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "file_no", "n_tokens", "start_in_file")] + [pa.array(sums, pa.int64())], ["doc_id", "file_no", "n_tokens", "start_in_file", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``file_no``, the place of their file in the corpus."""
    files = spark.read.schema(SCHEMA).parquet(path)
    return files.withColumn("file_no", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start among all ids, n_tokens, ids_crc32.

    Starts count within files when written; the files' totals, one row for each file, place them in the corpus.
    """
    rows = read_token_files(spark, path)
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens"))
    before = F.coalesce(F.sum("file_tokens").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("file_no", before.alias("base"))
    sums = rows.select("doc_id", "file_no", "n_tokens", "start_in_file", "tokens").mapInArrow(_checked, "doc_id long, file_no long, n_tokens long, start_in_file long, ids_crc32 long")
    return sums.join(bases, "file_no").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_files(documents: DataFrame, form: TokenFormat = TokenFormat()) -> DataFrame:
    """Write the files to the shared folder and return what ``token_index`` reads from them."""
    path = shared_path(documents.sparkSession, "token-files")
    write_token_files(documents, path, form)
    return token_index(documents.sparkSession, path)
