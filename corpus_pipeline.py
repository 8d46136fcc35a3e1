"""The corpus pipeline: documents become packed training sequences.

Each stage works on all rows its predecessor kept and returns the columns of documents, but for the last:

* quality classifier: documents that it rejects go;
* near-duplicates: of each group of documents linked at a similarity of 0.8 or more, one of the smallest id stays;
* decontamination: documents in which a benchmark passage occurs go;
* secret scan: every span of a secret is replaced in the text;
* packing: the texts become pieces of token sequences.

Empty tables pass through every stage; nulls and repeated rows are treated as the operators' modules say. Documents that
repeat both id and text are one after the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import decontaminate, near_dedup, packing, quality, secret_scan
from mediacat.llm.shared import NO_ID, bound_batches, id_key, materialize, table


#: Executors come to the last stage with what four stages left in them: its workers keep fewer pieces than ``op8``'s, at
#: the cost of encoding some again.
PACKING = packing.PackingPlan(kept_pieces=100_000, part_bytes=1 << 20)

#: Documents are near-duplicates from this similarity of their word shingles on, in hundredths.
NEAR_HUNDREDTHS = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return quality.keep_good(docs, quality.train(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    kept = near_dedup.near_duplicates(docs, NEAR_HUNDREDTHS).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_kept_id"), F.col("text_hash").alias("_kept_text"))
    keyed = docs.withColumns({"_kept_id": id_key(), "_kept_text": near_dedup.text_key()})
    return keyed.join(kept, ["_kept_id", "_kept_text"], "left_semi").dropDuplicates(["_kept_id", "_kept_text"]).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_hit_id"), F.col("text_hash").alias("_hit_text"))
    keyed = docs.withColumns({"_hit_id": id_key(), "_hit_text": F.xxhash64("text")})
    return keyed.join(found, ["_hit_id", "_hit_text"], "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs, PACKING)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Token ids and the trained models have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
