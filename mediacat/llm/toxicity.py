"""A toxicity classifier: character n-grams scaled by naive Bayes log-count ratios, weighted by a linear model.

* *Features.* A text is lower-cased (A-Z) and every white-space code ends a word. The n-grams of ``low`` to ``high``
  characters of each word with one space before and one after it are hashed into ``BUCKETS`` buckets; a document's value
  in a bucket is the number of its n-grams there over the root of its number of words (and ``FEW`` more), so that one
  chance hit in a long text weighs little and a few in a short one much.
* *Ratios.* Over the training rows, ``log((1 + s1) / (B + S1)) - log((1 + s0) / (B + S0))`` of each bucket, with the sums
  of the values in toxic and in other rows and their totals. Buckets whose mean values differ by ``least`` standard errors
  or more stay, at most ``features`` of them, the surest first. Sums are of whole numbers, so that models are the same
  however rows are dealt out.
* *Weights.* A logistic model over value times ratio of the buckets that stay; ``score`` is its probability.

Training rows are labelled rows outside the held-out third (``crc32`` of the id as text modulo 3 is 1), at most
``sample`` of each label: those of the lowest hashes of id and text, equal rows once. The choice is made on ids and
hashes alone, so that only chosen texts are shuffled. The driver gets at most ``BUCKETS`` sums and the chosen rows'
values in the buckets that stay.

Rows: a null or empty text has no features and scores the model's bias; a null ``doc_id`` is the empty id of the held-out
rule and has no label; repeated rows score alike; labels other than 0 and 1 are ignored, and an id with both labels trains
both. Without rows of both labels there are no features, and the score is the share of toxic rows, one of each label
added. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import id_key
from mediacat.llm.words import WHITE, HashPrefixes, segment_sums, slices, text_column

BUCKETS = 1 << 18
#: Added to the number of words.
FEW = 10
#: Values are summed as whole numbers of this fraction.
UNIT = 1 << 16


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the training rows of each label, ``features`` the buckets with a weight."""

    low: int = 3
    high: int = 6
    sample: int = 8000
    features: int = 1 << 13
    least: float = 3.0
    rounds: int = 200
    rate: float = 1.0
    decay: float = 1e-4
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Weight times ratio of every bucket, and the bias."""

    weights: np.ndarray
    bias: float


class Grams:
    """The hashed n-grams of a run of documents: ``buckets`` and ``docs``, one of each for every n-gram, and ``scale``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, low: int, high: int) -> None:
        self.n = len(offsets) - 1
        b = WHITE[raw]
        b = np.insert(np.append(b, np.uint8(0)), offsets[:-1], 0)  # a separator before each document and behind the last
        chars = np.flatnonzero((b & 0xC0) != 0x80)  # first bytes; a separator is a character
        blank = b[chars] == 0
        blanks = np.concatenate([[0], np.cumsum(blank)])
        edges = np.searchsorted(chars, offsets + np.arange(self.n + 1))
        opens = np.zeros(len(chars), np.int64)
        opens[1:] = blank[:-1] & ~blank[1:]
        self.scale = 1 / np.sqrt(segment_sums(opens, edges) + FEW)
        places, prefix = np.append(chars, len(b)), HashPrefixes(b)
        self.buckets, self.bounds = [], []
        for size in range(low, high + 1):
            first = np.arange(max(len(chars) - size + 1, 0))
            first = first[blanks[first + size - 1] == blanks[first + 1]]  # no separator but at the ends
            self.buckets.append((prefix.hashes(places[first], places[first + size]) & np.uint64(BUCKETS - 1)).astype(np.int64))
            self.bounds.append(np.searchsorted(first, edges))

    def values(self, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, bucket (or its number, where that is not negative) and value, ascending by the first two."""
        size, keys = BUCKETS if number is None else max(int(number.max()) + 1, 1), [np.zeros(0, np.int64)]
        for x, bounds in zip(self.buckets, self.bounds, strict=True):
            doc = np.repeat(np.arange(self.n), np.diff(bounds))
            if number is not None:
                x = number[x]
                doc, x = doc[x >= 0], x[x >= 0]
            keys.append(doc * size + x)
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        doc, bucket = key // size, key % size
        return doc, bucket, count * self.scale[doc]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return sum(segment_sums(weights[x], bounds) for x, bounds in zip(self.buckets, self.bounds, strict=True)) * self.scale


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def training_rows(documents: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """``text`` and ``toxic`` of at most ``sample`` rows of each label."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    marked = marked.select(F.col("doc_id").cast("long").alias("_key"), F.col("toxic").cast("int").alias("toxic")).distinct()
    keyed = documents.select(id_key().alias("_key"), _text()).withColumn("_hash", F.xxhash64("_key", "text"))
    known = keyed.select("_key", "_hash").join(marked, "_key").select("toxic", "_hash").distinct()
    chosen = [known.where(F.col("toxic") == y).orderBy("_hash").limit(how.sample) for y in (0, 1)]
    rows = keyed.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_hash")
    return rows.dropDuplicates(["_hash", "toxic"]).select("text", "toxic")


def _count(how: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((4, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            rows += np.bincount(toxic, minlength=2)
            for first, last, raw, offsets in slices(text_column(batch.column("text"))):
                doc, bucket, value = Grams(raw, offsets, how.low, how.high).values()
                for y in (0, 1):
                    of = toxic[first:last][doc] == y
                    whole = np.rint(value[of] * UNIT).astype(np.int64)
                    np.add.at(sums[y], bucket[of], whole)
                    np.add.at(sums[2 + y], bucket[of], whole * whole // UNIT)
        has = np.flatnonzero(sums[:2].any(axis=0))
        none = np.zeros(1, np.int64)
        columns = [np.append(has, -1), np.append(sums[0, has], rows[0]), np.append(sums[1, has], rows[1]), np.append(sums[2, has], none), np.append(sums[3, has], none)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "s0", "s1", "q0", "q1"])

    return run


def log_count_ratios(rows: DataFrame, how: Training = Training()) -> tuple[np.ndarray, np.ndarray, float]:
    """The buckets that stay, their ratios, and the log odds of a toxic row."""
    names = ("s0", "s1", "q0", "q1")
    counted = rows.mapInArrow(_count(how), "bucket long, s0 long, s1 long, q0 long, q1 long").groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    bucket, *sums = (np.asarray(counted.column(x).combine_chunks()) if counted.num_rows else np.zeros(0, np.int64) for x in ("bucket", *names))
    all0, all1 = (int(x[bucket < 0].sum()) for x in sums[:2])
    prior = float(np.log((all1 + 1) / (all0 + 1)))
    if not all0 or not all1:
        return np.zeros(0, np.int64), np.zeros(0), prior
    s0, s1, q0, q1 = (x[bucket >= 0] / UNIT for x in sums)
    bucket = bucket[bucket >= 0]
    ratio = np.log((1 + s1) / (len(bucket) + s1.sum())) - np.log((1 + s0) / (len(bucket) + s0.sum()))
    spread = sum(np.maximum(q / n - (s / n) ** 2, 0) / n + 1e-3 / n**2 for s, q, n in ((s0, q0, all0), (s1, q1, all1)))
    sure = np.abs(s1 / all1 - s0 / all0) / np.sqrt(spread)
    kept = np.lexsort((bucket, -sure))[: how.features]
    kept = kept[sure[kept] >= how.least]
    kept = kept[np.argsort(bucket[kept])]
    return bucket[kept], ratio[kept], prior


def _featured(number: np.ndarray, how: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic")
            for first, last, raw, offsets in slices(text_column(batch.column("text"))):
                some = Grams(raw, offsets, how.low, how.high)
                doc, feature, value = some.values(number)
                ends = np.searchsorted(doc, np.arange(some.n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*lists, toxic.slice(first, last - first)], ["feature", "value", "toxic"])

    return run


def fit(feature: np.ndarray, doc: np.ndarray, value: np.ndarray, toxic: np.ndarray, features: int, prior: float, how: Training) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by descent with momentum; ``value`` holds the scaled ones.

    Both labels weigh alike in sum. The step is ``rate`` over the largest curvature, found by powers of the rows' products.
    """
    n = len(toxic)
    share = np.where(toxic == 1, 0.5 / max(np.count_nonzero(toxic == 1), 1), 0.5 / max(np.count_nonzero(toxic == 0), 1))
    across = np.ones(features)
    for _ in range(8):
        across /= max(np.linalg.norm(across), 1e-12)
        across = np.bincount(feature, (share * np.bincount(doc, across[feature] * value, n))[doc] * value, features)
    rate = how.rate / max(np.linalg.norm(across), 1e-12)
    weights, bias, step, bias_step = np.zeros(features), prior, np.zeros(features), 0.0
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights[feature] * value, n) + bias, -50, 50)))
        error = (p - toxic) * share
        step = 0.9 * step + np.bincount(feature, error[doc] * value, features) + how.decay * weights
        bias_step = 0.9 * bias_step + error.sum()
        weights, bias = weights - rate * step, bias - 0.5 * how.rate * bias_step
    return weights, float(bias)


def train(documents: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    rows = training_rows(documents, labels, how)
    bucket, ratio, prior = log_count_ratios(rows, how)
    weights = np.zeros(BUCKETS)
    if not len(bucket):
        return Model(weights, prior)
    number = np.full(BUCKETS, -1, np.int64)
    number[bucket] = np.arange(len(bucket))
    found = rows.mapInArrow(_featured(number, how), "feature array<int>, value array<float>, toxic int").toArrow().sort_by([("toxic", "ascending")])
    feature, value, toxic = (found.column(x).combine_chunks() for x in ("feature", "value", "toxic"))
    doc = np.repeat(np.arange(len(feature)), np.asarray(feature.value_lengths()))
    feature = np.asarray(feature.flatten())
    own, bias = fit(feature, doc, np.asarray(value.flatten()) * ratio[feature], np.asarray(toxic), len(bucket), prior, how)
    weights[bucket] = own * ratio
    return Model(weights, bias)


def score(documents: DataFrame, model: Model, how: Training = Training()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.zeros(0), *(Grams(raw, offsets, how.low, how.high).sums(weights) for _, _, raw, offsets in slices(text_column(batch.column("text"))))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(sums) + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= how.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(documents: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """Train on the labelled rows that are not held out and score all documents."""
    return score(documents, train(documents, labels, how), how)
