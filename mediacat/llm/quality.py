"""A quality classifier trained without labels: heuristic labellers, their accuracies, a hashed linear scorer.

1. *Label.* Each document gets votes: bad, good or none from overlapping heuristics over its words and bytes.
2. *Weigh.* Votes are counted by pattern over all documents (at most 2 ** 10 patterns). Expectation-maximisation on the
   counts estimates each labeller's vote probabilities for good and for bad documents and the share of bad ones; a
   pattern's posterior follows.
3. *Train.* The rows of the lowest hashes of id and text, at most ``sample``, get their pattern's posterior as a soft label. A
   logistic model is fitted on hashed features: the shares of their words, of the shapes of their words, and of words
   equal to the one before, in 2 ** 16 buckets.
4. *Score.* Every document is scored over its whole text; below ``threshold`` it is rejected.

Rows: a null or empty text has no votes and no features but the bias of the model, and is rejected only if the model's
prior says so; repeated rows score alike, and are one row of the sample; a null ``doc_id`` stays null. On an empty
table nothing is fitted and nothing returned. Other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import id_key
from mediacat.llm.words import find_words, hash_spans, segment_sums, separators, slices, text_column

BUCKETS = 1 << 16
LABELLERS = ("symbols", "odd_words", "shouting", "exclaims", "repeats", "few_distinct", "no_sentences", "prose", "vocabulary", "plain")
NONE, GOOD, BAD = 0, 1, 2
#: Added to the number of words in shares, so that a few words weigh less than the bias.
FEW = 5


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the documents the scorer is fitted on; what is bad with probability over 1 - ``threshold`` goes."""

    sample: int = 4000
    rounds: int = 200
    rate: float = 2.0
    decay: float = 1e-4
    threshold: float = 0.35


def _table(codes: str | bytes) -> np.ndarray:
    to = np.zeros(256, bool)
    to[list(codes.encode() if isinstance(codes, str) else codes)] = True
    return to


_WHITE = separators(bytes([0x20, *range(0x09, 0x0E)]))
_SYMBOL = _table("#$%&*+<=>@[\\]^_`{|}~")
_UPPER, _LOWER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
_END = _table(".!?")
_REPEAT = 77  # the bucket of words equal to the one before


def _shape_table() -> np.ndarray:
    to = _WHITE.copy()
    for codes, shape in ((_UPPER, "A"), (_LOWER, "a"), (_DIGIT, "0"), (_table(bytes(range(128, 256))), "a")):
        to[codes] = ord(shape)
    return to


_SHAPE = _shape_table()


@dataclass
class Slice:
    """Word statistics of a run of documents."""

    raw: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        lowered = _WHITE[self.raw]
        self.starts, self.ends, self.bounds = find_words(lowered != 0, self.offsets)
        self.words = hash_spans(lowered, self.starts, self.ends)
        self.shapes = hash_spans(_SHAPE[self.raw], self.starts, self.ends)
        self.n = np.diff(self.bounds)
        self.repeat = np.zeros(len(self.words), bool)
        self.repeat[1:] = self.words[1:] == self.words[:-1]
        self.repeat[self.bounds[:-1][self.n > 0]] = False

    def byte_count(self, which: np.ndarray) -> np.ndarray:
        return segment_sums(which[self.raw].astype(np.int64), self.offsets)

    def word_share(self, flags: np.ndarray) -> np.ndarray:
        return segment_sums(flags.astype(np.int64), self.bounds) / np.maximum(self.n, 1)

    def distinct_share(self) -> np.ndarray:
        out = np.zeros(len(self.n))
        for i, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            if b > a:
                some = np.sort(self.words[a:b])
                out[i] = (1 + np.count_nonzero(some[1:] != some[:-1])) / (b - a)
        return out

    def votes(self) -> np.ndarray:
        """A column for each labeller."""
        n, size = self.n, np.maximum(segment_sums(self.ends - self.starts, self.bounds), 1)
        last = self.raw[self.ends - 1] if len(self.ends) else np.zeros(0, np.uint8)
        plain = np.concatenate([[0], np.cumsum(~(_SYMBOL[self.raw] | (self.raw < 48) | ((self.raw > 57) & (self.raw < 65))))])
        bare = plain[self.ends] == plain[self.starts]
        symbols = self.byte_count(_SYMBOL) / size
        odd = self.word_share(_SYMBOL[last] | bare)
        upper, lower = self.byte_count(_UPPER), self.byte_count(_LOWER)
        shout = upper / np.maximum(upper + lower, 1)
        exclaim = self.byte_count(_table("!")) / np.maximum(n, 1)
        repeats, distinct, ends = self.word_share(self.repeat), self.distinct_share(), self.word_share(_END[last])
        length = size / np.maximum(n, 1)
        bad = [symbols > 0.05, odd > 0.2, (shout > 0.5) & (upper + lower >= 20), (exclaim > 0.5) & (n >= 5), (repeats > 0.2) & (n >= 5), (distinct < 0.15) & (n >= 30), (ends < 0.02) & (n >= 20)]
        calm = (symbols < 0.01) & (shout < 0.2) & (repeats < 0.05)
        good = [(ends > 0.03) & (ends * n <= 0.35 * n + 1.5) & calm, (distinct > 0.3) & (length > 3) & (length < 9) & calm & (n >= 5), (symbols == 0) & (odd == 0) & (shout < 0.5) & (n > 0)]
        return np.stack([np.where(x, BAD, NONE) for x in bad] + [np.where(x, GOOD, NONE) for x in good], axis=1)

    def patterns(self) -> np.ndarray:
        return self.votes() @ (3 ** np.arange(len(LABELLERS)))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features, and the documents they are of, unsorted."""
        doc = np.repeat(np.arange(len(self.n)), self.n)
        mask = np.uint64(BUCKETS - 1)
        again = np.flatnonzero(self.repeat)
        return np.concatenate([(self.words & mask), (self.shapes >> np.uint64(20)) & mask, np.full(len(again), _REPEAT, np.uint64)]).astype(np.int64), np.concatenate([doc, doc, doc[again]])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        bucket, doc = self.features()
        return np.bincount(doc, weights[bucket], len(self.n)) / (self.n + FEW)


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """The probability of good for each pattern, by expectation-maximisation on the patterns' counts."""
    if not counts:
        return {}
    patterns, weight = np.array(list(counts)), np.array(list(counts.values()), float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior = np.where((votes == BAD).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        logs = []
        for share in (posterior, 1 - posterior):
            mass = weight * share
            seen = np.stack([((votes == v) * mass[:, None]).sum(axis=0) for v in (NONE, GOOD, BAD)])
            chance = (seen + 0.1) / (mass.sum() + 0.3)
            logs.append(np.log((mass.sum() + 1) / (weight.sum() + 2)) + sum(np.log(chance[v]) @ (votes == v).T for v in (NONE, GOOD, BAD)))
        posterior = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return dict(zip(patterns.tolist(), posterior.tolist(), strict=True))


def fit(bucket: np.ndarray, doc: np.ndarray, share: np.ndarray, target: np.ndarray, training: Training) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model for sparse rows (doc, bucket, share), with momentum and a scale by frequency."""
    weights, bias, step, bias_step = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    n = len(target)
    scale = 1 / np.sqrt(np.bincount(bucket, share**2, BUCKETS) / n + 1e-6)
    for _ in range(training.rounds):
        p = 1 / (1 + np.exp(-(np.bincount(doc, weights[bucket] * share, n) + bias)))
        error = (p - target) / n
        slope = np.bincount(bucket, error[doc] * share, BUCKETS) + training.decay * weights
        step, bias_step = 0.9 * step + slope * scale, 0.9 * bias_step + error.sum()
        weights, bias = weights - training.rate * step, bias - training.rate * bias_step
    return weights.astype(np.float32), float(bias)


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in slices(text_column(batch.column("text"))):
            pattern, n = np.unique(Slice(raw, offsets).patterns(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern.astype(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in slices(text_column(batch.column("text"))):
            some = Slice(raw, offsets)
            bucket, doc = some.features()
            key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(some.n) + 1) * BUCKETS).astype(np.int32)
            share = (n / (some.n + FEW)[key // BUCKETS]).astype(np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key % BUCKETS).astype(np.int32), share)]
            yield pa.RecordBatch.from_arrays([pa.array(some.patterns().astype(np.int64)), *lists], ["pattern", "buckets", "shares"])


def _text(documents: DataFrame, *more) -> DataFrame:
    return documents.select(*more, F.col("text").cast("string").alias("text"))


def sampled_texts(documents: DataFrame, sample: int) -> DataFrame:
    """The texts of the rows of the lowest hashes of id and text, at most ``sample``; rows equal in both are one."""
    keyed = _text(documents, id_key().alias("_key")).select(F.xxhash64("_key", "text").alias("_hash"), "text")
    chosen = keyed.select("_hash").distinct().orderBy("_hash").limit(sample)
    return keyed.join(F.broadcast(chosen), "_hash", "left_semi").dropDuplicates(["_hash"]).select("text")


def train(documents: DataFrame, training: Training = Training()) -> tuple[np.ndarray, float]:
    """Weights and bias from the documents' own votes."""
    counted = _text(documents).mapInArrow(_count_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    posterior = estimate({r.pattern: r.n for r in counted.collect()})
    rows = sampled_texts(documents, training.sample).mapInArrow(_featured, "pattern long, buckets array<int>, shares array<float>").toArrow()
    if not rows.num_rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    lists = rows.column("buckets").combine_chunks()
    doc = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
    target = np.array([posterior[x] for x in rows.column("pattern").to_pylist()])
    return fit(np.asarray(lists.flatten()), doc, np.asarray(rows.column("shares").combine_chunks().flatten()), target, training)


def _probabilities(column: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    out, words = [np.zeros(0)], [np.zeros(0, np.int64)]
    for _, _, raw, offsets in slices(text_column(column)):
        some = Slice(raw, offsets)
        out.append(1 / (1 + np.exp(-np.clip(some.sums(weights) + bias, -50, 50))))
        words.append(some.n)
    return np.concatenate(out), np.concatenate(words)


def score(documents: DataFrame, model: tuple[np.ndarray, float], training: Training = Training()) -> DataFrame:
    """Per row: doc_id, n_words, score (the probability of good), keep."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = _probabilities(batch.column("text"), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(p), pa.array(p >= training.threshold)], ["doc_id", "n_words", "score", "keep"])

    return _text(documents, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_words long, score double, keep boolean")


def keep_good(documents: DataFrame, model: tuple[np.ndarray, float], training: Training = Training()) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = _probabilities(batch.column("text"), weights, bias)
            yield batch.filter(pa.array(p >= training.threshold))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, training: Training = Training()) -> DataFrame:
    """Train on the documents and score all of them."""
    return score(documents, train(documents, training), training)
