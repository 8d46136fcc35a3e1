"""The toxicity classifier: n-grams, ratios and scores against plain Python, and accuracy on labels held out."""

import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from mediacat.llm import toxicity
from mediacat.llm.toxicity import BUCKETS, FEW, UNIT, Grams, Training
from mediacat.llm.words import HashPrefixes, slices

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOW = Training(least=1.0, rounds=60)


def bucket_of(gram):
    b = np.frombuffer(gram.encode(), np.uint8)
    return int(HashPrefixes(b).hashes(np.array([0]), np.array([len(b)]))[0] & np.uint64(BUCKETS - 1))


def values_of(text, how=HOW):
    """Bucket -> value, by Python strings; a separator hashes as the byte 0."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = Counter(w[i : i + k] for w in (f"\x00{w}\x00" for w in words) for k in range(how.low, how.high + 1) for i in range(len(w) - k + 1))
    out = Counter()
    for g, n in grams.items():
        out[bucket_of(g)] += n
    return {b: n / math.sqrt(len(words) + FEW) for b, n in out.items()}


@pytest.fixture(scope="module")
def plain(texts):
    return [x for x in texts if x is None or len(x) < 2000 and "\x00" not in x]


def test_grams_of_texts(plain):
    column = pa.array([x or "" for x in plain])
    for _, _, raw, offsets in slices(column):
        doc, bucket, value = Grams(raw, offsets, HOW.low, HOW.high).values()
        for i, x in enumerate(plain):
            of = doc == i
            assert dict(zip(bucket[of].tolist(), value[of].tolist(), strict=True)) == pytest.approx(values_of(x))


@pytest.fixture(scope="module")
def labelled(spark, rows):
    found = [(d, x, int("river" in (x or ""))) for d, x in rows]
    labels = [(d, y, 1) for d, _, y in found] + [(None, 1, 1), (found[0][0], None, 1), (found[1][0], 7, 1)]
    return found, spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_ratios_and_scores(spark, docs, labelled, plain):
    found, labels = labelled
    small = docs.where("length(coalesce(text, '')) < 2000 and not contains(coalesce(text, ''), char(0))")
    train = {(d, x or "", y) for d, x, y in found if d is not None and zlib.crc32(str(d).encode()) % 3 != 1 and x in plain}
    sums = {0: Counter(), 1: Counter()}
    for _, x, y in train:
        for b, v in values_of(x).items():
            sums[y][b] += round(v * UNIT) / UNIT
    size = len(sums[0].keys() | sums[1].keys())
    total = {y: sum(sums[y].values()) for y in (0, 1)}
    bucket, ratio, prior = toxicity.log_count_ratios(toxicity.training_rows(small, labels, HOW), HOW)
    assert len(bucket) and prior == pytest.approx(math.log((1 + sum(y for *_, y in train)) / (1 + sum(1 - y for *_, y in train))))
    for b, r in zip(bucket.tolist(), ratio.tolist(), strict=True):
        assert r == pytest.approx(math.log((1 + sums[1][b]) / (size + total[1])) - math.log((1 + sums[0][b]) / (size + total[0])))
    model = toxicity.train(small, labels, HOW)
    for r in toxicity.score(small.select("doc_id", "text", "score"), model, HOW).join(small.select("doc_id", "text"), "doc_id").collect():
        z = sum(v * model.weights[b] for b, v in values_of(r.text).items()) + model.bias
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(r.score >= 0.7)


def test_fit_reaches_the_minimum():
    rnd = np.random.default_rng(1)
    x, hidden = rnd.normal(size=(300, 5)), np.array([2.0, -1.0, 0.0, 0.5, 0.0])
    y = (x @ hidden + rnd.logistic(size=300) > 0).astype(int)
    doc, feature = (i.ravel() for i in np.indices(x.shape))
    how = replace(Training(), rounds=3000, decay=1e-3)
    weights, bias = toxicity.fit(feature, doc, x.ravel(), y, 5, 0.0, how)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    error = (1 / (1 + np.exp(-(x @ weights + bias))) - y) * share
    assert np.abs(error @ x + how.decay * weights).max() < 1e-6 and abs(error.sum()) < 1e-6


def test_sample_is_bounded_in_rows(spark, docs, labelled):
    one = docs.limit(1).selectExpr("7 as doc_id", "'river ' as text")
    many = one.unionByName(one.sparkSession.range(500).selectExpr("7 as doc_id", "concat('river ', id % 40) as text"))
    labels = spark.createDataFrame([(7, 0), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(many, labels, replace(HOW, sample=10)).collect()
    assert len(rows) == 20 and len({(r.text, r.toxic) for r in rows}) == 20


def test_edges(spark, docs, rows, no_docs, labelled):
    _, labels = labelled
    out = toxicity.classify(docs, labels, HOW).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    bias = {r.score for r in out if r.doc_id in {d for d, x in rows if not (x or "").strip()}}
    assert len(bias) == 1
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert toxicity.classify(no_docs, labels, HOW).count() == 0
    for unlabelled in (labels.limit(0), labels.where("toxic = 1")):
        scores = {r.score for r in toxicity.classify(docs, unlabelled, HOW).collect()}
        assert len(scores) == 1


def test_held_out_accuracy(spark):
    from mediacat.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    out = QUERIES["op12_toxicity"](spark, sf).join(labels, "doc_id").join(documents, "doc_id").where("held_out").toPandas()
    toxic, rest = out[out.toxic == 1], out[out.toxic == 0]
    assert toxic.predicted.mean() > 0.9 and rest.predicted.mean() < 0.005
    assert toxic.groupby("lang").predicted.mean().min() > 0.8
