"""The quality classifier against plain Python: votes, expectation-maximisation, features, scores, the sample's bound."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacat.llm import quality
from mediacat.llm.quality import BAD, BUCKETS, FEW, GOOD, LABELLERS, NONE, Training
from mediacat.llm.words import HashPrefixes, slices, text_column

SYMBOLS = set(b"#$%&*+<=>@[\\]^_`{|}~")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))]


def votes_of(text):
    raw = (text or "").encode()
    words, cased = words_of(text), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, size = len(words), max(sum(map(len, words)), 1)
    share = lambda k: k / max(n, 1)
    upper, lower = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122)))
    symbols = sum(c in SYMBOLS for c in raw) / size
    odd = share(sum(w[-1] in SYMBOLS or all(c in SYMBOLS or c < 48 or 57 < c < 65 for c in w) for w in cased))
    shout, exclaim = upper / max(upper + lower, 1), share(raw.count(b"!"))
    repeats, distinct = share(sum(a == b for a, b in zip(words, words[1:], strict=False))), len(set(words)) / n if n else 0
    ends = share(sum(w[-1:] in (b".", b"!", b"?") for w in cased))
    bad = [symbols > 0.05, odd > 0.2, shout > 0.5 and upper + lower >= 20, exclaim > 0.5 and n >= 5, repeats > 0.2 and n >= 5, distinct < 0.15 and n >= 30, ends < 0.02 and n >= 20]
    calm = symbols < 0.01 and shout < 0.2 and repeats < 0.05
    good = [ends > 0.03 and ends * n <= 0.35 * n + 1.5 and calm, distinct > 0.3 and 3 < size / max(n, 1) < 9 and calm and n >= 5, symbols == 0 and odd == 0 and shout < 0.5 and n > 0]
    return [BAD if x else NONE for x in bad] + [GOOD if x else NONE for x in good]


def bucket_of(word, shift=0):
    h = HashPrefixes(np.frombuffer(word, np.uint8)).hashes(np.array([0]), np.array([len(word)]))[0]
    return int((h >> np.uint64(shift)) & np.uint64(BUCKETS - 1))


def shares_of(text):
    words, cased = words_of(text), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shape = lambda w: bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in w.encode())
    found = Counter([bucket_of(w) for w in words] + [bucket_of(shape(w), 20) for w in cased])
    found[77] += sum(a == b for a, b in zip(words, words[1:], strict=False))
    return {b: k / (len(words) + FEW) for b, k in found.items() if k}


@pytest.fixture(scope="module")
def texts_to_vote(texts):
    made = ["Stop! " * 8, "THE BIG STONE IS UNDER THE RIVER NOW.", "a#b c* d& 12,, -- x", "word word word again. " * 9, "One two three four five. Six seven eight nine. " * 4, "no marks here " * 12]
    return [x for x in texts if x is None or "\x00" not in x and len(x) < 3000] + made


def test_votes(spark, texts_to_vote):
    import pyarrow as pa

    (_, _, raw, offsets), = slices(text_column(pa.array(texts_to_vote)))
    got = quality.Slice(raw, offsets).votes().tolist()
    for text, votes in zip(texts_to_vote, got, strict=True):
        assert votes == votes_of(text), text


def test_expectation_maximisation_step_by_step():
    rnd = np.random.default_rng(3)
    rows = [[int(rnd.choice([NONE, BAD], p=[0.6, 0.4] if bad else [0.95, 0.05])) for _ in range(7)] + [int(rnd.choice([NONE, GOOD], p=[0.8, 0.2] if bad else [0.3, 0.7])) for _ in range(3)] for bad in rnd.random(500) < 0.3]
    counts = Counter(sum(v * 3**i for i, v in enumerate(r)) for r in rows)
    posterior = {p: 0.05 if any(p // 3**i % 3 == BAD for i in range(len(LABELLERS))) else 0.95 for p in counts}
    for _ in range(20):
        total, chance = {}, {}
        for side in (0, 1):
            weight = {p: n * (posterior[p] if side == 0 else 1 - posterior[p]) for p, n in counts.items()}
            total[side] = sum(weight.values())
            for i in range(len(LABELLERS)):
                for v in (NONE, GOOD, BAD):
                    chance[side, i, v] = (sum(w for p, w in weight.items() if p // 3**i % 3 == v) + 0.1) / (total[side] + 0.3)
        everything = sum(counts.values())
        for p in posterior:
            logs = [math.log((total[s] + 1) / (everything + 2)) + sum(math.log(chance[s, i, p // 3**i % 3]) for i in range(len(LABELLERS))) for s in (0, 1)]
            posterior[p] = 1 / (1 + math.exp(min(max(logs[1] - logs[0], -50), 50)))
    got = quality.estimate(counts, 20)
    assert got.keys() == posterior.keys() and all(got[p] == pytest.approx(posterior[p], abs=1e-9) for p in got)


def test_model_and_scores(spark, texts_to_vote):
    """Training by plain steps over the same rows, and scores by plain sums."""
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts_to_vote)], "doc_id long, text string")
    how = Training(rounds=25)
    weights, bias = quality.train(docs, how)
    distinct = list(dict.fromkeys(texts_to_vote))
    assert len(texts_to_vote) == docs.count() and distinct
    posterior = quality.estimate(Counter(sum(v * 3**i for i, v in enumerate(votes_of(x))) for x in texts_to_vote))
    rows = [(shares_of(x), posterior[sum(v * 3**i for i, v in enumerate(votes_of(x)))]) for x in texts_to_vote]
    square = Counter()
    for shares, _ in rows:
        for b, s in shares.items():
            square[b] += s * s
    scale = {b: 1 / math.sqrt(q / len(rows) + 1e-6) for b, q in square.items()}
    w, step, own_bias, bias_step = dict.fromkeys(square, 0.0), dict.fromkeys(square, 0.0), 0.0, 0.0
    for _ in range(how.rounds):
        slope, of_bias = {b: how.decay * w[b] for b in w}, 0.0
        for shares, target in rows:
            error = (1 / (1 + math.exp(-(sum(w[b] * s for b, s in shares.items()) + own_bias))) - target) / len(rows)
            of_bias += error
            for b, s in shares.items():
                slope[b] += error * s
        for b in w:
            step[b] = 0.9 * step[b] + slope[b] * scale[b]
            w[b] -= how.rate * step[b]
        bias_step = 0.9 * bias_step + of_bias
        own_bias -= how.rate * bias_step
    assert bias == pytest.approx(own_bias, abs=1e-3)
    assert all(weights[b] == pytest.approx(v, abs=2e-3, rel=1e-2) for b, v in w.items())
    for r in quality.score(docs, (weights, bias), how).collect():
        shares = shares_of(texts_to_vote[r.doc_id])
        p = 1 / (1 + math.exp(-(sum(float(weights[b]) * s for b, s in shares.items()) + bias)))
        assert r.n_words == len(words_of(texts_to_vote[r.doc_id])) and r.score == pytest.approx(p, abs=1e-5)
        assert r.keep == (r.score >= how.threshold)


def test_sample_is_bounded_in_rows(spark):
    """Two thirds of the rows have no id, and some rows repeat."""
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5000).cast("string")).alias("text"))
    assert quality.sampled_texts(docs, 400).count() == 400
    same = spark.range(5000).selectExpr("cast(null as long) as doc_id", "'one text' as text")
    assert quality.sampled_texts(same, 400).count() == 1
    weights, _ = quality.train(docs, Training(sample=50, rounds=5))
    assert 0 < np.count_nonzero(weights) <= 3 + 2 * 50 + 50
