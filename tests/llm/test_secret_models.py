"""The secret models on strings they were not trained on: recall for random ones, false alarms for identifiers, all by spans of whole texts."""

import base64
import math
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mediacat.llm import secret_scan
from mediacat.llm.secret_scan import ALPHABET, CODES, FOLDS, Evidence

WORDS = (
    "get set user account by id project module class name value service manager controller request response handler factory config database connection pool thread queue message event listener adapter "
    "repository customer order invoice payment address session context stream reader writer buffer cache index token parser builder helper util data model view render update delete insert select query "
    "filter sort page size limit offset total count status state error warning info debug level version release build deploy server client host port path file folder upload download image video"
).split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    return secret_scan.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")).persist()


@pytest.fixture(scope="module")
def model(samples):
    return secret_scan.train(samples)


def strings():
    rnd = random.Random(1)
    word, cap = lambda: rnd.choice(WORDS), lambda: rnd.choice(WORDS).capitalize()
    drawn = lambda alphabet, n: lambda: "".join(rnd.choices(alphabet, k=n))
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    kinds = {
        "random lower": drawn(low, 32), "random upper": drawn(up, 32), "random letters": drawn(low + up, 32), "random letters and digits": drawn(low + up + digits, 32), "random lower and digits": drawn(low + digits, 24),
        "random upper hex": drawn("0123456789ABCDEF", 32), "random base64": lambda: base64.b64encode(rnd.randbytes(30)).decode(), "random short": drawn(low + up + digits, 20),
        "camel": lambda: word() + "".join(cap() for _ in range(4)), "camel and number": lambda: word() + "".join(cap() for _ in range(3)) + str(rnd.randint(0, 99)), "snake": lambda: "_".join(word() for _ in range(5)),
        "path": lambda: f"com/example/{word()}/{word()}{rnd.randint(1, 9)}/{cap()}{cap()}", "constant": lambda: "_".join(word().upper() for _ in range(4)), "kebab": lambda: "-".join(word() for _ in range(4)) + f"-{rnd.randint(1, 9999)}",
        "date": lambda: f"20{rnd.randint(10, 30)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}T{rnd.randint(0, 23):02}-{rnd.randint(0, 59):02}-00-{word()}", "version": lambda: f"{word()}-{word()}-{rnd.randint(0, 20)}-{rnd.randint(0, 200)}-SNAPSHOT",
        "digits": lambda: drawn(digits, rnd.randint(16, 30))(),
    }
    return {k: [x for x in (make() for _ in range(300)) if len(x) >= 16] for k, make in kinds.items()} | {"getUserAccountById": ["getUserAccountById" + c for c in ALPHABET]}


def test_held_out_recall_and_false_alarms(spark, model):
    kinds = strings()
    texts = [(k, f"see {x} here") for k, found in kinds.items() for x in found]
    docs = spark.createDataFrame([(i, x, k) for i, (k, x) in enumerate(texts)], "doc_id long, text string, kind string")
    out = secret_scan.scan(docs, model).select("row.kind", F.col("base"), F.exists("spans", lambda x: (x["start"] == 4) & (x["end"] == F.char_length("scanned") - 5)).alias("hit"))
    share = {r.kind: r.s for r in out.where("size(base) = 0").groupBy("kind").agg(F.avg(F.col("hit").cast("int")).alias("s")).collect()}
    assert share.keys() == kinds.keys()
    for kind, s in share.items():
        assert s > 0.95 if kind.startswith("random") else s < 0.02, (kind, s)


def test_models_and_threshold_by_counting(spark, samples, model):
    """Log ratios from plain counts of the same samples; the threshold is above all but few of the ordinary tokens held out."""
    rows = samples.select("token", "is_random", (F.pmod(F.xxhash64("token"), F.lit(FOLDS)) == 0).alias("held")).collect()
    counts, total = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    code = {c: i + 1 for i, c in enumerate(ALPHABET)}
    steps = lambda t: zip([0, *(code.get(c, 0) for c in t)], [code.get(c, 0) for c in t], strict=False)
    for r in rows:
        if not r.held:
            for a, b in steps(r.token):
                counts[r.is_random][a, b] += 1
                total[r.is_random][a] += 1
    prior = Evidence().prior
    chance = lambda kind, a, b: math.log((counts[kind][a, b] + prior) / (total[kind][a] + prior * CODES))
    for a in range(CODES):
        for b in range(CODES):
            assert model.ratios[a * CODES + b] == pytest.approx(chance(True, a, b) - chance(False, a, b), abs=1e-3)
    held = [sum(model.ratios[a * CODES + b] for a, b in steps(r.token)) for r in rows if r.held and not r.is_random and len(r.token) >= 16]
    assert len(held) > 500 and sum(x > model.total for x in held) <= 0.01 * len(held)


def test_sample_is_bounded_in_rows(spark):
    """Two thirds of the rows have no id; equal rows are one."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("abcdefgh"), F.translate((F.col("id") % 2000).cast("string"), "0123456789", "abcdefghij")).alias("text"))
    few = Evidence(documents=50, strings=1)
    none = secret_scan.labelled_samples(docs.limit(0), few).where("not is_random").distinct()
    some = secret_scan.labelled_samples(docs, few).where("not is_random").distinct()
    assert 0 < some.join(none, "token", "left_anti").where("token rlike '^abcdefgh[a-j]+$'").count() <= 50
