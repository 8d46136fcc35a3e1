"""Secrets in texts: fixed patterns, and long tokens that look more random than written.

The patterns' spans (``assign``, ``access``, ``hex``) are those of a scan from the left for each kind. The method adds
``markov`` spans: a token of 16 or more letters, digits and ``+/_=-`` is scored by two first-order Markov models over
its characters, one of random strings, one of ordinary identifiers. The sum of the log ratios of their transition
probabilities is the evidence; a token is reported if the sum and its mean reach their thresholds, and no pattern's span
overlaps it. Nothing but the models decides.

The models are counted from labelled tokens (``labelled_samples``): random ones are digests of row numbers in several
alphabets and the values that patterns found; ordinary ones are the words of a bounded sample of documents and the public
names of Python's standard library, alone and joined the ways identifiers, paths, versions and dates are. One token in
``FOLDS`` is held out: the threshold of the sum is the higher of ``total`` and the sum that all but ``false_alarms`` of the
ordinary ones held out stay below. ``train`` gives at most 64 * 64 log ratios and that threshold, constants of the scan.

All spans are counted in code points from 0, end exclusive; everything is DataFrame functions inside the row.

Rows: a null text is empty and has no spans; each row is scanned by itself, so that repeated rows have equal results; an
empty table gives no rows, and models trained without ordinary words still rest on their priors. Other columns stay.
"""

from __future__ import annotations

import builtins
import importlib
import keyword
import math
import re
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.arrays import bound, numbers, running_totals
from mediacat.llm.shared import NO_ID

# The patterns that define the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Codes of characters: 1 to 62, and 0 for all others and for the place before a token.
CODES = len(ALPHABET) + 1
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"


@dataclass(frozen=True)
class Evidence:
    """Thresholds of the sum and of the mean log ratio, the share of false alarms, and the bounds and prior of training."""

    total: float = 20.0
    mean: float = 0.4
    false_alarms: float = 0.005
    documents: int = 2000
    strings: int = 4000
    prior: float = 0.5


#: One token in so many is held out of the models, for the threshold.
FOLDS = 5
#: Modules whose public names are ordinary identifiers.
MODULES = "argparse ast asyncio base64 collections concurrent.futures configparser csv datetime decimal difflib dis email.message functools html.parser http.client http.server inspect io itertools json locale logging logging.handlers mailbox os os.path pathlib pickle random shutil smtplib socket statistics string subprocess tarfile tempfile threading traceback typing unittest unittest.mock urllib.parse urllib.request xml.dom.minidom zipfile".split()


@dataclass(frozen=True)
class Model:
    """Log ratios of transition probabilities, random over ordinary, at ``before * CODES + after``; threshold of their sum."""

    ratios: list[float]
    total: float


def library_names() -> list[str]:
    """Public names of Python's standard library."""
    names = {*keyword.kwlist, *sys.stdlib_module_names, *dir(builtins)}
    for name in MODULES:
        module = importlib.import_module(name)
        for x in dir(module):
            names.add(x)
            if isinstance(getattr(module, x, None), type):
                names.update(dir(getattr(module, x)))
    return sorted(x.strip("_") for x in names if re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", x.strip("_")))


def _spans(text: Column, pattern: str, kind: str, wanted: Column | None = None, keep=None) -> Column:
    """Spans (start, end, rank) of all matches from the left that ``keep`` accepts; ``wanted`` spares other texts."""
    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("long"))
        return F.zip_with(running_totals(steps), found, lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), m.alias("token")))

    spans = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["token"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,token:string>>")
    return F.when(F.coalesce(wanted if wanted is not None else text.rlike(pattern), F.lit(False)), spans.cast("array<struct<start:bigint,end:bigint,rank:int,token:string>>")).otherwise(none)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``base``: spans of the three patterns by start, then kind."""
    t = F.col(text)
    assigned = (F.contains(t, F.lit(":")) | F.contains(t, F.lit("="))) & t.rlike(ASSIGN)
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    out = docs.withColumn("_assign", _spans(t, ASSIGN, "assign", assigned, value)).withColumn("_access", _spans(t, ACCESS, "access", F.contains(t, F.lit("AKIA")))).withColumn("_hex", _spans(t, HEX, "hex"))
    return out.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")


def codes(token: Column) -> Column:
    """The codes of a token's characters."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def labelled_samples(documents: DataFrame, evidence: Evidence = Evidence()) -> DataFrame:
    """Tokens with ``is_random``: from at most ``documents`` rows, of the lowest hashes of id and text, and from digests."""
    spark = documents.sparkSession
    keyed = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"))
    keyed = keyed.select("text", F.xxhash64("_key", "text").alias("_hash"))
    chosen = keyed.select("_hash").distinct().orderBy("_hash").limit(evidence.documents)
    texts = keyed.join(F.broadcast(chosen), "_hash", "left_semi").dropDuplicates(["_hash"]).select("text")
    scanned = base_spans(texts, "text")
    values = scanned.select(F.explode("base").alias("s")).select(F.coalesce(F.nullif(F.regexp_extract("s.token", ASSIGN, 2), F.lit("")), F.col("s.token")).alias("token"))
    words = scanned.where("size(base) = 0").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).distinct()
    names = spark.createDataFrame([(x,) for x in library_names()], "w string")
    pieces = names.select(F.explode(F.regexp_extract_all("w", F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))).alias("w")).where("length(w) > 1").distinct()
    ordinary = names.select(F.col("w").alias("token")).unionByName(joined_words(words.unionByName(pieces)))
    digest = F.sha2(F.col("id").cast("string"), 256)
    encoded = F.base64(F.unhex(digest))
    pick = lambda alphabet: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.substring(F.lit(alphabet), (F.conv(F.substring(digest, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("int") % len(alphabet)) + 1, F.lit(1))), "")
    kinds = F.array(digest, F.upper(digest), encoded, F.regexp_replace(encoded, "[+/=]", ""), F.upper(encoded), pick(ALPHABET[:26]), pick(ALPHABET[26:52]), pick(ALPHABET[:52]), pick(ALPHABET[:26] + ALPHABET[52:]))
    digests = spark.range(evidence.strings).select(F.explode(kinds).alias("token"))
    return ordinary.withColumn("is_random", F.lit(False)).unionByName(digests.unionByName(values).withColumn("is_random", F.lit(True)))


def joined_words(words: DataFrame) -> DataFrame:
    """Tokens made of each word (column ``w``) and others, in the ways of identifiers, paths, versions, dates and lines of marks."""
    h = lambda salt, n: F.pmod(F.xxhash64("w", F.lit(salt)), F.lit(n))
    number = lambda salt, n: h(salt, n).cast("string")
    two = lambda salt, n: F.lpad((h(salt, n) + 1).cast("string"), 2, "0")
    date = F.concat_ws("-", (h(1, 60) + 1980).cast("string"), two(2, 12), two(3, 28))
    clock = F.concat_ws("-", two(4, 23), two(5, 59), two(6, 59))
    buddy = words.select(F.col("w").alias("v"), F.pmod(F.xxhash64("w"), F.lit(4096)).alias("_n")).dropDuplicates(["_n"])
    paired = words.withColumn("_n", h(7, 4096)).join(buddy, "_n", "left").withColumn("v", F.coalesce("v", "w"))
    low, cap = lambda c: F.lower(F.col(c)), lambda c: F.initcap(F.lower(F.col(c)))
    return paired.select(F.explode(F.array(
        F.col("w"), F.upper("w"), cap("w"), F.concat_ws("_", low("w"), low("v")), F.concat(low("w"), cap("v"), cap("w")), F.concat(cap("v"), cap("w")), F.concat_ws("_", F.upper("w"), F.upper("v")),
        F.concat(F.concat_ws("-", low("w"), low("v")), F.lit("-"), F.lpad(number(8, 10000), 4, "0")), F.concat_ws("/", low("w"), low("v"), cap("w")), F.concat(low("w"), cap("v"), number(9, 20)),
        F.concat(low("w"), number(10, 10), F.lit("/"), cap("v")), F.concat(low("w"), F.lit("-v"), number(11, 20), F.lit("-"), number(12, 30), F.lit("-"), number(13, 100)),
        F.concat(date, F.lit("-"), low("w")), F.concat(date, F.lit("T"), clock, F.lit("-"), low("v")), F.concat(low("w"), F.lit("_"), F.translate(date, "-", "")), F.concat_ws("_", low("v"), low("w"), number(14, 100)),
        F.concat(number(15, 10**9), number(16, 10**9)), F.concat(low("w"), F.lit("="), low("v")), F.concat(low("w"), F.lit("="), number(17, 100000)),
        F.repeat(F.substring(F.lit("-=_+/"), (h(18, 5) + 1).cast("int"), F.lit(1)), (h(19, 64) + 16).cast("int")),  # a line across the page
    )).alias("token"))


def _held_out() -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(FOLDS)) == 0


def train(samples: DataFrame, evidence: Evidence = Evidence()) -> Model:
    """The models of the tokens that are not held out, and the threshold from those that are."""
    chain = samples.where(~_held_out()).select("is_random", F.concat(F.array(F.lit(0)), codes(F.col("token"))).alias("c")).where("size(c) > 1")
    steps = chain.select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * CODES + F.get("c", i))).alias("step"))
    counts = {(r.is_random, r.step): r["count"] for r in steps.groupBy("is_random", "step").count().collect()}
    totals = {(kind, a): sum(counts.get((kind, a * CODES + x), 0) for x in range(CODES)) for kind in (True, False) for a in range(CODES)}

    def log_probability(kind: bool, before: int, after: int) -> float:
        return math.log((counts.get((kind, before * CODES + after), 0) + evidence.prior) / (totals[kind, before] + evidence.prior * CODES))

    ratios = [round(log_probability(True, a, b) - log_probability(False, a, b), 3) for a in range(CODES) for b in range(CODES)]
    long = samples.where(_held_out() & ~F.col("is_random")).where(F.col("token").rlike(f"^{TOKEN}$"))
    above = long.agg(F.percentile_approx(log_ratio(F.col("token"), ratios), 1 - evidence.false_alarms, 1000)).first()[0]
    return Model(ratios, max(evidence.total, above if above is not None else evidence.total))


def log_ratio(token: Column, model: Model | list[float]) -> Column:
    """The evidence that a token is random: the sum over its transitions, the first from before the token."""
    ratios = numbers(model.ratios if isinstance(model, Model) else model, "double")
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("before"), (acc["sum"] + F.get(ratios, acc["before"] * CODES + c)).alias("sum"))
    return F.aggregate(codes(token), start, step, lambda acc: acc["sum"])


def scan(documents: DataFrame, model: Model, evidence: Evidence = Evidence()) -> DataFrame:
    """The rows as ``row``, with ``base`` and ``spans``: arrays of (start, end, rank, token), ``spans`` with the added ones."""
    docs = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("scanned"))
    docs = base_spans(docs, "scanned").withColumn("tokens", _spans(F.col("scanned"), TOKEN, "markov"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    score = lambda x: log_ratio(x["token"], model)
    random = lambda x: bound(score(x), lambda s: (s >= model.total) & (s >= evidence.mean * F.char_length(x["token"])))
    added = F.filter(F.filter("tokens", random), apart)
    return docs.withColumn("spans", F.array_sort(F.concat("base", added))).select("row", "scanned", "base", "spans")


def scan_corpus(documents: DataFrame, evidence: Evidence = Evidence()) -> DataFrame:
    """Train on the documents' own bounded sample and scan all of them."""
    return scan(documents, train(labelled_samples(documents, evidence), evidence), evidence)


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == KINDS.index(kind))).cast("long")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced; spans in order of their starts."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        parts = F.when(fresh, F.concat(acc["parts"], F.array(kept, F.lit(by)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def mask_secrets(documents: DataFrame, model: Model, evidence: Evidence = Evidence()) -> DataFrame:
    """The rows with every span replaced in ``text``, and ``n_chars``, if there is one, counted anew where one was."""
    found = scan(documents, model, evidence).withColumn("masked", mask(F.col("scanned"), F.col("spans")))
    hit = F.size("spans") > 0
    new = {"text": F.col("masked"), "n_chars": F.char_length("masked").cast(dict(documents.dtypes).get("n_chars", "long"))}
    return found.select(*(F.when(hit, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in documents.columns))
