"""Benchmark passages in training documents, by a positional inverted index.

Words are runs of ASCII letters and digits and of all code points above 127, A-Z in lower case. A window is ten
consecutive words of an item (all words of a shorter item). Words are compared by 64-bit hashes.

1. The occurrences of the benchmark's words are counted over all documents. A window with a word that never occurs is
   done with. Of the others the two rarest words are the anchors.
2. The index is stored: for each document the postings (word, position) of anchors, each with the words up to nine
   places before and behind it.
3. Postings meet the windows by an equality join on the anchor; the position less the anchor's place in the window is a
   start. Starts to which both anchors agree are kept, and the stored words around them decide: equal words are an exact
   phrase match, most of the window's words in any order a proximity match.

Everything is DataFrame functions. Which words are anchors is first tested by a constant map of 2**18 bits, whatever the
size of the benchmark; the join then decides. A posting's list is not gathered anywhere: matches are grouped by document
and start.

Rows: a null or empty text has no words. Rows are told apart by ``doc_id`` and text; rows equal in both have equal
results, one each. A null ``doc_id`` comes back as null. Items without words match nothing; items with the same id are
one; an item without an id hits words but is not named. With an empty benchmark nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.arrays import in_map, membership_map
from mediacat.llm.shared import materialize

WINDOW = 10
#: A window of n words is near where n - MISSING of them stand within the words around an anchor.
MISSING = 2

_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words as they are written."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORDS), F.lit(0))


def term(word: Column) -> Column:
    """The hash of a word with A-Z in lower case."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.xxhash64(F.when(plain, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: window, terms, items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(F.col("text")), term).alias("all_terms")).where("size(all_terms) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all_terms") - (WINDOW - 1), F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all_terms", i, WINDOW))).alias("terms"))
    return cut.groupBy(F.xxhash64("terms").alias("window"), "terms").agg(F.collect_set("item_id").alias("items"))


def anchored(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows that may occur, each with its anchors: the two rarest distinct words (term, place from 0)."""
    places = windows.select("window", F.posexplode("terms").alias("place", "term"))
    bits = membership_map(places.select("term").distinct(), "term")
    counts = documents.select(F.explode(words(F.col("text"))).alias("word")).select(term(F.col("word")).alias("term")).where(in_map(bits, F.col("term")))
    counts = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.join(counts, "term").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "term", "place"))).alias("ranked"))
    rare = F.slice(F.filter("ranked", lambda x, i: (i == 0) | (x["term"] != F.get("ranked", i - 1)["term"])), 1, 2)
    found = windows.join(ranked, "window").where(F.size("ranked") == F.size("terms"))
    return found.select("window", "terms", "items", F.transform(rare, lambda x: F.struct(x["term"].alias("term"), x["place"].alias("place"))).alias("anchors"))


def build_index(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """Stored rows: doc_id, text_hash, n_words, postings of the anchor terms (term, at, from_, around), places from 1."""
    bits = membership_map(anchors, "term")
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(words(F.col("text")), term).alias("terms"))
    places = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: in_map(bits, F.get("terms", i - 1)))
    places = F.when(F.size("terms") > 0, places).otherwise(F.array().cast("array<int>"))

    def posting(i: Column) -> Column:
        low = F.greatest(i - (WINDOW - 1), F.lit(1))
        return F.struct(F.get("terms", i - 1).alias("term"), i.alias("at"), low.alias("from_"), F.slice("terms", low, i + WINDOW - low).alias("around"))

    return materialize(docs.select("doc_id", "text_hash", F.size("terms").cast("long").alias("n_words"), F.transform(places, posting).alias("postings")), "postings")


def matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document and start: window, exact or near, the words covered. Rows equal in id and text have one entry."""
    one = windows.select("window", "terms", "items", F.size("anchors").alias("needed"), F.explode("anchors").alias("a"))
    one = one.select("window", "terms", "items", "needed", F.col("a.term").alias("term"), F.col("a.place").alias("place"))
    hits = index.select("doc_id", "text_hash", F.explode("postings").alias("p")).select("doc_id", "text_hash", F.col("p.term").alias("term"), "p.at", "p.from_", "p.around")
    met = hits.join(one, "term").withColumn("start", F.col("at") - F.col("place")).where("start >= 1")
    near = F.size(F.array_intersect("around", "terms")) >= F.greatest(F.size(F.array_distinct("terms")) - MISSING, F.lit(1))
    exact = F.slice("around", F.greatest(F.col("start") - F.col("from_") + 1, F.lit(1)), F.size("terms")) == F.col("terms")
    met = met.where(near).select("doc_id", "text_hash", "window", "start", "place", "needed", "items", F.size("terms").alias("length"), exact.alias("exact"))
    found = met.groupBy("doc_id", "text_hash", "window", "start").agg(
        F.count_distinct("place").alias("agreeing"), F.first("needed").alias("needed"), F.first("items").alias("items"), F.first("length").alias("length"), F.bool_and("exact").alias("same")
    )
    return found.withColumn("exact", (F.col("agreeing") == F.col("needed")) & F.col("same")).drop("agreeing", "needed", "same")


def covered(spans: Column) -> Column:
    """Words in the union of spans (start, length)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    windows = materialize(anchored(documents, benchmark_windows(benchmark)), "windows")
    index = build_index(documents, windows.select(F.explode("anchors.term").alias("term")).distinct())
    span = F.when(F.col("exact"), F.struct("start", "length"))
    found = matches(index, windows).groupBy("doc_id", "text_hash").agg(
        F.collect_list(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("exact"), F.col("items")))))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("n_near")
    )
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), covered(F.col("spans")).alias("hit"), "items", "n_near")
    rows = index.drop("postings").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items"),
    )
