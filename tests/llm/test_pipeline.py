"""The pipeline's stages, each against brute force on its own input."""

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from mediacat.llm.shared import materialize
from tests.llm.test_operators import base_of, components_of, sets_of, words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(len(w) - 9, 1) if w else 0)}
    lengths = {len(x) for x in windows}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = materialize(stage(spark, docs, SF), "stage")
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {d for d, _ in before}
            assert after.agg(F.count_if(F.col("length") > 1024)).first()[0] == 0
            break
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "quality classifier":
            good = [d for d, _ in before if label.get(d) == 1]
            assert sum(d in kept for d in good) >= 0.97 * len(good)
            assert sum(d in kept for d, _ in before if label.get(d) == 0) <= 2
        elif name == "near duplicates":
            roots = components_of(sets_of(before), 80)  # the stage's own threshold; op4's is 85
            assert set(kept) == {d for d in roots if roots[d] == d}
        elif name == "decontamination":
            clean = {d for d, x in before if not any(tuple(w[i : i + n]) in windows for w in [words_of(x)] for n in lengths for i in range(len(w) - n + 1))}
            assert set(kept) == clean and len(clean) < len(before)
        else:
            for d, x in before:
                spans = [tuple(map(int, s.split(":")[1:])) for s in base_of(x).split(",") if s]
                assert kept[d] == x if not spans else all(x[a:b] not in kept[d] for a, b in spans)
        docs = after


def test_edges(spark, docs, rows, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        assert len(out) > 0, name
        assert stage(spark, no_docs, SF).count() == 0, name
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()
    by_text = defaultdict(int)
    for r in kept:
        by_text[(r.doc_id, r.text)] += 1
    assert max(by_text.values()) == 1


def test_near_duplicate_stage_keeps_unrelated_texts_and_drops_copies_without_id(spark):
    from tests.llm.test_operators import near_copies

    rows, docs = near_copies(spark)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()]
    assert len(kept) == len(set(kept))
    always = {rows[i] for i in (0, 1, 6, 10, 11, 13)}
    assert always < set(kept) and rows[2] not in kept and rows[5] not in kept
    assert sum(rows[i] in kept for i in (3, 4)) == 1 and sum(rows[i] in kept for i in (7, 8)) == 1 and len(kept) == 8


def test_packing_workers_keep_few_pieces_and_pack_the_same(spark):
    from mediacat.llm import packing, tokens

    def kept(batches):  # pieces that a worker holds after the plan's encoder has met this many different ones
        held = tokens.encoder(packing.tokenizer_path(plan.tokenizer), plan.pieces, plan.kept_pieces, plan.part_bytes)
        for at in range(0, 450_000, 50_000):
            list(held.parts(pa.array([" ".join(f"{i:x}q" for i in range(at, at + 50_000))]), plan.end_id))
        yield pa.RecordBatch.from_pydict({"n": [len(held.known) + len(held.older)]})

    plan = corpus_pipeline.PACKING
    assert spark.range(1).mapInArrow(kept, "n long").first().n < 330_000
    docs = spark.createDataFrame([(i, f"{i % 7} some words, ids 0x{i * i:x} and the like " * (i % 90)) for i in range(300)] + [(None, None)], "doc_id long, text string").coalesce(1)
    assert sorted(map(str, corpus_pipeline.packed(spark, docs, SF).collect())) == sorted(map(str, packing.pack_documents(docs).collect()))


def test_queries_are_registered():
    from __spark_entry__ import queries

    names = queries()
    assert "pipeline" in names and sorted({int(m[1]) for x in names if (m := re.match(r"op(\d+)_", x))}) == list(range(1, 14))
