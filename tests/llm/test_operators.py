"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediacat.llm import decontaminate, fingerprints, licenses, near_dedup, packing, quality, secret_scan, token_files, tokens
from mediacat.llm.arrays import running_totals
from mediacat.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.doc_id].append(r)
    return found


def order(rows):
    return sorted(((a is not None, a or 0, b or "", a) for a, b in rows), key=lambda x: x[:3])


def test_running_totals(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 500)], "x array<long>")
    for r in df.select("x", running_totals(F.col("x")).alias("t")).collect():
        assert r.t == np.cumsum(r.x).tolist()


def test_fingerprints(docs, rows, no_docs):
    found, ordered = by_id(fingerprints.fingerprint_documents(docs)), order(rows)
    assert sum(map(len, found.values())) == len(rows)
    prints, errors = {}, []
    for i, (_, _, text, doc_id) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][2]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = next(x for x in found[doc_id] if x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest())
        assert r.n_chars == len(text) and prints.setdefault(text, r.fingerprint) == r.fingerprint
        a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOWER))) for x in (text, following))
        if a and b:
            errors.append(r.near_next - sum((a & b).values()) / sum((a | b).values()))
        assert 0 <= r.near_edited <= 1
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    assert fingerprints.fingerprint_documents(no_docs).count() == 0


def test_collision_rate_is_generalised_jaccard():
    a, b = "x " * 5 + "y " * 3 + "z", "x " * 2 + "y " * 6 + "w"
    one, other = fingerprints.fingerprint_texts([a, b], 4096)
    assert abs(fingerprints.likeness(one, other) - (2 + 3) / (5 + 6 + 1 + 1)) < 0.03
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness(one, "") == 0.0


BASE = [("assign", re.compile(secret_scan.ASSIGN.replace("(?i)", ""), re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_of(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, keep) in enumerate(BASE) for m in p.finditer(text) if keep(m))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)


def test_secret_spans(spark, docs, rows, no_docs):
    many = spark.createDataFrame([(9001, " ".join(["secret=abcdef1"] * 300)), (9002, "token=" * 40), (9003, "2024-01-01-12-30-00-000 " + "-" * 60 + " MyLongClassNameForTheThing")], "doc_id long, text string")
    model = secret_scan.train(secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    for df in (docs, many):
        out = secret_scan.scan(df, model).select("row.doc_id", "row.text", secret_scan.as_text(F.col("base")).alias("b"), secret_scan.as_text(F.col("spans")).alias("s"), secret_scan.mask(F.col("scanned"), F.col("spans")).alias("m"))
        for r in out.collect():
            text = r.text or ""
            assert r.b == base_of(text)
            assert set(filter(None, r.b.split(","))) <= set(filter(None, r.s.split(",")))
            assert ("markov" in r.s) == ("aWx7" in text)
            spans = [tuple(map(int, x.split(":")[1:])) for x in r.s.split(",") if x]
            parts, at = [], 0
            for a, b in spans:
                parts += [text[at:a], "[SECRET]"] if a >= at else []
                at = max(at, b)
            assert r.m == "".join(parts) + text[at:]
    assert secret_scan.scan_corpus(no_docs).count() == 0
    masked = secret_scan.mask_secrets(docs, model)
    assert masked.columns == docs.columns and masked.where("n_chars <> char_length(coalesce(text, ''))").count() == 0


def test_markov_models_tell_held_out_strings_apart(spark, docs):
    model = secret_scan.train(secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    random = [hashlib.sha512(str(i).encode()).hexdigest()[:32] for i in range(50)]
    plain = ["thereareordinarywords", "user_account_manager_id", "THE_LONG_CONSTANT_OF_STONE", "RiverUnderStoneTree", "light/under/the/river"]
    scores = {r.t: r.s for r in spark.createDataFrame([(x,) for x in random + plain], "t string").select("t", secret_scan.log_ratio(F.col("t"), model).alias("s")).collect()}
    assert min(scores[x] for x in random) > 24 and max(scores[x] for x in plain) < 0


def test_licenses(spark, no_docs):
    known = licenses.known_licenses(spark)
    mit, bsd0 = "Released under the MIT License.", licenses.KNOWN[-1][1]
    rows = [(1, f"some text\n{mit.upper()}\nmore"), (2, "Copyright (c) 2020 A\n" + bsd0.replace(",", " ,")), (3, None), (4, ""), (5, "released under the mit license and more"), (6, mit), (6, mit), (None, "LICENCED under\nLicensed under CC BY-NC 4.0")]
    out = licenses.scan_licenses(spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, licenses string"), known)
    got = sorted((str(r.doc_id), r.licenses, r.n_lines, r.whole) for r in out.collect())
    assert got == [("1", "MIT", 1, False), ("2", "0BSD", 0, True), ("3", "", 0, False), ("4", "", 0, False), ("5", "", 0, False), ("6", "MIT", 1, True), ("6", "MIT", 1, True), ("None", "CC-BY-NC-4.0", 1, False)]
    assert licenses.scan_licenses(no_docs, known).count() == 0
    assert licenses.scan_licenses(no_docs.select("doc_id", "text").union(spark.createDataFrame([(1, mit)], "doc_id long, text string")), known.limit(0)).first().licenses == ""


def test_full_licence_texts(spark):
    """Known texts alone, inside a readme or a source file, wrapped at 72 and 80 columns, without blank lines, in capitals."""
    import os
    import textwrap

    texts = [(i, x) for i, x in licenses.KNOWN if len(x) > 400]
    folder = "/usr/share/common-licenses/"  # where a machine has them, the long texts too
    long = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts += [(i, open(folder + f, encoding="utf-8").read()) for f, i in long.items() if os.path.exists(folder + f)]
    rows, expected = [], {}
    for name, x in texts:
        paragraphs = ["\n".join(y for y in p.split("\n") if y.strip()) for p in x.split("\n\n")]
        wrapped = lambda n, gap, of=paragraphs: gap.join(textwrap.fill(" ".join(p.split()), n, break_long_words=False, break_on_hyphens=False) for p in of if p.strip())
        forms = [(x, True), ("Copyright (c) 2024 Some One\n\n" + x, True), (f"# A project\n\nWhat it does.\n\n## Licence\n\n{x}\n\n## More\n\nText.", False)]
        if name not in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0") or len(x) < 1500:  # those hold copyright lines of their own
            forms += [(wrapped(72, "\n\n"), True), (wrapped(80, "\n"), True), ("intro\n" + wrapped(40, "\n\n").upper() + "\nend", False), ("/*\n * " + wrapped(72, "\n\n").replace("\n", "\n * ") + "\n */\nint x;", False)]
        for form, whole in forms:
            expected[len(rows)] = (name, whole)
            rows.append((len(rows), form))
        rows.append((len(rows), x[: len(x) // 2]))
        rows.append((len(rows), x.replace(" of ", " off ").replace(" OF ", " OFF ").replace(" by ", " bye ")))
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    for i, (name, whole) in expected.items():
        assert name in out[i].licenses.split(",") and out[i].whole == whole and out[i].n_texts >= 1, (name, rows[i][1][:80], out[i])
    for i in out.keys() - expected.keys():
        assert out[i].n_texts == 0 and not out[i].whole, (rows[i][1][:80], out[i])


def sets_of(rows):
    found = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        found[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return found


def components_of(sets, threshold=85):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=lambda d: (d is not None, d or 0))
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)), key=lambda d: (d is not None, d or 0))
                parent[y] = x
    return {d: root(d) for d in ids}


def check_near(df, rows):
    sets = sets_of(rows)
    expected = components_of(sets)
    out = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in out) == sorted((str(d), len(sets[d]), expected[d], expected[d] == d) for d, _ in rows)


def test_near_duplicates(docs, rows, no_docs):
    check_near(docs, rows)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """A group larger than its blocks, of copies at all distances, and a passage that others share."""
    rnd = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rnd.choice(150, rnd.integers(0, 5), replace=False):
            w[at] = f"n{rnd.integers(10**9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60] + [f"o{rnd.integers(10**9)}" for _ in range(150)])) for i in range(60)]
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 16)
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_near_duplicates_at_another_threshold(spark):
    """Near copies of 500 words with 10 or 12 scattered ones changed: the first are links at 0.80, none at 0.85."""
    rows = []
    for pair in range(6):
        w = [f"p{pair}w{i}" for i in range(500)]
        changed = list(w)
        for i in range(10 if pair < 4 else 12):
            changed[20 + 40 * i] = f"new{i}"
        rows += [(2 * pair, " ".join(w)), (2 * pair + 1, " ".join(changed))]
    sets = sets_of(rows)
    near = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(6)]
    assert all(0.80 <= x < 0.85 for x in near[:4]) and all(x < 0.80 for x in near[4:])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.near_duplicates(docs, 80).where("kept").collect()} == {0, 2, 4, 6, 8, 9, 10, 11}
    assert near_dedup.near_duplicates(docs).where("kept").count() == 12
    assert (near_dedup.matches(85), near_dedup.matches(80)) == (15, 12)


def near_copies(spark):
    """(id, text): unrelated texts under one id, near copies without an id or with the same one, repeated rows."""
    rnd = np.random.default_rng(6)
    new = lambda: " ".join(f"w{x}" for x in rnd.integers(10**9, size=120))
    a, b, c, d, e = (new() for _ in range(5))
    rows = [(3, b), (5, a), (5, b + " end"), (None, c), (None, c + " more"), (7, c + " again"), (None, d), (8, e), (8, e + " once"), (8, e), (9, new()), (None, ""), (None, ""), (9, None)]
    return rows, spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node int")


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rows, docs = near_copies(spark)
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    got = {(r.doc_id, r.text_hash): (r.component_id, r.kept) for r in out}
    of = lambda i: got[rows[i][0], hashes[rows[i]]]
    assert [of(i)[0] for i in range(len(rows))] == [3, 5, 3, None, None, None, None, 8, 8, 8, 9, None, None, 9]
    assert [of(i)[1] for i in (0, 1, 2, 5, 6, 10, 11, 13)] == [True, True, False, False, True, True, True, True]
    assert of(3)[1] != of(4)[1] and of(7)[1] != of(8)[1] and of(7) == of(9)


def test_near_duplicates_of_a_row_repeated_often(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.range(3000).selectExpr("1 as doc_id", f"'{text}' as text").union(spark.range(1).selectExpr("2", f"'{text} end'"))
    found = near_dedup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, True, 3000), (2, 1, False, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (200, 200), (7, 300)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({label[x] for x in [*range(1, 61), 300]}) == 1 and label[100] == label[101] != label[1] and 200 not in label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference_ids(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_pieces_encode_like_whole_texts(name, kind, texts, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    encoder = tokens.Encoder(public_tokenizers.path(name), kind)
    rnd = np.random.default_rng(5)
    letters = list("ab C\n\n  \t'sé́  \x1c\x850٣!?<|>中\U0001f600ΣσA")
    more = ["".join(rnd.choice(letters, rnd.integers(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b"]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    for i in range(0, len(more), 100):
        for x, got in zip(more[i : i + 100], encoder.encode(more[i : i + 100]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_added_tokens_are_one_id(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    encoder, plain = tokens.encoder(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name))
    rnd = np.random.default_rng(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "a", "B.", ", c", "é", "\u0301", "x'", "s"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", *("".join(rnd.choice(parts, rnd.integers(1, 12))) for _ in range(2000))]
    for i in range(0, len(texts), 100):
        for x, got in zip(texts[i : i + 100], encoder.encode(texts[i : i + 100]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(x, add_special_tokens=False).ids, repr(x)


def test_queries_keep_added_tokens(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    found = {r.doc_id: r for r in token_files.tokenize_to_files(df).collect()}
    assert (found[1].n_tokens, found[1].ids_crc32, found[2].start) == (4, zlib.crc32(np.array([320, 49407, 321, 1], "<u4").tobytes()), 4)
    assert {(r.doc_id, r.doc_tokens) for r in packing.pack_documents(df).collect()} == {(1, 5), (2, 2)}


def test_marks_after_letters_that_are_lowered_or_taken_apart():
    found = sorted(set(tokens.odd_endings().pattern) - set("[\\W_][.,]"))
    assert "\u0130" in found and "\u0958" in found and "\ufb2a" in found and len(found) < 200
    encoder, plain = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), "words"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = np.random.default_rng(8)
    made = [f"BELED{c}YES{c}. Yeni, {c}, {c}.{c} a{c}." for c in [*found, "\u00e9", "\u1e9e", "\u01c5", "e\u0301", "\u2126", "\uac00"]]
    made += ["".join(rnd.choice([*found, "a", "B", "1", ".", ",", " ", "\u00e9", "\u0307"], rnd.integers(1, 25))) for _ in range(4000)]
    for text, got in zip(made, encoder.encode(made), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_parts_of_a_batch_hold_all_texts_in_order(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 200)
    plain, rnd = Tokenizer.from_file(public_tokenizers.path(name)), np.random.default_rng(12)
    parts = ["Stone", " river", "\u00c9clat", "x1", ".", ",", " ", "\n", "\n\n", "\t", "'s", "_", "\0", "\x1c", "\u3000", "\u0301", "\u0130", "\U0001f600", "<|endoftext|>", "<|endoftext|> "]
    texts = [None, "", "x" * 900, *("".join(rnd.choice(parts, rnd.integers(0, 25))) for _ in range(3000))]
    found = list(tokens.encoder(public_tokenizers.path(name), kind).parts(pa.array(["cut off", *texts], pa.string())[1:], 7))
    assert len(found) > 100
    for text, got in zip(texts, (x for part in found for x in part.to_pylist()), strict=True):
        assert got == [*plain.encode(text or "", add_special_tokens=False).ids, 7], repr(text)


def test_marks_are_odd_after_the_same_codes_in_arrow():
    codes = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for marks in (tokens.odd_endings(), re.compile(r"[\W_][.,]")):
        found = pc.match_substring_regex(pa.array([f"a{c}.a" for c in codes]), tokens._odd(marks)).to_pylist()
        assert found == [bool(marks.search(f"a{c}.a")) for c in codes]


def test_pieces_that_begin_with_white_space_are_encoded_together():
    encoder, calls = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes"), []
    whole = encoder.tokenizer
    rnd = np.random.default_rng(13)
    words = ["".join(rnd.choice(list("abcdef'1\u00e9-"), rnd.integers(1, 9))) for _ in range(2000)]
    text = "".join(rnd.choice([" ", "\n"], 1)[0] + w for w in words)

    class Counted:
        def encode_batch_fast(self, pieces, **options):
            calls.extend(pieces)
            return whole.encode_batch_fast(pieces, **options)

    encoder.tokenizer = Counted()
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 5


def test_token_files(spark, docs, rows, no_docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path)
    found, at = by_id(token_files.token_index(spark, path)), 0
    for _, _, text, doc_id in order(rows):
        ids = reference_ids("word_bpe_49k.json", text, 1)
        assert (at, len(ids), zlib.crc32(ids.tobytes())) in [(r.start, r.n_tokens, r.ids_crc32) for r in found[doc_id]]
        at += len(ids)
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next((tmp_path / "tokens").glob("*.parquet"))).metadata.row_group(0)
    lists = next(meta.column(i) for i in range(meta.num_columns) if "tokens" in meta.column(i).path_in_schema)
    assert "DELTA_BINARY_PACKED" in lists.encodings and meta.column(0).has_column_index
    assert token_files.tokenize_to_files(no_docs).count() == 0


def test_starts_go_on_over_the_parts_of_batches(monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 100)
    plain, form = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), token_files.TokenFormat()
    texts = [None, "", *(f"Stone {i} river, " * (i % 9) for i in range(300)), "<|endoftext|>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    found = list(token_files._encoded(form, tokens.tokenizer_path(form.tokenizer))(iter([batch.slice(0, 120), batch.slice(0, 0), batch.slice(120)])))
    rows, at = pa.Table.from_batches(found).to_pylist(), 0
    assert len(found) > 50 and [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, text in zip(rows, texts, strict=True):
        want = [*plain.encode(text or "", add_special_tokens=False).ids, form.end_id]
        assert (r["tokens"], r["n_tokens"], r["start_in_file"]) == (want, len(want), at)
        at += len(want)


def test_packing(docs, rows, no_docs):
    pieces = packing.pack_documents(docs).collect()
    by_sequence, ids = defaultdict(list), {d: [] for d, _ in rows}
    for r in pieces:
        by_sequence[r.sequence_id].append(r)
        ids[r.doc_id].append(r)
    for pack in by_sequence.values():
        at = 0
        for r in sorted(pack, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    copies = Counter(d for d, _ in rows)
    for doc_id, text in rows:
        want = reference_ids("byte_bpe_50k.json", text, 0)
        assert sum(r.length for r in ids[doc_id]) == len(want) * copies[doc_id]
        for r in ids[doc_id]:
            assert r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
        if copies[doc_id] == 1:
            assert sorted((r.start, r.start + r.length) for r in ids[doc_id])[-1][1] == len(want)
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_balances_cost():
    plan = packing.PackingPlan(capacity=64)
    rnd = np.random.default_rng(0)
    pieces, n = packing.balance([packing.Piece(i, 0, np.zeros(rnd.integers(1, 64), "<u4")) for i in range(400)], plan)
    cost = Counter()
    for x in pieces:
        cost[x.sequence] += plan.cost(len(x.ids))
    full = [cost[s] for s in range(n - 6)]
    assert np.std(full) < 0.25 * np.mean(full)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark, docs, rows, no_docs):
    texts = [x for _, x in rows if x and len(x.split()) > 20]
    bench = [(1, " ".join(texts[0].split()[3:16])), (10, texts[1]), (2, "Smile"), (3, None), (4, "..."), (5, "never seen words at all"), (6, texts[1]), (None, texts[2].upper()), (7, "WORD-word word word, word word word word word word word")]
    benchmark = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, window int")
    windows = defaultdict(set)
    for item, text in bench:
        w = words_of(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])] |= {item} - {None}
    found = by_id(decontaminate.contamination(docs, benchmark))
    assert sum(map(len, found.values())) == len(rows)
    for doc_id, text in rows:
        w, hit, items = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (some := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= some
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        for r in found[doc_id]:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha, bool(hit)), (doc_id, text)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    assert decontaminate.contamination(no_docs, benchmark).count() == 0


def test_proximity_matches(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    rows = [(1, "so alpha beta gamma delta epsilon zeta eta theta iota kappa so"), (2, "so alpha gamma beta delta epsilon zeta eta theta iota kappa"), (3, "alpha and kappa")]
    found = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert [(found[i].n_items, found[i].n_near_items) for i in (1, 2, 3)] == [(1, 1), (0, 1), (0, 0)]


def test_quality_on_held_out_labels(spark, sf_dir="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    pairs = [(label[r.doc_id], r.keep) for r in quality.classify(docs).collect() if r.doc_id in label]
    good = [k for q, k in pairs if q]
    assert sum(good) / len(good) > 0.98 and sum(not k for q, k in pairs if not q) / len([1 for q, _ in pairs if not q]) > 0.9


def test_quality_edges(docs, rows, no_docs):
    model = quality.train(docs)
    assert quality.score(docs, model).count() == len(rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where("keep").count()
    assert quality.classify(no_docs).count() == 0


def test_expectation_maximisation_finds_the_labellers():
    rnd = np.random.default_rng(1)
    bad = rnd.random(20_000) < 0.2
    catch = np.array([0.7, 0.6, 0.5, 0, 0, 0, 0])
    votes = np.zeros((20_000, len(quality.LABELLERS)), int)
    votes[:, :7] = np.where(bad[:, None], rnd.random((20_000, 7)) < catch, rnd.random((20_000, 7)) < 0.02) * quality.BAD
    votes[:, 7:] = (rnd.random((20_000, len(quality.LABELLERS) - 7)) < np.where(bad, 0.1, 0.9)[:, None]) * quality.GOOD
    patterns = votes @ 3 ** np.arange(len(quality.LABELLERS))
    posterior = quality.estimate(Counter(patterns.tolist()))
    guess = np.array([posterior[p] < 0.5 for p in patterns.tolist()])
    assert (guess == bad).mean() > 0.97
