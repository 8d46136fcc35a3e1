"""The registered queries of this subpackage over whole tables, and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm import chats, decontaminate, fill_middle, fingerprints, html_main, license_digests, licenses, near_dedup, packing, quality, secret_scan, token_files, toxicity, whitening
from mediacat.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_corpus(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    return found.select("row.doc_id", *counts, F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


_CANONICAL = """list_filter(list_transform(string_split(regexp_replace({spelled}, '[^\\p{{L}}\\p{{N}}\\n©]+', ' ', 'g'), chr(10)), lambda x: trim(x)),
  lambda y: y <> '' and not (starts_with(y, 'copyright ') and not regexp_matches(y, '^copyright (holders?|notices?|owners?|laws?|interests?|licenses?|statements?|rights?|protection|disclaimers?|permission|and|or|in|is|to|on|of)( |$)'))
    and not starts_with(y, 'c copyright ') and not contains(y, '©') and y not in ('copyright', 'all rights reserved'))"""
_SPELLED = "lower(coalesce(text, ''))"
for _a, _b in (
    ("licence", "license"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("favour", "favor"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("http://", "https://"),
):
    _SPELLED = f"replace({_SPELLED}, '{_a}', '{_b}')"
# Ids, first eight words, characters and SHA-256 of the canonical forms of the known short texts, computed apart from the library.
_SHORT = (
    ("Apache-2.0", "licensed under the apache license version 2 0", 45, "28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6"),
    ("Apache-2.0", "licensed under the apache license version 2 0", 121, "724f3fd6f0a5802e9ded322c70a704e6ea310356286a16ec6dd4e24eaa926919"),
    ("MIT", "released under the mit license", 30, "123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940"),
    ("MIT", "licensed under the mit license", 30, "00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541"),
    ("GPL-3.0", "this work is licensed under the gnu general", 68, "37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5"),
    ("GPL-3.0", "licensed under the gnu general public license version", 55, "62b2ee53c71c14a3de093131238dba64b8686f08f7c919d263022044fe82d29c"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0", 27, "e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16"),
    ("CC-BY-4.0", "licensed under cc by 4 0", 24, "5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0", 27, "2b112a6fd54caf2eae8e23516b628ad8ac20c00e407e568c503a16ef1eabaec2"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license", 39, "0974d0ab3b4deb9b6e21519293cacb68e85cd19414330602b34f54bba00cc156"),
    ("MPL-2.0", "this source code form is subject to the", 185, "a7891d5763bc6e48071bd0cff7b7aa922b30c550600350b3ec16485e4e8312a6"),
    ("MIT", "permission is hereby granted free of charge to", 988, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms", 1197, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", 1386, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("ISC", "permission to use copy modify and or distribute", 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("Zlib", "this software is provided as is without any", 784, "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("BSL-1.0", "permission is hereby granted free of charge to", 1242, "4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85"),
    ("Unlicense", "this is free and unencumbered software released into", 1172, "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
    ("Apache-2.0", "licensed under the apache license version 2 0", 502, "c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073"),
    ("GPL-3.0-or-later", "this program is free software you can redistribute", 233, "66237b20dfaa335f5c003a3da64555538643deb65ca015c0d5fa588527312c4e"),
    ("GPL-2.0-or-later", "this program is free software you can redistribute", 233, "a311bfb80ef013414e08cf2ea0128d424ffe3b22888612edd81cc8f04be43f8d"),
    ("AGPL-3.0-or-later", "this program is free software you can redistribute", 240, "dcaf5fc7bcb7a7ddf0023e5716f0d0d0b8bfe3feec817b5b03d5de36b55f5250"),
    ("LGPL-3.0-or-later", "this library is free software you can redistribute", 240, "26a2d582faf58185e991b7ac687ad265df7f70630b3fa29ed58df5a81c9e84ca"),
    ("0BSD", "permission to use copy modify and or distribute", 590, "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
)
_OP3 = f"""
with known(name, head, chars, digest) as (values {', '.join(f"('{n}', '{h}', {c}, '{d}')" for n, h, c, d in (*_SHORT, *license_digests.DIGESTS))}),
docs as (select doc_id, lines, array_to_string(lines, ' ') as canonical from (select doc_id, {_CANONICAL.format(spelled=_SPELLED)} as lines from documents)),
line_hits as (select doc_id, i, name from (select doc_id, sha256(unnest(lines)) as digest, unnest(range(len(lines))) as i from docs) join known using (digest)),
whole_hits as (select doc_id, name from (select doc_id, sha256(canonical) as digest from docs where canonical <> '') join known using (digest)),
heads as (select distinct head, chars from known where chars >= 200),
parts as (select doc_id, canonical, head, chars, p, unnest(range(1, len(p))) as i from (select doc_id, canonical, head, chars, string_split(canonical, head) as p from docs join heads on contains(canonical, head))),
rests as (select doc_id, i, head, chars, substr(canonical, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(head) + 1)::bigint) as rest from parts where p[i] = '' or p[i] like '% '),
text_hits as (select doc_id, i, r.head, r.chars, name from rests r join known k on k.digest = sha256(left(rest, r.chars)) where length(rest) >= r.chars and substr(rest, r.chars + 1, 1) in ('', ' ')),
named as (select doc_id, string_agg(distinct name, ',' order by name) as licenses from (select doc_id, name from line_hits union all select * from whole_hits union all select doc_id, name from text_hits) group by doc_id)
select d.doc_id, coalesce(licenses, '') as licenses, coalesce((select count(distinct i) from line_hits h where h.doc_id = d.doc_id), 0) as n_lines,
  coalesce((select count(*) from (select distinct doc_id, i, head, chars from text_hits) h where h.doc_id = d.doc_id), 0) as n_texts,
  exists (select 1 from whole_hits h where h.doc_id = d.doc_id) as whole
from docs d left join named using (doc_id)
"""


@query("op3_licenses", _OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


_OP4 = """
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
  select distinct doc_id, list_slice(w, i, i + 4) as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)
), sizes as (select doc_id, count(*) as n from sets group by doc_id
), links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by all)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * common >= 85 * (p.n + q.n - common)
), reached as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reached r join links l on l.a = r.other
), lowest as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from lowest left join sizes using (doc_id)
"""


@query("op4_near_duplicates", _OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize_to_files(table(spark, sf_dir, "documents"))


_OP6 = """
with docs as (
  select doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: hash(x)) as w
  from documents
), items as (
  select cast(item_id as varchar) as item_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: hash(x)) as w
  from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as n, list_slice(w, i, i + 9) as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
), sizes as (select distinct n from windows
), places as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)
), found as (select doc_id, i, n, item_id from places join windows using (n, win)
), hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found)) group by doc_id
), named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from docs d left join hit using (doc_id) left join named using (doc_id)
"""


@query("op6_decontamination", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


_OP9 = """
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
whole as (select conv_id, count(*) as n_turns, list({'role': role, 'text': text} order by place) as said from turns group by conv_id),
prefixes as (select distinct list_slice(said, 1, k) as said from (select said, unnest(range(1, n_turns)) as k from whole)),
kept as (select min(conv_id) as conv_id, any_value(n_turns) as n_turns, count(*) as n_equal, said from whole where said not in (select said from prefixes) group by said)
select k.conv_id, (place - 1) // 64 as part, any_value(n_turns) as n_turns, any_value(n_equal) as n_equal,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by place) as rendered
from kept k join turns t on t.conv_id = k.conv_id group by k.conv_id, (place - 1) // 64
"""


@query("op9_chats", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.collapse(table(spark, sf_dir, "conversations"))


@query("op10_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP13 = """
with units as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u from documents
), drawn as (
  select *, cast(len(u) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from units
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn
), parted as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cut
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parted
"""


@query("op13_fill_in_middle", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    chars = [F.char_length(f"parts.{x}").cast("long").alias(f"{x}_chars") for x in ("prefix", "middle")]
    return out.select("row.doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
