"""Licences by canonical digests: entire texts and entire lines, normalised and hash-joined to known licences.

A text's canonical form: lower case; equivalent spellings replaced; lines that state a copyright dropped; every run of
other code points than letters and digits one space, also from line to line. So neither wrapping nor blank lines matter.
Its SHA-256 digest is compared with the digests of known texts, made by the same expression. The units compared are

* the document as a whole;
* each of its lines, as a notice often stands as one line among others;
* from each place where the first ``HEAD`` words of a known text of ``LONG`` or more characters stand, as many characters
  as that text has: a licence inside a readme or a source file is found as a whole or not at all.

Short texts are rows of ``KNOWN``; of long ones ``DIGESTS`` holds the first words, the length and the digest. A caller may
give other rows.

Everything is DataFrame functions: lines that begin with a known two-character start and places of known first words
(constants, taken from the known texts) are exploded as digests, joined by equality to the known ones, and counted by
document.

Rows: a null or empty text, or one of copyright lines alone, has no canonical text and matches nothing. Rows are told
apart by ``doc_id`` and text; rows equal in both have equal results, one each. Known licences whose canonical texts are
equal are reported together. Empty tables of documents or licences give no rows or no matches. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.arrays import bound
from mediacat.llm.license_digests import DIGESTS

#: Words that a known text is looked for by, and the characters of those that are looked for within other text.
HEAD, LONG = 8, 200

#: Equivalent spellings, the right one canonical.
SPELLINGS = (("licence", "license"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("http://", "https://"))

#: Beginnings of lines that speak of copyright and state none, as a wrapped line may.
ABOUT_COPYRIGHT = "^copyright (holders?|notices?|owners?|laws?|interests?|licenses?|statements?|rights?|protection|disclaimers?|permission|and|or|in|is|to|on|of)( |$)"

# Notices and texts of well-known licences as they are published.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("GPL-2.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.'),
    ("AGPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("LGPL-3.0-or-later", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)


def canonical_lines(text: Column) -> Column:
    """Lower-case lines with canonical spellings and spaces alone; lines without letters and copyright lines dropped."""
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for spelling, canonical in SPELLINGS:
        x = F.replace(x, F.lit(spelling), F.lit(canonical))
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\n©]+", " ")
    lines = F.transform(F.split(x, "\n"), lambda y: F.trim(y))  # trim itself would take the index for its second argument
    return F.filter(lines, lambda y: (y != "") & ~((y.startswith("copyright ") & ~y.rlike(ABOUT_COPYRIGHT)) | y.startswith("c copyright ") | y.contains("©") | y.isin("copyright", "all rights reserved")))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_licenses(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """Known licences as a table: license_id, and either text or head, chars and digest of its canonical form."""
    schema = "license_id string, text string, head string, chars int, digest string"
    return spark.createDataFrame([(*x, None, None, None) for x in known] + [(x[0], None, *x[1:]) for x in digests], schema)


def canonical_text(text: Column) -> Column:
    return F.array_join(canonical_lines(text), " ")


def head_of(canonical: Column) -> Column:
    """The first words of a canonical text."""
    return F.substring_index(canonical, " ", HEAD)


def _digests(licenses: DataFrame) -> DataFrame:
    """license_id, head, chars, digest of all rows, whichever way they are given."""
    given = {c: F.col(c) if c in licenses.columns else F.lit(None) for c in ("head", "chars", "digest")}
    own = licenses.select("license_id", *(given[c].alias(c) for c in given), canonical_text(F.col("text")).alias("canonical"))
    rows = own.select(
        "license_id", F.coalesce("head", head_of(F.col("canonical"))).alias("head"), F.coalesce("chars", F.char_length("canonical")).cast("int").alias("chars"), F.coalesce("digest", digest(F.col("canonical"))).alias("digest")
    )
    return rows.where("chars > 0")


def _from_heads(canonical: Column, sizes: dict[str, list[int]]) -> Column:
    """Digests of what begins with known first words and has the length of a text that begins so, and ends with a word."""
    known = F.filter(F.array(*(F.struct(F.lit(h).alias("head"), F.array(*map(F.lit, n)).alias("sizes")) for h, n in sorted(sizes.items()))), lambda x: F.contains(canonical, x["head"]))

    def of(x: Column) -> Column:
        def cut(parts: Column) -> Column:
            rest = lambda i: F.concat(x["head"], F.call_function("array_join", F.slice(parts, i + 1, F.size(parts)), x["head"]))
            starts = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.get(parts, i - 1).alias("before"), rest(i).alias("rest"))), lambda y: (y["before"] == "") | y["before"].endswith(" "))
            fits = lambda y, n: (F.char_length(y["rest"]) >= n) & F.substring(y["rest"], n + 1, F.lit(1)).isin("", " ")
            return F.flatten(F.transform(starts, lambda y: F.transform(F.filter(x["sizes"], lambda n: fits(y, n)), lambda n: digest(F.substring(y["rest"], F.lit(1), n)))))

        return bound(F.split(canonical, F.concat(F.lit("\\Q"), x["head"], F.lit("\\E")), -1), cut)

    return F.flatten(F.transform(known, of)) if sizes else F.array().cast("array<string>")


def scan_licenses(documents: DataFrame, licenses: DataFrame) -> DataFrame:
    """Per document: doc_id, licenses (sorted ids, comma-joined), n_lines (matching lines), n_texts (known texts found at their first words), whole (the text is one licence)."""
    rows = _digests(licenses)
    digests = rows.groupBy("digest").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    known = rows.select("head", "chars").distinct().collect()
    starts = sorted({r.head[:2] for r in known})
    sizes: dict[str, list[int]] = {}
    for r in sorted(known):
        if r.chars >= LONG:  # shorter ones are found as lines
            sizes.setdefault(r.head, []).append(r.chars)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), canonical_lines(F.col("text")).alias("lines"))
    docs = docs.withColumn("canonical", F.array_join("lines", " "))
    begins = lambda y: F.substring(y, 1, 2).isin(starts)
    unit = lambda d, kind: F.struct(d.alias("digest"), F.lit(kind).alias("kind"))
    units = F.concat(
        F.transform(F.filter("lines", begins), lambda y: unit(digest(y), "line")),
        F.when(begins(F.col("canonical")), F.array(unit(digest(F.col("canonical")), "whole"))).otherwise(F.array()),
        F.transform(_from_heads(F.col("canonical"), sizes), lambda d: unit(d, "text")),
        F.array(unit(F.concat(F.lit("row "), F.xxhash64("doc_id", "text_hash").cast("string")), "row")),
    )
    rows = docs.select("doc_id", "text_hash", F.explode(units).alias("u")).select("doc_id", "text_hash", "u.*")
    met = rows.join(digests, "digest", "left")
    hit = lambda kind: F.col("ids").isNotNull() & (F.col("kind") == kind)
    found = met.groupBy("doc_id", "text_hash").agg(
        F.count_if(F.col("kind") == "row").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"),
        F.count_if(hit("line")).alias("lines"), F.count_if(hit("text")).alias("texts"), F.bool_or(hit("whole")).alias("whole"),
    )
    each = lambda c: (F.col(c) / F.col("copies")).cast("long")
    one = found.select("doc_id", F.array_join("ids", ",").alias("licenses"), each("lines").alias("n_lines"), each("texts").alias("n_texts"), "whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return one.drop("copy")
