"""License scans by canonical digest lookup.

A text is normalised once: lower case, copyright statements dropped, punctuation and white space to single blanks, variant
spellings to one. The SHA-256 of the whole text is looked up among the digests of known licence texts; those of its single
lines and of its paragraphs (lines between blank ones), which is how notices stand in texts, among those of notices and short
licences. Line breaks do not matter, so a rewrapped licence has the same digest. The tables of digests are fixed and small
(under two hundred rows), so they are the broadcast side; documents are never shuffled but for the rows that hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut

# Spellings that count as the same word, and texts of licences and notices.
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "favour": "favor", "acknowledgement": "acknowledgment", "v1": "version 1", "v2": "version 2", "v3": "version 3"}
_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAME = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE {0} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {1} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_FREE = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. "
_COPY = "You should have received a copy of the GNU {} along with this program. If not, see {}."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http{}://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to '
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{}://mozilla.org/MPL/2.0/."
#: (licence, a text by which it is granted).
KNOWN: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
    ("BSL-1.0", _BOOST), ("Zlib", _ZLIB), *[("Unlicense", _UNLICENSE + x) for x in ("<http://unlicense.org/>", "<https://unlicense.org>", "<http://unlicense.org>", "<https://unlicense.org/>")],
    *[("Apache-2.0", _APACHE.format(x)) for x in ("", "s")], *[("MPL-2.0", _MPL.format(x)) for x in ("", "s")],
]
for _a, _b in (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("REGENTS", "REGENTS"), ("AUTHOR", "AUTHOR")):
    KNOWN.append(("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL.format(_a, _b)))
    KNOWN += [("BSD-3-Clause", _BSD_HEAD + _BSD_NAME.format(x) + _BSD_TAIL.format(_a, _b)) for x in ("the copyright holder", "the copyright holders", "the University", "the author")]
for _kind, _name, _version in (("GPL-2.0-or-later", "General Public License", "2"), ("GPL-3.0-or-later", "General Public License", "3"), ("AGPL-3.0-or-later", "Affero General Public License", "3"), ("LGPL-3.0-or-later", "Lesser General Public License", "3"), ("LGPL-2.1-or-later", "Lesser General Public License", "2.1")):
    for _mark in (":", ";"):
        _free = _FREE.format(_mark, _name, _version)
        KNOWN.append((_kind, _free))
        KNOWN += [(_kind, _free + _HOPE.format(_name) + _COPY.format(_name, x)) for x in ("<http://www.gnu.org/licenses/>", "<https://www.gnu.org/licenses/>")]
#: Titles that may stand before the texts above.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",), "Zlib": ("zlib License", "The zlib License")}
KNOWN += [(_n, f"{_t} {_f}") for _n, _f in KNOWN if _n in TITLES for _t in (*TITLES[_n], *(f"{x} All rights reserved." for x in TITLES[_n] if x.startswith("BSD")))]
#: Digests of the whole canonical texts of longer licences, as their publishers print them, and of their terms alone (up to and
#: with the line END OF TERMS AND CONDITIONS) where something follows.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87",),
    "Artistic-1.0": ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",),
    "BSD-3-Clause": ("3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",),
    "GFDL-1.3": ("93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",),
    "GPL-3.0": ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",),
    "MPL-2.0": ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",),
}
for _name, _forms in {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",),
}.items():
    for _form in _forms:
        KNOWN += [(_name, _lead + _form) for _lead in ("Licensed under ", "Licensed under the ", "Released under ", "Released under the ", "This work is licensed under the ", "This file is licensed under the ")]


#: A copyright statement: the word with a sign, a year or a placeholder after it, or the sign alone.
COPYRIGHT = r"^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*[0-9a-z<\[{]|©)"


def marked(text: Column) -> Column:
    """The normalised text with its lines kept apart by a line end between blanks. Letters and digits of any script stay; null counts as empty."""
    line = lambda x: F.when(x.rlike(COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    out = F.concat(F.lit(" "), F.array_join(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), line), " \n "), F.lit(" "))
    for one, other in SAME.items():
        for _ in range(2):  # neighbours share a blank
            out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return out


def _one(part: Column) -> Column:
    """A part of a marked text on one line."""
    joined = F.replace(part, F.lit("\n"), F.lit(" "))
    return F.trim(F.when(F.contains(joined, F.lit("  ")), F.regexp_replace(joined, " +", " ")).otherwise(joined))


def canonical(text: Column) -> Column:
    """The normalised text, as a column."""
    return _one(marked(text))


def marked_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    line = f"CASE WHEN regexp_matches(l, '{COPYRIGHT}') THEN '' ELSE trim(regexp_replace(l, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END"
    out = f"' ' || array_to_string(list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: {line}), ' ' || chr(10) || ' ') || ' '"
    for one, other in SAME.items():
        for _ in range(2):
            out = f"replace({out}, ' {one} ', ' {other} ')"
    return out


def _one_sql(part: str) -> str:
    return f"trim(regexp_replace(replace({part}, chr(10), ' '), ' +', ' ', 'g'))"


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known(spark: SparkSession) -> DataFrame:
    """(digest, license, length): of KNOWN (length: of the canonical text) and of DIGESTS (null); forms that normalise alike are one row."""
    forms = spark.createDataFrame(KNOWN, "license string, form string").withColumn("canon", canonical(F.col("form")))
    short = forms.select(_sha(F.col("canon")).alias("digest"), "license", F.length("canon").alias("length"))
    long = spark.createDataFrame([(d, n) for n, ds in DIGESTS.items() for d in ds], "digest string, license string")
    return short.unionByName(long.withColumn("length", F.lit(None).cast("int"))).distinct()


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text), license (of the whole text, or null), line_licenses (of lines and paragraphs, comma-joined, or '').

    One row for each input row. Rows that repeat an id with another text are scanned each for itself, and so are rows with a
    null id. Null texts count as empty; empty texts have the digest of the empty text, which is no licence.
    """
    table = known(spark)
    lengths = sorted(r["length"] for r in table.where("length is not null").select("length").distinct().collect())  # of a fixed list
    table = F.broadcast(table)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), marked(F.col("text")).alias("m"))
    lines, paragraphs = F.split("m", " \n ", -1), F.split("m", " \n  \n ", -1)
    # a digest can only be known if its text is as long as a known one: others are not hashed
    pieces = F.array_distinct(F.filter(F.concat(F.transform(lines, lambda x: F.trim(x)), F.transform(paragraphs, _one)), lambda x: F.length(x).isin(lengths)))
    found = own.select("doc_id", "row", _sha(_one(F.col("m"))).alias("digest"), F.transform(pieces, _sha).alias("parts"))
    found = Cut(found, "licenses").df
    hits = found.where("size(parts) > 0").select("doc_id", "row", F.explode("parts").alias("digest")).join(table.where("length is not null").select("digest", "license"), "digest")
    hits = hits.groupBy(F.col("doc_id").alias("id2"), F.col("row").alias("row2")).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"))  # of one document
    whole = found.select("doc_id", "row", "digest").join(table.select("digest", "license"), "digest", "left")
    out = whole.join(hits, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def scan_sql() -> str:
    forms = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    long = ", ".join(f"('{d}', '{n}')" for n, ds in DIGESTS.items() for d in ds)
    m = marked_sql("text")
    return f"""
WITH forms(license, form) AS (VALUES {forms}), long(digest, license) AS (VALUES {long}),
short AS (SELECT DISTINCT sha256({_one_sql(marked_sql('form'))}) AS digest, license FROM forms),
known AS (SELECT digest, license FROM short UNION SELECT digest, license FROM long),
own AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {m} AS m FROM documents),
whole AS (SELECT row, doc_id, sha256({_one_sql('m')}) AS digest FROM own),
single AS (SELECT row, trim(unnest(string_split(m, ' ' || chr(10) || ' '))) AS part FROM own UNION ALL SELECT row, unnest(string_split(m, ' ' || chr(10) || '  ' || chr(10) || ' ')) FROM own),
hits AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM single JOIN short ON short.digest = sha256({_one_sql('part')}) GROUP BY row)
SELECT whole.doc_id, whole.digest, known.license, coalesce(line_licenses, '') AS line_licenses
FROM whole LEFT JOIN known USING (digest) LEFT JOIN hits ON hits.row = whole.row
"""
