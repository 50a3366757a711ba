"""Licence scans by canonical digests, in native DataFrame expressions only.

A text is brought to a canonical form: small letters, copyright lines dropped, equivalent spellings made one, everything
but letters and digits to single spaces. The digests of the whole text and of each of its lines are looked up by hash
joins in a table of known licences and notices, canonicalised in the same way. A line can only equal a known notice of
the same length, so lines of other lengths are dropped before they are hashed; that loses nothing.

Long licence texts are known by their digests alone (DIGESTS), so they needn't be here.

Nulls: a null or empty text has no canonical form, hence no licence; a null doc_id is kept. Repeated rows are returned as
often as they come. Texts of any length are canonicalised whole, and lines of equal digest under several licences go to
the alphabetically first. Other columns aren't read, whatever their names. `from_folder` reads further known texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
WARRANTY_MIT = MIT[MIT.index("THE SOFTWARE IS") :]
MIT0 = MIT[: MIT.index(", subject to")] + ".\n" + WARRANTY_MIT
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + ISC[ISC.index("THE SOFTWARE IS") :]
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
POSTGRES = """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.
IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."""
WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(name: str, version: str, lesser: bool, program: str, end: str) -> str:
    """The notice of a GNU licence for files under this version or a later one."""
    kind = f"GNU {name} General Public License"
    return (
        f"{program} is free software{';' if lesser or version == '2' else ':'} you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation"
        f"{';' if version in ('2', '2.1') else ','} either version {version} of the License, or (at your option) any later version.\n"
        f"{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details.\n{end.format(kind)}"
    ).replace("GNU  General", "GNU General")


_SEE = "You should have received a copy of the {} along with this program. If not, see <https://www.gnu.org/licenses/>."
GPL2 = _gnu("", "2", False, "This program", "You should have received a copy of the {} along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
GPL3 = _gnu("", "3", False, "This program", _SEE)
AGPL3 = _gnu("Affero", "3", False, "This program", _SEE)
LGPL21 = _gnu("Lesser", "2.1", True, "This library", "You should have received a copy of the {} along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")
LGPL3 = _gnu("Lesser", "3", False, "This program", _SEE)
#: Licences of SPDX lines and their kinds.
SPDX = {
    "permissive": "0BSD Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC0-1.0 ISC MIT MIT-0 PostgreSQL Unlicense WTFPL Zlib",
    "copyleft": "AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-4.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-2.0",
    "non-commercial": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0",
}
#: Fixed values: (licence, kind, text).
KNOWN = (
    ("MIT", "permissive", MIT),
    ("MIT", "permissive", "The MIT License\n" + MIT),
    ("MIT", "permissive", "The MIT License (MIT)\n" + MIT),
    ("MIT", "permissive", "MIT License\n" + MIT),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT-0", "permissive", MIT0),
    ("MIT-0", "permissive", "MIT No Attribution\n" + MIT0),
    ("ISC", "permissive", ISC),
    ("ISC", "permissive", "ISC License\n" + ISC),
    ("0BSD", "permissive", ZERO_BSD),
    ("0BSD", "permissive", "BSD Zero Clause License\n" + ZERO_BSD),
    ("BSD-2-Clause", "permissive", BSD2 + WARRANTY_BSD),
    ("BSD-2-Clause", "permissive", "BSD 2-Clause License\n" + BSD2 + WARRANTY_BSD),
    ("BSD-3-Clause", "permissive", BSD3 + WARRANTY_BSD),
    ("BSD-3-Clause", "permissive", "BSD 3-Clause License\n" + BSD3 + WARRANTY_BSD),
    ("Zlib", "permissive", ZLIB),
    ("Zlib", "permissive", "zlib License\n" + ZLIB),
    ("BSL-1.0", "permissive", BOOST),
    ("BSL-1.0", "permissive", "Boost Software License - Version 1.0 - August 17th, 2003\n" + BOOST),
    ("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "permissive", UNLICENSE),
    ("PostgreSQL", "permissive", POSTGRES),
    ("PostgreSQL", "permissive", "PostgreSQL License\n" + POSTGRES),
    ("WTFPL", "permissive", WTFPL),
    ("WTFPL", "permissive", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n" + WTFPL),
    ("Apache-2.0", "permissive", APACHE),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-or-later", "copyleft", GPL2),
    ("GPL-3.0-or-later", "copyleft", GPL3),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1-or-later", "copyleft", LGPL21),
    ("LGPL-3.0-or-later", "copyleft", LGPL3),
    ("AGPL-3.0-or-later", "copyleft", AGPL3),
    ("MPL-2.0", "copyleft", MPL),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    *((name, kind, f"SPDX-License-Identifier: {name}") for kind, names in SPDX.items() for name in names.split()),
)
#: Fixed values: (pattern, replacement), applied in this order to small letters; the same in Java and RE2.
STEPS = (
    (r"(^|\n)[ \t*#/]*(copyright|\(c\)|©)[^\n]*", r"\1"),
    (r"licence", "license"),
    (r"sub[- \t]+license", "sublicense"),
    (r"copyright([ \t\r\n]+)owner", r"copyright\1holder"),
    (r"(authori|organi|capitali|categori|initiali|maximi|minimi|optimi|reali|recogni|utili|emphasi|customi)s(ation|e|ing)", r"\1z\2"),
    (r"(fav|lab|col|hon|behavi)our", r"\1or"),
    (r"(cent|calib)re", r"\1er"),
    (r"(catalog|analog)ue", r"\1"),
    (r"analyse", "analyze"),
    (r"(label|model|signal|cancel)l(ed|ing)", r"\1\2"),
    (r"(judg|acknowledg)ement", r"\1ment"),
    (r"(off|def)ence", r"\1ense"),
    (r"fulfil([^l])", r"fulfill\1"),
    (r"artefact", "artifact"),
    (r"practise", "practice"),
    (r"programme([^dr])", r"program\1"),
    (r"whilst", "while"),
    (r"wilful", "willful"),
    (r"per[ \t]+cent", "percent"),
    (r"non-commercial", "noncommercial"),
    (r"https://", "http://"),
    (r"&", " and "),
)


#: Fixed values: (licence, kind, digest, length) of the canonical forms of long licence texts, with and without what stands behind their terms.
DIGESTS = (
    ("Apache-2.0", "permissive", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b", 9706),
    ("Apache-2.0", "permissive", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd", 8690),
    ("Artistic-1.0-Perl", "permissive", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304", 5683),
    ("BSD-3-Clause", "permissive", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9", 1381),
    ("CC0-1.0", "permissive", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "copyleft", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f", 19509),
    ("GFDL-1.3", "copyleft", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480", 21877),
    ("GPL-1.0", "copyleft", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    ("GPL-1.0", "copyleft", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415),
    ("GPL-2.0", "copyleft", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", 17053),
    ("GPL-2.0", "copyleft", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", 14419),
    ("GPL-3.0", "copyleft", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f", 33274),
    ("GPL-3.0", "copyleft", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b", 30836),
    ("LGPL-2.0", "copyleft", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3", 23937),
    ("LGPL-2.0", "copyleft", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c", 22084),
    ("LGPL-2.1", "copyleft", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345", 25024),
    ("LGPL-2.1", "copyleft", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c", 23172),
    ("LGPL-3.0", "copyleft", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "copyleft", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", 22339),
    ("MPL-2.0", "copyleft", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56", 14272),
)


def _steps(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return out


def canonical(text: Column) -> Column:
    """The canonical form of whole texts."""
    return F.trim(F.regexp_replace(_steps(text), r"[^\p{L}\p{N}]+", " "))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of the lines, one under the other; lines without letters or digits are ''."""
    return F.regexp_replace(F.regexp_replace(_steps(text), r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n")


def known_digests(licences: DataFrame, stored: tuple = ()) -> DataFrame:
    """(digest, licence, kind, size) of licences(licence, kind, text) and of stored ones (see DIGESTS): one row a digest, the alphabetically first licence if several share it."""
    rows = licences.select("licence", "kind", canonical(F.col("text")).alias("c")).where("c <> ''")
    rows = rows.select(F.sha2("c", 256).alias("digest"), F.length("c").alias("size"), "licence", "kind")
    if stored:
        rows = rows.union(licences.sparkSession.createDataFrame(list(stored), "licence string, kind string, digest string, size int").select("digest", "size", "licence", "kind"))
    return rows.groupBy("digest", "size").agg(F.min(F.struct("licence", "kind")).alias("l")).select("digest", "l.licence", "l.kind", "size")


def scan(docs: DataFrame, licences: DataFrame, stored: tuple | None = None) -> DataFrame:
    """(doc_id, digest, licence, kind, notices, n_notice_lines): the licence that the whole text is, and those that its lines state.

    The sizes of known forms, at most a few hundred distinct numbers, are gathered once; digests are joined with the known
    table as Spark sees fit, and each row carries the distinct notices of its document only.
    """
    known = known_digests(licences, DIGESTS if stored is None else stored)
    sizes = sorted(r[0] for r in known.select("size").distinct().collect()) or [0]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the steps run once a text: canonical() of the whole is its lines' with spaces between them
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), canonical_lines(text).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x)).isin(sizes))
    rows = rows.select("doc_id", "_row", F.trim(F.regexp_replace("_text", r"[ \n]+", " ")).alias("_c"), F.transform(lines, lambda x: F.sha2(F.trim(x), 256)).alias("_lines"))
    rows = common.written(rows.select("doc_id", "_row", F.when(F.col("_c") != "", F.sha2("_c", 256)).alias("digest"), "_lines"), "licence-digests")
    noted = rows.select("_row", F.explode("_lines").alias("digest")).join(known.select("digest", "licence"), "digest")
    noted = noted.groupBy("_row", "licence").count().groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list("licence")), ",").alias("notices"), F.sum("count").alias("n_notice_lines"))
    # a null digest equals none: its rows get keys of their own, so that they don't meet in one task
    own = F.coalesce("digest", F.col("_row").cast("string"))
    named = known.select(F.col("digest").alias("_key"), "licence", "kind")
    found = rows.drop("_lines").withColumn("_key", own).join(named, "_key", "left").join(noted, "_row", "left")
    return found.select("doc_id", "digest", "licence", "kind", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"))


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "licence string, kind string, text string")


def from_folder(spark: SparkSession, path: str, kind: str = "unknown") -> DataFrame:
    """Known texts from a folder of text files that are named by their licences; union them with known_table() for scan()."""
    found = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return found.select(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.(txt|md)$", "").alias("licence"), F.lit(kind).alias("kind"), F.col("value").alias("text"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), known_table(spark))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({', '.join(map(quoted, row))})" for row in KNOWN)
    stored = ", ".join(f"({', '.join(map(quoted, row[:3]))})" for row in DIGESTS)
    steps = "lower(t)"
    for pattern, to in STEPS:
        steps = f"regexp_replace({steps}, {quoted(pattern)}, {quoted(to)}, 'g')"
    whole = f"trim(regexp_replace({steps}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    split = f"string_split(regexp_replace(regexp_replace({steps}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), chr(10))"
    return f"""
WITH known0(licence, kind, t) AS (VALUES {values}),
known AS (SELECT digest, min({{'licence': licence, 'kind': kind}}) AS l FROM (SELECT licence, kind, sha256({whole}) AS digest FROM known0 UNION ALL SELECT * FROM (VALUES {stored}) AS s(licence, kind, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, {whole} AS c, {split} AS ls FROM d),
n AS (SELECT r, k.l.licence AS licence FROM (SELECT r, sha256(trim(unnest(ls))) AS digest FROM w) x JOIN known k USING (digest)),
s AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n FROM n GROUP BY r)
SELECT w.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, k.l.licence AS licence, k.l.kind AS kind,
  coalesce(s.notices, '') AS notices, coalesce(s.n, 0)::BIGINT AS n_notice_lines
FROM w LEFT JOIN known k ON k.digest = sha256(w.c) AND w.c <> '' LEFT JOIN s ON s.r = w.r
"""


ORACLE = _oracle()
