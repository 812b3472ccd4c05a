"""Licence scans: Dice coefficient over word bigrams against licence templates, built-in functions only.

A text's units (whole text, paragraphs, two to four paragraphs in a row, lines) are lower-cased and reduced to words. With A
and B the sets of word bigrams, Dice is 2|A and B| / (|A| + |B|), which can reach a threshold
t only if |A| lies between |B| t / (2 - t) and |B| (2 - t) / t. So each template is listed
under the sizes that it may match, and a unit meets templates by an equi-join on its size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import pick

#: Notices and whole texts of public licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-notice": "Released into the public domain under CC0 1.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see https://www.gnu.org/licenses/."
    ),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        'with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS "
        'PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
        "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "unlicense-notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author "
        "or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For "
        "more information, please refer to <https://unlicense.org>"
    ),
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD = 0.8
WORD = "[a-z0-9.]+"


def normal_words(text: str) -> list[str]:
    """Lower-cased words of letters, digits and inner dots."""
    return [w for w in (m.strip(".") for m in re.findall(WORD, text.lower())) if w]


def _bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams that can reach ``threshold`` with a template of ``size``."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> tuple[DataFrame, int, int]:
    """``size, license, grams, own``: each template under each size it may match; and the overall bounds.

    As large as the templates, whatever the corpus.
    """
    rows, low, high = [], 1 << 30, 0
    for name, text in sorted(templates.items()):
        grams = sorted(_bigrams(normal_words(text)))
        if not grams:
            continue
        a, b = size_bounds(len(grams), threshold)
        low, high = min(low, a), max(high, b)
        rows += [(n, name, grams, len(grams)) for n in range(max(1, a), b + 1)]
    table = spark.createDataFrame(rows, "size int, license string, grams array<string>, own int")
    return table.select("size", "license", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"), "own"), low, high


def _words(unit: Column) -> Column:
    found = F.regexp_extract_all(F.lower(unit), F.lit(WORD), F.lit(0))
    bare = F.transform(found, lambda w: F.btrim(w, F.lit(".")))
    return F.filter(bare, lambda w: w != "")


#: A licence may stand in a longer text as so many paragraphs in a row.
RUNS = (2, 3, 4)


def _units(rows: DataFrame) -> DataFrame:
    """``doc_id, unit`` of ``doc_id, text``: whole text, paragraphs, runs of paragraphs and lines, each different string once."""
    plain = rows.select("doc_id", F.explode(F.array(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")))).alias("text")).where("text is not null")
    cut = plain.select("doc_id", "text", F.explode(F.array(F.split("text", "\n\n"))).alias("parts"))
    run = lambda k: F.when(
        F.size("parts") >= k, F.transform(F.sequence(F.lit(1), F.size("parts") - (k - 1)), lambda i: F.array_join(F.slice("parts", i, k), "\n\n"))
    ).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array("text"), F.col("parts"), *map(run, RUNS), F.split("text", "\n"))
    return cut.select("doc_id", F.explode(F.array_distinct(every)).alias("unit"))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, license, score, n_units``: for each id and licence found the best Dice and how many units matched.

    Units are whole texts, paragraphs, runs of two to four paragraphs, and lines, with CRLF as LF; equal units of a text count once. Ids without
    a match give no row; a null or empty text matches nothing. Rows that repeat an id add to
    its counts. ``score`` is rounded to six digits.
    """
    table, low, high = template_table(docs.sparkSession, templates, threshold)
    slim = pick(docs, doc_id=id_col, text=text_col)
    units = _units(slim)
    # low + 1 words are needed for low bigrams, and a word takes at least two bytes with its gap.
    units = units.where(F.octet_length("unit") >= 2 * low + 1)
    # explode() keeps the words as a column: a projection would be inlined and run again for each pair.
    words = units.select("doc_id", F.explode(F.array(_words(F.col("unit")))).alias("w")).where(F.size("w") > low)
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda a, i: F.xxhash64(F.concat_ws(" ", a, F.get("w", i + 1))))
    grams = words.select("doc_id", F.explode(F.array(F.array_distinct(pairs))).alias("a"))
    sized = grams.withColumn("size", F.size("a")).where(F.col("size").between(low, high))
    met = sized.join(F.broadcast(table), "size")
    dice = 2.0 * F.size(F.array_intersect("a", "grams")) / (F.col("size") + F.col("own"))
    hits = met.select("doc_id", "license", F.round(dice, 6).alias("score")).where(F.col("score") >= threshold)
    return hits.groupBy("doc_id", "license").agg(F.max("score").alias("score"), F.count("*").alias("n_units"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, with every unit compared to every template."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    grams = lambda ws: f"list_distinct([{ws}[i] || ' ' || {ws}[i + 1] for i in range(1, len({ws}))])"
    words = lambda t: f"[x for x in [trim(y, '.') for y in regexp_extract_all(lower({t}), '{WORD}')] if x <> '']"
    runs = ", ".join(f"[array_to_string(p[i:i + {k - 1}], chr(10) || chr(10)) for i in range(1, len(p) - {k - 2})]" for k in RUNS)
    return f"""
    WITH t0(license, body) AS (VALUES {values}),
    t1 AS (SELECT license, {words("body")} AS w FROM t0),
    t AS (SELECT license, {grams("w")} AS g FROM t1),
    d AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS p FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents)),
    u0 AS (SELECT doc_id, unnest(list_distinct(list_concat([text], p, {runs}, string_split(text, chr(10))))) AS unit FROM d),
    u1 AS (SELECT doc_id, {words("unit")} AS w FROM u0),
    u AS (SELECT doc_id, {grams("w")} AS g FROM u1 WHERE len(w) >= 2),
    s AS (SELECT doc_id, license, round(2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)), 6) AS score
          FROM u JOIN t ON len(u.g) BETWEEN len(t.g) * {threshold} / (2 - {threshold}) - 0.001 AND len(t.g) * (2 - {threshold}) / {threshold} + 0.001)
    SELECT doc_id, license, max(score) AS score, count(*) AS n_units FROM s WHERE score >= {threshold} GROUP BY doc_id, license"""
