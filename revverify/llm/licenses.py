"""Operator 10 [native]: licence scan by sparse TF-IDF cosine to templates, with inheritance from ancestor directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Identifiers of licences, as headers state them.
IDENTIFIERS = (
    "Apache-2.0", "MIT", "MIT-0", "ISC", "Zlib", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "CC0-1.0",
)
# Texts of short licences without their copyright lines.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program."
# Notices that name a licence, and the licence they name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("MIT-0", f"{_MIT_GRANT.partition(', subject to')[0]}. {_MIT_WARRANTY}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; altered source versions must be plainly marked as such; this notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
    ("GPL-3.0", "This program " + _GNU.format("General Public License", 3, "General Public License", "General Public License")),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program " + _GNU.format("General Public License", 2, "General Public License", "General Public License")),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library " + _GNU.format("Lesser General Public License", 2.1, "Lesser General Public License", "Lesser General Public License")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program " + _GNU.format("Affero General Public License", 3, "Affero General Public License", "Affero General Public License")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    *((x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS),
)
#: Words of a window over a line that is longer, and the words from one window to the next.
WINDOW, STEP = 32, 16
CUE = "(?i)licen[sc]|copyright|public domain|rights reserved|hereby granted|redistribut|spdx"
LICENSE_FILE = "(?i)^(licen[sc]e|copying|unlicense|notice)([.-].*)?$"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.\-]+"), lambda w: F.length(F.btrim(w, F.lit(".-"))) > 0)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(words: Column) -> Column:
    """Of a sorted array of words: each word once with its count, as array<struct<w, tf>>."""

    def of(w: Column) -> Column:
        n = F.size(w)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
        run = lambda a, b: F.struct(F.element_at(w, a).alias("w"), (F.coalesce(b, n + 1) - a).cast("double").alias("tf"))
        return _let(starts, lambda s: F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), run))

    return _let(words, of)


def _likely(lines: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """The words (key, w, tf) of the lines whose cosine with a template can reach ``least``.

    A word's inverse document frequency is 1 or more, so a line's norm is at least that of its template words' weights and its other
    words' counts. This bounds every cosine from above without the frequencies of other words: lines below it need no join.
    """
    ly = y.groupBy("t").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ly"))
    per = y.join(F.broadcast(ly), "t").groupBy("w").agg(F.first("idf").alias("idf"), F.map_from_entries(F.collect_list(F.struct("t", F.col("y") / F.col("ly")))).alias("y"))
    # One row: the fixed template words with their frequency and their normed weight in each template.
    known = per.agg(F.collect_list("w").alias("known"), F.map_from_entries(F.collect_list(F.struct("w", F.struct("idf", "y")))).alias("of"))
    sum_of = lambda of, f: F.aggregate(of, F.lit(0.0), lambda total, r: total + f(r))

    def reaches(hits: Column) -> Column:
        norm = F.sqrt(sum_of("runs", lambda r: r["tf"] * r["tf"]) + sum_of(hits, lambda r: r["x"] * r["x"] - r["tf"] * r["tf"]))
        dots = (sum_of(hits, lambda r, t=t: r["x"] * F.coalesce(r["y"][F.lit(t)], F.lit(0.0))) for t in range(len(TEMPLATES)))
        return F.greatest(*dots) >= (least - 1e-6) * norm

    met = F.filter("runs", lambda r: F.array_contains("known", r["w"]))
    hits = F.transform(met, lambda r: _let(F.element_at("of", r["w"]), lambda o: F.struct(r["tf"].alias("tf"), (r["tf"] * o["idf"]).alias("x"), o["y"].alias("y"))))
    return lines.join(F.broadcast(known)).where(_let(hits, reaches)).select("key", F.inline("runs"))


def scan_licenses(files: DataFrame, least: float = 0.6) -> DataFrame:
    """Licence of each row (path, text): path, own, own_score, inherited, inherited_from, license, after the row's other columns (but for those of these names).

    Units of a text are scored against the templates by the cosine of TF-IDF vectors over words, whose document counts are
    taken over all units of all files. Units are: every line with a licence word; of longer lines their overlapping windows of 32 words
    with one; every block of lines (between blank ones) with one, so headers and notices wrapped over lines count as a whole; and of a licence file (by its
    base name) every line and the whole text. The best unit and template (ties: by name) count, from ``least`` on. Equal units are scored once, and
    those of one file count once. Texts of any length are taken whole; an empty table gives no rows. A file without own licence inherits that of the nearest ancestor directory which
    holds a licence file with one (several: the best score, then by name). license = own or inherited. A null path or text is
    read as empty; blank lines have no score. Rows that repeat are kept as they are, each with the same result: paths that repeat with other texts have the best own licence.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    result = ("path", "own", "own_score", "inherited", "inherited_from", "license")
    others = [c for c in files.columns if c not in (*result, "text")]
    files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), text.alias("text"), F.struct(F.lit(0), *others).alias("others"))
    name = F.element_at(F.split("path", "/"), -1)
    is_file = name.rlike(LICENSE_FILE)
    split = F.transform(F.split("text", r"\R"), lambda x: F.btrim(x))
    cued = F.filter(split, lambda x: x.rlike(CUE))
    words_of = lambda x: F.filter(F.split(x, "[ \t]+"), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - STEP - 1, F.lit(0)), F.lit(STEP))
    cut = lambda x: _let(words_of(x), lambda w: F.when(F.size(w) > WINDOW, F.transform(starts(w), lambda i: F.array_join(F.slice(w, i + 1, WINDOW), " "))).otherwise(F.array().cast("array<string>")))
    windows = F.filter(F.flatten(F.transform(cued, cut)), lambda x: x.rlike(CUE))
    blocks = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda x: F.btrim(x)), lambda x: x.rlike(CUE) & x.contains("\n"))
    none = F.array().cast("array<string>")
    units = F.array_distinct(F.concat(F.when(is_file, split).otherwise(cued), windows, blocks, F.when(is_file, F.array(F.btrim("text"))).otherwise(none)))
    lines = files.where(F.col("text").rlike(CUE) | is_file).select("path", F.explode(units).alias("line"))
    lines = stored(lines.where(F.col("line").rlike("[A-Za-z0-9]")).withColumn("key", F.unhex(F.md5("line"))))
    # Only lines that can reach the threshold go word by word through a join, by the 16 bytes of their MD5.
    distinct = lines.groupBy("line").agg(F.count("*").alias("n"))
    words = F.sort_array(F.transform(_tokens(F.col("line")), lambda w: F.btrim(w, F.lit(".-"))))
    distinct = stored(distinct.select(F.unhex(F.md5("line")).alias("key"), "n", _runs(words).alias("runs")))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    spark = files.sparkSession
    rows = [(i, a, b) for i, (a, b) in enumerate(TEMPLATES)]
    tpl = spark.createDataFrame(rows, "t int, license string, notice string")
    tpl = tpl.select("t", "license", F.explode(_tokens(F.col("notice"))).alias("w")).select("t", "license", F.btrim("w", F.lit(".-")).alias("w")).groupBy("t", "license", "w").agg(F.count("*").alias("tf"))
    weight = lambda tf, df: F.col(tf) * (F.ln((1 + F.col("total")) / (1 + F.coalesce(F.col(df), F.lit(0)))) + 1)
    df = stored(distinct.select("n", F.explode("runs.w").alias("w")).groupBy("w").agg(F.sum("n").alias("df")))
    one = F.broadcast(total)  # one row
    # The templates' words are a fixed few hundred rows.
    y = stored(tpl.join(df.join(F.broadcast(tpl.select("w").distinct()), "w", "left_semi"), "w", "left").join(one).select("t", "license", "w", weight("tf", "df").alias("y"), (weight("tf", "df") / F.col("tf")).alias("idf")))
    x = stored(_likely(distinct, y, least).join(df, "w").join(one).select("key", "w", weight("tf", "df").alias("x")))
    lx = x.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("lx"))
    ly = y.groupBy("t").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ly"))
    dot = x.join(F.broadcast(y), "w").groupBy("key", "t", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("lx") * F.col("ly")), 6)
    best = dot.join(lx, "key").join(F.broadcast(ly), "t").groupBy("key").agg(F.max_by(F.struct("license", score.alias("s")), F.struct(score, F.col("license").alias("l"))).alias("b"))
    best = best.select("key", F.col("b.license").alias("own"), F.col("b.s").alias("own_score")).where(F.col("own_score") >= least)
    top = lambda: F.max_by(F.struct("own", "own_score"), F.struct("own_score", "own")).alias("b")
    own = lines.join(best, "key").groupBy("path").agg(top()).select("path", F.col("b.own").alias("own"), F.col("b.own_score").alias("own_score"))
    own = stored(own)
    folder = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    given = own.where(name.rlike(LICENSE_FILE)).withColumn("dir", folder(F.col("path"))).groupBy("dir").agg(top()).select("dir", F.col("b.own").alias("given"))
    # Nearest ancestor: every directory, once, meets its ancestors by path; the deepest one with a licence wins.
    dirs = files.select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ups = dirs.select(F.col("dir").alias("low"), F.explode(F.array_distinct(F.array_append(up, F.lit("")))).alias("dir"))
    heir = ups.join(given, "dir").groupBy("low").agg(F.max_by(F.struct("given", "dir"), F.length("dir")).alias("h"))
    heir = heir.select(F.col("low").alias("dir"), F.col("h.given").alias("from_dir"), F.col("h.dir").alias("where_from"))
    out = files.select("path", "others").join(own, "path", "left").withColumn("dir", folder(F.col("path"))).join(heir, "dir", "left")
    bare = F.col("own").isNull()
    inherited, whence = F.when(bare, F.col("from_dir")), F.when(bare, F.col("where_from"))
    return out.select(*[F.col("others")[c].alias(c) for c in others], "path", "own", "own_score", inherited.alias("inherited"), whence.alias("inherited_from"), F.coalesce("own", inherited).alias("license"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence of every document. Documents have no paths, so each gets one from its source and doc_id; every tenth is its directory's licence file.

    A document without doc_id gets its path from its source and text, so that only equal texts share one.
    """
    d = F.col("doc_id")
    a, b = F.expr("doc_id div 1000").cast("string"), F.expr("(doc_id div 100) % 10").cast("string")
    path = F.when(d % 100 == 0, F.concat_ws("/", "source", a, F.concat(F.lit("LICENSE."), d))).when(d % 10 == 0, F.concat_ws("/", "source", a, b, F.concat(F.lit("LICENSE."), d)))
    name = F.coalesce(d.cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    path = F.coalesce(path, F.concat_ws("/", "source", a, b, F.concat(F.lit("doc_"), name, F.lit(".txt"))))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path.alias("path"), "text")
    return scan_licenses(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "path", "own", "own_score", "inherited", "inherited_from", "license")


def _oracle() -> str:
    values = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))
    words = "list_filter(list_transform(string_split_regex(lower({}), '[^a-z0-9.\\-]+'), lambda w: trim(w, '.-')), lambda w: w <> '')"
    return rf"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 100 = 0 THEN source || '/' || (doc_id // 1000) || '/LICENSE.' || doc_id
    WHEN doc_id % 10 = 0 THEN source || '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/LICENSE.' || doc_id
    ELSE source || '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/doc_' || doc_id || '.txt' END AS path FROM documents),
s0 AS (SELECT path, text, doc_id % 10 = 0 AS file, list_transform(string_split_regex(text, '\r\n|[\n\x0b\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x)) AS ls FROM f),
s1 AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '{CUE}')) AS cued FROM s0 WHERE file OR regexp_matches(text, '{CUE}')),
s2 AS (SELECT *, list_transform(cued, lambda x: list_filter(string_split_regex(x, '[ \t]+'), lambda w: w <> '')) AS ws FROM s1),
l AS (SELECT path, line FROM (SELECT path, unnest(list_distinct(list_concat(CASE WHEN file THEN ls ELSE cued END,
        list_filter(flatten(list_transform(list_filter(ws, lambda w: len(w) > {WINDOW}), lambda w: list_transform(range(0, len(w) - {STEP}, {STEP}), lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' ')))), lambda x: regexp_matches(x, '{CUE}')),
        list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda x: trim(x)), lambda x: regexp_matches(x, '{CUE}') AND contains(x, chr(10))),
        CASE WHEN file THEN [trim(text)] ELSE [] END))) AS line FROM s2) WHERE regexp_matches(line, '[A-Za-z0-9]')),
d AS (SELECT line, count(*) AS n FROM l GROUP BY line),
w AS (SELECT line, n, w, count(*) AS tf FROM (SELECT line, n, unnest({words.format("line")}) AS w FROM d) GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) AS total FROM d),
df AS (SELECT w, sum(n) AS df FROM w GROUP BY w),
t AS (SELECT t, license, w, count(*) AS tf FROM (SELECT t, license, unnest({words.format("notice")}) AS w FROM (VALUES {values}) v(t, license, notice)) GROUP BY ALL),
x AS (SELECT line, w, tf * (ln((1 + total) / (1 + df)) + 1) AS x FROM w JOIN df USING (w), total),
y AS (SELECT t, license, w, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS y FROM t LEFT JOIN df USING (w), total),
lx AS (SELECT line, sqrt(sum(x * x)) AS lx FROM x GROUP BY line),
ly AS (SELECT t, sqrt(sum(y * y)) AS ly FROM y GROUP BY t),
s AS (SELECT line, license, round(sum(x * y) / (any_value(lx) * any_value(ly)), 6) AS s FROM x JOIN y USING (w) JOIN lx USING (line) JOIN ly USING (t) GROUP BY line, t, license),
b AS (SELECT line, license AS own, s AS own_score FROM s WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY s DESC, license DESC) = 1),
own AS (SELECT path, own, own_score FROM l JOIN b USING (line) QUALIFY row_number() OVER (PARTITION BY path ORDER BY own_score DESC, own DESC) = 1),
g AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, own AS given FROM own WHERE path LIKE '%/LICENSE.%'
      QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY own_score DESC, own DESC) = 1),
h AS (SELECT path, given, dir FROM f JOIN g ON starts_with(path, dir || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY len(dir) DESC) = 1)
SELECT doc_id, path, own, own_score, CASE WHEN own IS NULL THEN given END AS inherited, CASE WHEN own IS NULL THEN dir END AS inherited_from,
       coalesce(own, given) AS license
FROM f LEFT JOIN own USING (path) LEFT JOIN h USING (path)
"""


ORACLE_OP10 = _oracle()
