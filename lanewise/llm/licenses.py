"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Of a text that names a licence, a copyright or a permission (NOTICE), these are notices: each line
that has such a word, each block of several lines that has one (blocks part at lines without an
ASCII letter or digit, as comment headers and paragraphs do), and the whole text if it has several
blocks.  Their terms, and those of the templates (notices, headers and whole licences), are weighted
by tf * idf, idf = ln((1 + n) / (1 + df)) + 1 over all notices; a file's own licence is that of the
template most alike to one of its notices, from THRESHOLD on; lines go before blocks in a tie.  A
file is a licence file, and speaks for its directory, if a notice of that licence has at least half
of its words, or its name is that of one (LICENSE, COPYING).  A file without a licence of its own
has that of the nearest directory above it with a licence file.  Everything is in DataFrame
expressions; only notices are exploded to terms.

Null and empty texts have no notices and can only inherit; a null path has no directories.
Rows that repeat path and text give the same row each (they, and equal notices, are found by 128 bits of hash).  Of several licence files in a directory
the one most alike to its template speaks, then the least path.  Other columns pass through; a
result column replaces one of its name.  Terms of a common notice are counted by partial
aggregates; templates are a fixed table of under two thousand terms, the only thing broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.5
NOTICE = "(?i)licen[sc]e|copyright|spdx-|all rights reserved|permission is hereby"

# Notices and headers of common licences, and whole licences without their copyright lines.
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. "
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License "
    "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 Universal License."),
    ("Proprietary", "Copyright. All rights reserved. No license is granted."),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    )),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    )),
    ("GPL-2.0", _GPL.format("General", 2)),
    ("GPL-3.0", _GPL.format("General", 3)),
    ("LGPL-3.0", _GPL.format("Lesser General", 3)),
    ("AGPL-3.0", _GPL.format("Affero General", 3)),
)

LICENSE_NAME = r"(?i)(^|/)(licen[sc]e|copying)(\.lesser)?([-_][a-z0-9+_-]+(\.[0-9]+)*)?(\.(txt|md|rst))?$"
TERMS = "[a-z0-9]+"
#: What parts blocks: a line end, then lines without a letter or digit.
PARTING = "\\n([^A-Za-z0-9\\n]*\\n)+"
#: Blocks are numbered after all lines, a whole text after all blocks.
BLOCKS, WHOLE = 1 << 40, 1 << 41


def _terms(line: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERMS), 0)


def notices(files: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, number, line (the notice's text): one row for each notice."""
    text = F.when(F.col(text).rlike(NOTICE), F.col(text))  # else null: nothing of it is split
    told = lambda parts, base: F.transform(parts, lambda x, i: F.struct((i + F.lit(base)).cast("long").alias("number"), x.alias("line")))
    blocks = F.split(text, PARTING)
    several = F.filter(told(blocks, BLOCKS), lambda x: F.contains(x["line"], F.lit("\n")))
    whole = F.when(F.size(blocks) > 1, told(F.array(text), WHOLE))
    every = F.concat(told(F.split(text, "\n"), 0), several, F.coalesce(whole, F.expr("array()").cast("array<struct<number:bigint,line:string>>")))
    found = F.filter(every, lambda x: x["line"].rlike(NOTICE))
    return files.select(*key, F.explode(found).alias("found")).select(*key, "found.number", "found.line")


def classified(found: DataFrame) -> DataFrame:
    """Notices(id, line) -> id, license, score of the best template from THRESHOLD on; id tells the texts of notices apart.

    Each distinct notice is compared once; its copies count in df.  As no idf is below 1, a notice's
    length has a lower bound without the df of terms that no template has; only the terms of
    notices whose score can reach THRESHOLD by it are joined with df."""
    spark = found.sparkSession
    lines = found.groupBy("id").agg(F.count("*").alias("copies"), F.first("line").alias("line"))
    terms = lines.select("id", "copies", F.explode(_terms(F.col("line"))).alias("term")).groupBy("id", "copies", "term").agg(F.count("*").alias("tf"))
    terms = common.staged(terms, "terms")
    df = terms.groupBy("term").agg(F.sum("copies").alias("df"))
    n = found.count()
    idf = F.ln((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weight = F.col("tf") * F.col("idf")
    length = lambda w: F.sqrt(F.sum(w * w))

    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    theirs = templates.select("template", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    theirs = theirs.join(df, "term", "left").withColumn("idf", idf).select("template", "term", "idf", weight.alias("w"))
    theirs = theirs.join(theirs.groupBy("template").agg(length(F.col("w")).alias("norm")), "template").select("template", "term", "idf", (F.col("w") / F.col("norm")).alias("v"))
    theirs = common.staged(theirs.coalesce(1), "templates")

    dots = terms.join(F.broadcast(theirs), "term").groupBy("id", "template").agg(F.sum(weight * F.col("v")).alias("dot"))
    least = terms.join(F.broadcast(theirs.select("term", "idf").distinct()), "term", "left").groupBy("id").agg(length(F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("least"))
    able = common.staged(dots.join(least, "id").where(F.col("dot") >= (THRESHOLD - 1e-5) * F.col("least")).drop("least"), "able")
    norms = terms.join(able.select("id").distinct(), "id", "left_semi").join(df, "term").withColumn("idf", idf).groupBy("id").agg(length(weight).alias("norm"))
    scores = able.join(norms, "id").select("id", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = F.max(F.struct("score", (-F.col("template")).alias("rank"))).alias("best")
    best = scores.where(F.col("score") >= THRESHOLD).groupBy("id").agg(best).select("id", "best.score", (-F.col("best.rank")).alias("template"))
    return best.join(F.broadcast(templates.select("template", "license")), "template").select("id", "license", "score")


def scanned(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files with own_license, own_score, is_license_file, license and inherited_from (a path)."""
    added = ["own_license", "own_score", "is_license_file", "license", "inherited_from"]
    files = files.drop(*added)
    both = [F.col(path), F.col(path).isNull(), F.col(text), F.col(text).isNull()]
    key = F.concat_ws("-", F.xxhash64(F.lit(1), *both), F.xxhash64(F.lit(2), *both)).alias("__key")
    words = F.size(_terms(F.coalesce(text, F.lit(""))))
    # notices only; texts without any are not shuffled for them
    with common.scratch(files.sparkSession):
        most = (2 * F.size(_terms(F.col("line"))) >= F.col("words")).alias("most")
        found = notices(files.select(key, F.col(path).alias("path"), words.alias("words"), F.col(text).alias("text")), ["__key", "path", "words"], "text").dropDuplicates(["__key", "path", "number"])
        found = common.staged(found.select("__key", "path", "number", most, F.unhex(F.md5(F.col("line"))).alias("id"), "line"), "notices")
        kinds = common.staged(classified(found), "kinds")
        own = found.drop("line").join(kinds, "id")
        best = F.max(F.struct("score", (-F.col("number")).alias("back"), "license")).alias("best")
        own = own.groupBy("__key", "path").agg(best, F.collect_set(F.when(F.col("most"), F.col("license"))).alias("mostly"))
        named = F.coalesce(F.col("path").rlike(LICENSE_NAME), F.lit(False))
        own = own.select("__key", "path", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"), (F.array_contains("mostly", F.col("best.license")) | named).alias("is_license_file"))
        own = common.staged(own, "own", keep=True)

    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    speaks = own.where("is_license_file AND path IS NOT NULL").withColumn("folder", folder(F.col("path")))
    first = F.row_number().over(Window.partitionBy("folder").orderBy(F.col("own_score").desc(), "path", "own_license"))
    speaks = speaks.withColumn("rank", first).where("rank = 1").select("folder", F.col("own_license").alias("license"), F.col("path").alias("inherited_from"))

    # every directory once, with those above it
    folders = files.where(F.col(path).isNotNull()).select(folder(F.col(path)).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.withColumn("depth", F.explode(F.sequence(F.size(parts), F.lit(0)))).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = above.join(speaks.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.max(F.struct("depth", "license", "inherited_from")).alias("near"))
    nearest = nearest.select(F.col("folder").alias("__folder"), F.col("near.license").alias("__license"), F.col("near.inherited_from").alias("__from"))

    own = own.select(F.col("__key").alias("__own"), "own_license", "own_score", "is_license_file")
    own = own.dropDuplicates(["__own"])
    out = files.withColumn("__key", key).withColumn("__folder", folder(F.col(path)))
    out = out.join(own, F.col("__key") == F.col("__own"), "left").join(nearest, "__folder", "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        *[F.col(c) for c in files.columns], "own_license", "own_score", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "__license").alias("license"), F.when(inherits, F.col("__from")).alias("inherited_from"),
    )


PATH = "concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), cast(floor(doc_id / 512) as bigint), concat(cast(doc_id as string), '.txt'))"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, their path from source, language and number."""
    docs = common.documents(spark, sf_dir).select("doc_id", F.expr(PATH).alias("path"), "text")
    # text is dropped before the joins of the result, so only its hash travels
    return scanned(docs).select("doc_id", "path", "own_license", "own_score", "is_license_file", "license", "inherited_from")


_TEMPLATE_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
_NOTICE_SQL = NOTICE.replace("(?i)", "")
_PARTING_SQL = PARTING.replace("(", "(?:")
ORACLE_SQL = f"""
WITH files AS (
  SELECT doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 512 AS VARCHAR), doc_id || '.txt') AS path, coalesce(text, '') AS text FROM documents),
told AS (SELECT doc_id, path, text, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words, string_split(text, chr(10)) AS lines, string_split_regex(text, '{_PARTING_SQL}') AS blocks FROM files WHERE regexp_matches(text, '{_NOTICE_SQL}', 'i')),
found AS (
  SELECT doc_id, path, words, unnest(lines) AS line, generate_subscripts(lines, 1) AS number FROM told
  UNION ALL SELECT * FROM (SELECT doc_id, path, words, unnest(blocks) AS line, {BLOCKS} + generate_subscripts(blocks, 1) AS number FROM told) WHERE contains(line, chr(10))
  UNION ALL SELECT doc_id, path, words, text, {WHOLE} FROM told WHERE len(blocks) > 1),
notices AS (SELECT * FROM found WHERE regexp_matches(line, '{_NOTICE_SQL}', 'i')),
templates AS (SELECT * FROM (VALUES {_TEMPLATE_VALUES}) AS t(template, license, text)),
lines AS (SELECT line, count(*) AS copies FROM notices GROUP BY line),
terms AS (SELECT line, copies, term, count(*) AS tf FROM (SELECT line, copies, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM lines) GROUP BY ALL),
df AS (SELECT term, sum(copies) AS df FROM terms GROUP BY term),
weighed AS (SELECT line, term, tf * (ln((1 + (SELECT count(*) FROM notices)) / (1 + df)) + 1) AS w FROM terms JOIN df USING (term)),
own AS (SELECT line, term, w / sqrt(sum(w * w) OVER (PARTITION BY line)) AS w FROM weighed),
template_terms AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
theirs AS (
  SELECT template, term, v / sqrt(sum(v * v) OVER (PARTITION BY template)) AS v
  FROM (SELECT template, term, tf * (ln((1 + (SELECT count(*) FROM notices)) / (1 + coalesce(df, 0))) + 1) AS v FROM template_terms LEFT JOIN df USING (term))),
scores AS (SELECT line, template, round(sum(w * v), 6) AS score FROM own JOIN theirs USING (term) GROUP BY line, template),
kinds AS (SELECT line, score, license FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, template) AS rank FROM scores WHERE score >= {THRESHOLD}) JOIN templates USING (template) WHERE rank = 1),
judged AS (SELECT doc_id, path, license, score, number, 2 * len(regexp_extract_all(lower(line), '[a-z0-9]+')) >= words AS most FROM notices JOIN kinds USING (line)),
mostly AS (SELECT DISTINCT doc_id, license FROM judged WHERE most),
best AS (
  SELECT r.doc_id, path, r.license AS own_license, score AS own_score, m.doc_id IS NOT NULL OR regexp_matches(path, '{LICENSE_NAME}') AS is_license_file
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, number) AS rank FROM judged) r LEFT JOIN mostly m ON r.doc_id = m.doc_id AND r.license = m.license WHERE rank = 1),
speaks AS (
  SELECT folder, own_license AS license, path AS inherited_from
  FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY own_score DESC, path) AS rank FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM best WHERE is_license_file)) WHERE rank = 1),
above AS (
  SELECT doc_id, depth, array_to_string(parts[1:depth], '/') AS folder
  FROM (SELECT doc_id, parts, unnest(range(len(parts) + 1)) AS depth FROM (SELECT doc_id, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM files))),
nearest AS (SELECT doc_id, license, inherited_from FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC) AS rank FROM above JOIN speaks USING (folder)) WHERE rank = 1)
SELECT f.doc_id, f.path, own_license, own_score, coalesce(is_license_file, false) AS is_license_file, coalesce(own_license, n.license) AS license, CASE WHEN own_license IS NULL THEN n.inherited_from END AS inherited_from
FROM files f LEFT JOIN best b ON f.doc_id = b.doc_id LEFT JOIN nearest n ON f.doc_id = n.doc_id"""
