"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Only DataFrame functions.  The passages of a text are the whole of it (licence files), its blocks of lines between
lines without letters or digits (header comments over several lines), and its single lines (notices).  A term weighs by its count in the passage
and the logarithm of how few texts have it; terms in fewer than one of some 1,100 texts all weigh the same (``RARE``), so
verdicts don't depend on how many texts there are.  A passage with a cosine of ``LEAST`` or more to a template has its licence.

Templates are a table (license, text) of any number.  Passages are left out only where the cosine can't reach
``LEAST``: a passage that has none but the lightest terms of a template is at most as near as the
template's own part of these.  The other terms are anchors; only passages with one of them become rows (text, passage, term, count),
which meet the frequencies and the templates' terms in joins.  Copies of a text are one text.

A text that matches as a whole licenses its directory.  One without licence of its
own takes that of the nearest ancestor directory.  That is solved for distinct
directories, joined to the ancestors of each, and then joined to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.tables import cut, hash128

#: Notices, headers and texts of common licences, by SPDX id (fixed values: the licences' own words).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", """MIT License
Copyright (c)
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
LEAST = 0.8
#: The logarithm of how many texts there are for each that has a term counts up to this.
RARE = 7.0
_TERM = "[^a-z0-9]+"
#: The characters beyond ASCII whose lower case has an ASCII letter: Kelvin and the dotted I.
_NOT_ASCII = "\u212a\u0130"
#: Between blocks: lines without letters or digits.
_GAP = "\n[^A-Za-z0-9]*\n"


def terms_of(text: Column) -> Column:
    """The terms of a passage, repeats included: ASCII letters and digits in lower case."""
    for c in _NOT_ASCII:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.lower(text), _TERM, -1), "")


def anchors(weight: Mapping[str, float], templates: Iterable[Mapping[str, int]], least: float) -> list[str]:
    """The template terms of which a passage must have one to reach ``least``: all but the lightest that together can't.

    ``templates`` are counts of terms.
    """
    having: dict[str, list[int]] = {}
    vectors = [{w: (n * weight[w]) ** 2 for w, n in t.items()} for t in templates]
    for k, v in enumerate(vectors):
        for w in v:
            having.setdefault(w, []).append(k)
    room = [(least**2 - 1e-9) * sum(v.values()) for v in vectors]
    light: set[str] = set()
    for w in sorted(weight, key=lambda w: (weight[w], w)):
        if any(room[k] <= vectors[k][w] for k in having[w]):
            break
        for k in having[w]:
            room[k] -= vectors[k][w]
        light.add(w)
    return sorted(set(weight) - light)


def scan_licenses(docs: DataFrame, path: Column, templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One row for each row: doc_id, path, license, how, similarity, inherited_from.

    Takes ``doc_id`` and ``text`` (null: empty); ``path`` is the text's path,
    with ``/`` between directories (null: no directory); ``templates`` are rows (license, text), else ``TEMPLATES``.  ``how`` is file (the whole text is a
    notice or licence), header (one of its blocks or lines is), inherited or none.  The nearest template wins, of
    equals the first licence by name; a directory with several licence files has the
    licence of most of them.  Repeated rows each come out and count.  An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(list(TEMPLATES), "license string, text string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = hash128(text)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), path.cast("string").alias("path"), t1.alias("t1"), t2.alias("t2"))
    named = templates.select(F.col("license").cast("string").alias("license"), F.xxhash64("license", "text").alias("tid"), F.col("text").cast("string").alias("text")).distinct()
    named = cut(named.select("license", "tid", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("license", "tid", "term").agg(F.count("*").alias("tf")), "templates")
    n_docs = base.count()
    seen = cut(base.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    idf = F.least(F.lit(RARE), F.log((1.0 + n_docs) / (1 + F.coalesce("df", F.lit(0))))) + 1
    known = cut(named.join(seen, "term", "left").select("license", "tid", "term", "tf", idf.alias("idf")), "weighed")
    vectors: dict[int, dict[str, int]] = {}
    weight: dict[str, float] = {}
    for r in known.collect():  # the templates' terms
        vectors.setdefault(r["tid"], {})[r["term"]] = r["tf"]
        weight[r["term"]] = r["idf"]
    needed = F.lit(anchors(weight, vectors.values(), least)) if weight else F.array().cast("array<string>")

    parts = F.concat(F.array("text"), F.split("text", "\n", -1), F.split("text", _GAP, -1))
    some = base.where(F.arrays_overlap(terms_of(F.col("text")), needed))
    held = some.select("t1", "t2", F.posexplode(parts).alias("pid", "p")).select("t1", "t2", "pid", terms_of(F.col("p")).alias("terms"))
    held = held.where(F.arrays_overlap("terms", needed)).select("t1", "t2", "pid", F.explode("terms").alias("term"))
    # copies of a text multiply all counts of a passage, which leaves its direction as it is
    held = held.groupBy("t1", "t2", "pid", "term").agg(F.count("*").alias("n"))
    held = cut(held.join(seen, "term").select("t1", "t2", "pid", "term", (F.col("n") * idf).alias("w")), "passages")
    norms = held.groupBy("t1", "t2", "pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    wt = F.col("tf") * F.col("idf")
    sizes = known.groupBy("license", "tid").agg(F.sqrt(F.sum(wt * wt)).alias("size"))
    dots = held.join(known.select("tid", "term", wt.alias("wt")), "term").groupBy("t1", "t2", "pid", "tid").agg(F.sum(F.col("w") * F.col("wt")).alias("dot"))
    cosine = F.col("dot") / (F.col("norm") * F.col("size"))
    near = dots.join(sizes, "tid").join(norms, ["t1", "t2", "pid"]).select("t1", "t2", "license", (F.col("pid") == 0).alias("whole"), F.round(cosine, 6).alias("similarity"))
    # of equals the first by name: the order of (-similarity, license) among whole matches, else among the others
    best = F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("similarity")).alias("off"), "license")).alias("best")
    own = near.where(F.col("similarity") >= least).groupBy("t1", "t2").agg(best)
    own = cut(own.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("best.license").alias("license"), (~F.col("best.part")).alias("whole"), (-F.col("best.off")).alias("similarity")), "own")

    folder = F.when(F.col("path").contains("/"), F.expr("left(path, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))"))
    rows = base.select("doc_id", "path", "t1", "t2", folder.alias("folder")).join(own, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    rows = cut(rows.select("doc_id", "path", "folder", "license", "whole", "similarity"), "rows")

    # directories: their own licence, then that of the nearest ancestor that has one
    votes = rows.where("whole and folder is not null").groupBy("folder", "license").count()
    licensed = votes.groupBy("folder").agg(F.max_by("license", F.struct("count", F.col("license").alias("name"))).alias("license")).withColumnRenamed("folder", "ancestor")
    folders = rows.where("folder is not null").select("folder").distinct()
    steps = F.split("folder", "/", -1)
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("ancestor"))
    nearest = above.join(licensed, "ancestor").groupBy("folder").agg(F.max_by("license", F.length("ancestor")).alias("inherited"), F.max_by("ancestor", F.length("ancestor")).alias("inherited_from"))
    nearest = cut(nearest, "folders")
    out = rows.join(nearest, "folder", "left")
    mine, theirs = F.col("license").isNotNull(), F.col("inherited").isNotNull()
    how = F.when(F.col("whole"), F.lit("file")).when(mine, F.lit("header")).when(theirs, F.lit("inherited")).otherwise(F.lit("none"))
    return out.select("doc_id", "path", F.coalesce("license", "inherited").alias("license"), how.alias("how"), "similarity", F.when(~mine, F.col("inherited_from")).alias("inherited_from"))


def document_path() -> Column:
    """A path for each of ``documents``: source, language, up to two more directories, and number."""
    deeper = F.element_at(F.array(F.lit(""), F.lit("a/"), F.lit("a/b/")), F.coalesce(F.pmod(F.col("doc_id"), F.lit(3)), F.lit(0)).cast("int") + 1)
    return F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"), deeper, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))


_ROWS = ", ".join(f"""({k}, '{n}', '{t.replace("'", "''")}')""" for k, (n, t) in enumerate(TEMPLATES))
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_IDF = f"least({RARE}, ln((1.0::DOUBLE + nd) / (1 + coalesce(df, 0)))) + 1"
ORACLE_SQL = f"""
WITH given(tid, license, text) AS (VALUES {_ROWS}),
tpl AS (SELECT tid, license, term, count(*) AS tf FROM (SELECT tid, license, unnest(regexp_split_to_array({_LOWER.format('text')}, '{_TERM}')) AS term FROM given) WHERE term <> '' GROUP BY ALL),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') ||
         CASE coalesce((doc_id % 3 + 3) % 3, 0) WHEN 0 THEN '' WHEN 1 THEN '/a' ELSE '/a/b' END AS folder, coalesce(doc_id::VARCHAR, 'none') || '.txt' AS file FROM documents),
size AS (SELECT count(*) AS nd FROM docs),
freq AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_split_to_array({_LOWER.format('text')}, '{_TERM}'))) AS term FROM docs) WHERE term <> '' GROUP BY term),
vec AS MATERIALIZED (SELECT tid, license, term, tf * ({_IDF}) AS wt FROM tpl CROSS JOIN size LEFT JOIN freq USING (term)),
pas AS (SELECT rid, 0 AS i, text AS p FROM docs UNION ALL SELECT rid, 1, unnest(string_split(text, chr(10))) FROM docs
        UNION ALL SELECT rid, 2, unnest(regexp_split_to_array(text, '\n[^A-Za-z0-9]*\n')) FROM docs),
words AS (SELECT pid, rid, i, unnest(regexp_split_to_array({_LOWER.format('p')}, '{_TERM}')) AS term FROM (SELECT *, row_number() OVER () AS pid FROM pas)),
held AS MATERIALIZED (SELECT pid, rid, i, term, count(*) * ({_IDF}) AS w FROM words CROSS JOIN size JOIN freq USING (term) WHERE term <> '' GROUP BY pid, rid, i, term, nd, df),
norms AS (SELECT pid, sqrt(sum(w * w)) AS norm FROM held GROUP BY pid),
sizes AS (SELECT tid, sqrt(sum(wt * wt)) AS tn FROM vec GROUP BY tid),
cos AS (SELECT pid, rid, i, tid, license, sum(w * wt) AS dot FROM held JOIN vec USING (term) GROUP BY ALL),
near AS (SELECT rid, i = 0 AS whole, license, round(dot / (norm * tn), 6) AS similarity FROM cos JOIN norms USING (pid) JOIN sizes USING (tid)),
own AS (SELECT rid, license, whole, similarity FROM near WHERE similarity >= {LEAST}
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY whole DESC, similarity DESC, license) = 1),
votes AS (SELECT folder, license FROM own JOIN docs USING (rid) WHERE whole GROUP BY folder, license
          QUALIFY row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, license DESC) = 1),
nearest AS (SELECT d.folder, v.license, v.folder AS ancestor FROM (SELECT DISTINCT folder FROM docs) d JOIN votes v ON d.folder = v.folder OR starts_with(d.folder, v.folder || '/')
            QUALIFY row_number() OVER (PARTITION BY d.folder ORDER BY length(v.folder) DESC) = 1)
SELECT doc_id, d.folder || '/' || file AS path, coalesce(o.license, v.license) AS license,
       CASE WHEN o.whole THEN 'file' WHEN o.license IS NOT NULL THEN 'header' WHEN v.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       similarity, CASE WHEN o.license IS NULL AND v.license IS NOT NULL THEN v.ancestor END AS inherited_from
FROM docs d LEFT JOIN own o USING (rid) LEFT JOIN nearest v ON v.folder = d.folder
"""
