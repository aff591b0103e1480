"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

A file has two kinds of units. Every line is compared with one-line notices. Runs are compared
with headers, whole licences and the beginnings of long ones: a line is of a run if half of its
distinct terms or more are words of these templates; lines without terms (blank, or of comment
signs only) don't end a run, and code, names or prose do. Of a run all its prefixes of 1, 2, 4, 8 ...
lines and the run itself are units, so a notice is found wherever it stands and whatever follows
it; where other words of licences stand right before it in the same run, it is weighed with them.
Wrapped lines and other layout don't count: a unit is a bag of terms.

A unit whose cosine with a template is ``LEAST`` or more declares its licence, and the best unit
(then the first template) is the file's own. Terms are lower-cased runs of letters, digits, dots
and hyphens; weights are term count times ln((1 + N) / (1 + df)) + 1, with df over all N files; a
term that no template has counts in the unit's length with df 0. Units without any of the terms
that a match needs are not weighed: by Cauchy-Schwarz, what is left of a template without them is
too short, and they are its rarest ones. Neither a name nor a place in the file is needed.

A file that declares no licence itself takes it from the licence files of the nearest directory
above it: files named like LICENSE or COPYING that declare one, files that are a licence text for
``WHOLE_PERCENT`` of their terms, and files that begin as a long licence does. A header or a notice
licenses its own file only. Of several in a directory the one with the smallest path counts.
Ancestors are joined for each distinct directory, not for each file; then files meet their
directory in a join that Spark can split where a directory has a third of all files.

Only DataFrame functions are used; what is collected are the frequencies of the templates'
terms, of which there is a fixed number. The lines of one file are ordered in one task. Null texts
and empty files declare nothing. A null path is in no directory. Repeated rows stay. Extra columns
stay, whatever their names, but for the text's; what is found is one column, whose name must be new.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.batches import forget, text_or_empty, written

LEAST = 0.6
#: Kinds of templates; a template of one line is compared with lines, any other with runs of lines.
LINE, HEADER, BEGINNING, WHOLE = "line", "header", "beginning", "whole"
RUN = "run"
WHOLE_PERCENT = 80
#: Notices by which works name their licence, headers, and the texts of short licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_HEADER = """This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {n} of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
_GNU_OPENING = """{name} Version {n}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but
changing it is not allowed. Preamble"""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
#: (licence, kind of unit, text); the order breaks ties.
TEMPLATES = (
    ("MIT", LINE, "Released under the MIT License"),
    ("MIT", LINE, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", LINE, "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", LINE, "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", LINE, "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", LINE, "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD", LINE, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", LINE, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", LINE, "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", LINE, "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", LINE, "Licensed under CC BY-NC 4.0"),
    ("Apache-2.0", HEADER, _APACHE_HEADER),
    ("Apache-2.0", BEGINNING, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("GPL-2.0", HEADER, _GNU_HEADER.format(name="GNU General Public License", n=2)),
    ("GPL-3.0", HEADER, _GNU_HEADER.format(name="GNU General Public License", n=3)),
    ("LGPL-3.0", HEADER, _GNU_HEADER.format(name="GNU Lesser General Public License", n=3)),
    ("AGPL-3.0", HEADER, _GNU_HEADER.format(name="GNU Affero General Public License", n=3)),
    ("GPL-2.0", BEGINNING, _GNU_OPENING.format(name="GNU GENERAL PUBLIC LICENSE", n=2, date="June 1991", years="1989, 1991")),
    ("GPL-3.0", BEGINNING, _GNU_OPENING.format(name="GNU GENERAL PUBLIC LICENSE", n=3, date="29 June 2007", years="2007")),
    ("MPL-2.0", HEADER, _MPL_HEADER),
    ("MIT", WHOLE, f"MIT License {_MIT}"),
    ("ISC", WHOLE, f"ISC License {_ISC}"),
    ("BSD-2-Clause", WHOLE, f"BSD 2-Clause License {_BSD_TERMS} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", WHOLE, f"BSD 3-Clause License {_BSD_TERMS} {_BSD_NAME} {_BSD_DISCLAIMER}"),
    ("Zlib", WHOLE, f"zlib License {_ZLIB}"),
    ("Unlicense", WHOLE, _UNLICENSE),
)
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
TERM = r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]"


def python_terms(text: str) -> list[str]:
    import re

    return re.findall(TERM, text.lower())


def terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def weights(files: DataFrame, templates=TEMPLATES, text: str = "text") -> tuple[dict[str, float], float]:
    """idf of every template term over all files, and of a term that no file has."""
    vocabulary = sorted({t for _, _, notice in templates for t in python_terms(notice)})
    found = files.select(F.array_intersect(terms(text_or_empty(text)), F.array(*map(F.lit, vocabulary))).alias("v"))
    counted = found.select(F.explode(F.concat(F.col("v"), F.array(F.lit("")))).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counted.collect()}
    n = df.get("", 0)
    idf = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {t: idf(df.get(t, 0)) for t in vocabulary}, idf(0)


def vectors(idf: dict[str, float], templates=TEMPLATES) -> list[tuple[str, dict[str, float], float]]:
    """(kind, weights by term, length) of each template."""
    out = []
    for _, kind, notice in templates:
        own: dict[str, float] = {}
        for t in python_terms(notice):
            own[t] = own.get(t, 0.0) + idf[t]
        out.append((kind, own, math.sqrt(sum(x * x for x in own.values()))))
    return out


def needed(templates: list, idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a unit that matches any of the templates must have one: of each, the most common terms are left out as long as what is left out is too short for a match."""
    out: set[str] = set()
    for _, own, length in templates:
        rest = 0.0
        for term in sorted(own, key=lambda t: (idf[t], t)):
            if rest >= 0 and math.sqrt(rest + own[term] ** 2) / length < least - 1e-8:
                rest += own[term] ** 2
            else:
                rest = -1.0
                out.add(term)
    return sorted(out)


def small_table(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A table of constants of the planner's own: no rows are sent, and no plan has an expression for each value."""
    value = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(value, row)) + ")" for row in rows) + f" AS t({', '.join(names)})")


def keyed(files: DataFrame, text: str, key: str = "_key", path: str = "path") -> DataFrame:
    """``files`` with a key of path and content; rows that repeat both share it."""
    return files.withColumn(key, F.unhex(F.substring(F.sha2(F.concat_ws("\x00", F.coalesce(path, F.lit("")), text_or_empty(text)), 256), 1, 32)))  # 16 bytes


def lines_of(files: DataFrame) -> DataFrame:
    """_key, place (from 0) and terms of every line of files(_key, content)."""
    return files.select("_key", F.posexplode(F.split("content", "\n", -1)).alias("place", "line")).select("_key", "place", terms(F.col("line")).alias("terms"))


def runs_of(lines: DataFrame, legal: list[str]) -> DataFrame:
    """_key, start (from 1), size and terms of the units that runs of lines(_key, place, terms) make, a row for each line of each."""
    known = F.array(*map(F.lit, legal))
    some = lines.where(F.size("terms") > 0).withColumn("k", F.row_number().over(Window.partitionBy("_key").orderBy("place")))
    some = some.where(2 * F.size(F.array_intersect("terms", known)) >= F.size(F.array_distinct("terms")))
    some = some.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("_key").orderBy("k")))
    run = Window.partitionBy("_key", "run")
    placed = some.withColumns({"r": F.row_number().over(run.orderBy("k")).cast("long"), "m": F.count("*").over(run), "start": F.min("k").over(run).cast("long")})
    sizes = F.expr("concat(filter(transform(sequence(0, 40), j -> shiftleft(1L, j)), s -> s >= r AND s < m), array(m))")
    return placed.select("_key", "start", "terms", F.explode(sizes).alias("size"))


def units(files: DataFrame, must: dict[str, list[str]], legal: list[str]) -> DataFrame:
    """_key, kind, start, size, term and n: how often each term is in each unit of files(_key, content) that may match a template."""
    every = lines_of(files)
    has = lambda kind: F.arrays_overlap("terms", F.array(*map(F.lit, must[kind])))
    lines = every.where(has(LINE)).select("_key", F.lit(LINE).alias("kind"), F.col("place").cast("long").alias("start"), F.lit(1).cast("long").alias("size"), "terms")
    runs = runs_of(every, legal).select("_key", F.lit(RUN).alias("kind"), "start", "size", "terms")
    each = lines.unionByName(runs).select("_key", "kind", "start", "size", F.explode("terms").alias("term"))
    return each.groupBy("_key", "kind", "start", "size", "term").agg(F.count("*").alias("n"))


def declared(files: DataFrame, templates=TEMPLATES, least: float = LEAST, text: str = "text", path: str = "path") -> DataFrame:
    """_key, path, license, score and gives (whether its best unit makes it a licence file), of each file that declares a licence; written."""
    spark = files.sparkSession
    idf, unknown = weights(files, templates, text)
    own = vectors(idf, templates)
    unit_kind = lambda kind: LINE if kind == LINE else RUN
    terms_of = small_table(spark, ("term", "idf"), list(idf.items()))
    parts = small_table(spark, ("which", "kind", "term", "y", "length"), [(i, unit_kind(kind), t, x, n) for i, (kind, v, n) in enumerate(own) for t, x in v.items()])
    must = {kind: needed([v for v in own if unit_kind(v[0]) == kind], idf, least) for kind in (LINE, RUN)}
    legal = sorted({t for kind, v, _ in own if kind != LINE for t in v})

    content = text_or_empty(text)
    some = keyed(files, text, path=path).select("_key", F.col(path).alias("path"), content.alias("content"), terms(content).alias("terms"))
    some = some.where(F.arrays_overlap("terms", F.array(*map(F.lit, sorted({*must[LINE], *must[RUN]})))))
    some = written(some.select("_key", "path", "content", F.size("terms").alias("n_terms")).dropDuplicates(["_key"]), "candidates")
    weighed = units(some, must, legal).join(F.broadcast(terms_of), "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    weighed = written(weighed, "units")
    unit = ["_key", "kind", "start", "size"]
    norms = weighed.groupBy(*unit).agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.sum("n").alias("n"))
    dots = weighed.join(F.broadcast(parts), ["kind", "term"]).groupBy(*unit, "which", "length").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scores = dots.join(norms, unit).withColumn("score", F.round(F.col("dot") / F.sqrt("square") / F.col("length"), 9)).where(F.col("score") >= least)
    template = lambda values: F.array(*map(F.lit, values))[F.col("which")]
    kinds = template([kind for _, kind, _ in templates])
    judged = scores.join(some.select("_key", "path", "n_terms"), "_key")
    gives = ((kinds == WHOLE) & (F.col("n") * 100 >= F.col("n_terms") * WHOLE_PERCENT)) | ((kinds == BEGINNING) & (F.col("start") == 1))
    best = judged.groupBy("_key", "path").agg(F.max(F.struct("score", (-F.col("which")).alias("which"), gives.alias("gives"))).alias("best"))
    found = written(best.select("_key", "path", F.array(*[F.lit(name) for name, _, _ in templates])[-F.col("best.which")].alias("license"), "best.score", "best.gives"), "licenses")
    forget(some, weighed)
    return found


def directory(path):
    """The path without its last part; null if there is none."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def new_name(name: str, taken: list[str]) -> str:
    """A column's name that nobody has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST, text: str = "text", path: str = "path", out: str = "found") -> DataFrame:
    """Every column of ``files`` but the text, and ``out``: own_license, own_score, license and inherited_from (a path)."""
    if out.lower() in {c.lower() for c in files.columns}:
        raise ValueError(f"there is a column {out} already: give another name as out")
    own = declared(files, templates, least, text, path)
    key, folder = (new_name(f"_corvane_{x}", files.columns) for x in ("key", "dir"))
    slim = keyed(files, text, key, path).withColumn(folder, directory(F.col(path))).drop(text)
    givers = own.where(F.col("gives") | F.col("path").rlike(LICENCE_FILE)).where(F.col("path").contains("/"))
    givers = givers.groupBy(directory(F.col("path")).alias("above")).agg(F.min(F.struct("path", "license")).alias("giver"))
    dirs = slim.select(F.col(folder).alias("dir")).where("dir IS NOT NULL").distinct()
    names = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(names, 1, n), "/").alias("above")))).alias("a"))
    near = ancestors.select("dir", "a.depth", "a.above").join(givers, "above").groupBy("dir").agg(F.max(F.struct("depth", "giver")).alias("nearest"))
    # under names of their own, so that no column of the caller's is meant
    left = slim.select(F.struct(*[F.col(f"`{c}`") for c in files.columns if c != text]).alias("row"), F.col(key).alias("key"), F.col(folder).alias("at"))
    mine = own.select(F.col("_key").alias("own_key"), "license", "score")
    near = near.select(F.concat("dir", F.lit("")).alias("near_dir"), F.col("nearest.giver").alias("giver"))  # dealt anew
    both = left.join(mine.hint("merge"), F.col("key") == F.col("own_key"), "left").join(near.hint("merge"), F.col("at") == F.col("near_dir"), "left")
    inherited = F.when(F.col("license").isNull(), F.col("giver.path"))
    result = F.struct(F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "giver.license").alias("license"), inherited.alias("inherited_from"))
    return both.select("row.*", result.alias(out))
