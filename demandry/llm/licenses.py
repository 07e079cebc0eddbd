"""Licence notices by sparse TF-IDF cosine to templates, and inheritance from the nearest directory with a licence file.

DataFrame functions only. The templates are fixed and few, so their inverse document frequencies and postings (of each
term the templates that have it, with its weight there) are literals of the plan, and a text is scored where it lies,
without a shuffle.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

#: SPDX ids and names of licences. Of each, its name, a line that grants it and its SPDX line are templates.
NAMES = {
    "0BSD": "BSD Zero Clause License",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "CC0 1.0 Universal Public Domain Dedication",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MIT-0": "MIT No Attribution License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "Unlicense": "Unlicense",
}
#: Licences whose SPDX ids say which versions are meant; of each, these ids are templates of their own.
VERSIONED, RANGES = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"), ("only", "or-later")
#: Notices and parts of texts of the licences.
EXCERPTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD license."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
)
#: Words that carry no weight. Names of licence files. What parts paragraphs, comment marks included.
STOP = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "do", "for", "from", "has", "if", "in", "into", "is", "it", "its", "may", "no", "not", "of", "on", "or", "out", "that", "the", "this", "to", "under", "was", "which", "with", "you", "your")
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
PARAGRAPH = r"\n[ \t\r*#/;-]*\n"

#: An SPDX expression of several licences: it is the answer where a text has one beside a notice.
EXPRESSION = r"(?i:SPDX-License-Identifier):[ \t]*([(]?[A-Za-z0-9.+-]+[)]?(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]?[A-Za-z0-9.+-]+[)]?)+)"

TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Cosine from which a line or paragraph is a notice; share of a text's words in such lines, or in paragraphs of the
#: cosine CLOSE, from which it is a licence file.
COSINE, CLOSE, FILE_SHARE = 0.6, 0.8, 0.8


def templates() -> list[tuple[str, str]]:
    """(licence, text): the names, granting lines and SPDX lines, and the excerpts."""
    ruled = [(k, text) for k, name in NAMES.items() for text in (name, f"Licensed under the {name}.", f"SPDX-License-Identifier: {k}")]
    ruled += [(f"{k}-{r}", f"SPDX-License-Identifier: {k}-{r}") for k in VERSIONED for r in RANGES]
    return [*ruled, *EXCERPTS]


def template_vectors() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """(idf, idf of an unknown term, unit vectors of the templates)."""
    bags = [(name, Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP)) for name, text in templates()]
    df = Counter(t for _, bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    rare = math.log(1 + len(bags)) + 1
    vectors = []
    for name, bag in bags:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        vectors.append((name, {t: n * idf[t] / norm for t, n in bag.items()}))
    return idf, rare, vectors


def needed_terms() -> list[str]:
    """Terms of which every text has one that comes to the cosine COSINE with any template.

    A text that shares only the terms S with a template has at most the cosine sqrt(sum of squared weights over S), so of
    each template the heaviest terms are taken until the rest falls short.
    """
    taken: set[str] = set()
    for _, vector in template_vectors()[2]:
        rest = sum(x * x for t, x in vector.items() if t not in taken)
        for t, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if rest < COSINE**2 - 1e-9:
                break
            if t not in taken:
                taken.add(t)
                rest -= x * x
    return sorted(taken)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def scores(units: Column) -> Column:
    """For each text of an array that may be a notice struct(best, words): best is struct(score, license) of the nearest
    template, words the number of the text's words.

    Left out is what can't come to COSINE: a text without a needed term, and one whose known terms weigh too little
    beside its number of different unknown ones, each of which adds to the norm.
    """
    idf, rare, vectors = template_vectors()
    postings: dict[str, list] = {}
    for k, (_, v) in enumerate(vectors):
        for t, x in v.items():
            postings.setdefault(t, []).append({"k": k, "x": x})
    entries = F.from_json(F.lit(json.dumps({t: {"idf": x, "at": postings[t]} for t, x in idf.items()})), "map<string,struct<idf:double,at:array<struct<k:int,x:double>>>>")
    names, known, needed = (F.array(*[F.lit(t) for t in ts]) for ts in ([n for n, _ in vectors], list(idf), needed_terms()))
    square = lambda x: x * x
    found = F.filter(F.transform(units, lambda x: F.struct(_terms(x).alias("t"), x.alias("x"))), lambda u: F.arrays_overlap(u["t"], needed))
    own = F.transform(found, lambda u: F.struct(F.filter(u["t"], lambda t: ~t.isin(*STOP)).alias("t"), u["x"].alias("x")))
    weighed = F.transform(
        own,
        lambda u: F.struct(
            u["t"].alias("t"),
            u["x"].alias("x"),
            F.transform(F.array_intersect(u["t"], known), lambda t: F.struct(t.alias("t"), F.size(F.filter(u["t"], lambda x: x == t)).cast("double").alias("n"), F.try_element_at(entries, t).alias("e"))).alias("k"),
            F.size(F.array_distinct(u["t"])).alias("d"),
        ),
    )
    weight = lambda u: _sum(F.transform(u["k"], lambda k: square(k["n"] * k["e"]["idf"])))
    fine = F.filter(weighed, lambda u: (1 - COSINE**2) * weight(u) >= (COSINE**2 - 1e-9) * (rare * rare) * (u["d"] - F.size(u["k"])))
    # The few that are left are scored in full.
    unknown = lambda u: F.transform(F.array_except(u["t"], known), lambda t: F.size(F.filter(u["t"], lambda x: x == t)).cast("double"))
    norm = lambda u: F.sqrt(weight(u) + _sum(F.transform(unknown(u), square)) * (rare * rare))
    shares = lambda u: F.flatten(F.transform(u["k"], lambda k: F.transform(k["e"]["at"], lambda p: F.struct(p["k"].alias("k"), (p["x"] * k["n"] * k["e"]["idf"]).alias("x")))))
    one = lambda u, k: _sum(F.transform(F.filter(u["s"], lambda s: s["k"] == k), lambda s: s["x"]))
    bound = F.transform(fine, lambda u: F.struct(shares(u).alias("s"), norm(u).alias("norm"), u["x"].alias("x")))
    best = lambda u: F.array_max(F.transform(F.array_distinct(F.transform(u["s"], lambda s: s["k"])), lambda k: F.struct(F.round(one(u, k) / u["norm"], 9).alias("score"), names[k].alias("license"))))
    return F.transform(bound, lambda u: F.struct(best(u).alias("best"), _words(u["x"]).alias("words")))


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)")))


def scan(docs: DataFrame, text_col: str = "text", path_col: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, path, license, score and is_file of each document, from all its lines and paragraphs."""
    needed = F.array(*[F.lit(t) for t in needed_terms()])
    notices = lambda units: F.filter(scores(units), lambda x: x["best"]["score"] >= COSINE)
    own = docs.select(*[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)], F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.coalesce(F.arrays_overlap(_terms(F.col(text_col)), needed), F.lit(False)).alias("marked"))
    own = own.withColumn("lines", F.when(F.col("marked"), notices(F.split("text", "\n")))).withColumn("paragraphs", F.when(F.col("marked"), notices(F.split("text", PARAGRAPH))))
    best = F.array_max(F.transform(F.concat("lines", "paragraphs"), lambda x: x["best"]))
    total = lambda c, least: F.aggregate(F.filter(c, lambda x: x["best"]["score"] >= least), F.lit(0), lambda a, x: a + x["words"])
    own = own.withColumn("best", best).withColumn("share", F.when(F.col("marked"), F.greatest(total("lines", COSINE), total("paragraphs", CLOSE)) >= FILE_SHARE * _words(F.col("text"))))
    several = F.regexp_replace(F.regexp_extract("text", EXPRESSION, 1), r"[ \t]+", " ")
    named = F.when(F.col("best").isNotNull() & (several != ""), several).otherwise(F.col("best.license"))
    is_file = F.col("best").isNotNull() & (F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False)) | F.coalesce("share", F.lit(False)))
    return own.select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)], "path", named.alias("license"), F.round("best.score", 6).alias("score"), is_file.alias("is_file"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(scanned: DataFrame, keep: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """keep columns, path, license, score, origin (header, file, inherited or none) and inherited_from.

    A document without a notice takes the licence of the nearest directory above it that holds a licence file (of
    several files the first path). Ancestors are joined by path for the distinct directories, not for the documents; the
    documents then join their own directory's answer.
    """
    files = scanned.where("is_file").groupBy(parent(F.col("path")).alias("__holder")).agg(F.min(F.struct("path", "license")).alias("__file"))
    folders = scanned.where(F.col("path").isNotNull()).select(parent(F.col("path")).alias("__folder")).distinct()
    parts = F.split("__folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = folders.select("__folder", F.explode(F.array_distinct(F.when(F.col("__folder") == "", F.array(F.lit(""))).otherwise(up))).alias("__holder"))
    nearest = above.join(files, "__holder").groupBy("__folder").agg(F.max(F.struct(F.length("__holder").alias("depth"), "__file")).alias("__near")).checkpoint()
    if nearest.count() <= broadcast_rows:
        nearest = F.broadcast(nearest)
    own = scanned.withColumn("__parent", parent(F.col("path"))).join(nearest, F.col("__parent") == F.col("__folder"), "left")
    declared, near = F.col("license").isNotNull(), F.col("__near.__file")
    origin = F.when(F.col("is_file"), "file").when(declared, "header").when(near.isNotNull(), "inherited").otherwise("none")
    return own.select(*keep, "path", F.coalesce("license", near["license"]).alias("license"), "score", origin.alias("origin"), F.when(~declared, near["path"]).alias("inherited_from"))


def license_scan(docs: DataFrame, text_col: str = "text", path_col: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: keep columns, path, license, score, origin, inherited_from.

    A notice is a line or a paragraph whose TF-IDF cosine to a template is at least COSINE; the best one decides (on equal
    scores the last licence name), but for an SPDX expression of several licences, which is taken as it is written. Only texts, lines and paragraphs are left out that can't come to that cosine. A licence file is a document with a notice that is named like one or
    consists of notices for FILE_SHARE of its words. Null and empty texts declare nothing but may inherit; a null path
    neither gives nor inherits; repeated rows stay; an empty table gives no rows; other columns of docs are not read.
    """
    return inherit(materialise(scan(docs, text_col, path_col, keep), "licenses"), keep)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents; the table has no paths, so source/lang/doc_id stands for one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return license_scan(docs.select("doc_id", "text", path.alias("path")), keep=("doc_id",))


def _op7_sql() -> str:
    idf, rare, vectors = template_vectors()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(t)}, {x!r})" for t, x in idf.items())
    cells = ", ".join(f"({k}, {quote(n)}, {quote(t)}, {x!r})" for k, (n, v) in enumerate(vectors) for t, x in v.items())
    return f"""
with idf(term, idf) as (values {known}), cell(k, license, term, x) as (values {cells}),
doc as (
  select row_number() over () as rid, doc_id, text,
    concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(cast(doc_id as varchar), '-')) as path from documents
), split as (
  select rid, true as whole, unnest(regexp_split_to_array(text, '{PARAGRAPH}')) as line from doc
  union all select rid, false, unnest(string_split(text, chr(10))) from doc
), line as (
  select row_number() over () as lid, rid, whole, line from split
), term as (
  select lid, unnest(regexp_extract_all(lower(line), '{TERM}')) as term from line
), tf as (
  select t.lid, t.term, i.idf, count(*) as n from term t left join idf i using (term)
  where t.term not in ({", ".join(map(quote, STOP))}) group by all
), norm as (
  select lid, sqrt(sum(case when idf is null then n * {rare * rare!r} else n * idf * n * idf end)) as norm from tf group by lid
), dot as (
  select tf.lid, c.k, c.license, sum(tf.n * tf.idf * c.x) as dot from tf join cell c on tf.term = c.term group by all
), best as (
  select d.lid, max(struct_pack(score := round(d.dot / n.norm, 9), license := d.license)) as best from dot d join norm n using (lid) group by d.lid
), notice as (
  select l.rid, l.whole, best, len(regexp_extract_all(l.line, '\\S+')) as words from best b join line l using (lid) where best.score >= {COSINE}
), per as (
  select rid, max(best) as best, greatest(coalesce(sum(words) filter (whole and best.score >= {CLOSE}), 0), coalesce(sum(words) filter (not whole), 0)) as words from notice group by rid
), scanned as (
  select d.doc_id, d.path, case when p.best is not null and coalesce(regexp_extract(d.text, '{EXPRESSION}', 1), '') <> '' then regexp_replace(regexp_extract(d.text, '{EXPRESSION}', 1), '[ \t]+', ' ', 'g') else p.best.license end as license, round(p.best.score, 6) as score,
    coalesce(p.words >= {FILE_SHARE} * len(regexp_extract_all(d.text, '\\S+')), false) as is_file,
    regexp_replace(d.path, '/?[^/]*$', '') as folder
  from doc d left join per p using (rid)
), holder as (
  select folder, min(struct_pack(path := path, license := license)) as file from scanned where is_file group by folder
), nearest as (
  select f.folder, arg_max(h.file, length(h.folder)) as file from (select distinct folder from scanned) f
  join holder h on f.folder = h.folder or h.folder = '' or starts_with(f.folder, h.folder || '/') group by f.folder
)
select s.doc_id, s.path, coalesce(s.license, n.file.license) as license, s.score,
  case when s.is_file then 'file' when s.license is not null then 'header' when n.file is not null then 'inherited' else 'none' end as origin,
  case when s.license is null then n.file.path end as inherited_from
from scanned s left join nearest n on s.folder = n.folder
"""


OP7_SQL = _op7_sql()
