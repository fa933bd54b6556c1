"""License scans: TF-IDF cosine to templates, then nearest-ancestor inheritance (operator 9).

Every line of every text that names a licence is a candidate, and so is every header block:
the run of lines without an empty line between them that holds such a line. The terms of
a candidate are weighted
(1 + ln tf) * idf, idf = 1 - ln(max(share, RARE)), with the share of candidates that hold
the term counted for every term, and held against TEMPLATES by cosine. Shares and not
counts make a candidate's cosine the same in a small and a large table: terms in less than
RARE of the candidates weigh alike. The dot products are sparse: a term meets the
templates that have it. An SPDX tag is one term with the id after it; a document's own licence is that of its best candidate at
`least` or above. A file called LICENSE, LICENCE, COPYING or NOTICE gives its licence
to its directory, and a document without its own takes that of the nearest ancestor
directory. Only DataFrame functions: terms are pre-aggregated per candidate, templates are a
parameter and join by broadcast, and directories are made distinct before the path join.

Defined results: null and empty texts have no licence of their own; rows of one id
share their best candidate; equal cosines take the least licence name; a null path inherits
nothing; several licence files in a directory give the one of highest score, then least name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaplens.llm.common import saved, small

# Names, notices and texts of public licences, and the ids of SPDX tags.
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD_CLAUSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", _TWO_CLAUSES + _AS_IS),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", _TWO_CLAUSES + _THIRD_CLAUSE + _AS_IS),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License, CC BY-SA 4.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal public domain dedication"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License, version 3."),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}") for x in sorted({name for name, _ in TEMPLATES} - {"Proprietary"})]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}-{end}") for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for end in ("only", "or-later")]
CANDIDATE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|all rights reserved"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"
TERM = r"(?:spdx-license-identifier:\s*)?[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.6
RARE = 0.005


def _template_terms(templates: list[tuple[str, str]]) -> list[Counter]:
    return [Counter(re.sub(r":\s*", ":", t) for t in re.findall(TERM, text.lower())) for _, text in templates]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, unit, words): the lines that name a licence, and the blocks of two lines or more that hold one. Equal ones of a row count once."""
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, r"\n[ \t\r\f\x0B]*\n\s*"), lambda b: b.contains("\n"))
    units = F.array_distinct(F.filter(F.concat(lines, blocks), lambda u: u.rlike(CANDIDATE)))
    rows = docs.where(text.rlike(CANDIDATE)).where(F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).alias("row_id"), F.explode(units).alias("words")).withColumn("unit", F.md5("words")).distinct()


def own_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(row_id, own_license, own_score) of the documents with a licence of their own."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    unit = ["row_id", "unit"]
    words = F.regexp_extract_all(F.lower("words"), F.lit(TERM), F.lit(0))
    terms = candidates(docs, id_col, text_col).select(*unit, F.explode(words).alias("term")).withColumn("term", F.regexp_replace("term", r":\s*", ":"))
    tf = saved(terms.groupBy(*unit, "term").agg(F.count("*").alias("tf")))
    counted = _template_terms(templates)
    vocabulary = sorted(set().union(*counted))
    n = tf.select(*unit).distinct().count()
    counts = saved(tf.groupBy("term").agg(F.count("*").alias("df")))
    seen = {r["term"]: r["df"] for r in counts.where(F.col("term").isin(vocabulary)).collect()}  # at most the templates' terms
    idf = {t: 1 - math.log(max(RARE, seen.get(t, 0) / max(1, n))) for t in vocabulary}
    rows = []
    for i, terms_of in enumerate(counted):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in sorted(terms_of.items())}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(t, i, x / norm) for t, x in w.items()]
    table = spark.createDataFrame(rows, "term string, template int, t double")
    share = F.col("df") / F.lit(float(max(1, n)))
    idfs = counts.select("term", (1 - F.log(F.greatest(F.lit(RARE), share))).alias("idf"))
    weighed = saved(tf.join(small(idfs, 64), "term").select(*unit, "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(table), "term").groupBy(*unit, "template").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))  # a parameter's terms
    names = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), F.col("template") + 1)
    scored = dots.join(norms, unit).select("row_id", F.struct((-F.round(F.col("dot") / F.col("norm"), 6)).alias("s"), names.alias("name")).alias("b"))
    best = scored.groupBy("row_id").agg(F.min("b").alias("b"))
    return best.select("row_id", F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("own_score")).where(F.col("own_score") >= least)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """id, path, own_license, own_score, inherited_license, inherited_from and license of every row of docs."""
    own = saved(own_licenses(docs, id_col, text_col, templates, least))
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    files = docs.select(F.col(id_col).alias("row_id"), F.col(path_col).cast("string").alias("path"))
    files = files.join(small(own, 64), "row_id", "left").withColumn("dir", folder).withColumn("is_file", F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)))
    given = files.where("is_file and own_license is not null").groupBy(F.col("dir").alias("inherited_from")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license"))["own_license"].alias("inherited_license"))
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("inherited_from")
    dirs = files.where("dir is not null").select("dir").distinct().select("dir", above).distinct()
    nearest = dirs.join(small(given, 100), "inherited_from").groupBy("dir").agg(F.max_by(F.struct("inherited_license", "inherited_from"), F.length("inherited_from")).alias("up"))
    out = files.join(small(nearest, 150), "dir", "left")
    return out.select(F.col("row_id").alias(id_col), "path", "own_license", "own_score", F.col("up.inherited_license").alias("inherited_license"), F.col("up.inherited_from").alias("inherited_from"), F.coalesce("own_license", "up.inherited_license").alias("license"))
