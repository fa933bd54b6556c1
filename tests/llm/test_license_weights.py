"""A line keeps its licence however long the table is and however common its other words are."""

import pytest
from pyspark.sql import functions as F

from gaplens.llm import licenses

LINES = {
    1: ("Copyright Acme. All rights reserved.", "Proprietary"),
    2: ("Copyright 2019. All rights reserved.", "Proprietary"),
    3: ("Project released under the MIT License.", "MIT"),
    4: ("// SPDX-License-Identifier: MIT", "MIT"),
    5: ("SPDX-License-Identifier:GPL-3.0-or-later", "GPL-3.0"),
    6: ("SPDX-License-Identifier: ISC", "ISC"),
    7: ("Released under the EUPL License.", None),
    8: ("All rights reserved.", "Proprietary"),
    9: ("SPDX-License-Identifier: Fancy-1.0", None),
    10: ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0"),
    11: ("Mozilla Public License Version 2.0", "MPL-2.0"),
    12: ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    13: ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
}
#: Some frequent lines of the many.
KINDS = [
    "Copyright. All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Copyright and some other words.",
]
HEADER = """# Copyright 2020 Acme
# Licensed under the Apache License, Version 2.0 (the "License"); you may not
# use this file except in compliance with the License. You may obtain a copy of
# the License at http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software distributed
# under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
# CONDITIONS OF ANY KIND, either express or implied.

import os
"""


@pytest.mark.parametrize("n", [300, 200_000])
def test_licences_do_not_depend_on_the_number_of_lines(spark, n):
    kinds = KINDS
    many = spark.range(100, 100 + n).select(F.col("id").alias("doc_id"), F.array(*map(F.lit, kinds))[(F.col("id") % len(kinds)).cast("int")].alias("text"))
    docs = many.union(spark.createDataFrame([(i, t) for i, (t, _) in LINES.items()], many.schema))
    got = {r.row_id: r.own_license for r in licenses.own_licenses(docs).where("row_id < 100").collect()}
    assert got == {i: name for i, (_, name) in LINES.items() if name}


def test_common_words_weigh_little(spark):
    texts = ["Foobar Project released under the MIT License."] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r.own_score for r in licenses.own_licenses(docs).collect()}
    assert len(scores) == 1 and scores.pop() > 0.8


def test_header_blocks_are_held_against_whole_texts(spark):
    docs = spark.createDataFrame([(1, HEADER), (2, "plain words\n\nmore plain words"), (3, None)], "doc_id long, text string")
    units = [r.words for r in licenses.candidates(docs, "doc_id", "text").collect()]
    assert any(u.count("\n") == 6 for u in units)
    got = licenses.own_licenses(docs).collect()
    assert [(r.row_id, r.own_license) for r in got] == [(1, "Apache-2.0")] and got[0].own_score > 0.8


def test_real_paths_inherit(spark):
    rows = [(1, "MIT License", "/src/LICENSE"), (2, "x", "/src/a/b/c.py"), (3, "x", "/other/d.py"), (4, "SPDX-License-Identifier: ISC", "/src/e.py"), (5, "Mozilla Public License Version 2.0", "/src/a/COPYING"), (6, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("MIT", "/src"), 2: ("MPL-2.0", "/src/a"), 3: (None, None), 4: ("ISC", "/src"), 5: ("MPL-2.0", "/src/a"), 6: (None, None)}
