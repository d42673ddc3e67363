"""License scans: usual forms, look-alikes, a dense model, SQL on the same rows, odd input."""

import math
import re
from collections import Counter

import duckdb
import pytest

from cohortline.llm import licenses
from cohortline.llm.license_templates import GENERIC, templates

WHOLE = {license: text for license, kind, text in templates() if kind == "text"}
HEADER = """/* Foo is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Foo is distributed in the hope that it will be useful.
 */
int main() { return 0; }"""
APACHE_HEADER = """# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.

import os"""
FORMS = [
    ("MIT License", "MIT"),
    ("The MIT License (MIT)", "MIT"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
    (WHOLE["MIT"].replace("MIT License\n", "").replace("<year> <copyright holders>", "2019 Jane Doe"), "MIT"),
    (WHOLE["BSD-3-Clause"].replace("Regents of the University of California", "Foo Project Authors"), "BSD-3-Clause"),
    (HEADER, "GPL-3.0"),
    (HEADER.replace("GNU General", "GNU Lesser General"), "LGPL-3.0"),
    (HEADER.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
    (APACHE_HEADER, "Apache-2.0"),
    ("All rights reserved.", "Proprietary"),
    ("Released under the MIT License. All rights reserved.", "MIT"),
    *((text, license) for license, text in WHOLE.items()),
]
OTHERS = [
    "SPDX-License-Identifier: WTFPL",
    "He studied at MIT and got a driving license.",
    "MIT",
    "The general public may use the park; no license is needed.",
    "Permission to park is granted, free of charge.",
    "The Apache helicopter flew over version 2 of the base.",
    "See the LICENSE file for details.",
    "This project needs version 3.0 of the tool.",
    "All seats are reserved.",
    None,
    "",
    " \n\t\n ",
    "word " * 50_000,
]


def _words(text):
    return re.findall(licenses.TERM, text.lower())


def _dense(texts):
    """The nearest template of every unit by full vectors, and of every text by its units."""
    held = Counter(term for t in texts for term in set(_words(t)))

    def vector(words):
        found = {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + held[w])) + 1) for w, n in Counter(words).items()}
        length = math.sqrt(sum(v * v for v in found.values()))
        return {w: v / length for w, v in found.items()}

    fixed = [(license, kind, vector(_words(text))) for license, kind, text in templates()]
    rank = {"text": 0, "notice": 1, "name": 2}
    for text in texts:
        units = [("name", s) for s in re.sub(licenses.SENTENCE_END, r"\1\n", text).split("\n") if len(_words(s)) > 1]
        units += [("notice", s) for s in re.split(licenses.BLANK_LINE, text)] + [("text", text)]
        found = []
        for of, unit in units:
            own = vector(_words(unit)) if _words(unit) else {}
            for license, kind, terms in fixed:
                told = all(t in own for t in terms if t not in GENERIC) if kind == "name" else True
                if told and (kind == of or (of == "text" and kind == "notice")):
                    cosine = round(sum(v * terms.get(w, 0) for w, v in own.items()), 9)
                    if cosine >= licenses.SIMILARITY:
                        found.append((license == "Proprietary", rank[kind], -cosine, license))
        yield min(found)[2:] if found else None


@pytest.fixture(scope="module")
def scanned(shipped):
    rows = [(i, f"folder-{i}/file.py", text, 1.0, "x") for i, text in enumerate([text for text, _ in FORMS] + OTHERS)]
    frame = shipped.createDataFrame(rows, "row long, path string, text string, n double, term string")
    return frame, {r["row"]: r for r in licenses.scan_licenses(frame).collect()}


def test_usual_forms_are_found(scanned):
    _, got = scanned
    assert [got[i]["license"] for i in range(len(FORMS))] == [license for _, license in FORMS]


def test_look_alikes_and_empty_texts_are_left_alone(scanned):
    _, got = scanned
    assert {got[len(FORMS) + i]["license"] for i in range(len(OTHERS))} == {None}


def test_scan_equals_dense_vectors(scanned):
    frame, got = scanned
    texts = [r["text"] or "" for r in frame.orderBy("row").collect()]
    for row, best in enumerate(_dense(texts)):
        if best is None:
            assert got[row]["license"] is None
        else:
            assert got[row]["license"] == best[1]
            assert got[row]["cosine"] == pytest.approx(-best[0], abs=1e-8)


def test_query_equals_sql_on_license_texts(shipped, tmp_path):
    rows = [(i, text, "en", "web" if i % 3 else "code", 0) for i, text in enumerate([text for text, _ in FORMS] + OTHERS)]
    shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = {tuple(r) for r in licenses.op6_license_scan(shipped, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = set(con.execute(licenses._sql()).fetchall())
    assert got == want


def test_licenses_pass_down_directories(shipped):
    files = [
        (1, "LICENSE", WHOLE["MIT"]),
        (2, "a/code.py", "x = 1"),
        (3, "a/b/COPYING", WHOLE["GPL-3.0"]),
        (4, "a/b/c/d.py", None),
        (5, "a/bc/d.py", ""),
        (6, None, "x = 2"),
        (6, None, "x = 2"),
        (7, "a/b/e.py", "# SPDX-License-Identifier: ISC\nx = 3"),
    ]
    frame = shipped.createDataFrame(files, "row long, path string, text string")
    got = [(r["row"], r["license"], r["effective"], r["inherited_from"]) for r in licenses.scan_licenses(frame).collect()]
    assert sorted(got) == [
        (1, "MIT", "MIT", None),
        (2, None, "MIT", ""),
        (3, "GPL-3.0", "GPL-3.0", None),
        (4, None, "GPL-3.0", "a/b"),
        (5, None, "MIT", ""),
        (6, None, "MIT", ""),
        (6, None, "MIT", ""),
        (7, "ISC", "ISC", None),
    ]
    assert licenses.scan_licenses(frame.limit(0)).collect() == []
