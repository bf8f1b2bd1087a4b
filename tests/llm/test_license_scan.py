"""Licence digests."""

import os

import duckdb

from tracewarden.llm import license_scan

MIT = next(t for name, t in license_scan.KNOWN if name == "MIT" and len(t) > 500)


def test_forms(spark):
    loud = "Copyright (c) 2020 Somebody\n\n# (C) 1999 Other\n" + MIT.upper().replace(" ", "  ").replace("SUBLICENSE", "sub-licence")
    docs = spark.createDataFrame([(1, MIT, "x"), (2, loud, "x"), (3, MIT + " more", "x"), (4, "text\n*** licensed UNDER the apache licence -- version 2.0 ***\nRELEASED under the MIT license", "x"), (5, None, "x"), (None, "", "x"), (1, "other", "x"), (1, MIT, "x")], "doc_id long, text string, license string")
    rows = license_scan.scan(docs).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.license, r.n_license_lines, r.line_licenses))
    assert sorted(by[1], key=str) == sorted([("MIT", 0, ""), ("MIT", 0, ""), (None, 0, "")], key=str)
    assert by[2] == [("MIT", 0, "")] and by[3] == [(None, 0, "")] and by[4] == [(None, 2, "Apache-2.0,MIT")]
    assert by[5] == by[None] == [(None, 0, "")]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_oracle(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    expected = sorted(con.execute(license_scan.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in license_scan.scan(spark.read.parquet(os.path.join(data_dir, "documents.parquet"))).collect())
    assert got == expected and any(r[3] for r in got)


def test_titled_and_wrapped_texts(spark):
    import textwrap

    isc = next(t for name, t in license_scan.KNOWN if name == "ISC")
    wrap = lambda t, n: "\n".join(textwrap.fill(p, n) for p in t.split("\n"))
    texts = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrap(MIT, 78)),
        ("MIT", "# The MIT License (MIT)\r\n\r\n© 2020 Somebody\r\nAll rights reserved.\r\n" + MIT),
        ("MIT", "(The MIT License)\n\nCopyright (c) 2020 Somebody\n\n" + MIT),
        ("ISC", "ISC License\n\nCopyright 2001-2020, Somebody\n\n" + isc.replace("the above copyright", "the above\ncopyright")),
        *(("ISC", wrap(isc, n)) for n in range(40, 100)),
        *(("MIT", wrap(MIT, n)) for n in range(40, 100)),
        (None, "MIT License"),
        (None, "All rights reserved"),
        (None, isc.replace("copyright notice and this", "notice and this")),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(docs).collect()} == {i: name for i, (name, _) in enumerate(texts)}


BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_texts(spark):
    head = "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n"
    texts = [("BSD-2-Clause", BSD_2 + BSD_END), ("BSD-3-Clause", head + BSD_2 + BSD_3 + BSD_END), (None, BSD_2)]
    folder, names = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    for file, name in names.items():  # where the system has the long texts
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}", encoding="utf-8") as f:
                texts.append((name, f.read()))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(docs).collect()} == {i: name for i, (name, _) in enumerate(texts)}


def test_adjacent_words_and_long_lines(spark):
    """Spellings next to each other, notices behind long decoration, and very long texts."""
    texts = ["licence licence licence", "license  LICENSE license", "per cent per cent", "percent percent", "*" * 5000 + " Released under the MIT License. " + "-" * 90_000, MIT + " x" * 200_000]
    docs = spark.createDataFrame([(i, t, "d", "k") for i, t in enumerate(texts)], "doc_id long, text string, digest string, known string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[0].digest == got[1].digest and got[2].digest == got[3].digest != got[0].digest
    assert got[4].n_license_lines == 1 and got[4].license == "MIT" and got[5].license is None
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, got.values())) == sorted(con.execute(license_scan.oracle_sql()).fetchall())


def test_whole_texts_in_changed_layout(spark):
    """Case, punctuation, copyright lines and spellings do not matter to whole texts; one more sentence does."""
    texts = [
        ("BSD-3-Clause", "Copyright 1999 A. Nobody.\nCopyright (c) 2001 B. Nobody\n" + (BSD_2 + BSD_3 + BSD_END).lower().replace(",", " ;").replace("1.", "*").replace("2.", "*").replace("\n3.", "\n*")),
        ("MIT", MIT.replace('"Software"', "''Software''").replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(" ", "\t ")),
        (None, MIT + "\nThe software may not be sold."),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    rows = license_scan.scan(docs).collect()
    assert {r.doc_id: r.license for r in rows if r.doc_id} == {i: name for i, (name, _) in enumerate(texts) if i}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, rows), key=str) == sorted(con.execute(license_scan.oracle_sql()).fetchall(), key=str)
