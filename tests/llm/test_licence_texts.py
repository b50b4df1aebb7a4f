"""Licences of texts that are written out here, with what a reader says they are."""

import pytest

from attesta.llm import licences

BSD = """Copyright (c) 2020, Example Corp.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of Example Corp. & Sons nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
TEXTS = {
    BSD.replace("1. ", "* ").replace("2. ", "* ") + ENDORSE.replace("3. ", "* ").replace("Corp. & Sons", "Corp"): "BSD-3-Clause",
    BSD.replace("1. ", "* ").replace("2. ", "* "): "BSD-2-Clause",
    " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/.\n": "MPL-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n": "GPL-3.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989": "GPL-2.0",
    "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n": "LGPL-2.1",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "Apache-2.0",
    "Mozilla Public License Version 2.0\n==================================\n": "MPL-2.0",
    "Creative Commons Attribution 4.0 International Public License": "CC-BY-4.0",
    "The plugin is licensed under the MIT License and was written by us.": "MIT",
    "Our tool is licensed under the MIT Licence.": "MIT",
    "The plugin is not licensed under the MIT License.": "",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": "",
    "We talked about the GNU General Public License, version 3, for hours.": "",
}


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_licence_of_a_text(spark, text):
    assert licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licences == TEXTS[text]


def test_no_sentence_of_the_table_is_out_of_reach(spark):
    """Each one, with a name in its slots, alone and between other lines, gives its identifier."""
    rows = [(k, s) for k, many in licences.SENTENCES.items() for s in many]
    texts = [(i, f"Before.\n\n{s.replace('<name>', 'some thing')}.\nAfter") for i, (_, s) in enumerate(rows)]
    got = {r.doc_id: r.sentence_ids for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (k, _) in enumerate(rows):
        assert k in got[i].split(","), rows[i]


def test_sql_reads_wrapped_lines_as_the_operator_does(spark, tmp_path):
    import duckdb

    odd = [*TEXTS, *(t.replace(" ", "\n") for t in TEXTS), *(t.replace("\n", "\r\n // ") for t in TEXTS), "", None, "\n\n\n", "MIT License\rMIT License"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(licences.scan_sql()).fetchall()}
    assert {r.doc_id: (r.sentence_ids, r.n_sentences, r.licences) for r in licences.scan(df).collect()} == want
