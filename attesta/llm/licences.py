"""Licence scan by sentence rules, native DataFrame expressions throughout.

A text is normalised, and those sentences that licence texts and notices are made of are looked for in it and mapped to
identifiers: from the start of a line or sentence to the end of one, on one line or wrapped over several with or without
comment marks, but not across a blank line, the end of a sentence or a colon that ends a line. Ordered rules then look
for sequences of identifiers, longest and most telling first; what a rule has matched is used up, so that a shorter rule
can't report a part of it again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import pick

#: Sentences of public licence texts and notices, normalised, by identifier; <name> is up to 120 characters of a line.
SENTENCES = {
    "mit-short": ["<name> is licensed under the mit license", "<name> is licensed under the mit license and <name>", "<name> is released under the mit license", "<name> is distributed under the mit license", "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "the software is provided as is"],
    "liability": ["in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"],
    "isc-grant": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-head": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-endorse-any": ["neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the names of <name> nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of <name> may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-short": ["licensed under the bsd license", "use of this source code is governed by a bsd-style license that can be found in the license file"],
    "apache-grant": ["licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license", "licensed under the apache license, version 2.0 (the license)"],
    "apache-copy": ["you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0", "you may obtain a copy of the license at"],
    "apache-asis": ["unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "apache-title": ["apache license version 2.0, january 2004"],
    "apache-short": ["<name> is licensed under the apache license, version 2.0", "<name> is released under the apache license, version 2.0", "licensed under the apache license, version 2.0", "licensed under the apache license 2.0", "released under the apache license, version 2.0"],
    "gpl3-title": ["gnu general public license version 3, 29 june 2007"],
    "gpl3-preamble": ["the gnu general public license is a free, copyleft license for software and other kinds of works"],
    "gpl2-title": ["gnu general public license version 2, june 1991"],
    "lgpl21-title": ["gnu lesser general public license version 2.1, february 1999"],
    "lgpl3-title": ["gnu lesser general public license version 3, 29 june 2007"],
    "agpl3-title": ["gnu affero general public license version 3, 19 november 2007"],
    "gnu-verbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "mpl2-title": ["mozilla public license version 2.0", "mozilla public license, version 2.0"],
    "cc-by-title": ["creative commons attribution 4.0 international public license"],
    "cc-by-sa-title": ["creative commons attribution-sharealike 4.0 international public license"],
    "cc-by-nc-title": ["creative commons attribution-noncommercial 4.0 international public license"],
    "cc0-title": ["cc0 1.0 universal"],
    "epl2-title": ["eclipse public license - v 2.0"],
    "gpl3-short": ["<name> is licensed under the gnu general public license, version 3", "this work is licensed under the gnu general public license, version 3", "licensed under the gnu general public license, version 3", "licensed under the gnu general public license version 3"],
    "gpl2-short": ["<name> is licensed under the gnu general public license, version 2", "this work is licensed under the gnu general public license, version 2", "licensed under the gnu general public license, version 2", "licensed under the gnu general public license version 2"],
    "gpl-grant": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "gpl2-grant": ["this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "lgpl-short": ["licensed under the gnu lesser general public license, version 3", "licensed under the gnu lesser general public license, version 2.1"],
    "agpl-short": ["licensed under the gnu affero general public license, version 3"],
    "mpl-head": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/", "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc0": ["released under cc0 1.0", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "0bsd-grant": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "0bsd-asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsl-grant": ["permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following:"],
    "bsl-short": ["distributed under the boost software license, version 1.0"],
    "zlib-asis": ["this software is provided as-is, without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsd-4-ad": ["all advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "lgpl21-grant": ["this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version"],
    "lgpl3-grant": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "agpl-grant": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "lgpl-see": ["see the gnu lesser general public license for more details"],
    "agpl-see": ["see the gnu affero general public license for more details"],
    "epl2-head": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "cddl-head": ["the contents of this file are subject to the terms of the common development and distribution license (the license)", "the contents of this file are subject to the terms of the common development and distribution license"],
    "ofl-head": ["this font software is licensed under the sil open font license, version 1.1"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "eupl-short": ["licensed under the eupl, version 1.2 or - as soon they will be approved by the european commission - subsequent versions of the eupl", "licensed under the eupl-1.2"],
    "artistic2": ["this program is free software; you can redistribute it and/or modify it under the terms of the artistic license 2.0", "you can redistribute it and/or modify it under the terms of the artistic license (2.0)"],
    "cc-by-nd": ["licensed under cc by-nd 4.0", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "cc-by-nc-sa": ["licensed under cc by-nc-sa 4.0", "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license"],
    "cc-by-nc-nd": ["licensed under cc by-nc-nd 4.0", "this work is licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license"],
    "spdx-mit": ["spdx-license-identifier: mit"],
    "spdx-apache": ["spdx-license-identifier: apache-2.0"],
    "spdx-bsd2": ["spdx-license-identifier: bsd-2-clause"],
    "spdx-bsd3": ["spdx-license-identifier: bsd-3-clause"],
    "spdx-isc": ["spdx-license-identifier: isc"],
    "spdx-gpl2": ["spdx-license-identifier: gpl-2.0-only", "spdx-license-identifier: gpl-2.0"],
    "spdx-gpl2-later": ["spdx-license-identifier: gpl-2.0-or-later", "spdx-license-identifier: gpl-2.0+"],
    "spdx-gpl3": ["spdx-license-identifier: gpl-3.0-only", "spdx-license-identifier: gpl-3.0"],
    "spdx-gpl3-later": ["spdx-license-identifier: gpl-3.0-or-later", "spdx-license-identifier: gpl-3.0+"],
    "spdx-lgpl21-later": ["spdx-license-identifier: lgpl-2.1-or-later", "spdx-license-identifier: lgpl-2.1+"],
    "spdx-mpl2": ["spdx-license-identifier: mpl-2.0"],
}

#: Licences by sequences of sentence identifiers, in the order they are tried.
RULES = [
    ("BSD-4-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-4-ad"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse-any"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl3-title", "gnu-verbatim"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-3.0", ["gpl3-preamble"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("Apache-2.0", ["apache-title"]),
    ("CC-BY-4.0", ["cc-by-title"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-title"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "0bsd-asis"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSL-1.0", ["bsl-short"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("AGPL-3.0-or-later", ["agpl-grant"]),
    ("EPL-2.0", ["epl2-head"]),
    ("CDDL", ["cddl-head"]),
    ("OFL-1.1", ["ofl-head"]),
    ("WTFPL", ["wtfpl"]),
    ("EUPL-1.2", ["eupl-short"]),
    ("Artistic-2.0", ["artistic2"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("BSD-2-Clause", ["spdx-bsd2"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("ISC", ["spdx-isc"]),
    ("GPL-2.0", ["spdx-gpl2"]),
    ("GPL-2.0-or-later", ["spdx-gpl2-later"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-3.0-or-later", ["spdx-gpl3-later"]),
    ("LGPL-2.1-or-later", ["spdx-lgpl21-later"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("LGPL", ["lgpl-short"]),
    ("AGPL-3.0", ["agpl-short"]),
    ("MPL-2.0", ["mpl-head", "mpl-copy"]),
    ("MPL-2.0", ["mpl-head"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("BSD", ["bsd-short"]),
]

ENDS, EDGES, QUOTES = r"[.!?][\x20\x09-\x0D]+", r"^[\x20\x09-\x0D#*/;.,!?-]+|[\x20\x09-\x0D*/;.,!?-]+$", "[\"'`]"
#: How lines become comparable after the sentences' ends are marked by \r. Nothing here takes more than linear time.
LINES = [(QUOTES, ""), (r"[\x20\x09\x0B\x0C]+", " "), (r" ?(?:\*/?|//)? ?\n[ #*/;-]*+", "\n"), (r"\n\n+", "\r"), (r": ?\n", ":\r"), ("licence", "license")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


SLOT, NAME = "<name>", r"[^\n\r]{1,120}?"
#: What stands for a blank between two words, and for the mark of a sentence's end: in the text as it is, and in one where
#: these marks are doubled for engines that can't look ahead.
ONCE, TWICE = (r"[ \n]", r"\r"), (r"(?: |\n\n)", r"\r\r")


def key_of(sentence: str) -> str:
    """A known sentence as the normalised text has it: ends within it marked (as after `v.`), edges stripped."""
    return re.sub(EDGES, "", re.sub(ENDS, "\r", sentence))


def pattern_of(sentence: str, blank: str, end: str) -> str:
    literal = lambda x: re.escape(x).replace(r"\ ", " ").replace("\\\r", "\r").replace(" ", blank).replace("\r", end)
    return NAME.join(literal(part) for part in key_of(sentence).split(SLOT))


def known_of(sentences: dict[str, list[str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(sentence, identifier) without names in them and with, the longest first."""
    every = sorted(((s, k) for k, many in sentences.items() for s in many), key=lambda x: -len(x[0]))
    return [x for x in every if SLOT not in x[0]], [x for x in every if SLOT in x[0]]


def identifier_of(sentence: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """The identifier of a sentence as it was found, line ends turned to blanks."""
    whole, named = known_of(sentences)
    exact = F.try_element_at(F.create_map(*(F.lit(x) for s, k in whole for x in (key_of(s), k))), sentence) if whole else F.lit(None).cast("string")
    return F.coalesce(exact, *(F.when(sentence.rlike(f"^{pattern_of(s, ' ', chr(13))}$"), k) for s, k in named))


def wanted(sentences: dict[str, list[str]] = SENTENCES) -> str:
    """Finds known sentences in normalised text, the longest that ends where a line or sentence does; those that name
    something of their own come after all others."""
    whole, named = known_of(sentences)
    known = "|".join(pattern_of(s, *ONCE) for s, _ in whole + named)
    return rf"(?:^|[\n\r])[ #*/;.,!?-]*+({known})(?=[ */;.,!?-]*+(?:[\n\r]|\z))"


def sentence_identifiers(text: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """The identifiers of the text's known sentences, in order."""
    clean = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"\r\n?", "\n")
    for pattern, by in [(ENDS, "\r"), *LINES]:
        clean = F.regexp_replace(clean, pattern, by)
    return F.filter(F.transform(F.regexp_extract_all(clean, F.lit(wanted(sentences)), F.lit(1)), lambda s: identifier_of(F.translate(s, "\n", " "), sentences)), lambda k: k.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """One row per row of docs: doc_id, sentence_ids (in order, comma-separated), n_sentences, licences (in rule order).

    A text without licence sentences, an empty and a null one have empty strings. A licence is reported once however
    often its rules match. Other tables of sentences (normalised, by identifier) and of ordered rules may be given. Repeated rows get equal results. Other columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), sentence_identifiers(F.col("text"), sentences).alias("ids"))
    out = rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"))
    # Each identifier stands between bars of its own, so that neighbours can be used up one after the other.
    out = out.withColumn("rest", F.concat(F.lit("|"), F.replace("sentence_ids", F.lit(","), F.lit("||")), F.lit("|")))
    hits = []
    for i, (_, ids) in enumerate(rules):
        at = F.lit("|" + "||".join(ids) + "|")
        out = out.withColumn(f"hit{i}", F.contains("rest", at)).withColumn("rest", F.replace("rest", at, F.lit("!")))
        hits.append(F.when(F.col(f"hit{i}"), F.lit(rules[i][0])))
    return out.select("doc_id", "sentence_ids", "n_sentences", F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",").alias("licences"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_sql(s: str) -> str:
    """A string or pattern as SQL has it, control characters by their numbers."""
    parts = re.split("([\n\r])", s)
    return " || ".join(f"chr({ord(p)})" if p in ("\n", "\r") else _quoted(p) for p in parts if p) or "''"


def scan_sql() -> str:
    """The same in DuckDB's SQL: lines that are wrapped included. Marks of ends are doubled there, as its patterns can't look
    ahead: a sentence takes one of them before and one after it."""
    whole, named = known_of(SENTENCES)
    clean = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '\\r\\n?', chr(10), 'g')"
    for pattern, by in [(ENDS, "\r"), *LINES]:
        clean = f"regexp_replace({clean}, {_quoted(pattern.replace('*+', '*'))}, {_in_sql(by)}, 'g')"
    twice = f"replace(replace({clean}, chr(10), chr(10) || chr(10)), chr(13), chr(13) || chr(13))"
    pattern = f"(?:^|[\\n\\r])[ #*/;.,!?-]*({'|'.join(pattern_of(s, *TWICE) for s, _ in whole + named)})[ */;.,!?-]*(?:[\\n\\r]|\\z)"
    once = "replace(replace(s, chr(10) || chr(10), ' '), chr(13) || chr(13), chr(13))"
    known = ", ".join(f"{_in_sql(key_of(s))}: {_quoted(k)}" for s, k in whole)
    cases = " ".join(f"WHEN regexp_full_match({once}, {_quoted(pattern_of(s, ' ', chr(92) + 'r'))}) THEN {_quoted(k)}" for s, k in named)
    ctes, prev = [], "b"
    for i, (_, ids) in enumerate(RULES):
        at = _quoted("|" + "||".join(ids) + "|")
        ctes.append(f"r{i} AS (SELECT * EXCLUDE (rest), contains(rest, {at}) AS hit{i}, replace(rest, {at}, '!') AS rest FROM {prev})")
        prev = f"r{i}"
    hits = ", ".join(f"CASE WHEN hit{i} THEN {_quoted(name)} END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH s AS (SELECT doc_id, regexp_extract_all({twice}, {_quoted(pattern)}, 1) AS ss FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(ss, lambda s: coalesce(MAP {{{known}}}[{once}], CASE {cases} END)), lambda x: x IS NOT NULL) AS ids FROM s),
b AS (SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences, '|' || replace(coalesce(array_to_string(ids, ','), ''), ',', '||') || '|' AS rest FROM k),
{", ".join(ctes)},
u AS (SELECT doc_id, sentence_ids, n_sentences, list_filter([{hits}], lambda x: x IS NOT NULL) AS l FROM {prev})
SELECT doc_id, sentence_ids, n_sentences, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS licences FROM u
"""
