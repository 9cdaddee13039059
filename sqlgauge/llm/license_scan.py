"""Operator 9: licence scans by sentence rules, in DataFrame functions only.

Texts are normalised to lower-case words and digits. A sentence ends at closing
punctuation before white space and at blank lines. It may end, or go on, at a
line end (with or without comment leaders), at ':' before a capital or list mark, after a
list number, and before the capitalised opening of a long notice: hard-wrapped
and flattened licences read like those of one sentence per line, and the longest
known sentence is taken. Known licence sentences map to identifiers; everything
else drops out. The identifiers of a
document, in order, are matched against rules in rule order: a rule names a
licence and a run of identifiers, and the runs it matches are used up, so that a
later, shorter rule does not claim them again. Identifiers that no rule used are
reported as ``n_unmatched``.

Rows are handled one by one: nothing is shuffled, joined or sent to Python.

Defined results: null and empty texts have no sentences; a licence is named once
per document, in rule order; documents without any known sentence are left out of
``licensed_documents`` (``with_licenses`` keeps every row, with empty arrays);
repeated rows each keep their row; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm.graph import fresh

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "APACHE2_SHORT": ["Licensed under the Apache License, Version 2.0",
                      "Licensed under the Apache License, Version 2.0 (the \"License\")",
                      "This work is licensed under the Apache License, Version 2.0",
                      "Released under the Apache License, Version 2.0"],
    "APACHE2_COMPLY": ["you may not use this file except in compliance with the License"],
    "APACHE2_COPY": ["You may obtain a copy of the License at",
                     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "APACHE2_BASIS": ["Unless required by applicable law or agreed to in writing, software distributed under "
                      "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
                      "ANY KIND, either express or implied"],
    "APACHE2_SEE": ["See the License for the specific language governing permissions and limitations under "
                    "the License"],
    "MIT_SHORT": ["Released under the MIT License", "Licensed under the MIT License",
                  "This work is licensed under the MIT License", "Distributed under the MIT License"],
    "MIT_NAME": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "MIT_GRANT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                  "software and associated documentation files (the \"Software\"), to deal in the Software "
                  "without restriction, including without limitation the rights to use, copy, modify, merge, "
                  "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
                  "to whom the Software is furnished to do so, subject to the following conditions:"],
    "MIT_NOTICE": ["The above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the Software"],
    "MIT_AS_IS": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
                  "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
                  "PURPOSE AND NONINFRINGEMENT"],
    "MIT_LIABLE": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
                   "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
                   "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "ISC_GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or "
                  "without fee is hereby granted, provided that the above copyright notice and this permission "
                  "notice appear in all copies"],
    "ISC_AS_IS": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
                  "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "BSD_REDIST": ["Redistribution and use in source and binary forms, with or without modification, are "
                   "permitted provided that the following conditions are met:"],
    "BSD_SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of "
                   "conditions and the following disclaimer"],
    "BSD_BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of "
                   "conditions and the following disclaimer in the documentation and/or other materials "
                   "provided with the distribution"],
    "BSD_ENDORSE": ["Neither the name of the copyright holder nor the names of its contributors may be used to "
                    "endorse or promote products derived from this software without specific prior written "
                    "permission"],
    "BSD_AS_IS": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
                  "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
                  "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "BSD3_SHORT": ["Licensed under the BSD 3-Clause License", "Released under the 3-Clause BSD License"],
    "BSD2_SHORT": ["Licensed under the BSD 2-Clause License", "Released under the 2-Clause BSD License"],
    "GPL3_SHORT": ["This work is licensed under the GNU General Public License, version 3",
                   "Licensed under the GNU General Public License, version 3",
                   "Released under the GNU General Public License, version 3"],
    "GPL2_SHORT": ["This work is licensed under the GNU General Public License, version 2",
                   "Licensed under the GNU General Public License, version 2",
                   "Released under the GNU General Public License, version 2"],
    "GPL_FREE": ["This program is free software: you can redistribute it and/or modify it under the terms of "
                 "the GNU General Public License as published by the Free Software Foundation, either version "
                 "3 of the License, or (at your option) any later version"],
    "GPL2_FREE": ["This program is free software; you can redistribute it and/or modify it under the terms of "
                  "the GNU General Public License as published by the Free Software Foundation; either version "
                  "2 of the License, or (at your option) any later version"],
    "GPL_HOPE": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
                 "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "GPL_SEE": ["See the GNU General Public License for more details"],
    "LGPL3_SHORT": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL3_SHORT": ["Licensed under the GNU Affero General Public License, version 3"],
    "MPL2_FORM": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "MPL2_COPY": ["If a copy of the Mozilla Public License was not distributed with this file, You can obtain one at "
                  "https://mozilla.org/MPL/2.0/"],
    "MPL2_SHORT": ["Licensed under the Mozilla Public License, Version 2.0"],
    "CC_BY": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0",
              "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC_BY_SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC_BY_NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                 "License"],
    "CC0": ["This work is dedicated to the public domain under the CC0 1.0 Universal license",
            "Licensed under CC0 1.0"],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain"],
}
# Rules in order; the first to match uses up its sentences.
RULES = [
    ("Apache-2.0", ["APACHE2_SHORT", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_BASIS", "APACHE2_SEE"]),
    ("BSD-3-Clause", ["BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_AS_IS"]),
    ("BSD-2-Clause", ["BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS"]),
    ("MIT", ["MIT_NAME", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE"]),
    ("GPL-3.0-or-later", ["GPL_FREE", "GPL_HOPE", "GPL_SEE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE", "GPL_HOPE", "GPL_SEE"]),
    ("ISC", ["ISC_GRANT", "ISC_AS_IS"]),
    ("MPL-2.0", ["MPL2_FORM", "MPL2_COPY"]),
    ("GPL-3.0-or-later", ["GPL_FREE"]),
    ("GPL-2.0-or-later", ["GPL2_FREE"]),
    ("MPL-2.0", ["MPL2_FORM"]),
    ("Apache-2.0", ["APACHE2_SHORT"]),
    ("MIT", ["MIT_SHORT"]),
    ("BSD-3-Clause", ["BSD3_SHORT"]),
    ("BSD-2-Clause", ["BSD2_SHORT"]),
    ("GPL-3.0", ["GPL3_SHORT"]),
    ("GPL-2.0", ["GPL2_SHORT"]),
    ("LGPL-3.0", ["LGPL3_SHORT"]),
    ("AGPL-3.0", ["AGPL3_SHORT"]),
    ("MPL-2.0", ["MPL2_SHORT"]),
    ("CC-BY-4.0", ["CC_BY"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC"]),
    ("CC0-1.0", ["CC0"]),
    ("Unlicense", ["UNLICENSE"]),
]
#: Every known sentence has one of these; texts without any have no sentence to look up.
MARKS = ("licens", "copyright", "permi", "warrant", "redistribut", "liable", "software", "public")
#: Ends of a sentence in a ``laid_out`` text: certain ones, and places that may lie inside one.
HARD, SOFT = "\x01", "\x02"
LONG = 12  # a capitalised notice of more words opens a sentence anywhere in a line


def normalise(sentence: str) -> str:
    """The normal form of one sentence: its lower-case words and digits."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_parts() -> dict[str, str]:
    """Normalised sentence -> identifier; a notice that holds a sentence end is cut like a text."""
    out = {}
    for ident, texts in SENTENCES.items():
        for text in texts:
            parts = [normalise(p) for p in re.split(r"[.!?;]+(?=\s|$)", text)]
            parts = [p for p in parts if p]
            # Long notices may span several cut parts: each part carries the identifier's part number.
            for k, p in enumerate(parts):
                name = ident if len(parts) == 1 else f"{ident}/{k + 1}"
                if out.setdefault(p, name) != name:
                    raise ValueError(f"{p!r} belongs to {out[p]} and {name}")
                if not any(m in p for m in MARKS):
                    raise ValueError(f"{p!r} has none of the marks")
    return out


def rule_patterns() -> list[tuple[str, str]]:
    """(licence, run of identifiers written as <A><B>) in rule order."""
    n_parts = {}
    for name in known_parts().values():
        ident, _, k = name.partition("/")
        n_parts[ident] = max(n_parts.get(ident, 0), int(k or 0))
    spell = lambda i: "".join(f"<{i}/{k + 1}>" for k in range(n_parts[i])) or f"<{i}>"
    return [(name, "".join(map(spell, run))) for name, run in RULES]


def _openings() -> str:
    """Regex: the first words of long notices, written like the start of a sentence."""
    found = []
    for texts in SENTENCES.values():
        for text in texts:
            if len(normalise(text).split()) > LONG and text[0].isupper():
                found.append(r"\s+".join(map(re.escape, text.split()[:3])))
    return "|".join(dict.fromkeys(found))


def known_pattern() -> str:
    """Regex: a whole known sentence of a ``laid_out`` text, longer ones first."""
    runs = sorted(known_parts(), key=lambda p: (-len(p), p))
    words = "|".join(p.replace(" ", f"[ {SOFT}]") for p in runs)
    return f"(?<![^{HARD}{SOFT}])(?:{words})(?![^{HARD}{SOFT}])"


def laid_out(text: Column) -> Column:
    """Lower-case words parted by a blank, SOFT (a sentence may end here) or HARD (it does)."""
    out = F.translate(text, HARD + SOFT, "##")
    out = F.regexp_replace(out, r"\r\n?|\f", "\n")
    for before in (r"(?<=:)[ \t]+(?=[^a-z \t]|[a-z]\))", rf"[ \t]+(?={_openings()})",
                   r"(?<=\s\(?(?:[0-9]{1,2}|[a-z])\))[ \t]"):
        out = F.regexp_replace(out, before, SOFT)
    out = F.regexp_replace(F.lower(out), rf"[.!?;]+([ \t\n{SOFT}]|\z)", HARD)
    for pattern, mark in ((rf"[^a-z0-9\n{HARD}{SOFT}]+", " "), (rf"\n[ {SOFT}\n]*\n", HARD),
                          (rf"[ {SOFT}\n]*[{SOFT}\n][ {SOFT}\n]*", SOFT), (f" ?{HARD} ?", HARD)):
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def sentence_ids(text: Column) -> Column:
    """array<string>: identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in known_parts().items() for x in pair])
    low = F.lower(text)
    marked = None
    for m in MARKS:
        marked = low.contains(m) if marked is None else marked | low.contains(m)
    runs = F.regexp_extract_all(laid_out(text), F.lit(known_pattern()), F.lit(0))
    found = F.transform(runs, lambda s: F.try_element_at(known, F.translate(s, SOFT, " ")))
    return F.when(marked, found).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column) -> Column:
    """struct<seq, found>: what no rule used, and the licences in rule order."""
    seq = F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(run).alias("run"))
                      for name, run in rule_patterns()])
    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("found"))

    def apply(state, rule):
        hit = state["seq"].contains(rule["run"])
        return F.struct(F.replace(state["seq"], rule["run"], F.lit("|")).alias("seq"),
                        F.when(hit, F.array_union(state["found"], F.array(rule["license"])))
                        .otherwise(state["found"]).alias("found"))
    return F.aggregate(rules, start, apply)


def with_licenses(docs: DataFrame, text_col: str = "text", ids_col: str = "sentence_ids",
                  licenses_col: str = "licenses", unmatched_col: str = "n_unmatched") -> DataFrame:
    """``docs`` with the known sentences, the licences and the number of sentences left over."""
    out = docs.withColumn(ids_col, sentence_ids(F.col(text_col)))
    # Most texts have no known sentence: rules are matched only where there is one.
    m = F.when(F.size(ids_col) > 0, match_rules(F.col(ids_col)))
    name = fresh(out, "_matched")
    out = out.withColumn(name, m)
    none = F.array().cast("array<string>")
    left = F.length(F.regexp_replace(F.col(name)["seq"], "[^<]", "")).cast("bigint")
    return (out.withColumn(licenses_col, F.coalesce(F.col(name)["found"], none))
            .withColumn(unmatched_col, F.coalesce(left, F.lit(0).cast("bigint"))).drop(name))


def licensed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses, sentence_ids (comma-joined) and n_unmatched of documents with known sentences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return (with_licenses(rows).where(F.size("sentence_ids") > 0)
            .select("doc_id", F.array_join("licenses", ",").alias("licenses"),
                    F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_unmatched"))


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB SQL, for texts of one sentence per line (it joins no wrapped lines)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(p)}, {quote(i)})" for p, i in known_parts().items())
    steps, last = [], "s0"
    for k, (name, run) in enumerate(rule_patterns(), 1):
        steps.append(f"s{k} AS (SELECT doc_id, row_no, ids, replace(seq, {quote(run)}, '|') AS seq, "
                     f"CASE WHEN contains(seq, {quote(run)}) AND NOT list_contains(found, {quote(name)}) "
                     f"THEN list_append(found, {quote(name)}) ELSE found END AS found FROM {last})")
        last = f"s{k}"
    return f"""
WITH known(sentence, ident) AS (VALUES {known}),
rows AS (SELECT doc_id, row_number() OVER () AS row_no, text FROM {table}),
cut AS (SELECT doc_id, row_no, string_split(regexp_replace(regexp_replace(regexp_replace(lower(text),
          '[.!?;]+([ \\t\\r\\n\\f]|\\z)', chr(10), 'g'), '[\\r\\f]', chr(10), 'g'),
          '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS parts FROM rows),
each AS (SELECT doc_id, row_no, trim(unnest(parts)) AS sentence, generate_subscripts(parts, 1) AS at FROM cut),
seqs AS (SELECT e.doc_id, e.row_no, list(k.ident ORDER BY e.at) AS ids
         FROM each e JOIN known k USING (sentence) GROUP BY e.doc_id, e.row_no),
s0 AS (SELECT doc_id, row_no, ids, '<' || array_to_string(ids, '><') || '>' AS seq, []::VARCHAR[] AS found FROM seqs),
{", ".join(steps)}
SELECT doc_id, array_to_string(found, ',') AS licenses, array_to_string(ids, ',') AS sentence_ids,
       CAST(length(regexp_replace(seq, '[^<]', '', 'g')) AS BIGINT) AS n_unmatched
FROM {last}
"""
