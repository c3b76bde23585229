"""Licence scans by sentence-rule recognition.

Texts are cut into sentences (at line feeds, and after . ! ? ; before white
space); neighbouring lines that only together are a known sentence, with no
blank line and no end of a sentence between, are one too.  A sentence is normalised: lower case, everything but letters and
digits collapsed to single spaces, articles dropped.  Known sentences map to identifiers; a
text becomes the sequence of its sentences' identifiers.  Ordered rules then
match identifier sequences: a rule takes every place where its identifiers
follow one another with no other known sentence between, and what an earlier
rule has taken no later rule sees.  Known sentences that no rule takes are
reported as unmatched.

Only built-in functions run.  The tables of sentences and rules are constants
of this module, a few dozen rows, and are broadcast.

Defined cases: null and empty texts have no sentences and give no row in
``sentences`` and a row without licences in ``scan``; rows that repeat a
doc_id are scanned each; a null id is kept; a very long text is scanned whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of common licence notices, and the rules over them.
SENTENCES = {
    "Apache.licensed": "Licensed under the Apache License, Version 2.0",
    "Apache.dont-use": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "Apache.may-not": "you may not use this file except in compliance with the License",
    "Apache.obtain": "You may obtain a copy of the License at",
    "Apache.url": "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache.as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "Apache.see": "See the License for the specific language governing permissions and limitations under the License",
    "MIT.released": "Released under the MIT License",
    "MIT.licensed": "Licensed under the MIT License",
    "MIT.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MIT.as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
    "GPL3.work": "This work is licensed under the GNU General Public License, version 3",
    "GPL.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GPL.copy": "You should have received a copy of the GNU General Public License along with this program",
    "CC-BY-NC.licensed": "Licensed under CC BY-NC 4.0",
    "CC-BY.licensed": "Licensed under CC BY 4.0",
    "BSD.redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "General.rights": "All rights reserved",
    "BSD.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ISC.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "MPL.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "LGPL.library": "This library is free software",
    "LGPL.free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL.version": "either version 2.1 of the License, or (at your option) any later version",
    "AGPL.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "AGPL.copy": "You should have received a copy of the GNU Affero General Public License along with this program",
    "Unlicense.free": "This is free and unencumbered software released into the public domain",
    "Unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "CC0.dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "CC0.licensed": "Licensed under CC0 1.0",
    "CC-BY-SA.licensed": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA.work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}
#: The whole sentences of licences of which SENTENCES has the beginning.
WHOLE = {
    "MIT.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT.as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
}
#: Every known sentence matches this; texts that don't are not searched for wrapped ones.
HINT = "(?i)licen|software|permission|program|redistribution|rights|redistribute|mpl"
RULES = [
    ("Apache-2.0", ["Apache.dont-use", "Apache.may-not", "Apache.obtain", "Apache.url", "Apache.as-is", "Apache.see"]),
    ("GPL-3.0-or-later", ["GPL.free", "GPL.hope", "GPL.copy"]),
    ("GPL-3.0-or-later", ["GPL.free"]),
    ("MIT", ["MIT.grant", "MIT.notice", "MIT.as-is"]),
    ("BSD-3-Clause", ["BSD.redistribution", "BSD.source", "BSD.binary", "BSD.names"]),
    ("BSD-2-Clause", ["BSD.redistribution", "BSD.source", "BSD.binary"]),
    ("Apache-2.0", ["Apache.licensed"]),
    ("Apache-2.0", ["Apache.dont-use"]),
    ("MIT", ["MIT.released"]),
    ("MIT", ["MIT.licensed"]),
    ("GPL-3.0-only", ["GPL3.work"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC.licensed"]),
    ("CC-BY-4.0", ["CC-BY.licensed"]),
    ("All-rights-reserved", ["General.rights"]),
    ("ISC", ["ISC.grant"]),
    ("MPL-2.0", ["MPL.terms", "MPL.copy"]),
    ("MPL-2.0", ["MPL.terms"]),
    ("LGPL-2.1-or-later", ["LGPL.library", "LGPL.free", "LGPL.version"]),
    ("AGPL-3.0-or-later", ["AGPL.free", "GPL.hope", "AGPL.copy"]),
    ("AGPL-3.0-or-later", ["AGPL.free"]),
    ("Unlicense", ["Unlicense.free", "Unlicense.anyone"]),
    ("Unlicense", ["Unlicense.free"]),
    ("CC0-1.0", ["CC0.dedicated"]),
    ("CC0-1.0", ["CC0.licensed"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA.licensed"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA.work"]),
]
#: Each identifier in a sequence is one character, so that rules are plain substrings.
CODES = {name: chr(0x100 + i) for i, name in enumerate(SENTENCES)}
#: What stands in a sequence where a rule has taken its sentences: one character a rule.
TAKEN = [chr(0x1000 + i) for i in range(len(RULES))]


def normal(sentence: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"\b(the|a|an) ", "")


def _normal_text(sentence: str) -> str:
    import re

    return re.sub(r"\b(the|a|an) ", "", re.sub("[^a-z0-9]+", " ", sentence.lower()).strip())


def _cut(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?;])[ \t\r]+", "$1\n"), r"\n")


def _wrapped(rows: DataFrame, known: DataFrame, texts: list[str]) -> DataFrame:
    """(doc_id, row_, place, last, name) of the known sentences, ``texts``, that run over the lines from ``place`` to ``last``."""

    def begins(line: Column) -> Column:
        any_of = F.lit(False)
        for s in texts:
            any_of |= (F.length(line) < len(s)) & F.lit(s).startswith(line)
        return (line != "") & any_of

    some = rows.where(F.col("text").rlike(HINT)).select("doc_id", "row_", _cut(F.col("text")).alias("lines"))
    first = F.transform("lines", lambda x, i: F.struct(i.alias("place"), F.regexp_replace(normal(x), r" ?\b(the|a|an)$", "").alias("line")))
    some = some.where("size(lines) > 1").select("doc_id", "row_", "lines", F.explode(F.filter(first, lambda x: begins(x.line)).place).alias("place"))
    # A line holds one word at least.
    runs = some.select("doc_id", "row_", "place", F.slice("lines", F.col("place") + 1, max(len(s.split()) for s in texts)).alias("run")).where("size(run) > 1")
    goes_on = lambda line: line.rlike("[A-Za-z0-9]") & ~line.rlike(r"[.!?;]\s*$")
    ends = F.filter(F.sequence(F.lit(2), F.size("run")), lambda n: F.forall(F.slice("run", 1, n - 1), goes_on))
    runs = runs.select("doc_id", "row_", "place", "run", F.explode(ends).alias("n"))
    runs = runs.select("doc_id", "row_", "place", (F.col("place") + F.col("n") - 1).alias("last"), normal(F.array_join(F.slice("run", F.lit(1), F.col("n")), " ")).alias("sentence"))
    return runs.join(F.broadcast(known), "sentence").select("doc_id", "row_", "place", "last", "name")


def sentences(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_, doc_id, place, name) of the known sentences of each text, the longest of those that begin in one place; ``row_`` tells rows apart."""
    table = [(_normal_text(s), n) for x in (SENTENCES, WHOLE) for n, s in x.items()]
    known = spark.createDataFrame(table, "sentence string, name string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_"), F.col(text_col).cast("string").alias("text"))
    parts = rows.select("doc_id", "row_", F.posexplode(_cut(F.col("text"))).alias("place", "sentence"))
    # Normalising never makes a sentence longer: shorter ones than the shortest known one can't match.
    parts = parts.where(F.length("sentence") >= min(len(_normal_text(s)) for s in SENTENCES.values()))
    parts = parts.withColumn("sentence", normal(F.col("sentence")))
    found = parts.join(F.broadcast(known), "sentence").select("doc_id", "row_", "place", F.col("place").alias("last"), "name")
    found = found.unionByName(_wrapped(rows, known, [s for s, _ in table]))
    return found.groupBy("doc_id", "row_", "place").agg(F.max(F.struct("last", "name")).alias("best")).select("doc_id", "row_", "place", "best.name")


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known, licenses, unmatched: a row per row of ``docs``.

    ``licenses`` are the distinct licences in the order of the rules, joined by
    commas ("" for none), ``unmatched`` the known sentences left over.
    """
    found = sentences(spark, docs, id_col, text_col)
    names, codes = F.array(*map(F.lit, CODES)), F.array(*map(F.lit, CODES.values()))
    found = found.withColumn("code", F.element_at(F.map_from_arrays(names, codes), F.col("name")))
    chain = found.groupBy("doc_id", "row_").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x.code), "").alias("chain"))
    left = F.col("chain")
    for mark, (_, ids) in zip(TAKEN, RULES, strict=True):
        left = F.replace(left, F.lit("".join(CODES[i] for i in ids)), F.lit(mark))
    chain = chain.withColumn("left", left)
    titles = list(dict.fromkeys(title for title, _ in RULES))
    hit = [F.when(F.col("left").rlike("[" + "".join(m for m, (t, _) in zip(TAKEN, RULES, strict=True) if t == title) + "]"), F.lit(title)) for title in titles]
    chain = chain.select(
        F.col("doc_id").alias("c_id"), F.col("row_").alias("c_row"), F.length("chain").alias("n_known"), F.concat_ws(",", *hit).alias("licenses"),
        F.length(F.regexp_replace("left", f"[{TAKEN[0]}-{TAKEN[-1]}]", "")).alias("unmatched"),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_"))
    out = rows.join(chain, rows.doc_id.eqNullSafe(chain.c_id) & (rows.row_ == chain.c_row), "left")
    return out.select("doc_id", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("unmatched", F.lit(0)).cast("long").alias("unmatched"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(_normal_text(s))}, {quote(CODES[n])})" for n, s in SENTENCES.items())
    left = "chain"
    for mark, (_, ids) in zip(TAKEN, RULES, strict=True):
        left = f"replace({left}, {quote(''.join(CODES[i] for i in ids))}, {quote(mark)})"
    titles = list(dict.fromkeys(title for title, _ in RULES))
    hits = ", ".join("CASE WHEN " + " OR ".join(f"contains(l, {quote(m)})" for m, (t, _) in zip(TAKEN, RULES, strict=True) if t == title) + f" THEN {quote(title)} END" for title in titles)
    return rf"""
WITH known(sentence, code) AS (VALUES {known}),
parts AS (
  SELECT doc_id, generate_subscripts(p, 1) AS place, unnest(p) AS sentence
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?;])[ \t\r]+', '\1' || chr(10), 'g'), '\n+') AS p FROM documents)
),
found AS (
  SELECT doc_id, place, code
  FROM (SELECT doc_id, place, regexp_replace(trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')), '\b(the|a|an) ', '', 'g') AS sentence FROM parts) JOIN known USING (sentence)
),
chains AS (SELECT doc_id, string_agg(code, '' ORDER BY place) AS chain FROM found GROUP BY doc_id),
matched AS (SELECT doc_id, length(chain) AS n_known, {left} AS l FROM chains)
SELECT d.doc_id, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, coalesce(concat_ws(',', {hits}), '') AS licenses,
       CAST(coalesce(length(regexp_replace(l, '[{TAKEN[0]}-{TAKEN[-1]}]', '', 'g')), 0) AS BIGINT) AS unmatched
FROM documents d LEFT JOIN matched m ON d.doc_id = m.doc_id
"""
