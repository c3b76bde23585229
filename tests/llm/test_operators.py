"""Each operator on small tables: defined cases, and results held against brute force."""

import hashlib
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import components, curriculum, decontaminate, licenses, line_dedup, media, near_dup, quality, quotations, toxicity, warc
from cuelake.llm.common import Scratch, word_count
from cuelake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
RNG = np.random.default_rng(7)
PROSE = [" ".join(f"{'abcdefgh'[i % 8]}{x}" for i, x in enumerate(RNG.integers(0, 500, 60))) for _ in range(12)]


def _edit(text, at):
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, LONG), (7, PROSE[0]), (8, _edit(PROSE[0], 30)), (9, PROSE[1]), (9, PROSE[1]), (10, PROSE[0]), (None, PROSE[0]), (11, "ÉCOLE one two three four five")]


def _docs(spark, rows, extra="f1 long, kept string, seed int, c0 int"):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], f"doc_id long, text string, {extra}")


def _shingles(text):
    words = [w for w in (text or "").lower().replace("\t", " ").split() if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_word_count(spark):
    rows = spark.createDataFrame([(t,) for _, t in EDGES], "text string").select("text", word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [len((r.text or "").split()) for r in rows]


def test_components_of_a_chain_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (7, 6), (None, 3)]
    got = {r.node: r.component for r in components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1300)}
    assert components.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_merged_components_equal_those_of_all_links(spark):
    rng = np.random.default_rng(4)
    edges = rng.integers(0, 300, (240, 2)).tolist()
    first, more = (spark.createDataFrame(x, "a long, b long").repartition(4) for x in (edges[:170], edges[170:]))
    scratch = Scratch(spark, "t")
    so_far = components.components(scratch, first)
    got = {tuple(r) for r in components.merged(scratch, so_far, more).collect()}
    assert got == {tuple(r) for r in components.components(scratch, first.unionByName(more)).collect()}
    assert {tuple(r) for r in components.merged(scratch, so_far, more.limit(0)).collect()} == {tuple(r) for r in so_far.collect()}


def test_near_duplicates_defined_cases(spark):
    rows = near_dup.near_duplicates(spark, _docs(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    n = len(_shingles(PROSE[0]))
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 29996, 6, True), (7, n, 7, True), (10, n, 7, False), (None, n, None, True)} <= got
    assert (8, len(_shingles(EDGES[7][1])), 7, False) in got and (9, len(_shingles(PROSE[1])), 9, True) in got
    assert near_dup.near_duplicates(spark, _docs(spark, [])).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets, comp = [_shingles(r.text) for r in rows], list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    smallest: dict = {}
    for i, r in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), r.doc_id), r.doc_id)
    want = {(r.doc_id, len(sets[i]), smallest[root(i)]) for i, r in enumerate(rows)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries()["op3_near_duplicates"](spark, SF).collect()} == want


def test_large_dense_groups_are_split_and_kept_whole(spark):
    base = PROSE[2].split()
    texts = []
    for i in range(1000):
        words = list(base)
        words[i % 60] = f"v{i}"
        texts.append((i, " ".join(words)))
    rows = near_dup.near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {0}


def test_lines(spark):
    line = "This is a long line of words that several documents share with one another, all told."
    rows = [(1, f"{line}\nshort\nown words that nobody else has in any of the documents"), (2, f"short\n{line}"), (3, line.replace("told", "said") + "\n\n" + line), (4, None), (5, ""), (None, line), (6, "\n\n")]
    out, gone = line_dedup.dedup_lines(spark, _docs(spark, rows))
    got = {r.doc_id: (r.text, r.n_lines_, r.n_removed_) for r in out.collect()}
    assert out.columns[:6] == ["doc_id", "text", "f1", "kept", "seed", "c0"]
    assert got == {1: (rows[0][1], 3, 0), 2: ("short", 2, 1), 3: ("", 3, 2), 4: (None, 0, 0), 5: ("", 1, 0), None: (line, 1, 0), 6: ("\n\n", 3, 0)}
    assert {(r.doc_id, r.line, r.keeper_doc) for r in gone.collect()} == {(2, 1, 1), (3, 0, 1), (3, 2, 1)}
    assert line_dedup.dedup_lines(spark, _docs(spark, []))[0].count() == 0


def test_lines_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines: dict = {}
    for r in docs.collect():
        for i, x in enumerate(r.text.split("\n")):
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\v\f\r").encode()
            if len(x) >= line_dedup.MIN_CHARS:
                lines.setdefault(x, []).append((r.doc_id, i))
    keys = list(lines)
    sets, comp = [{k[i : i + 8] for i in range(len(k) - 7)} for k in keys], list(range(len(keys)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    close = 0
    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
                close += 1
    groups: dict = {}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).extend(lines[k])
    want = {x for g in groups.values() for x in g if x != min(g)}
    got = {(r.doc_id, r.line) for r in line_dedup.dedup_lines(spark, docs)[1].collect()}
    # Banding misses a pair at the very threshold now and then; nothing else may differ.
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_query_removes_short_and_slightly_edited_lines(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    line = "Lines of forty-four bytes with one new word."
    more = [(-3, f"Menu\n\n{line}\nx"), (-2, f" menu \n\n{line.replace('new', 'neW')}\nY"), (-1, line.replace("bytes", "bites") + "\nMENU\n\nx\nx")]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    lines: dict = {}
    for r in docs.collect():
        for i, x in enumerate(r.text.split("\n")):
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\v\f\r").encode()
            if x:
                lines.setdefault(x, []).append((r.doc_id, i))
    keys = [k for k in lines if len(k) >= line_dedup.MIN_CHARS]
    sets, comp = [{k[i : i + 5] for i in range(len(k) - 4)} for k in keys], list(range(len(keys)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    groups: dict = {k: list(v) for k, v in lines.items() if len(k) < line_dedup.MIN_CHARS}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).extend(lines[k])
    want: dict = {}
    for g in groups.values():
        for d, _ in set(g) - {min(g)}:
            want[d] = want.get(d, 0) + 1
    got = {r.doc_id: r.n_removed for r in queries()["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert (got[-3], got[-2], got[-1]) == (0, 2, 4)
    assert all(n <= want.get(d, 0) for d, n in got.items()) and sum(got.values()) >= 0.995 * sum(want.values())


def _close_lines(n):
    """Pairs of random lines of similarity 0.75 to 0.8."""
    rng, pairs = np.random.default_rng(1), []
    while len(pairs) < n:
        a = rng.integers(97, 123, rng.integers(63, 250)).astype(np.uint8)
        b = a.copy()
        b[rng.integers(0, len(a), 1 + int(rng.integers(0, len(a) // 45)))] = 65
        s, t = ({x[i : i + line_dedup.SHINGLE].tobytes().lower() for i in range(len(x) - line_dedup.SHINGLE + 1)} for x in (a, b))
        if 75 <= 100 * len(s & t) / len(s | t) < 80:
            pairs.append((a, b))
    return pairs


def test_lines_of_the_threshold_meet(spark):
    signed, sketched = [], []
    for side in zip(*_close_lines(2000), strict=True):
        raw, off = np.concatenate(side), np.concatenate([[0], np.cumsum([len(x) for x in side])])
        value, first = line_dedup._shingles(raw, off[:-1], off[1:])
        signed.append(line_dedup._signatures(value, first))
        sketched.append(line_dedup.tb.minhash(value, first, line_dedup.SKETCH).astype(np.uint8))
    bands = [x.reshape(len(x), line_dedup.BANDS, line_dedup.ROWS) for x in signed]
    assert np.mean((bands[0] == bands[1]).all(axis=2).any(axis=1)) >= 0.995
    assert np.mean((sketched[0] == sketched[1]).mean(axis=1) >= line_dedup.LOW) >= 0.999
    # A pair that meets in a large band meets in one of its children too.
    blobs = spark.createDataFrame([(i, x.tobytes(), y.tobytes()) for i, (x, y) in enumerate(zip(*signed, strict=True))], "node long, x binary, y binary")
    together = F.arrays_overlap(line_dedup._branch(F.col("node"), F.col("x")), line_dedup._branch(F.col("node"), F.col("y")))
    assert blobs.where(together).count() >= 0.985 * 2000


def test_contamination(spark):
    item = "Where was the old bridge over the quiet river built, and by which of the masons of the town?"
    other = " ".join(PROSE[3].split()[:25])
    edited = item.replace("quiet ", "").replace("masons", "builders")
    rows = [(1, f"{PROSE[4]} {item} {PROSE[5]}"), (2, f"{PROSE[6]}\n{edited.upper()}"), (3, PROSE[7]), (4, None), (5, ""), (6, LONG + " " + item), (6, LONG + " " + item), (7, other), (None, item), (8, "where was the old bridge")]
    items = spark.createDataFrame([(1, item, "x"), (2, other, "y"), (3, None, "z"), (4, "two words", "z"), (5, item, "again")], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(spark, _docs(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 2, 6, None) for i in (1, 5)} | {(7, 2)}
    exact = next(r for r in got if r.doc_id == 1 and r.item_id == 1)
    assert (exact.score, exact.first_word, exact.end_word) == (1.0, 60, 60 + len(item.split()))
    assert decontaminate.contamination(spark, _docs(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.contamination(spark, _docs(spark, []), items).count() == 0


def test_contamination_of_groups_equals_brute_force(spark):
    items = [PROSE[k].split()[:38] for k in range(4)]
    fifth = lambda words: [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
    texts = [PROSE[8 + i % 4].split() for i in range(12)]
    # Equal edited copies that keep few seeds; one whole copy beside many of one edited version; two passages in one text; a passage beside a stray seed.
    texts += [PROSE[8].split() + fifth(items[0]) + PROSE[9].split()] * 3 + [items[1]] + [fifth(items[1]) + [f"y{i}"] for i in range(40)]
    texts += [items[2] + PROSE[10].split() + items[2][:3] + PROSE[9].split() + fifth(items[2])] + [items[3][:3] + PROSE[11].split() * 9 + fifth(items[3])] * 5
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    code = {w: i for i, w in enumerate({w for t in texts + items for w in t})}
    number = lambda words: np.array([code[w] for w in words])
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if decontaminate.align(number(x), number(t))[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(x)}
    got = decontaminate.contamination(spark, docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) == 50
    assert sum(r.item_id == 2 for r in got) == 2


def test_alignment_equals_the_plain_recurrence():
    for _ in range(30):
        a, b = RNG.integers(0, 4, 9), RNG.integers(0, 4, 14)
        h = np.zeros((10, 15), int)
        for i in range(9):
            for j in range(14):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 3000
    rows = [(1, "http://a", big, "r"), (2, "http://b\r\nX: y", big, "r"), (3, None, big, "r"), (4, "u", None, "r"), (5, "u", "", "r"), (6, "u", "small", "r"), (7, "u", "small", "r"), (None, "u", big, "r"), (3, "v", big, "r"), (8, "u", LONG, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    files = warc.write_warc(spark, pages, str(tmp_path / "w"), Scratch(spark, "t"))
    for split in (100, 5000, 1 << 20):
        got = warc.read_warc(files, split).collect()
        assert len(got) == len(rows)
        kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in got)
        sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
        want = [(p or 0, "revisit" if h == big and p != 3 else "response", 3 if h == big and p != 3 else 0, len((h or "").encode()), sha(h)) for p, _, h, _ in rows]
        assert kinds == sorted(want)
        assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h, _ in rows}
    assert warc.read_warc(warc.write_warc(spark, pages.limit(0), str(tmp_path / "e"), Scratch(spark, "t"))).count() == 0


def test_media_round_trip(spark, tmp_path):
    folder = str(tmp_path / "m")
    files = media.write_media(_docs(spark, [*EDGES, (-5, "x" * 64)]).repartition(3), folder, Scratch(spark, "t"))
    for split in (1000, 1 << 24):
        got = media.media_features(media.read_media(spark, folder, files, split)).collect()
        assert len(got) == len(EDGES) + 1
        want = set()
        for d, t in [*EDGES, (-5, "x" * 64)]:
            raw = (t or "").encode()
            pad = raw + bytes(-len(raw) % 64 if raw else 64)
            wav = media.to_wav(pad)
            want.add((d, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), len(wav), hashlib.sha256(wav).hexdigest()))
        assert {tuple(r)[:7] for r in got} == want
    assert media.read_media(spark, str(tmp_path / "none")).count() == 0


def test_media_members_fail_alone(spark, tmp_path):
    folder = tmp_path / "m"
    media.write_media(_docs(spark, [(i, PROSE[i]) for i in range(5)]).coalesce(1), str(folder), Scratch(spark, "t"))
    path = next(folder.glob("*.zip"))
    raw = bytearray(path.read_bytes())
    raw[60] ^= 0xFF
    path.write_bytes(raw)
    got = media.read_media(spark, str(folder)).collect()
    assert len(got) == 5 and sum(r.error is not None for r in got) == 1


def test_quotations(spark):
    first, second = "Where do we meet?\nAt the station?", "At noon, as always."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "user", f"> {second}\n>> Where do we meet?\nFine."), (1, 3, "user", "> where  DO we meet?\n> At the station?\nYes"), (1, 4, "user", "> never said\nOdd"),
        (2, 0, "user", "> " + second + "\nno link to another conversation"), (3, 0, "user", None), (None, 5, "user", "> x"), (4, None, "user", ""), (1, 4, "user", "> never said\nOdd"), (1, 5, "user", "> Fine.\n" + LONG),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")
    linked = quotations.link_quotations(spark, table)
    got = {(r.conv_id, r.turn): (r.body, r.reply_to, r.thread, r.depth, list(r.path)) for r in linked.collect()}
    assert linked.count() == len(rows)
    assert got[1, 2] == ("Fine.", 1, 1, 1, [1, 2]) and got[1, 3] == ("Yes", 0, 0, 1, [0, 3]) and got[1, 4] == ("Odd", None, 4, 0, [4])
    assert got[1, 5][1:] == (2, 1, 2, [1, 2, 5]) and got[2, 0][1] is None and got[3, 0][0] == "" and got[None, 5][0] == ""
    threads = {(r.conv_id, r.thread): [m.content for m in r.messages] for r in quotations.conversations(linked).collect()}
    assert threads[1, 0] == [first, "Yes"] and threads[1, 1][:2] == [second, "Fine."]
    assert quotations.link_quotations(spark, table.limit(0)).count() == 0


def test_quoted_sentences_and_rewrapped_paragraphs_are_linked(spark):
    paragraph = "The boat leaves at nine from the lower pier, and whoever is late will have to take the train instead"
    rows = [
        (1, 0, "user", "Good morning. Who has the keys? I left mine at home."), (1, 1, "assistant", f"Hello.\n\n{paragraph}.\n\nBye."), (1, 2, "user", "> Who has the keys?\nAnna."),
        (1, 3, "user", "> " + paragraph[:48] + "\n> " + paragraph[48:] + ".\nFine."), (1, 4, "user", "> Who has\n> the keys? I left mine\n> elsewhere.\nNobody."), (1, 5, "user", "> keys\nNo sentence."),
    ]
    got = {r.turn: r.reply_to for r in quotations.link_quotations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: None}


def test_licenses(spark):
    apache = ". ".join(licenses.SENTENCES[i] for i in licenses.RULES[0][1]) + "."
    rows = [(1, f"Some prose here. {apache}\nMore."), (2, "Released under the MIT License.\nAll rights reserved."), (3, licenses.SENTENCES["Apache.see"]), (4, None), (5, ""), (6, LONG), (2, "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License")]
    got = sorted((r.doc_id or 0, r.n_known, r.licenses, r.unmatched) for r in licenses.scan(spark, _docs(spark, rows)).collect())
    assert got == sorted([(1, 6, "Apache-2.0", 0), (2, 2, "MIT,All-rights-reserved", 0), (3, 1, "", 1), (4, 0, "", 0), (5, 0, "", 0), (6, 0, "", 0), (2, 1, "CC-BY-NC-4.0", 0), (0, 1, "MIT", 0)])
    assert licenses.scan(spark, _docs(spark, [])).count() == 0


NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MIT": """Copyright (c) 2020 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
}


def test_wrapped_licences(spark):
    rows, want = [], []
    for k, (title, text) in enumerate(NOTICES.items()):
        for width in (40, 70, 79, 10_000):
            lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
            for mark in ("", " * "):
                rows.append((len(rows), "Prose before.\n\n" + "\n".join(mark + x for x in lines) + "\nProse after"))
                want.append((title, [6, 3, 3, 3][k], 0))
    # Neither a blank line nor the end of a sentence is crossed; five short phrases are known in two lines as well.
    rows += [(100, "Released under\n\nthe MIT License"), (101, "Released under the.\nMIT License"), (102, "Released under the\nMIT License.\nAll rights\nreserved."), (103, "Licensed under the Apache License, Version 2.0\n(the \"License\");")]
    want += [("", 0, 0), ("", 0, 0), ("MIT,All-rights-reserved", 2, 0), ("Apache-2.0", 1, 0)]
    got = {r.doc_id: (r.licenses, r.n_known, r.unmatched) for r in licenses.scan(spark, _docs(spark, rows)).collect()}
    assert [got[r[0]] for r in rows] == want
    texts = [*licenses.SENTENCES.values(), *licenses.WHOLE.values()]
    assert spark.createDataFrame([(s,) for s in texts], "s string").where(F.col("s").rlike(licenses.HINT)).count() == len(texts)


def test_mixing_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["é"] * 30 + [None] * 10)]
    docs = spark.createDataFrame([(*r, 5) for r in [*rows, (0, None, "a"), (7, "", "only empty")]], "doc_id long, text string, source string, size int")
    got = curriculum.placed(spark, docs).collect()
    assert len(got) == len(rows) + 2
    size: dict = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(size.values())
    target, free = {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    taken: dict = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r["size"] and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 6 for s in order)
    placed = curriculum.mixture(spark, docs)
    position = [r.position_ for r in placed.select("position_").collect()]
    assert position == sorted(position) and placed.columns == [*docs.columns, "epoch_", "position_"] and len(position) == sum(len(r.positions) for r in got)
    assert curriculum.placed(spark, docs.limit(0)).count() == 0


def test_demand_is_inverted(spark):
    w = [2.0, 1.5, 0.5, 0.5, 0.0]
    grid = np.linspace(0, 1, 4001)
    area = np.concatenate([[0], np.cumsum((lambda v: (v[1:] + v[:-1]) / 2 * np.diff(grid))(np.interp(grid, np.linspace(0, 1, 5), w)))])
    rows = spark.createDataFrame([(x,) for x in np.linspace(0, 0.999, 50).tolist()], "s double").select("s", curriculum.invert_demand(F.array(*map(F.lit, w)), F.col("s")).alias("t")).collect()
    assert all(abs(np.interp(r.t, grid, area) / area[-1] - r.s) < 1e-3 for r in rows)


def _labelled(spark, bad):
    docs, labels = [], []
    for i in range(400):
        ill = i % 4 == 0
        words = PROSE[i % 12].split()
        words[i % 50] = f"u{i}"
        docs.append((i, bad(words) if ill else " ".join(words), "en", f"s{i % 3}", None, 1))
        labels.append((i, 0 if ill else 1, 1 if ill else 0, 9))
    docs += [(1000, None, None, None, None, 1), (1001, "", None, None, 0, 1), (0, docs[0][1], "en", "s0", None, 1), (None, LONG, "en", "s1", 5, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, label int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")


def test_quality(spark):
    docs, labels = _labelled(spark, lambda w: " ".join(x.upper() + "!!" for x in w))
    model = quality.fit(spark, docs, labels)
    got = quality.score(spark, docs, model).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    kept = quality.keep_good(spark, docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400} == {i for i in range(400) if i % 4}
    assert quality.score(spark, docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score(spark, docs, quality.fit(spark, docs, labels.limit(0))).collect()} == {1.0}


def test_toxicity(spark):
    docs, labels = _labelled(spark, lambda w: " ".join([*w[:20], "Vile!", *w[20:]]))
    got = toxicity.score(spark, docs, toxicity.fit(spark, docs, labels)).collect()
    assert len(got) == 404 and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "null").encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert {r.score for r in toxicity.score(spark, docs, toxicity.fit(spark, docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(spark, docs.limit(0), (np.zeros(0, int), np.zeros(0))).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries()["op8_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean)
    graded = queries()["op2_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in graded]) > 0.95


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    ours = queries()[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in ours.select(columns).collect()))) == sorted(map(repr, theirs.fetchall()))
