"""Operators against plain statements of their rules, on generated tables and on archives of other writers."""

import base64
import gzip
import hashlib
import math
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import curriculum, decontaminate, licenses, line_dedup, media, near_dup, quality, quotations, toxicity, warc
from cuelake.llm import textblock as tb
from cuelake.llm.common import Scratch
from cuelake.llm.queries import queries

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(11)
LONG = " ".join(f"w{i}" for i in range(30_000))


def _roots(n, links):
    comp = list(range(n))

    def root(x):
        while comp[x] != x:
            comp[x] = x = comp[comp[x]]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        comp[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_sorted_distinct_values():
    x = RNG.integers(0, 50, 400)
    assert tb.sorted_distinct(x).tolist() == sorted(set(x.tolist())) and tb.sorted_distinct(x[:0]).tolist() == []
    value, at = tb.first_of_each(x)
    assert (x[at] == value).all() and value.tolist() == sorted(set(x.tolist()))


# Near-duplicates


def test_large_group_of_near_copies_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(2600):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 12))):
            words[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    number: dict = {}
    bits = np.zeros((len(sets), 64), np.uint64)
    common = {s for s in sets[0] | {tuple(base[i : i + 5]) for i in range(146)} if s[0][0] == "b" and s[-1][0] == "b"}
    for s in sorted(common):
        number.setdefault(s, len(number))
    for k, s in enumerate(sets):
        for x in s & number.keys():
            bits[k, number[x] // 64] |= np.uint64(1 << number[x] % 64)
    links = []
    for i in range(len(sets)):
        both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1).astype(int)
        union = np.array([len(sets[i]) + len(x) for x in sets[i + 1 :]]) - both
        links += [(i, i + 1 + j) for j in np.flatnonzero(100 * both >= 75 * union)]
    want = _roots(len(sets), links)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, docs).collect()}
    assert [got[i] for i in range(len(sets))] == want and len(set(want)) > 20


def test_recall_of_near_duplicates(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sets = []
    for r in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({" ".join(words)} if words else set()))
    holders: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    shared: dict = {}
    for k, s in enumerate(sets):
        met: dict = {}
        for x in s:
            for j in holders[x]:
                if j > k:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                shared[k, j] = n / (len(s) + len(sets[j]) - n)
    got = {r.doc_id: r.component_id for r in queries()["op3_near_duplicates"](spark, sf).collect()}
    joined = {p: got[rows[p[0]].doc_id] == got[rows[p[1]].doc_id] for p in shared}
    edge = [joined[p] for p, s in shared.items() if s < 0.8]
    assert np.mean(list(joined.values())) >= 0.99 and (not edge or np.mean(edge) >= 0.9)


# Lines


def test_lines_of_rows_that_repeat_an_id(spark):
    line = "This is a long line of words that several documents share with one another, all told."
    own = "Nobody else has this long line, which must therefore stay wherever it was in the first place."
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for short in (False, True):
        clean = lambda rows: sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark, frame(rows), short=short)[0].collect() if r.text is not None)  # noqa: E731, B023
        assert clean([(1, line), (2, line), (2, own)]) == [(1, line), (2, ""), (2, own)]
        assert clean([(1, line), (2, f"{own}\nx\n{line}"), (2, "short"), (2, None)]) == [(1, line), (2, f"{own}\nx"), (2, "short")]
        every = [(i, t) for i in range(6) for t in (f"{line}\n{own[:50]} {i}-a {LONG[:80]}", f"{own[:50]} {i}-b {LONG[-90:]}\n{line}")]
        got = clean(every)
        assert len(got) == 12 and sum(line in t for _, t in got) == 1


def test_hot_bands_give_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in range(40)]
    lines = []
    for i in range(900):
        words = list(base)
        words[int(rng.integers(0, 40))] = f"other{i}"
        lines.append(" ".join(words))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(5)
    plain = {r.doc_id for r in line_dedup.dedup_lines(spark, docs, shingle=5)[1].select("doc_id").collect()}
    monkeypatch.setattr(line_dedup, "HOT_SEEN", 1)
    monkeypatch.setattr(line_dedup, "BUCKET", 1000)
    assert {r.doc_id for r in line_dedup.dedup_lines(spark, docs, shingle=5)[1].select("doc_id").collect()} == plain == set(range(1, 900))


def test_a_very_long_line(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG.replace("w77 ", "q ")), (3, "x\n" * 5000 + LONG)], "doc_id long, text string")
    out, gone = line_dedup.dedup_lines(spark, docs)
    assert {(r.doc_id, r.line) for r in gone.collect()} == {(2, 0), (3, 5000)}


# WARC


def _record(kind, fields, block):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\xff\x00 bytes</html>" * 90
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"
    blob = _record("warcinfo", {}, b"software: x") + _record("request", {"WARC-Target-URI": "http://a"}, b"GET / HTTP/1.1\r\n\r\n")
    blob += _record("response", {"WARC-Target-URI": "http://a", "WARC-Payload-Digest": f"sha1:{b32}"}, http + body)
    blob += _record("response", {"WARC-Target-URI": "http://b", "WARC-Payload-Digest": "sha256:abc", "X-Page-Id": "seven"}, http + b"b")
    blob += _record("response", {"WARC-Target-URI": "http://c"}, b"no http head")
    blob += _record("response", {"WARC-Target-URI": "http://d", "WARC-Payload-Digest": "sha1:" + "A" * 32}, http + b"d")
    blob += _record("revisit", {"WARC-Target-URI": "http://e", "WARC-Payload-Digest": f"SHA-1:{b32.lower()}", "WARC-Refers-To": "<urn:uuid:1>"}, http)
    blob += gzip.compress(b"no record") + _record("response", {"WARC-Target-URI": "http://f", "X-Page-Id": "-3"}, http + gzip.compress(b"inner"))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(blob)
    files = spark.createDataFrame([(str(path), len(blob))], "path string, size long")
    for split in (64, 700, 1 << 20):
        got = {r.url[-1]: r for r in warc.read_warc(files, split).collect()}
        assert sorted(got) == list("abcdef")
        assert bytes(got["a"].payload) == body and got["a"].payload_digest == hashlib.sha1(body).hexdigest() and got["a"].error is None
        assert (bytes(got["b"].payload), got["b"].page_id, got["b"].error, bytes(got["c"].payload)) == (b"b", None, None, b"") and got["d"].error is not None
        assert (got["e"].record_type, got["e"].payload, got["e"].payload_digest, got["e"].refers_to, got["e"].payload_bytes) == ("revisit", None, hashlib.sha1(body).hexdigest(), None, None)
        assert got["f"].page_id == -3 and gzip.decompress(got["f"].payload) == b"inner"


def test_one_hot_payload_and_many_empty_pages(spark, tmp_path):
    big, other = "<p>error" * 300, "<p>rare" * 200
    rows = [(i, big) for i in range(300)] + [(300 + i, "") for i in range(200)] + [(500, other), (501, other), (502, None)]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(spark, pages, str(tmp_path / "w"), Scratch(spark, "t"))).collect()}
    assert len(got) == 503 and all(got[i].refers_to == (299 if i < 299 else None) for i in range(500))
    assert got[500].refers_to == 501 and got[501].record_type == "response" and got[502].payload_bytes == 0


# Media


def test_foreign_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("pictures/", "")
        z.writestr("pictures/cat.jpg", b"\xff\xd8 cat", zipfile.ZIP_STORED)
        z.writestr("5_3_0.wav", media.to_wav(b"abc" + bytes(61)), zipfile.ZIP_DEFLATED)
        z.writestr("odd.bz", b"x" * 500, zipfile.ZIP_BZIP2)
        z.writestr("long.bin", bytes(100_000), zipfile.ZIP_STORED)
    (tmp_path / "b.zip").write_bytes(b"no archive at all" * 300)
    for split in (512, 1 << 24):
        got = {(r.name or r.archive[-5:]): r for r in media.read_media(spark, str(tmp_path), split_bytes=split).collect()}
        assert sorted(got) == ["5_3_0.wav", "b.zip", "long.bin", "odd.bz", "pictures/cat.jpg"]
        assert bytes(got["pictures/cat.jpg"].media) == b"\xff\xd8 cat" and got["pictures/cat.jpg"].member_id is None and len(got["long.bin"].media) == 100_000
        assert (got["5_3_0.wav"].member_id, got["5_3_0.wav"].n_bytes, got["5_3_0.wav"].error) == (5, 3, None)
        assert got["odd.bz"].error and got["odd.bz"].media is None and got["b.zip"].error


def test_features_by_the_plain_formulas(spark, tmp_path):
    texts = ["", "abc", "é" * 100, LONG[:5000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = media.write_media(docs, str(tmp_path / "m"), Scratch(spark, "t"))
    got = {r.doc_id: r.feature for r in media.media_features(media.read_media(spark, str(tmp_path / "m"), files)).collect()}
    for k, t in enumerate(texts):
        raw = t.encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        x = [b - 128 for b in raw]
        mean, level = sum(x) / len(x), math.sqrt(sum(v * v for v in x) / len(x))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        frames = [x[i : i + 64] for i in range(0, len(x), 64)]
        power = [sum(abs(sum(v * complex(math.cos(2 * math.pi * f * i / 64), -math.sin(2 * math.pi * f * i / 64)) for i, v in enumerate(y))) for y in frames) / len(frames) for f in range(33)]
        centre = sum(p * f for f, p in enumerate(power)) / sum(power)
        parts = dict(p.split("=") for p in got[k].split(";"))
        assert int(parts["crossings"]) == crossings
        assert all(abs(float(parts[n]) - v) < 2e-4 for n, v in (("mean", mean), ("rms", level), ("centre", centre)))


# Quotations


def _threads(seed, n):
    """Conversations whose messages quote earlier ones: whole, by line, by sentence, nested, edited, wrapped, repeated."""
    rng, rows = np.random.default_rng(seed), []
    words = [f"word{i}" for i in range(30)]
    sentence = lambda: " ".join(rng.choice(words, rng.integers(2, 7))).capitalize() + ".!?"[int(rng.integers(0, 3))]
    for conv in range(n):
        texts: list = []
        for turn in range(int(rng.integers(2, 12))):
            own = [" ".join(sentence() for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(0, 4)))]
            text = "\n".join([own[0], "", *own[1:]] if len(own) > 2 else own)
            if texts and rng.random() < 0.8:
                other = texts[int(rng.integers(0, len(texts)))]
                lines = other.split("\n")
                kind = int(rng.integers(0, 6))
                if kind == 1:
                    lines = [lines[int(rng.integers(0, len(lines)))]]
                elif kind == 2:
                    lines = [x.upper().replace(" ", "   ") for x in lines]
                elif kind == 3:
                    lines = [x.replace("word1", "changed") for x in lines]
                elif kind == 4:
                    lines = [y for x in lines for y in (x[: len(x) // 2], x[len(x) // 2 :])]
                elif kind == 5:
                    lines = [*lines, "never said by anyone"]
                mark = ["> ", ">", " > ", ">> "][int(rng.integers(0, 4))]
                quoted = "\n".join(mark + x for x in lines)
                text = f"{quoted}\n{text}" if rng.random() < 0.7 else f"{text}\r\n{quoted}"
            texts.append(text)
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
            if rng.random() < 0.03:
                rows.append(rows[-1])
    return [*rows, (None, 1, "user", "> word1"), (None, 1, "user", "x"), (5, None, "user", "> y\nz"), (10**9, 0, None, None), (10**9, 1, "user", ""), (10**9, 2, "user", ">\n> \n")]


def test_quotations_equal_the_sql(spark, tmp_path):
    rows = _threads(2, 150)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.execute(quotations.ORACLE)
    columns = [c[0] for c in theirs.description]
    want = sorted(map(repr, theirs.fetchall()))
    ours = queries()["op5_quotations"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(repr(tuple(r)) for r in ours) == want
    assert sum(r.reply_to is not None for r in ours) > 300 and max(r.depth for r in ours) >= 3


# Toxicity


def test_learning_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(300)]
    labels = np.array([float(3 in r or 17 in r) for r in rows])
    place, weight = toxicity.learn(rows, labels, epochs=2)
    z, n, end = {}, {}, 1 << toxicity.BITS

    def w(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(2):
        for k in np.argsort(tb.mix64(np.arange(300, dtype=np.uint64) + np.uint64(epoch * 1_000_003))):
            at = [*rows[k].tolist(), end]
            g = 1 / (1 + math.exp(-sum(w(i) for i in at))) - labels[k]
            for i, old in [(i, w(i)) for i in at]:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * old, n.get(i, 0.0) + g * g
    assert {p: round(v, 9) for p, v in zip(place.tolist(), weight.tolist(), strict=True)} == {i: round(w(i), 9) for i in z if w(i) != 0} and len(place) > 2


def test_scores_need_only_places_with_a_weight():
    texts = [LONG[:2000], "", "a b c a b", "the same words, the same words"]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    table = np.where(np.arange(1 << toxicity.BITS) % 3 == 0, 1.5, 0.0)
    row, at = toxicity._places(raw_ := np.frombuffer(raw, np.uint8), off)
    few, some = toxicity._places(raw_, off, table != 0)
    assert np.allclose(np.bincount(row, table[at], 4), np.bincount(few, table[some], 4)) and len(some) < len(at)


# Quality


def test_quality_on_rows_outside_the_fit(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    outside = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    model = quality.fit(spark, docs, labels.where(~outside))
    graded = quality.score(spark, docs, model).join(labels.where(outside), "doc_id").collect()
    assert len(graded) > 50 and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in graded]) > 0.95


def test_views_learn_from_each_other(spark):
    # Labelled rows: the words say nothing new of group B; the source, which the metadata view sees, does.
    rng, rows, labels = np.random.default_rng(4), [], []
    for i in range(3000):
        good, late = bool(i % 2), i >= 400
        pool = ["alpha", "beta"] if good else ["gamma", "delta"]
        new = (["fresh", "novel"] if good else ["stale", "trite"]) if late else []
        words = [*rng.choice([*pool, *new], 12), *rng.choice([f"c{k}" for k in range(50)], 30)]
        rows.append((i, " ".join(words), "en", "site-a" if good else "site-b", 200))
        if not late:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    probe = spark.createDataFrame([(1, "fresh novel fresh", "en", None, 200), (0, "stale trite stale", "en", None, 200)], docs.schema)
    score = lambda rounds: {r.doc_id: r.text_score for r in quality.score(spark, probe, quality.fit(spark, docs, marks, rounds=rounds)).collect()}
    before, after = score(0), score(3)
    assert after[1] - after[0] > before[1] - before[0] + 0.05 and after[1] > after[0]


def test_contradicting_labels(spark):
    texts = [(i, f"good words here {i}" if i % 2 else f"bad words there {i}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 10) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = [(i, i % 2, 1 - i % 2) for i, _ in texts]
    twice = [(i, 1, 0) for i, _ in texts if i % 2 == 0]
    one, two = (spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (rows, rows + twice))
    scores = [sorted((r.doc_id, round(r.score, 6)) for r in quality.score(spark, docs, quality.fit(spark, docs, x)).collect()) for x in (one, two)]
    assert scores[0] == scores[1]  # the smallest quality counts
    models = [toxicity.fit(spark, docs, x) for x in (one, two)]
    assert all((a == b).all() for a, b in zip(*models, strict=True))  # and the largest toxicity


# Decontamination


def test_contamination_equals_alignment_of_all_pairs(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    cut = str.maketrans({c: " " for c in map(chr, range(33, 127)) if not c.isalnum()})
    code: dict = {}
    words = lambda t: np.array([code.setdefault(w, len(code)) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "").translate(cut)).split()])
    texts, asked = {r.doc_id: words(r.text) for r in docs.collect()}, {r.item_id: words(r.text) for r in items.select("item_id", "text").collect()}
    want = set()
    for i, x in asked.items():
        for d, t in texts.items():
            if np.isin(x, t).sum() >= decontaminate.MIN_SCORE * len(x) and decontaminate.align(x, t)[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(x):
                want.add((d, i))
    got = decontaminate.contamination(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, decontaminate.contamination(spark, docs, items).collect())) == sorted(map(tuple, got.collect()))


def test_short_items_and_rows_of_one_id(spark):
    items = spark.createDataFrame([(1, "Open, sesame!"), (2, "Abracadabra"), (3, "one two three four five six"), (4, " ., ")], "item_id long, text string")
    rows = [(1, "Then say open sesame and go in"), (2, "sesame open"), (3, "abracadabra abracadabra"), (None, "one two three four five six"), (None, "nothing here at all"), (7, "nothing here either"), (7, "x one two three four five six y")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, item_id string, pos int")
    got = sorted((r.doc_id or 0, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.contamination(spark, docs, items).collect())
    assert got == [(0, 3, 1.0, 0, 6), (1, 1, 1.0, 2, 4), (3, 2, 1.0, 0, 1), (3, 2, 1.0, 1, 2), (7, 3, 1.0, 1, 7)]


# Licences

TEXTS = {
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def test_licence_texts(spark):
    import textwrap

    rows, want = [], []
    for title, text in TEXTS.items():
        for width in (72, 10_000):
            rows.append((len(rows), "Prose.\n\n" + "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n\n")) + "\n\nProse"))
            want.append(title)
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [(t, 0) for t in want]


# Mixing


def test_mixture_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b", "s")] * 3 + [(1, "c d", "s"), (None, "e f", "s"), (None, "e f", "s"), (2, LONG, None), (3, None, "s"), (4, "", "t")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, twin int")
    placed, out = curriculum.placed(spark, docs).collect(), curriculum.mixture(spark, docs).collect()
    assert len(placed) == len(rows) and len(out) == sum(len(r.positions) for r in placed)
    for key in {r[:3] for r in rows}:
        mine = [r for r in out if (r.doc_id, r.text, r.source) == key]
        same = sum(r[:3] == key for r in rows)
        assert len({r.twin for r in mine}) == min(same, len(mine))


@pytest.mark.parametrize("name", ["op1_warc", "op4_media", "op10_mixing"])
def test_reruns_agree(spark, name):
    one, two = (sorted(map(repr, queries()[name](spark, SF).collect())) for _ in range(2))
    assert one == two
