"""Importance resampling and the filter audit against plain statements of their rules."""

import hashlib
import math
import os
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest

from cuelake.llm import filter_audit, importance
from cuelake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i} " for i in range(20_000)) + "x" * 70_000


@pytest.mark.parametrize("name", ["op12_importance", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours, theirs = queries()[name](spark, SF).toPandas(), con.sql(oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda frame: sorted(tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))
    by = lambda r: tuple(str(v) for v in r)
    assert sorted(rows(ours), key=by) == sorted(rows(theirs), key=by)


# Importance resampling


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _grams(text, n):
    words = _words(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _plain(rows, target, n, percent=10, min_words=20):
    place = lambda g: zlib.crc32(g.encode()) % importance.BUCKETS
    s, t = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for _, text in rows:
        for g in _grams(text, n):
            s[place(g)] += 1
    for text in target:
        for g in _grams(text, n):
            t[place(g)] += 1
    out = []
    for i, text in rows:
        weight = sum(math.floor(1000 * math.log((t[place(g)] + 1) * (s.sum() + 10000) / ((s[place(g)] + 1) * (t.sum() + 10000)))) for g in _grams(text, n))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(_grams(text, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text))])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    k = percent * len(able) // 100
    ranks: dict = {}
    for at, r in enumerate(able[:k]):
        ranks.setdefault(tuple(map(str, r[:4])), []).append(at + 1)
    result = []
    for r in out:
        mine = ranks.get(tuple(map(str, r[:4])), [])
        result.append((*r[:4], mine.pop(0) if mine and r[4] >= min_words else None))
    return sorted(map(str, result))


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (1, 100), (3, 35), (2, 0)])
def test_draw_equals_the_plain_rule(spark, n, percent):
    rng = np.random.default_rng(n)
    text = lambda k: " ".join(f"{'Aé'[j % 2]}{rng.integers(0, 40)}" for j in range(k))
    rows = [(i, text(int(rng.integers(0, 60)))) for i in range(120)] + [(None, text(30)), (None, None), (7, text(25)), (-(1 << 63), text(40)), ((1 << 63) - 1, text(22)), (300, ""), (301, LONG), (302, "--- !!")]
    rows += [(500, "same words over and over " * 9)] * 12 + [(None, "same words over and over " * 9)] * 3
    target = [text(50), None, "", "same"]
    docs = spark.createDataFrame([(i, x, "other", 1) for i, x in rows], "doc_id long, text string, rank string, weight int").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(spark, docs, bench, n=n, percent=percent)
    assert sorted(str(tuple(r)) for r in got.collect()) == _plain(rows, target, n, percent)


def test_cutoff_of_ties(spark):
    scores = [5, 5, 5, 5, 9, 9, 1, 1, 1, -(10**6)]
    rows = spark.createDataFrame([(i, 30, 30, 0, s) for i, s in enumerate(scores)], "doc_id long, n_words long, n_features long, weight long, score long")
    for wanted in range(11):
        at, last = importance.cutoff(rows, wanted) if wanted else (9, -(1 << 63))
        got = sorted(i for i, s in enumerate(scores) if s > at or s == at and i <= last)
        assert got == sorted(sorted(range(10), key=lambda i: (-scores[i], i))[:wanted])


def test_nothing_to_draw_from(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(spark, docs, bench).collect() == []
    got = importance.resample(spark, spark.createDataFrame([(1, None), (2, "a b")], docs.schema), bench).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 0, None), (2, 2, None)]


# Filter audit


def _audit(rows, labels):
    marks: dict = {}
    for i, q, t in labels:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, q or 0), max(b, t or 0))
    key = lambda i: (i is None, i)
    judged = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        f += "E" * any((x or "") == text and ((j is not None and i is None) or (j is not None and i is not None and j < i)) for j, x, _ in rows)
        judged.append((lang or "", f, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part in {r[0] for r in judged}:
        total = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = [r for r in judged if r[0] == part]
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                redundant = sum(1 for r in judged if r[0] == part and f in r[1]) - len(gone)
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                unique = sum(1 for r in judged if r[0] == part and r[1] == f)
                lines.append([part, "".join(order), step + 1, len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*x[:9], total[x[9]]) for x in lines]
    return sorted(out)


def test_audit_equals_the_plain_rule(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a b", long, long + " X#", "REPEAT " * 300, "ÀÉ" * 40, LONG, "a|b " * 210, long.replace("w1", "W1")]
    rows = [(i, texts[int(rng.integers(0, len(texts)))], ["en", "de", None, ""][int(rng.integers(0, 4))]) for i in range(90)]
    rows += [(None, long, "en"), (None, "only here", "en"), (None, "only here", "de"), (3, rows[3][1], rows[3][2]), (4, "other", "fr"), (200, long, "en"), (201, None, "fr")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, 1), (6, 1, None)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, mask string, good boolean").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == _audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_fields_do_not_run_over():
    most = (1 << 63) - 1
    values = [most, 0, 1, most, most]
    assert filter_audit.unpack(filter_audit.pack(values), 5) == values
    assert filter_audit.unpack(filter_audit.pack([1, 0, 1]) * most, 3) == [most, 0, most]
