"""Phrases in long media and whole corpora, intervals of any length, subtitle files: against plain rules, and by their plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import audio, clip, intervals, match, phrase_index

PIECES = "request_id long, media_id long, piece_idx int, phrase string"


def _tokens(spark, media):
    """Tokens of 10 ms a character; ``media``: id -> sentences of tokens."""
    rows = []
    for medium, sentences in media.items():
        at = 0
        for s, words in enumerate(sentences):
            for k, w in enumerate(words):
                rows.append((medium, s, k, w, at, at + 10 * len(w)))
                at += 10 * len(w)
    return spark.createDataFrame(rows, "media_id long, sent_idx long, tok_idx int, token string, start_ms long, end_ms long")


def _plain(media, pieces):
    out = []
    for request, medium, piece, phrase in pieces:
        flat = [w for s in media.get(medium, []) for w in s]
        raw, times, t = " ".join(flat), [], 0
        for w in flat:
            times.append((t, t + 10 * len(w)))
            t += 10 * len(w)
        n, at, hits = len(phrase.split()), 0, []
        while (at := raw.find(phrase, at)) >= 0 and raw:
            hits.append(raw[:at].count(" "))
            at += n
        out += [(request, piece, k, times[i][0], times[i + n - 1][1]) for k, i in enumerate(hits) if i + n <= len(times)]
    return sorted(out)


def _got(spark, media, pieces):
    index = phrase_index.positions(_tokens(spark, media))
    found = phrase_index.phrase_match(spark.createDataFrame(pieces, PIECES), index)
    return sorted((r.request_id, r.piece_idx, r.occurrence, r.start_ms, r.end_ms) for r in found.collect())


def test_index_equals_the_rule_on_random_phrases(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join("ab"[k] for k in rng.integers(0, 2, int(rng.integers(1, 4))))
    media = {m: [[word() for _ in range(int(rng.integers(1, 9)))] for _ in range(int(rng.integers(1, 12)))] for m in range(12)}
    pieces = []
    for k in range(300):
        m = int(rng.integers(0, 13))
        raw = " ".join(w for s in media.get(m, [["a", "b"]]) for w in s)
        a = int(rng.integers(0, len(raw)))
        pieces.append((k, m, k % 3, raw[a : a + int(rng.integers(1, 14))] if k % 5 else " ".join(word() for _ in range(1 + k % 4))))
    pieces = [p for p in pieces if p[3].strip()]
    assert _got(spark, media, pieces) == _plain(media, pieces)


@pytest.mark.parametrize("phrase", ["a a a", "a a a a", " a a a", "a b a b a", "aa", "a  a", "a a a ", r"\E a", "ab ab ab ab ab"])
def test_phrases_that_overlap_themselves(spark, phrase):
    media = {1: [["a"] * 7, ["b"], ["a"] * 12], 2: [["a", "b"] * 9, ["aaaa", "aa", "a"], ["ab"] * 14], 3: [[r"\E", "a"]]}
    pieces = [(m, m, 0, phrase) for m in (1, 2, 3, 4)]
    assert _got(spark, media, pieces) == _plain(media, pieces)


def test_chains_run_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "CHAIN", 7)
    media = {1: [["a"] * 50, ["b", "a"], ["a"] * 41]}
    pieces = [(1, 1, 0, "a a a"), (2, 1, 0, "a a a a a")]
    assert _got(spark, media, pieces) == _plain(media, pieces)


def test_a_medium_of_five_million_tokens(spark):
    """All tokens in one medium: many tasks, and no row that holds more than a token of it."""
    n = 5_000_000
    rows = spark.range(0, n, 1, 16).select(F.lit(1).cast("long").alias("media_id"), F.floor(F.col("id") / 10).alias("sent_idx"), (F.col("id") % 10).cast("int").alias("tok_idx"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("token"), (F.col("id") * 20).alias("start_ms"), (F.col("id") * 20 + 20).alias("end_ms"))
    three = [r.token for r in rows.where("sent_idx = 123456").orderBy("tok_idx").limit(3).collect()]
    pieces = spark.createDataFrame([(1, 1, 0, " ".join(three)), (2, 1, 0, three[0][:-1] + "0 nothing"), (3, 1, 0, three[1])], PIECES)
    found = phrase_index.phrase_match(pieces, phrase_index.positions(rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan
    got = found.collect()
    assert (1, 1_234_560 * 20, 1_234_563 * 20) in {(r.request_id, r.start_ms, r.end_ms) for r in got}
    assert sum(r.request_id == 3 for r in got) == rows.where(F.contains("token", F.lit(three[1]))).count() and not any(r.request_id == 2 for r in got)


def _corpus_rule(docs, phrases):
    tokens = lambda t: re.findall(r"[一-鿿]|[\w-]+", t or "")
    out = []
    for item, phrase in phrases:
        p = " ".join(tokens(phrase))
        for doc, text in docs:
            raw, at = " ".join(tokens(text)), -1
            while p and (at := raw.find(p, at + 1)) >= 0:
                out.append((item, doc, raw[:at].count(" ")))
    return sorted(out)


@pytest.mark.parametrize("most", [10_000, 5])
def test_corpus_phrases_of_any_length(spark, most):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("abc"[int(k)] * int(rng.integers(1, 3)) for k in rng.integers(0, 3, n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "你好 world a-b, c"), (102, "aa aa")]
    phrases = [(k, docs[k % 60][1][a : a + int(rng.integers(3, 60))]) for k, a in enumerate(rng.integers(0, 20, 40).tolist())] + [(200, "好 world a"), (201, None), (202, "!"), (203, text(9))]
    short = [p for p in phrases if len(re.findall(r"[一-鿿]|[\w-]+", p[1] or "")) < 4]
    phrases = [p for p in phrases if p not in short or most > 5]
    found = phrase_index.corpus_phrases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(phrases, "item_id long, phrase string"), most)
    assert sorted(map(tuple, found.collect())) == _corpus_rule(docs, phrases)


def test_covers_are_disjoint_and_short(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(-500, 5000, (800, 2))] + [(0, 10**12), (-(10**11), 10**11), (-5, 1 << 60), (-(1 << 61), 1 << 61), (7, 8), (5, 5), (1, 3 * 3_600_000)]
    covered = spark.createDataFrame(rows, "a long, b long").withColumn("c", intervals.cover(F.col("a"), F.col("b"), 10)).collect()
    for r in covered:
        spans = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.c)
        assert len(spans) <= 2 * max(1, (r.b - r.a).bit_length())
        if r.a < r.b:
            assert spans[0][0] == r.a // 10 and spans[-1][1] == (r.b - 1) // 10 + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        else:
            assert not spans


def test_a_long_period_is_few_rows(spark):
    """A period of three hours against text and samples: under 60 rows, not one for each block of it."""
    hours = 3 * 3_600_000
    for width, length in ((clip.BLOCK_MS, hours), (audio.BLOCK, hours * 16)):
        assert spark.range(1).select(F.size(intervals.cover(F.lit(333), F.lit(333 + length), width)).alias("n")).first().n < 60
    lines = spark.createDataFrame([(1, k, ["t"], [(k * 10_000, k * 10_000 + 900)]) for k in range(2000)], "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>")
    cut = spark.createDataFrame([(1, 1, "audio", 0, 5000, 5000 + hours), (2, 1, "audio", 0, 0, 100)], "request_id long, media_id long, modality string, seg_idx int, cue_start_ms long, cue_end_ms long")
    found = clip.partial_sentences(cut, lines).collect()
    assert len(found) == sum(5000 < k * 10_000 + 900 <= 5000 + hours for k in range(2000))
    chunks = spark.createDataFrame([(1, 0, 0, [0.5] * 9000), (1, 1, 9000, [0.25] * 10), (1, 2, 9010, [])], "media_id int, chunk_idx int, start_sample long, samples array<double>")
    periods = spark.createDataFrame([(1, 0, 8990, 1 << 40), (1, 1, -5, 3), (1, 2, 100, 100), (1, 3, 9009, 9011)], "media_id int, seg_idx int, start_sample long, end_sample long")
    got = sorted((r.seg_idx, r.chunk_idx, r.first_sample, len(r.samples)) for r in audio.cut_samples(chunks, periods).collect())
    assert got == [(0, 0, 8990, 10), (0, 1, 9000, 10), (1, 0, 0, 3), (3, 1, 9009, 1)]


def test_modes_and_blanks(spark):
    media = spark.createDataFrame([(1, "p", "audio", True, 9)], "media_id long, path string, modality string, has_spk boolean, n_ms long")
    rows = [(1, 1, None, " "), (2, 1, None, ""), (3, 1, None, None), (4, 1, None, "\t")]
    asked = spark.createDataFrame([(*r, None, 0, 0) for r in rows], "request_id long, media_id long, dest_text string, dest_spk string, llm_response string, start_ost int, end_ost int")
    assert [r.mode for r in match.request_mode(asked, media).orderBy("request_id").collect()] == ["speaker", "phrase", "phrase", "speaker"]
    texts = spark.createDataFrame([(1, 1, "\t#a# \n#　")], "request_id long, media_id long, dest_text string")
    assert [r.phrase for r in match.request_pieces(texts).collect()] == ["a"]
