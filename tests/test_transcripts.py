import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cuelake import plans
from cuelake.functions.text import detokenize, normalize_phrase, tokenize
from cuelake.functions.timecode import format_time, parse_time
from cuelake.operators import audio, checks, clip, match, prompts
from cuelake.sources import transcripts as src_transcripts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(frame, columns):
    plain = lambda v: None if v is pd.NA or v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str(tuple(plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    ours, theirs = plans.queries()[name](spark, SF).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours, sorted(ours.columns)) == _rows(theirs, sorted(ours.columns))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("ms", "text"), [(0.0, "00:00:00,000"), (3_723_004.9, "01:02:03,004"), (-50.0, "-1:59:59,950"), (360_000_000.0, "100:00:00,000"), (59_999.0, "00:00:59,999")])
def test_time_codes(spark, ms, text):
    assert _one(spark, format_time(F.col("ms")), ms=ms) == text
    if ms >= 0:
        assert _one(spark, parse_time(F.col("t")), t=text) == int(ms)


def test_short_milliseconds_are_whole_numbers(spark):
    assert _one(spark, parse_time(F.col("t")), t="00:00:01,50") == 1050
    assert _one(spark, parse_time(F.col("t")), t="no time") is None


@pytest.mark.parametrize("text", ["你好 world-1 试 abc中文", "don't stop", "", "été 2024年", "a_b 𝒳 １２"])
def test_tokens_follow_the_rule(spark, text):
    assert _one(spark, tokenize(F.col("t")), t=text) == re.findall(r"[一-鿿]|[\w-]+", text)


def test_detokenize_and_normalize(spark):
    assert _one(spark, detokenize(F.split("t", " ")), t="你 好 big world 吗 。") == "你好 big world吗 "  # only marks are stripped at the end
    assert _one(spark, normalize_phrase(F.col("t")), t="你好，world! 吗") == "你 好 world 吗"


def _python_starts(raw, phrase):
    at, out, n = 0, [], len(phrase.split())
    while (at := raw.find(phrase, at)) >= 0:
        out.append(raw[:at].count(" "))
        at += n
    return out


@pytest.mark.parametrize(("raw", "phrase"), [("a b a b a b", "a b"), ("aaaa aaa", "aa"), ("the then the", "the"), ("x", "y"), ("a.b a.b", "a.b")])
def test_phrase_starts(spark, raw, phrase):
    assert _one(spark, match.phrase_starts(F.col("r"), F.col("p")), r=raw, p=phrase) == _python_starts(raw, phrase)


def test_ranges_in_text(spark):
    reply = "1. [00:00:00,500-00:00:05,850] a\n2. [00:00:07,120 - 00:00:12,940] b\n3. [00:00:13,24-00:00:25,620] c [1-2]"
    rows = match.text_ranges(spark.createDataFrame([(1, 1, reply), (2, 1, None)], "request_id long, media_id long, llm_response string")).orderBy("occurrence").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(500, 5850), (7120, 12940), (13024, 25620)]


def test_pieces_and_offsets(spark):
    asked = spark.createDataFrame([(1, 1, "a b[10, 20]#[x]#c[y]##d")], "request_id long, media_id long, dest_text string")
    rows = match.request_pieces(asked).orderBy("piece_idx").collect()
    assert [(r.piece_idx, r.phrase, r.offset_b, r.offset_e, r.bracket_failed) for r in rows] == [(0, "a b", 10, 20, False), (2, "c", 0, 0, True), (4, "d", 0, 0, False)]


def test_pcm(spark):
    assert _one(spark, audio.pcm_to_float(F.array(F.lit(-32768).cast("smallint"), F.lit(16384).cast("smallint")), "smallint"), k=1.0) == [-1.0, 0.5]
    assert _one(spark, audio.pcm_to_float(F.array(F.lit(0).cast("tinyint")), "tinyint"), k=1.0) == [-1.0]
    with pytest.raises(TypeError):
        audio.pcm_to_float(F.col("x"), "string")


def test_cue_numbers_are_dense(spark):
    rows = plans.queries()["clip_cues"](spark, SF).toPandas()
    for _, part in rows.groupby("request_id"):
        assert sorted(part.cue_no) == list(range(1, len(part) + 1))


def test_srt_sink(spark, tmp_path):
    table = spark.createDataFrame([(1, "1\na --> b\nx\n"), (2, "1\nc --> d\ny\n")], "media_id long, srt string")
    clip.write_srt(table, str(tmp_path / "srt"), "media_id")
    assert spark.read.text(str(tmp_path / "srt")).count() == 8


def test_manifest_and_routing(spark):
    files = spark.createDataFrame([(1, "a/B.WAV", True), (2, "c.mkv", False), (3, "noext", True)], "media_id long, path string, has_audio boolean")
    assert [(r.modality, r.reason) for r in prompts.media_manifest(files).orderBy("media_id").collect()] == [("audio", None), ("video", "no audio track"), (None, "unsupported file")]
    models = spark.createDataFrame([("g4f-gpt-4",), ("deepseek-x",), ("other",)], "model string")
    assert [(r.provider, r.sent_model, r.base_url) for r in prompts.routed(models).collect()] == [("g4f", "gpt-4", None), ("openai", "deepseek-x", prompts.DEEPSEEK), (None, None, None)]


def test_chunks_are_numbered_without_a_task_a_medium(spark, tmp_path):
    rows = [(i * 7 - 500, i % 2 if i % 11 else None, [float(i), 0.5]) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    chunks = src_transcripts.audio_chunks(spark, str(tmp_path))
    want = {}
    for _, label, samples in rows:
        want.setdefault(label, []).append(samples[0])
    got = {(r.media_id, r.chunk_idx, r.start_sample, r.samples[0]) for r in chunks.collect()}
    assert got == {(m, i, 64 * i, x) for m, xs in want.items() for i, x in enumerate(xs)} and chunks.count() == 3000
    # Within a medium, rows are windowed by range of ids; only the ranges' counts by medium alone.
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert all("part#" in x for x in plan.split("\n") if "row_number" in x and "windowspec" in x)


def test_clips_grow_with_their_media(spark):
    sizes = [plans.queries()["audio_clip_all"](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01")]
    n = [spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").count() for sf in ("sf0.001", "sf0.01")]
    assert sizes[0] < sizes[1] or n[0] == n[1]
    assert audio.cut_samples(_whole(spark), spark.createDataFrame([(1, 0, -5, 1 << 60)], "media_id int, seg_idx int, start_sample long, end_sample long")).selectExpr("sum(size(samples))").first()[0] == 64 * 500


def _whole(spark):
    return spark.range(500).selectExpr("1 AS media_id", "cast(id AS int) AS chunk_idx", "64 * id AS start_sample", "array_repeat(0.5D, 64) AS samples")


@pytest.mark.parametrize(("raw", "phrase"), [("a b c", "b "), ("a b c", " b"), (r"x \E y \E", r"\E"), (r"a\Eb", r"a\Eb"), ("a  b a  b", "a  b")])
def test_blanks_and_quotes_in_phrases(spark, raw, phrase):
    assert _one(spark, match.phrase_starts(F.col("r"), F.col("p")), r=raw, p=phrase) == _python_starts(raw, phrase)


def test_blanks_around_a_phrase_make_no_token(spark):
    times = [(1, 2), (3, 4), (5, 6)]
    script = spark.createDataFrame([(1, "a b c", times)], "media_id long, raw_text string, timestamp array<struct<start_ms:long,end_ms:long>>")
    pieces = spark.createDataFrame([(1, 1, "b "), (2, 1, "c d"), (3, 1, "c"), (4, 2, "a")], "request_id long, media_id long, phrase string")
    assert [(r.request_id, r.start_ms, r.end_ms) for r in match.phrase_match(pieces, script).orderBy("request_id").collect()] == [(1, 3, 4), (3, 5, 6)]
    short = script.withColumn("timestamp", F.slice("timestamp", 1, 2))
    assert [(r.request_id, r.reason) for r in match.phrase_rejects(pieces, short).collect()] == [(3, "no time for a token of the hit")]


def test_requests_on_unknown_media_are_answered(spark):
    requests = src_transcripts.complete_requests(spark.createDataFrame([(1, 5, "x[0, 0]"), (2, 6, "a[0, 0]")], "request_id long, media_id long, dest_text string"))
    assert [(r.start_ost, r.end_ost, r.dest_spk) for r in requests.collect()] == [(0, 0, None)] * 2
    media = spark.createDataFrame([(6, "p.wav", "audio", False, 1000)], "media_id long, path string, modality string, has_spk boolean, n_ms long")
    script = spark.createDataFrame([(6, "a a", [(1, 2), (3, 4)])], "media_id long, raw_text string, timestamp array<struct<start_ms:long,end_ms:long>>")
    lines = spark.createDataFrame([(6, 0, None, "a a", ["a", "a"], [(1, 2), (3, 4)])], "media_id long, sent_idx long, spk int, text string, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>")
    moded = match.request_mode(requests, media)
    found = match.segments(moded, script, lines)
    cut = clip.bounds(found, moded)
    log = {r.request_id: (r.n_periods, r.message) for r in clip.log(moded, cut, clip.timeline(cut, clip.partial_sentences(cut, lines)), match.request_pieces(moded), found).collect()}
    assert log[1] == (0, clip.NOTHING.format("audio")) and log[2][0] == 2 and log[2][1].endswith(clip.SEVERAL)


def test_requests_from_files_and_responses(spark, tmp_path):
    given = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "b", None)], "request_id long, media_id long, dest_text string, end_ost int")
    for kind in ("json", "csv", "parquet"):
        writer = given.write.format(kind)
        (writer.option("header", "true") if kind == "csv" else writer).save(str(tmp_path / kind))
        back = src_transcripts.read_requests(spark, str(tmp_path / kind), kind)
        assert sorted((r.request_id, r.dest_text, r.start_ost, r.end_ost, r.llm_response) for r in back.collect()) == [(1, "a", 0, 5, None), (2, "b", 0, 0, None)]
    answered = src_transcripts.with_responses(back, spark.createDataFrame([(2, "[x]"), (2, "[y]"), (3, "[z]")], "request_id long, response string"))
    assert sorted((r.request_id, r.llm_response or "") for r in answered.collect()) == [(1, ""), (2, "[y]")]


def test_faults_of_transcripts(spark):
    rows = [(1, 0, ["a"], [(0, 5)]), (1, 1, ["a", "b"], [(5, 9)]), (1, 2, ["a"], [(4, 9)]), (1, 3, ["a", "b"], [(20, 30), (25, 28)]), (2, 0, [], []), (2, 1, None, None), (2, 2, ["a"], [(7, 6)]), (3, 0, ["a", "b"], [(1, 2), (2, 3)])]
    table = spark.createDataFrame(rows, "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>")
    got = sorted((r.media_id, r.sent_idx, r.reason) for r in checks.transcript_faults(table).collect())
    number, empty, falls, early = "tokens and times differ in number", "no token", "token times fall", "starts before the sentence ahead"
    assert got == sorted([(1, 1, number), (1, 2, early), (1, 3, falls), (2, 0, empty), (2, 1, number), (2, 1, empty), (2, 2, falls)])
    assert sorted((r.media_id, r.sent_idx) for r in checks.sound(table).collect()) == [(1, 0), (3, 0)]


def test_srt_documents_keep_their_key(spark, tmp_path):
    table = spark.createDataFrame([(1, "1\na --> b\nx\n"), (2, "1\nc --> d\ny\n")], "media_id long, srt string")
    clip.write_srt_documents(table, str(tmp_path / "srt"), "media_id")
    assert sorted(map(tuple, clip.read_srt_documents(spark, str(tmp_path / "srt"), "media_id").collect())) == sorted(map(tuple, table.collect()))


def test_sentences_meet_periods_in_every_minute(spark):
    # One sentence of ten minutes, and short ones; periods inside, across and around them, against the rule on tokens.
    tokens = [("t", s, e) for s, e in zip(range(0, 600_000, 7000), range(5000, 605_000, 7000), strict=False)]
    sents = [(1, 0, tokens)] + [(1, k, [("u", 600_000 + 1000 * k, 600_000 + 1000 * k + 800)]) for k in range(1, 90)]
    lines = spark.createDataFrame([(m, k, [t for t, _, _ in ts], [(a, b) for _, a, b in ts]) for m, k, ts in sents], "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>")
    periods = [(-500, 700), (59_000, 61_000), (0, 10**9), (300_000, 300_000), (119_999, 480_001), (650_000, 655_500), (605_000, 604_000), (10**8, 10**9), (59_999, 60_000)]
    cut = spark.createDataFrame([(k, 1, "video", 0, a, b) for k, (a, b) in enumerate(periods)], "request_id long, media_id long, modality string, seg_idx int, cue_start_ms long, cue_end_ms long")
    got = sorted((r.request_id, r.sent_idx, r.rel_start_ms, r.rel_end_ms, r.text) for r in clip.partial_sentences(cut, lines).collect())
    want = []
    for k, (a, b) in enumerate(periods):
        for _, s, ts in sents:
            part = [t for t in ts if a < t[2] <= b] if ts[0][1] < b else []
            if part:
                want.append((k, s, part[0][1] - a, part[-1][2] - a, " ".join(t[0] for t in part)))
    assert got == sorted(want)
