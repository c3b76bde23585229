"""Files that a recogniser leaves, speakers from a diarisation with cuts of its own, and media on disk, each against a plain rule."""

import os
import random

from pyspark.sql import functions as F

from cuelake.operators import diarise, match
from cuelake.sources import media_files, states

TABLE = "media_id long, sent_idx int, spk int, text string, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>"


def _one(media, idx, spk, start, end):
    mid = (start + end) // 2
    return (media, idx, spk, "a b", ["a", "b"], [(start, mid), (mid, end)])


def _random_lists(seed):
    rng, own, said = random.Random(seed), [], []
    for media in range(6):
        for out, length, with_spk in ((own, 3000, False), (said, 5000, True)):
            at = rng.randrange(2000)
            for idx in range(40):
                end = at + rng.randrange(length)
                out.append(_one(media, idx, rng.randrange(3) if with_spk else None, at, end))
                at = end + rng.choice([0, 0, 700])
    said.append(_one(0, 40, 2, -5000, 900_000))  # one turn over the whole of a medium
    return own, said


def _plain(own, said):
    out = {}
    for m, idx, _, _, _, times in own:
        ms = {}
        for m2, _, spk, _, _, turn in said:
            if m == m2 and spk is not None:
                shared = min(times[-1][1], turn[-1][1]) - max(times[0][0], turn[0][0])
                if shared > 0:
                    ms[spk] = ms.get(spk, 0) + shared
        best = min(ms, key=lambda s: (-ms[s], s)) if ms else None
        out[m, idx] = (best, ms.get(best, 0))
    return out


def test_speakers_by_shared_time(spark):
    for seed in range(2):
        own, said = _random_lists(seed)
        got = diarise.with_speakers(spark.createDataFrame(own, TABLE), spark.createDataFrame(said, TABLE)).collect()
        assert len(got) == len(own) and {(r.media_id, r.sent_idx): (r.spk, r.overlap_ms) for r in got} == _plain(own, said)


def test_sentences_without_turns_and_turns_without_speakers(spark):
    own = spark.createDataFrame([_one(1, 0, 7, 0, 1000), _one(2, 0, 7, 0, 1000), _one(3, 0, 7, 500, 500)], TABLE)
    said = spark.createDataFrame([_one(1, 0, None, 0, 1000), _one(2, 0, 4, 1000, 2000), _one(3, 0, 1, 0, 1000)], TABLE)
    assert {(r.media_id, r.spk, r.overlap_ms) for r in diarise.with_speakers(own, said).collect()} == {(1, None, 0), (2, None, 0), (3, None, 0)}
    assert diarise.with_speakers(own, said.limit(0)).where("spk is null").count() == 3 and diarise.with_speakers(own.limit(0), said).count() == 0


def test_lists_come_back_and_damage_is_told(spark, tmp_path):
    own, said = _random_lists(3)
    a, b = spark.createDataFrame(own, TABLE), spark.createDataFrame(said, TABLE)
    path = str(tmp_path / "state")
    states.write_state(states.state_lines(a, b), path)
    bad = [
        ("sentences", "no json"), ("sentences", '{"media_id": 90, "sent_idx": 0, "tok'), ("sentences", '{"media_id": "x", "sent_idx": 1, "tokens": ["a"], "timestamp": [[0, 1]]}'),
        ("sentences", '{"sent_idx": 2, "tokens": ["a"], "timestamp": [[0, 1]]}'), ("sentences", '{"media_id": 91, "sent_idx": 3, "tokens": [], "timestamp": []}'),
        ("sentences", '{"media_id": 91, "sent_idx": 4, "tokens": ["a"], "timestamp": [[0]]}'), ("sentences", '{"media_id": 91, "sent_idx": 5, "tokens": ["a"]}'),
        ("sd_sentences", '{"media_id": 91, "sent_idx": 6, "tokens": ["a"], "timestamp": [[0, 1]]}'), ("sentences", '{"media_id": 92, "sent_idx": 7, "tokens": ["a"], "timestamp": [[0, 1]], "more": 1}'),
    ]
    spark.createDataFrame(bad, "list string, value string").write.mode("append").partitionBy("list").text(path)
    state = states.read_state(spark, path)
    assert sorted(map(str, state.diarised.collect())) == sorted(map(str, b.collect()))
    assert sorted(map(str, state.sentences.where("media_id < 90").collect())) == sorted(map(str, a.collect()))
    assert [(r.media_id, r.sent_idx, r.text) for r in state.sentences.where("media_id >= 90").collect()] == [(92, 7, None)]
    got = {(r.list, r.media_id, r.sent_idx, r.reason, r.record) for r in state.rejects.collect()}
    assert got == {
        ("sentences", None, None, "not readable", bad[0][1]), ("sentences", None, None, "not readable", bad[1][1]), ("sentences", None, None, "not readable", bad[2][1]),
        ("sentences", None, 2, "no medium or number", None), ("sentences", 91, 3, "no token", None), ("sentences", 91, 4, "tokens and times differ in number", None),
        ("sentences", 91, 5, "tokens and times differ in number", None), ("sd_sentences", 91, 6, "no speaker", None),
    }


def test_a_folder_without_diarisation(spark, tmp_path):
    own, said = _random_lists(4)
    path = str(tmp_path / "state")
    states.write_state(states.state_lines(spark.createDataFrame(own, TABLE)), path)
    state = states.read_state(spark, path)
    assert state.sentences.count() == len(own) and state.diarised.count() == 0 and state.rejects.count() == 0


def test_named_speakers_are_looked_up_in_the_diarised_list(spark, tmp_path):
    own, said = _random_lists(5)
    path = str(tmp_path / "state")
    states.write_state(states.state_lines(spark.createDataFrame(own, TABLE), spark.createDataFrame(said, TABLE)), path)
    asked = spark.createDataFrame([(1, 2, "spk1#spk0")], "request_id long, media_id long, dest_spk string")
    got = match.speaker_match(asked, match.envelopes(states.read_state(spark, path).diarised)).collect()
    want = {(k, idx, t[0][0], t[-1][1]) for k, who in ((0, 1), (1, 0)) for m, idx, spk, _, _, t in said if m == 2 and spk == who and t[-1][1] - t[0][0] > 999}
    assert {(r.piece_idx, r.occurrence, r.start_ms, r.end_ms) for r in got} == want and len(got) == len(want)


def test_a_scan_lists_files_and_reads_none(spark, tmp_path):
    for name, size in (("a b/x.WAV", 3), ("a b/c/y.mkv", 4), ("empty.mp4", 0), ("_hidden/w.mp4", 1), ("z.txt", 5), ("plain", 1), ("ü.mp4", 2)):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    rows = media_files.scan(spark, str(tmp_path))
    assert {(r.path, r.n_bytes, r.modality, r.reason) for r in rows.collect()} == {
        ("a b/x.WAV", 3, "audio", None), ("a b/c/y.mkv", 4, "video", None), ("z.txt", 5, None, "unsupported file"), ("plain", 1, None, "unsupported file"), ("ü.mp4", 2, "video", None)
    }
    assert rows.select(F.countDistinct("media_id")).first()[0] == 5
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and {r.path for r in media_files.scan(spark, str(tmp_path), "*.mkv").collect()} == {"a b/c/y.mkv"}
