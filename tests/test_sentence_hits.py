"""Phrases looked for inside sentences, also those that run on into later ones, and cuts by blocks of time: against plain rules, and by their plans."""

import numpy as np
from pyspark.sql import functions as F

from cuelake.operators import clip, phrase_index, running
from cuelake.plans import transcripts
from cuelake.sources import media_files

from test_long_media import PIECES, _plain

PLACED = "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>, places array<int>, n_before long, chars_before long"


def _placed(spark, media):
    rows = []
    for medium, sentences in media.items():
        at = n = chars = 0
        for s, words in enumerate(sentences):
            ends = np.cumsum([len(w) for w in words]).tolist()
            rows.append((medium, s, words, [(at + 10 * (e - len(w)), at + 10 * e) for w, e in zip(words, ends, strict=True)], [e - len(w) + i for i, (w, e) in enumerate(zip(words, ends, strict=True))], n, chars))
            at, n, chars = at + 10 * ends[-1], n + len(words), chars + ends[-1] + len(words)
    return spark.createDataFrame(rows, PLACED)


def test_hits_equal_the_rule(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join("ab"[k] for k in rng.integers(0, 2, int(rng.integers(1, 4))))
    media = {m: [[word() for _ in range(int(rng.integers(1, 5)))] for _ in range(int(rng.integers(1, 90)))] for m in range(6)} | {20: [["a"] * 7, ["a"], ["a"] * 12, ["b", "a"]]}
    pieces = []
    for k in range(300):
        m = int(rng.integers(0, 7))
        raw = " ".join(w for s in media.get(m, [["a", "b"]]) for w in s)
        a = int(rng.integers(0, len(raw)))
        pieces.append((k, m, k % 3, raw[a : a + int(rng.integers(1, 25))]))
    pieces = [p for p in pieces if p[3].strip()] + [(900 + k, 20, 0, p) for k, p in enumerate(["a a a", "a a a a", " a a", "aa", "a ", " b", "a b a"])]
    placed = _placed(spark, media).cache()
    hits = phrase_index.whole_hits(phrase_index.sentence_hits(spark.createDataFrame(pieces, PIECES), placed).cache(), placed).orderBy("request_id", "piece_idx", "at").collect()
    got, seen = [], {}
    for r in hits:
        k = seen[r.request_id, r.piece_idx] = seen.get((r.request_id, r.piece_idx), -1) + 1
        got.append((r.request_id, r.piece_idx, k, r.start_ms, r.end_ms))
    assert sorted(got) == _plain(media, pieces)


def test_first_hits_tell_which_pieces_have_one(spark):
    """With ``first`` the same pieces have a timed hit, in fewer rows."""
    rng = np.random.default_rng(11)
    word = lambda: "".join("abc"[k] for k in rng.integers(0, 3, int(rng.integers(1, 4))))
    media = {m: [[word() for _ in range(int(rng.integers(1, 9)))] for _ in range(int(rng.integers(1, 70)))] for m in range(5)} | {20: [["a"] * 7, ["a"], ["a"] * 12, ["b", "a"]]}
    texts = ["a", "ab", "a b", "c a", "aa b", " b", "a ", "b c a", "a a a", " a a", "abc cba", "cc\tb", "b a a a a b"]
    pieces = [(100 * m + k, m, 0, p) for m in [*media, 30] for k, p in enumerate(texts)]
    placed = _placed(spark, media).cache()
    # The first of two hits has no time, the second one has.
    placed = placed.withColumn("timestamp", F.when(F.expr("media_id = 3 and sent_idx % 2 = 0"), F.expr("transform(timestamp, (t, i) -> if(i < 3, null, t))")).otherwise(F.col("timestamp"))).cache()
    rows = {first: phrase_index.sentence_hits(spark.createDataFrame(pieces, PIECES), placed, first).cache() for first in (False, True)}
    found = {first: {r.request_id for r in phrase_index.whole_hits(rows[first], placed).where("start_ms is not null and end_ms is not null").collect()} for first in rows}
    assert found[True] == found[False] and 0 < len(found[True]) < len(pieces)
    assert rows[True].count() < rows[False].count()


def test_manifest_is_made_of_video_alone(spark, tmp_path, monkeypatch):
    """No sentence of audio is stored, no period numbered."""
    monkeypatch.setattr(transcripts, "folder", lambda spark, label: str(tmp_path / label))
    assert transcripts.clip_manifest(spark, "/root/testdata/sf0.001").count() > 0
    assert {p.name for p in (tmp_path / "clips").iterdir()} == {"sentences", "requests", "hits"}
    assert spark.read.parquet(str(tmp_path / "clips" / "sentences")).where("media_id % 2 = 0").isEmpty()


def test_tokens_of_falling_times_are_put_together(spark):
    rng = np.random.default_rng(2)
    rows = [(1, s, [f"w{k}" for k in range(9)], [(int(t), int(t) + 100) for t in (rng.integers(0, 30_000, 9) if s % 2 else np.sort(rng.integers(0, 30_000, 9)))]) for s in range(8)]
    lines = spark.createDataFrame(rows, "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>")
    asked = [(k, 1, "audio", 0, int(a), int(a) + int(d)) for k, (a, d) in enumerate(zip(rng.integers(-500, 30_000, 60), rng.choice([0, 150, 3000, 25_000], 60), strict=True))]
    cut = spark.createDataFrame(asked, "request_id long, media_id long, modality string, seg_idx int, cue_start_ms long, cue_end_ms long")
    want = []
    for request, _, _, _, a, b in asked:
        for _, s, words, times in rows:
            inside = [i for i, t in enumerate(times) if a < t[1] <= b and times[0][0] < b]
            if inside:
                want.append((request, s, times[inside[0]][0] - a, times[inside[-1]][1] - a, " ".join(words[i] for i in inside)))
    assert sorted((r.request_id, r.sent_idx, r.rel_start_ms, r.rel_end_ms, r.text) for r in clip.partial_sentences(cut, lines).collect()) == sorted(want)


def test_rows_are_numbered_in_one_exchange(spark, tmp_path):
    """Of what is exchanged only one table holds the texts."""
    spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("a"), F.col("id").alias("b"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(str(tmp_path / "rows"))
    plan = running.numbered(spark.read.parquet(str(tmp_path / "rows")), "k", "a", "b", "no")._jdf.queryExecution().executedPlan()
    wide, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.initialPlan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            wide += "text#" in node.output().toString()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert wide == 1


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"conv{k}").mkdir()
        (tmp_path / f"conv{k}" / "a.wav").write_bytes(b"x" * (k % 3 + 1))
    before = spark.conf.get(media_files.LISTING)
    spark.sparkContext.setJobGroup("scan", "scan")
    found = media_files.scan(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("scan") for s in status.getJobInfo(j).stageIds]
    assert sum(tasks) <= media_files.FOLDER_TASKS * spark.sparkContext.defaultParallelism
    assert spark.conf.get(media_files.LISTING) == before and found.count() == 300
    assert {(r.path, r.n_bytes) for r in found.collect()} == {(f"conv{k}/a.wav", k % 3 + 1) for k in range(300)}


def test_tokens_of_cuts_are_exchanged_once(spark):
    """However many levels the periods of a medium use, one exchange holds runs of tokens; long and short periods meet the same one."""
    lines = spark.createDataFrame([(1, 0, ["a"], [(0, 100)])], "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>")
    cut = spark.createDataFrame([(1, 1, "audio", 0, 0, 90_000)], "request_id long, media_id long, modality string, seg_idx int, cue_start_ms long, cue_end_ms long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = clip.partial_sentences(cut, lines)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wide, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            wide += "items#" in node.output().toString()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert wide == 1
