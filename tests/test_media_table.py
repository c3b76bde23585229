"""The bucketed table of media: replaced media only change themselves, and plans by medium need no exchange."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cuelake.operators import checks, match
from cuelake.sources import media_table

SENTENCE = "media_id long, sent_idx long, spk int, text string, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>"


def _rows(media, text, n=3):
    return [(m, s, m % 2 if m else None, f"{text}{m}", ["a"], [(s * 2000, s * 2000 + 1500)]) for m in media for s in range(n)]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def name(spark):
    name = f"media_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_medium_replaces_only_itself(spark, name, tmp_path):
    path, media = str(tmp_path / "t"), [*range(40), None]
    media_table.create_table(spark.createDataFrame(_rows(media, "old"), SENTENCE), name, path, ["sent_idx"], 8, 4)
    before = _files(path)
    assert len(before) <= 8
    got = media_table.replace_media(spark.createDataFrame(_rows([5, 999], "new", 2), SENTENCE), name)
    want = _rows([m for m in media if m != 5], "old") + _rows([5, 999], "new", 2)
    assert sorted(((r.media_id, r.sent_idx, r.text) for r in got.collect()), key=str) == sorted(((r[0], r[1], r[3]) for r in want), key=str)
    after, shards = _files(path), {r.s for r in spark.createDataFrame([(5,), (999,)], "media_id long").select(media_table._shard(8, 4).alias("s")).collect()}
    same = lambda files: {f: t for f, t in files.items() if not any(f"shard={s}/" in f for s in shards)}
    assert same(before) == same(after) and same(before) and len(shards) < 4
    assert set(before) - set(after)
    assert media_table.replace_media(spark.createDataFrame(_rows([None], "new", 1), SENTENCE), name).where("media_id is null").count() == 1
    assert media_table.replace_media(spark.createDataFrame([], SENTENCE), name).count() == len(want) - 2


def test_plans_by_medium_have_no_exchange(spark, name, tmp_path):
    table = media_table.create_table(spark.createDataFrame(_rows(range(40), "x"), SENTENCE), name, str(tmp_path / "t"), ["sent_idx"], 8, 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(checks.transcript_faults(table))
    asked = spark.createDataFrame([(1, 4, "spk0#spk1"), (2, 5, "spk1")], "request_id long, media_id long, dest_spk string")
    requests = media_table.create_table(asked, name + "r", str(tmp_path / "r"), ["request_id"], 8, 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        found = match.speaker_match(requests, match.envelopes(table))
        assert "Exchange" not in plan(found)
        assert sorted((r.request_id, r.piece_idx, r.occurrence) for r in found.collect()) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 0), (2, 0, 1), (2, 0, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql(f"DROP TABLE IF EXISTS {name}r")


def test_clashes_are_errors_and_no_rows_a_table(spark, name, tmp_path):
    empty = spark.createDataFrame([], SENTENCE)
    with pytest.raises(ValueError, match="shard"):
        media_table.create_table(empty.withColumn("shard", F.lit(1)), name, str(tmp_path / "t"), [])
    with pytest.raises(ValueError, match="dealt"):
        media_table.create_table(empty, name, str(tmp_path / "t"), [], 8, 3)
    assert media_table.create_table(empty, name, str(tmp_path / "t"), ["sent_idx"]).count() == 0
    assert media_table.replace_media(spark.createDataFrame(_rows([1], "n"), SENTENCE), name).count() == 3
