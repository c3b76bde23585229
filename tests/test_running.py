"""Running sums and numbers in blocks, against plain rules, and that no task gathers a key."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions.timecode import format_time
from cuelake.operators import clip, running
from cuelake.sources import srt_files


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_sums_and_numbers_equal_the_rule(spark, block):
    rng = random.Random(4)
    places = rng.sample(range(-50, 400), 300)
    rows = [(rng.choice([1, 1, 1, 2, None]), p, rng.choice([5, -2, 0, None])) for p in places]
    rows += [(7, None, 3), (7, 2, 4)]
    got = running.running(spark.createDataFrame(rows, "k int, o int, v int"), ["k"], "o", F.col("v"), "s", block)
    want = sorted(((k, o, v, sum(w or 0 for j, p, w in rows if j == k and (o is not None and (p is None or p < o)))) for k, o, v in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    pairs = [(rng.choice([1, None]), a, b) for a in range(-5, 9) for b in rng.sample(range(-20, 20), rng.randint(0, 12))]
    got = running.numbered(spark.createDataFrame(pairs, "k int, a int, b int"), "k", "a", "b", "no", block)
    want = sorted((str(k), a, b, sum(j == k and (x, y) < (a, b) for j, x, y in pairs)) for k, a, b in pairs)
    assert sorted((str(r.k), r.a, r.b, r.no) for r in got.collect()) == want
    assert running.running(spark.createDataFrame([], "k int, o int, v int"), ["k"], "o", F.col("v"), "s", block).count() == 0


def test_one_request_of_a_million_segments(spark, tmp_path):
    """Its rows are dealt to all tasks: the window is by block, and no task takes more than a share."""
    n = 1_000_000
    spark.range(n).select(F.lit(1).alias("request_id"), F.col("id").cast("int").alias("seg_idx"), (F.col("id") * 7).alias("cut_start_ms"), (F.col("id") * 7 + 5).alias("cut_end_ms")).write.parquet(str(tmp_path / "cut"))
    stored = spark.read.parquet(str(tmp_path / "cut"))
    line = running.running(stored, ["request_id"], "seg_idx", F.col("cut_end_ms") - F.col("cut_start_ms"), "out_start_ms")
    line.withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "line"))
    back = spark.read.parquet(str(tmp_path / "line"))
    assert back.where("out_start_ms <> seg_idx * 5L").count() == 0 and back.count() == n
    tasks = [r["count"] for r in back.groupBy("task").count().collect()]
    assert len(tasks) >= 4 and max(tasks) < n / 2


def test_documents_in_parts(spark, tmp_path):
    """A request of many cues: parts of bounded size, whose concatenation is the file and the document."""
    n = 25_000
    rows = spark.range(n).select(F.lit(3).alias("request_id"), (F.col("id") + 1).cast("int").alias("cue_no"), (F.col("id") * 10).alias("rel_start_ms"), (F.col("id") * 10 + 9).alias("rel_end_ms"), F.concat(F.lit("t"), "id").alias("text"))
    rows = rows.unionByName(rows.where("cue_no = 1").withColumn("request_id", F.lit(4)))
    parts = clip.clip_srt_parts(rows.repartition(6))
    assert sorted((r.request_id, r.part, r.n) for r in parts.groupBy("request_id", "part").agg(F.count("*").alias("n")).collect()) == [(3, k, 1) for k in range(n // clip.PART)] + [(4, 0, 1)]
    assert parts.select(F.max(F.length("srt"))).first()[0] < 60 * clip.PART
    clock = {r.id: (r.a, r.b) for r in spark.range(n).select("id", format_time(F.col("id") * 10).alias("a"), format_time(F.col("id") * 10 + 9).alias("b")).collect()}
    want = "".join(f"{k + 1}\n{clock[k][0]} --> {clock[k][1]}\nt{k}\n" for k in range(n))
    assert {r.request_id: r.srt for r in clip.clip_srt(rows).collect()}[3] == want
    path = str(tmp_path / "out")
    srt_files.write_srt_files(parts.select(F.concat("request_id", F.lit(".srt")).alias("file"), "part", "srt").repartition(5), path)
    assert open(f"{path}/3.srt", encoding="utf-8", newline="").read() == want and open(f"{path}/4.srt").read().startswith("1\n")


def test_parts_that_are_not_whole(spark, tmp_path):
    for rows in ([("a.srt", 0, "x"), ("a.srt", 0, "y")], [("a.srt", 0, "x"), ("a.srt", None, "y")]):
        with pytest.raises(Exception, match="two documents|without a number"):
            srt_files.write_srt_files(spark.createDataFrame(rows, "file string, part long, srt string"), str(tmp_path / "bad"))
    srt_files.write_srt_files(spark.createDataFrame([("a.srt", 2, "y"), ("a.srt", -1, None), ("b.srt", 0, "z"), ("a.srt", 1, "x")], "file string, part long, srt string"), str(tmp_path / "good"))
    assert open(tmp_path / "good" / "a.srt").read() == "xy" and open(tmp_path / "good" / "b.srt").read() == "z"
