"""The subtitle sink: one file a document, nothing of tasks that fail, and the reader gives back what was written."""

import os

import pytest
from pyspark.sql import functions as F

from cuelake.functions.timecode import format_time
from cuelake.sources import srt_files


def _files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_each_document_has_its_file(spark, tmp_path):
    path = str(tmp_path / "out here")
    rows = [("a/total.srt", "1  spk0\n00:00:00,000 --> 00:00:01,000\nhi\nyou\n2\n00:00:01,000 --> -1:59:59,950\nx\n"), ("b.srt", None), ("ç.srt", "1\n00:00:00,5 --> 100:00:00,000\n\n\n"), ("plain.srt", "no cue\n")]
    srt_files.write_srt_files(spark.createDataFrame(rows, srt_files.SCHEMA).repartition(3), path)
    assert _files(path) == sorted(n for n, _ in rows)
    assert {n: open(f"{path}/{n}", encoding="utf-8", newline="").read() for n, _ in rows} == {n: t or "" for n, t in rows}
    got = sorted(tuple(r) for r in srt_files.read_srt_files(spark, path).collect())
    assert got == [("a/total.srt", 1, "0", 0, 1000, "hi\nyou"), ("a/total.srt", 2, None, 1000, -50, "x"), ("ç.srt", 1, None, 5, 360_000_000, "")]
    srt_files.write_srt_files(spark.createDataFrame([("b.srt", "new")], srt_files.SCHEMA), path)  # others stay
    assert open(f"{path}/b.srt").read() == "new" and len(_files(path)) == 4


def test_nothing_is_left_of_a_job_that_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(40).select(F.concat("id", F.lit(".srt")).alias("file"), F.lit("x").alias("srt")).repartition(4)
    late = good.withColumn("srt", F.when(F.col("file") == "39.srt", F.raise_error(F.lit("stop"))).otherwise(F.col("srt")))
    twice = good.unionByName(spark.createDataFrame([("7.srt", "other")], srt_files.SCHEMA))
    for bad in (late, twice, spark.createDataFrame([("../x.srt", "y")], srt_files.SCHEMA), spark.createDataFrame([(None, "y")], srt_files.SCHEMA)):
        with pytest.raises(Exception, match="stop|two documents|no name"):
            srt_files.write_srt_files(bad, path)
        assert not os.path.exists(path) or _files(path) == [] and os.listdir(path) == []


def test_a_task_that_runs_twice_writes_once(tmp_path):
    writer = srt_files.SrtWriter(str(tmp_path))
    rows = [type("R", (), {"file": f"{k}.srt", "srt": str(k)})() for k in range(3)]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))  # the first attempt's message never reaches the driver
    assert _files(tmp_path) and not [f for f in _files(tmp_path) if f.endswith(".srt")] and lost.folder != kept.folder
    writer.commit([kept, None])
    assert _files(tmp_path) == ["0.srt", "1.srt", "2.srt"]


def test_times_of_files_parse_back(spark, tmp_path):
    times = spark.range(-5, 200).select(((F.col("id") * 7_654_321) % 500_000_000 - 60_000).alias("a"))
    doc = F.concat(F.lit("1\n"), format_time(F.col("a")), F.lit(" --> "), format_time(F.col("a") + 5), F.lit("\nt\n"))
    srt_files.write_srt_files(times.select(F.concat(F.lit("k"), "a", F.lit(".srt")).alias("file"), doc.alias("srt")), str(tmp_path / "t"))
    got = srt_files.read_srt_files(spark, str(tmp_path / "t")).collect()
    assert len(got) == times.distinct().count() and all(r.file == f"k{r.start_ms}.srt" and r.end_ms == r.start_ms + 5 and r.text == "t" for r in got)


def test_many_folders_are_read_in_few_tasks(spark, tmp_path):
    """Folders are listed and files read many to a task, at any depth; hidden ones are left out."""
    for k in range(300):
        (tmp_path / f"conv{k}" / "a b").mkdir(parents=True)
        (tmp_path / f"conv{k}" / "a b" / "x%20.srt").write_text(f"{k}\n00:00:00,000 --> 00:00:01,000\nt\n")
    (tmp_path / "top.srt").write_text("900\n00:00:00,000 --> 00:00:01,000\nt\n")
    (tmp_path / "_staging").mkdir()
    for hidden in ("_staging/1.srt", ".y.srt", "notes.txt"):
        (tmp_path / hidden).write_text("901\n00:00:00,000 --> 00:00:01,000\nt\n")
    spark.sparkContext.setJobGroup("srt", "srt")
    got = srt_files.read_srt_files(spark, f"file://{tmp_path}").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("srt") for s in status.getJobInfo(j).stageIds}
    assert sum(info.numTasks for info in map(status.getStageInfo, stages) if info) < 150
    assert {(r.file, r.cue_no) for r in got} == {("top.srt", 900)} | {(f"conv{k}/a b/x%20.srt", k) for k in range(300)} and len(got) == 301
