"""Accepted and rejected rows come from one pass."""

import pytest
from pyspark.sql import functions as F

from cuelake.operators import checks
from cuelake.sources import audited


def test_one_pass_gives_both_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (2, "x", ""), (None, "y", None)], "k long, status string, v string")
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            looked.add(b.num_rows)
            yield b

    got = audited.split_rows(rows.mapInArrow(count, rows.schema), F.when(F.coalesce(F.col("v"), F.lit("")) == "", F.lit("no v")), ["k", "status"], "t", str(tmp_path / "t"))
    assert [tuple(r) for r in got.accepted.collect()] == [(1, None, "a")]
    assert sorted(map(tuple, got.rejects.collect())) == [("t", '{"k":2,"status":"x"}', "no v"), ("t", '{"status":"y"}', "no v")]
    assert (got.n_accepted, got.n_rejected) == (1, 2) and looked.value == 3
    assert "PartitionFilters: [isnotnull(status_" in got.rejects._jdf.queryExecution().executedPlan().toString()


def test_no_rows_and_clashes(spark, tmp_path):
    empty = spark.createDataFrame([], "k long")
    got = audited.split_rows(empty, F.lit(None), ["k"], "t", str(tmp_path / "e"))
    assert got.accepted.count() == got.rejects.count() == got.n_accepted == got.n_rejected == 0
    with pytest.raises(ValueError, match="status_"):
        audited.split_rows(empty.withColumn("status_", F.lit(1)), F.lit(None), ["k"], "t", str(tmp_path / "c"))


def test_the_first_fault_of_a_row(spark):
    kind = "media_id long, sent_idx long, tokens array<string>, timestamp array<struct<start_ms:long,end_ms:long>>"
    rows = spark.createDataFrame([(1, 0, ["a"], [(0, 5)]), (1, 1, ["a"], []), (1, 2, [], []), (1, 3, ["a", "b"], [(5, 9), (6, 8)]), (1, 4, None, None)], kind)
    want = [None, "tokens and times differ in number", "no token", "token times fall", "tokens and times differ in number"]
    assert [r.f for r in rows.select("sent_idx", checks.row_fault().alias("f")).orderBy("sent_idx").collect()] == want
