"""Bands of lines that are small enough are compared as they are, and only lines of larger ones are signed for branching."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cuelake.llm import line_dedup, nodes
from cuelake.llm.common import Scratch

LINES = ["the first of three lines that are long enough to have shingles of their own", "the second one of them, which no band that is too large holds, is not signed", "the third of these lines is in a large band again, as the first of them is here"]


def test_only_lines_of_large_bands_are_signed():
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(LINES)]), pa.array([[0, 1, 2]]), pa.array([[7, 8, 9]]), pa.array([[True, False, True]])], ["text", "lines", "recs", "wide"])
    (out,) = line_dedup._pick(iter([batch]), 5)
    raw = np.frombuffer("".join(LINES).encode(), np.uint8)
    end = np.cumsum([len(x) for x in LINES])
    sig = line_dedup._signatures(*line_dedup._shingles(raw, np.concatenate([[0], end[:-1]]), end, 5))
    assert out.column("rec").to_pylist() == [7, 8, 9]
    assert out.column("sig").to_pylist() == [sig[0].tobytes(), None, sig[2].tobytes()]


def test_a_node_is_a_row_with_its_records():
    recs = np.array([5, 3, 3, 9, 4, 8])
    node = np.array([1, 1, 1, 2, 3, 3], np.int32)
    table = pa.table({"bucket": pa.array([0]), "nodes": pa.array([node.tolist()], pa.list_(pa.int32())), "recs": pa.array([recs.tolist()]), "bits": pa.array([[0] * 6], pa.list_(pa.int64()))})
    out = line_dedup._meeting(table)
    assert out.column("recs").to_pylist() == [[3, 5], [4, 8]] and out.column("n").to_pylist() == [2, 2]


def test_ready_sets_are_leaves_without_being_grouped_again(spark):
    sets = [[1, 2], [1, 2], [3, 4, 5], [2, 9]]
    rows = spark.createDataFrame([(i, r, len(x)) for i, x in enumerate(sets) for r in x], "node long, rec long, n long")
    signed = spark.createDataFrame([], "rec long, sig binary")
    scratch = Scratch(spark, "leaves")
    want, _ = nodes.leaves(scratch, rows, signed, line_dedup._branch, 3, rows)
    got, _ = nodes.leaves(scratch, rows.limit(0), signed, line_dedup._branch, 3, rows.limit(0), spark.createDataFrame([(x,) for x in sets], "members array<long>"))
    found = lambda x: sorted((r.leaf, r.rec) for r in x.collect())
    assert found(got) == found(want) and got.select(F.countDistinct("leaf")).first()[0] == 3


def test_signatures_of_stretches_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    size = rng.integers(40, 300, 200)
    end = np.cumsum(size)
    raw, start = rng.integers(65, 123, end[-1]).astype(np.uint8), end - size
    whole = line_dedup._signatures(*line_dedup._shingles(raw, start, end, 5))
    monkeypatch.setattr(line_dedup, "STRETCH", 1000)
    sig, count = line_dedup._signed(raw, start, end, 5)
    assert (sig == whole).all() and count.tolist() == (size - 4).tolist()
    assert bytes(line_dedup.tb.lower(np.arange(256, dtype=np.uint8))) == bytes(line_dedup.tb._LOWER)


def test_leaves_of_few_likely_pairs_are_compared_once(spark, tmp_path, monkeypatch):
    """A leaf names its likely pairs in the first pass; only leaves of many are stored to be compared again, with the same components."""
    rng, texts = np.random.default_rng(5), []
    for _ in range(30):
        base = "".join(map(chr, rng.integers(97, 123, 120)))
        texts += [base[:k] + "#" * 5 + base[k + 5 :] for k in (0, 20, 60, 100)] + [base[:60] + "".join(map(chr, rng.integers(97, 123, 60)))]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    row, value = line_dedup.line_shingles(raw, off, 5)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    sketch = line_dedup.tb.minhash(value, at, line_dedup.SKETCH).astype(np.uint8)
    rows = [(i, len(set(value[at[i] : at[i + 1]])), sketch[i].tobytes()) for i in range(len(texts))]
    sketches = spark.createDataFrame(rows, "rec long, size long, sketch binary")
    leaf = spark.createDataFrame([(i // 5, i) for i in range(len(texts))], "leaf long, rec long")
    table = spark.createDataFrame(list(enumerate(texts)), "rec long, text string")
    found = {}
    for rest in (4, 0):
        monkeypatch.setattr(nodes, "REST", rest)
        scratch = Scratch(spark, f"rest{rest}")
        comp = nodes.linked(scratch, leaf, None, sketches, table, line_dedup.partial(line_dedup.line_shingles, shingle=5), 75, line_dedup.LOW, True)
        found[rest] = sorted((r.node, r.component) for r in comp.collect())
        assert any(p.endswith("-cells") for p in scratch.paths) == (rest == 0)
    assert found[4] == found[0] and len(found[4]) == 90


def test_a_table_by_key_is_joined_without_an_exchange(spark):
    scratch = Scratch(spark, "by")
    rows = spark.range(1000).selectExpr("id AS rec", "cast(id AS string) AS text")
    stored = scratch.store_by(rows, "rec", "texts")
    joined = stored.hint("merge").join(stored.selectExpr("rec", "text AS other").hint("merge"), "rec")
    assert joined.where("text = other").count() == 1000
    assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString() and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
