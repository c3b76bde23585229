"""The pipeline's stages on a small table, each held against its operator's rule."""

import corpus_pipeline
from cuelake.llm import decontaminate, near_dup, quality
from cuelake.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.store(stage(spark, before, SF), name)
        assert after.columns == columns
        old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(new) < set(old)
        if name == "quality":
            score = {r.doc_id: r.score for r in quality.score(spark, docs, quality.fit(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert set(new) == {d for d in old if score[d] >= quality.MIN_SCORE}
        if name == "line_dedup":
            assert all(new[d] == "" or not old[d] or set(new[d].split("\n")) <= set(old[d].split("\n")) for d in new)
        if name == "near_duplicates":
            assert set(new) == {r.doc_id for r in near_dup.near_duplicates(spark, before).where("kept").collect()}
        if name == "decontamination":
            assert decontaminate.contamination(spark, after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    position = [r.position_ for r in out.collect()]
    assert position == sorted(position) and {r.doc_id for r in out.collect()} <= {r.doc_id for r in before.collect()}


def test_rows_with_null_or_repeated_ids_are_judged_by_themselves(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = prose[0].replace("a59", "other")
    rows = [(None, item), (None, prose[1]), (1, prose[0]), (2, prose[2]), (2, item), (3, prose[3]), (3, near), (1, near), (4, ""), (4, ""), (5, item + " more")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n_chars int")
    clean = corpus_pipeline.decontaminate_documents(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r.n_chars for r in clean.collect()} == {1, 2, 3, 5, 6, 7, 8, 9}
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()]
    ones = [x for x in kept if x[1] in (prose[0], near)]
    assert len(ones) == 1 and ones[0][0] == 1
    assert {(None, item), (None, prose[1]), (2, prose[2]), (3, prose[3]), (4, "")} <= set(kept) and kept.count((4, "")) == 1


#: Columns that the operators use inside, with other types, beside those of documents.
EXTRA = "code string, rec string, node int, size string, kept string, score string, component string, hits int"
PROSE = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
LINE = "A line that is long enough to be looked at, and that several of the documents here do hold, word for word."
ROWS = [
    (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 4), (4, PROSE[0], "en", "s", None), (4, PROSE[0], "en", "s", None), (4, PROSE[1], "de", "t", 5),
    (5, " ".join(f"w{i}" for i in range(40_000)), "en", "s", 9), (6, f"{PROSE[2]}\n{LINE}", "en", "s", 1), (7, f"{LINE}\n{PROSE[3]}", "en", "s", 1), (None, PROSE[4], "en", "s", 1), (None, f"{PROSE[5]}\n{LINE}", "en", "s", 1),
]


def _inputs(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "x", "y", k, "z", "no", "w", "c", k) for k, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars int, " + EXTRA)
    spark.createDataFrame([(None, 1, 0), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "an item that nobody has"), (1, None), (2, ""), (3, " ".join(PROSE[1].split()[5:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs


def test_stages_on_odd_rows(spark, tmp_path):
    docs = _inputs(spark, tmp_path)
    stage, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    marks = lambda df: sorted(r.hits for r in df.collect())
    every = list(range(len(ROWS)))
    for name in ("quality", "line_dedup", "near_duplicates", "decontamination"):
        assert stage[name](spark, docs, sf).columns == docs.columns
        empty = stage[name](spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0
    # With one class of labels, or none, nothing is rejected.
    assert marks(stage["quality"](spark, docs, sf)) == every
    # The line stays where it is first; a null id is never touched; what has no text keeps it.
    texts = {r.hits: r.text for r in stage["line_dedup"](spark, docs, sf).collect()}
    assert texts[8] == ROWS[8][1] and texts[9] == PROSE[3] and texts[11] == ROWS[11][1] and (texts[1], texts[2], texts[3]) == (None, "", " \n\t ") and texts[7] == ROWS[7][1]
    # One of two equal rows goes; another text of the same id stays.
    kept = stage["near_duplicates"](spark, docs, sf)
    assert kept.count() == len(ROWS) - 1 and {0, 1, 2, 3, 6, 7, 8, 9, 10, 11} <= set(marks(kept))
    # Only the row that holds the item goes, not the others of its id.
    assert marks(stage["decontamination"](spark, docs, sf)) == [k for k in every if k != 6]
    mixed = stage["mixing"](spark, docs, sf)
    assert mixed.columns[: len(docs.columns)] == docs.columns and {r.hits for r in mixed.collect()} <= set(every) - {0, 1, 2, 3} and stage["mixing"](spark, docs.limit(0), sf).count() == 0


def test_ids_that_occur_twice_with_other_texts(spark, tmp_path):
    rows = [(i // 2, f"{LINE}\n{' '.join(f'u{i}v{k}' for k in range(30))}") for i in range(12)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clean = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, str(tmp_path)).collect()]
    assert len(clean) == 12 and sum(LINE in t for _, t in clean) == 1 and {t.split("\n")[-1] for _, t in clean} == {t.split("\n")[1] for _, t in rows}
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).count() == 12
