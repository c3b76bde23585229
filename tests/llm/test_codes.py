"""Texts and lines that differ are never taken for equal."""

import numpy as np

from cuelake.llm import line_dedup, near_dup
from cuelake.llm import textblock as tb


def _opposites(n):
    """Two strings that differ in every byte and whose sums of powers are equal for every odd base."""
    rng = np.random.default_rng(n)
    sign = np.array([k.bit_count() % 2 for k in range(n)])
    base = rng.integers(98, 122, n)  # letters at random, so that the two share hardly any shingle
    return "".join(map(chr, base + sign)), "".join(map(chr, base + 1 - sign))


def _arrays(texts):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    return raw, np.concatenate([[0], end[:-1]]).astype(np.int64), end.astype(np.int64)


def test_codes_tell_spans_apart():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in [*range(1, 40), 511, 512, 513, 4000] for _ in range(20)] + [b"", b"\0", b"\0\0", b"a\0"]
    texts += [t for n in (1024, 2048) for t in (x.encode() for x in _opposites(n))]
    one, two = tb.span_codes(*_arrays(texts))
    for codes in (one, two):
        assert len({(t, c) for t, c in zip(texts, codes.tolist(), strict=True)}) == len(set(texts)) == len(set(codes.tolist()))
    # A span's codes are its own, wherever it stands.
    order = rng.permutation(len(texts))
    again = tb.span_codes(*_arrays([texts[i] for i in order]))
    assert (again[0] == one[order]).all() and (again[1] == two[order]).all() and tb.span_codes(np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 2)[0].size == 0


def test_made_up_collisions_keep_both(spark):
    a, b = _opposites(1024)
    old = tb.span_hash(*_arrays([a.encode(), b.encode()]))
    assert old[0] == old[1]
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}")], "doc_id long, text string")
    for short in (False, True):
        out, gone = line_dedup.dedup_lines(spark, docs, shingle=5, short=short)
        assert {r.doc_id: r.text for r in out.collect()} == {1: a, 2: b, 3: ""} and gone.count() == 2
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, docs.where("doc_id < 3")).collect()}
    assert found == {1: 1, 2: 2}


def test_lines_that_share_one_code_only_are_apart(spark):
    rows = [(1, 7, 0, 5, 1), (2, 7, 0, 5, 2), (3, 7, 4, 5, 1), (3, 7, 5, 5, 2), (4, 7, 0, 6, 1)]
    got = line_dedup.repeats(spark.createDataFrame(rows, "doc_id long, twin long, line int, code long, check long")).collect()
    assert {(r.doc_id, r.line, r.keep.doc_id, r.keep.line) for r in got} == {(3, 4, 1, 0), (3, 5, 2, 0)}
