"""Filter interaction audit: what each filter removes, in every order of the filters.

Five filters judge whole texts (FILTERS names them).  A document's failures are
a mask of five bits, and the mask alone decides what each of the 600 steps
(120 orders of five filters) does with it.  So every mask has one wide integer
whose fields hold its outcome at all steps: kept, removed, redundant, good and
toxic documents lost.  The integers of a part's documents are summed, and the
sum is unpacked into the part's rows.  A field is 64 bits wide; as a table has
fewer than 2^63 rows, no field runs over into the next.

Documents are counted by part, mask and labels before they are shuffled, so a
part that holds a third of all rows arrives as at most 128 counts, and the sum
of equal integers is one product.  Texts are read once, with built-in
functions; what is shuffled is a digest, an id and the mask.  Equal texts meet
by their SHA-256; copies are counted by part and labels before they meet, so a
large group of copies is no large group of rows.

Defined cases: null texts are empty (they fail A, no other words rule); null
parts are the empty part.  A null id is larger than every id, has no labels
and fails E where a row with an id holds its text.  Rows that repeat an id are
rows of their own; of equal texts, all rows of the smallest id pass E.  Several
labels of an id count as their largest.  Very long texts count whole.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters; bit k of a mask is set where FILTERS[k] fails.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"

FIELD_BITS = 64
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Counts of a part: those of the first kind once, those of OUTCOMES at each of the 600 steps.
_STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]


def fails(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rules = (n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT_PERCENT, upper * 100 > F.length(text) * MAX_UPPER_PERCENT, text.rlike(SYMBOLS))
    return sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: how many documents of a part fail which filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("twin"), fails(text).alias("mask"))
    rows = rows.groupBy("id", "part", "twin", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    marked = rows.where("id is not null").join(marks, "id", "left").unionByName(rows.where("id is null").withColumns({"good": no, "toxic": no}))
    # Of equal texts the rows of the smallest id pass E; the others are counted only.
    keys = ["twin", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")]
    groups = marked.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("n").alias("own"))).alias("first"))
    least = groups.groupBy("twin").agg(F.min(F.struct("first.none", "first.id")).alias("least"), F.count("*").alias("kinds"))
    groups = groups.join(least.where("kinds > 1"), "twin", "left")
    mine = F.col("least").isNull() | (F.struct("first.none", "first.id").eqNullSafe(F.col("least")))
    passed = F.when(mine, F.col("first.own")).otherwise(0)
    both = F.explode(F.array(F.struct("mask", passed.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passed).alias("n")))).alias("x")
    counted = groups.select("part", "good", "toxic", both).where("x.n > 0")
    return counted.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def outcomes(mask: int, good: bool, toxic: bool) -> list[int]:
    """What one document adds to every field: OUTCOMES at each step of each order, then unique_fails of each filter."""
    out = []
    for order, step in _STEPS:
        earlier = any(mask >> FILTERS.index(f) & 1 for f in order[:step])
        failed = bool(mask >> FILTERS.index(order[step]) & 1)
        removed = failed and not earlier
        out += [not failed and not earlier, removed, failed and earlier, removed and good, removed and toxic]
    return [int(x) for x in out] + [int(mask == 1 << k) for k in range(len(FILTERS))]


def pack(values: list[int]) -> int:
    """One integer of 64-bit fields, the first the lowest."""
    return int.from_bytes(b"".join(v.to_bytes(FIELD_BITS // 8, "little") for v in values), "little")


def unpack(wide: int, fields: int) -> list[int]:
    raw = wide.to_bytes(fields * FIELD_BITS // 8, "little")
    return [int.from_bytes(raw[k : k + FIELD_BITS // 8], "little") for k in range(0, len(raw), FIELD_BITS // 8)]


def _unpacked(counts: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its counts, at most 128."""
    wide = sum(int(r.n) * pack(outcomes(int(r.mask), bool(r.good), bool(r.toxic))) for r in counts.itertuples())
    per, steps = len(OUTCOMES), len(_STEPS)
    fields = unpack(wide, per * steps + len(FILTERS))
    rows = [(counts["part"].iloc[0], order, step + 1, *fields[k * per : (k + 1) * per], fields[per * steps + FILTERS.index(order[step])]) for k, (order, step) in enumerate(_STEPS)]
    table = pd.DataFrame(rows, columns=["part", "filter_order", "step", *OUTCOMES, "unique_fails"])
    table["shapley"] = table["removed"].groupby([o[s - 1] for o, s in zip(table["filter_order"], table["step"], strict=True)]).transform("sum")
    return table


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, good_lost, toxic_lost, unique_fails, shapley: 600 rows a part."""
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, good_lost long, toxic_lost long, unique_fails long, shapley long"
    return masks(docs, labels, part_col).groupBy("part").applyInPandas(_unpacked, schema)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id AS e FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS f
  FROM words LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, f, good, toxic, count(*) AS n FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, s, 1) AS own, list_filter(string_split(substr(filter_order, 1, s - 1), ''), lambda x: x <> '') AS earlier FROM orders, range(1, 6) AS r(s)
), judged AS (
  SELECT part, filter_order, step, own, n, good, toxic, f, contains(f, own) AS failed, len(list_filter(earlier, lambda x: contains(f, x))) > 0 AS gone FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (failed AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (f = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (failed AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (failed AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM summed
"""
