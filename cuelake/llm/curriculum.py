"""Mixing sources to target weights as a time-varying curriculum.

Targets.  A document's size is its number of words.  Sources in code-point
order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the size of all
documents; no target exceeds MAX_EPOCHS times its source's size, and what is
cut off is shared again by weight.  That is a water level: the smallest level
L with sum(min(cap, weight * L)) = total, found from running sums over the
(small) table of sources.

Curriculum.  A source's weight changes over training time t in [0, 1] as a
piecewise-linear schedule; here sources early in the order are wanted early.
Integrating the schedule gives the source's cumulative token demand, scaled
so that its integral over the whole training is its target.  The documents of a source,
in hash order and repeated epoch after epoch, lie on its token axis; a copy
whose middle lies below the target is taken, and its training position is the
time at which the cumulative demand reaches its middle.  The result is
range-sorted by position.

Running sums run in two levels, over hash buckets of a source and within a
bucket, so that a source that holds most rows is still spread over all tasks;
there are as many buckets as a bucket has rows on average.
Only built-in functions are used.

Defined cases: null or empty texts have size 0 and are taken 0 times; sources
without words have target 0; a null source is a source of its own; rows that
repeat a doc_id are rows of their own; ties in the order are rows of equal id
and size, whose positions may change places; a null id is placed like the
empty id; a very long text is one document.  An empty table gives an empty
result.  Other columns pass through in ``mixture``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

MAX_EPOCHS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, target) from rows (source, size); one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = by_source.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(3)) + 1)
    cap = F.lit(MAX_EPOCHS) * F.col("source_size")
    ranked = ranked.withColumn("cap", cap).withColumn("turn", F.col("cap") / F.col("weight"))
    # At the level of source k in the order of cap/weight, sources before it are at their caps.
    up = Window.orderBy("turn", "rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    step = step.withColumn("level", (F.col("total") - F.col("full")) / F.sum("weight").over(after))
    # Any such step overstates what the sources take at its level, but for the right one: it is the highest.
    step = step.withColumn("level", F.max("level").over(every))
    return step.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def schedule(rank: Column, sources: Column) -> Column:
    """Weights of a source at t = 0, 1/4, ..., 1: from 2 down to 1/2 for the first, reversed for the last."""
    lean = F.when(sources > 1, (rank - 1) / (sources - 1)).otherwise(F.lit(0.5))
    return F.array(*(2.0 - 1.5 * t - lean * (1.5 - 3.0 * t) for t in (0.0, 0.25, 0.5, 0.75, 1.0)))


def invert_demand(weights: Column, share: Column) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its whole.

    Each segment is linear, so its integral is a quadratic, solved in the form
    that stays exact for level segments.
    """
    parts = 4
    w = [F.element_at(weights, i + 1) for i in range(parts + 1)]
    area = [(w[i] + w[i + 1]) / (2 * parts) for i in range(parts)]
    whole = area[0] + area[1] + area[2] + area[3]
    need = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * whole
    result, start = None, F.lit(0.0)
    out = []
    for i in range(parts):
        rest = F.least(F.greatest(need - start, F.lit(0.0)), area[i])
        slope = (w[i + 1] - w[i]) * parts
        root = F.sqrt(F.greatest(w[i] * w[i] + 2 * slope * rest, F.lit(0.0)))
        out.append((start + area[i], F.least(i / parts + 2 * rest / (w[i] + root), F.lit((i + 1) / parts))))
        start = start + area[i]
    for i in reversed(range(parts)):
        result = out[i][1] if result is None else F.when(need <= out[i][0], out[i][1]).otherwise(result)
    return result


def placed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions: one row per document.

    ``positions`` holds a training position for each copy that is taken.
    """
    return _placed(spark, docs, id_col, text_col, source_col).drop("twin")


def _placed(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What ``placed`` gives, and twin, the hash of the text."""
    scratch, text = Scratch(spark, "mixture"), F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("twin"))
    rows = scratch.store(rows.withColumn("at", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    goal = targets(rows).withColumn("n_sources", F.count("*").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    goal = scratch.store(goal, "targets")
    # Hash buckets: the first 28 bits of the document's place, scaled to the table.
    buckets = max(1, math.isqrt(rows.count()))
    spot = (F.conv(F.substring("at", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)).cast("long")
    rows = rows.withColumn("bucket", spot)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s, g = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "before"), goal.withColumnRenamed("source", "g_source")
    s = s.join(g, s.s_source.eqNullSafe(g.g_source))
    rows = rows.join(s, rows.source.eqNullSafe(s.s_source) & (rows.bucket == s.s_bucket))
    middle = F.col("before") + F.col("inner") + F.col("size") / 2
    copies = F.transform(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)), lambda e: middle + e * F.col("source_size"))
    copies = F.filter(copies, lambda m: (m < F.col("target")) & (F.col("size") > 0))
    weights = schedule(F.col("rank"), F.col("n_sources"))
    rows = rows.withColumn("middles", copies).withColumn("weights", weights)
    rows = rows.withColumn("positions", F.transform("middles", lambda m: invert_demand(F.col("weights"), m / F.col("target"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions", "twin")


def mixture(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training sequence: the columns of ``docs`` and epoch_, position_, a row per copy, range-sorted."""
    where, keys = _placed(spark, docs, id_col, text_col, source_col), ["doc_id", "source", "twin"]
    # Rows that repeat (id, source, text) are told apart by their number, on both sides alike.
    where = where.groupBy(*keys).agg(F.flatten(F.collect_list("positions")).alias("positions_"), F.count("*").alias("same_"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    col = {n: F.col(f"c{docs.columns.index(n)}") for n in (id_col, text_col, source_col)}
    plain = plain.withColumns({"id_": col[id_col].cast("long"), "source_": col[source_col].cast("string"), "twin_": F.xxhash64(col[text_col].cast("string"))})
    joined = plain.join(where, plain.id_.eqNullSafe(where.doc_id) & plain.source_.eqNullSafe(where.source) & (plain.twin_ == where.twin))
    number = F.row_number().over(Window.partitionBy("id_", "source_", "twin_").orderBy(F.xxhash64(*(f"c{i}" for i in range(len(docs.columns))))))
    several = joined.where("same_ > 1").withColumn("k_", number)
    several = several.withColumn("mine_", F.filter(F.sort_array("positions_"), lambda x, i: F.pmod(i, F.col("same_")) == F.col("k_") - 1)).drop("k_")
    every = joined.where("same_ = 1").withColumn("mine_", F.sort_array("positions_")).unionByName(several)
    out = every.select(*(F.col(f"c{i}") for i in range(len(docs.columns))), F.posexplode("mine_").alias("epoch_", "position_"))
    return out.toDF(*docs.columns, "epoch_", "position_").sort("position_")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM by_source
), weighed AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked
), levels AS (
  SELECT k.cap / k.weight AS turn,
         ((SELECT sum(source_size) FROM weighed) - coalesce((SELECT sum(b.cap) FROM weighed b WHERE b.cap / b.weight < k.cap / k.weight), 0))
         / (SELECT sum(a.weight) FROM weighed a WHERE a.cap / a.weight >= k.cap / k.weight) AS level
  FROM weighed k
), goal AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT max(level) FROM levels)) AS target FROM weighed
), running AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2 AS middle FROM sized
)
SELECT r.doc_id, r.size, g.source_size, g.target,
       CAST(r.size * (CAST(middle < target AS INT) + CAST(middle + g.source_size < target AS INT) + CAST(middle + 2 * g.source_size < target AS INT)) AS BIGINT) AS taken
FROM running r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
"""
