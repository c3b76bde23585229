"""Points in intervals by equal keys: an interval is a few aligned blocks of time, a point lies in one block a level.

The blocks of level k are 2^k base blocks long and aligned, so an interval of n
base blocks is at most 2 log2(n) + 2 disjoint blocks, whatever its length, and a
point meets each interval in at most one of them.  Points are repeated only
for the levels that intervals of their key really use: short intervals
use one or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The highest level there can be: more base blocks than whole numbers of 64 bits can tell apart.
LEVELS = 61


def _base(x: Column, width: int) -> Column:
    """The base block of a place, exact for all whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(width)), F.lit(width))


def _down(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def cover(low: Column, high: Column, width: int) -> Column:
    """Disjoint aligned blocks, structs (level, block), of the base blocks of ``width`` that [low, high) touches.

    An empty interval has none.  On each level what does not fill a block of the
    next level is taken: at most one block at either end.
    """
    a, b = _base(low.cast("long"), width), _base(high.cast("long") - 1, width) + 1
    whole = F.lit(1).cast("long")
    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(b - a, whole).cast("double"))).cast("int") + 1))

    def on(level: Column) -> Column:
        lo, hi = -_down(-a, level), _down(b, level)
        next_lo, next_hi = -_down(-a, level + 1), _down(b, level + 1)
        inside = next_lo < next_hi
        left = F.when((lo < hi) & (~inside | (lo < 2 * next_lo)), lo)
        # Where the next level has nothing, at most two neighbouring blocks are left.
        right = F.when((lo < hi) & F.when(inside, hi > 2 * next_hi).otherwise(hi - lo > 1), hi - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda x: F.struct(level.alias("level"), x.cast("long").alias("block")))

    return F.when(low < high, F.flatten(F.transform(levels, on))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def points_in(points: DataFrame, intervals: DataFrame, key: str, point: str, low: str, high: str, width: int) -> DataFrame:
    """All columns of both, a row for each point of a key in [low, high) of an interval of that key.

    ``width``: the base block, about the length of a short interval.
    """
    asked = intervals.where(F.col(low) < F.col(high)).withColumn("cover_", F.explode(cover(F.col(low), F.col(high), width)))
    asked = asked.select("*", F.col("cover_.level").alias("level_"), F.col("cover_.block").alias("block_")).drop("cover_")
    used = asked.groupBy(F.col(key).alias("key_")).agg(F.sort_array(F.collect_set("level_")).alias("levels_"))
    placed = points.join(used, points[key] == used["key_"]).drop("key_").withColumn("level_", F.explode("levels_")).drop("levels_")
    met = placed.withColumn("block_", _down(_base(F.col(point).cast("long"), width), F.col("level_"))).join(asked, [key, "level_", "block_"]).drop("level_", "block_")
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
