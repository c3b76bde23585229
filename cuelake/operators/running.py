"""Sums and numbers along an order within a key, where one key may hold most rows.

A window over a key gathers all its rows in one task.  Here the order, a column
of whole numbers, is cut into blocks of BLOCK consecutive values: each block
sums its own rows, the few totals of a key's blocks are summed in a window, and
every row adds what lies before it in its block.  No task holds more of a key
than a block and one narrow row for each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive values of the order that one block covers.
BLOCK = 4096


def _keyed(rows: DataFrame, keys: list[str], by: str, block: int, nulls: bool) -> tuple[DataFrame, list[str]]:
    """``rows`` with what they are dealt by, and its names: the keys, and the block of the place, the least of all where there is none.

    Null keys are told by a column of their own: windows and joins by plain
    columns need one exchange, comparisons that are safe for nulls a second one.
    """
    whole, size = F.col(by).cast("long"), F.lit(block)
    place = F.coalesce(F.call_function("div", whole - F.pmod(whole, size), size), F.lit(-(1 << 63)).cast("long"))
    made = {"block_": place}
    if nulls:
        for i, k in enumerate(keys):
            made |= {f"key{i}_": F.coalesce(F.col(k), F.lit("0").cast(rows.schema[k].dataType)), f"none{i}_": F.col(k).isNull()}
        keys = [f"{x}{i}_" for i in range(len(keys)) for x in ("key", "none")]
    return rows.withColumns(made), [*keys, "block_"]


def _ahead(own: Window) -> Column:
    return F.coalesce(F.sum("amount_").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(rows: DataFrame, keys: list[str], by: str, amount: Column, name: str, block: int = BLOCK, nulls: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` and ``name``: the sum of ``amount`` over the rows of equal ``keys`` that come earlier along ``by``.

    Null keys are a key, or left out where ``nulls`` is false; rows without a
    place come first, null amounts count as 0; of rows of one place those come first that are
    first along ``then``.  ``rows`` is read twice, so it should be a stored table.
    """
    placed, where = _keyed(rows.withColumn("amount_", F.coalesce(amount.cast("long"), F.lit(0))), keys, by, block, nulls)
    totals = placed.groupBy(*where).agg(F.sum("amount_").alias("amount_"))
    totals = totals.select(*where, _ahead(Window.partitionBy(*where[:-1]).orderBy("block_")).alias("ahead_"))
    met = placed.withColumn("own_", _ahead(Window.partitionBy(*where).orderBy(by, *then))).join(totals, where)
    return met.select(*rows.columns, (F.col("ahead_") + F.col("own_")).alias(name))


def numbered(rows: DataFrame, key: str, outer: str, inner: str, name: str, block: int = BLOCK, nulls: bool = True, beside: DataFrame | None = None) -> DataFrame:
    """``rows`` and ``name``: 0, 1, 2 ... along (outer, inner) within ``key``, whatever the share of a key or of one ``outer``.

    Rows go through one exchange; what lies ahead of a block of an ``outer`` is
    summed over narrow rows.  ``beside``: a table by (key, outer) whose other columns the rows
    get too, null where it has none; it meets the narrow rows.
    """
    placed, where = _keyed(rows.withColumn("amount_", F.lit(1).cast("long")), [key, outer], inner, block, nulls)
    counts = placed.groupBy(key, outer, *(w for w in where if w not in (key, outer))).agg(F.count("*").alias("n_"))
    counts = counts.withColumnRenamed("block_", "inner_")
    counts = running(counts, [key], outer, F.col("n_"), "ahead_", block, nulls, ("inner_",)).withColumnRenamed("inner_", "block_")
    more = []
    if beside is not None:
        more = [c for c in beside.columns if c not in (key, outer)]
        counts = counts.join(beside, [key, outer], "left")
    own = placed.withColumn("own_", _ahead(Window.partitionBy(*where).orderBy(inner)))
    met = own.join(counts.select(*where, "ahead_", *more), where)
    return met.select(*rows.columns, (F.col("ahead_") + F.col("own_")).alias(name), *more)
