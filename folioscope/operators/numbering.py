"""Dense numbers and running sums in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.storage import saved

#: A fixed value: monotonically_increasing_id has a partition's number above this many bits, and the row's place below.
PLACE_BITS = 33


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df``, written in ranges of ``order``, with _part, a range's number, and _at: 0, 1, ... inside it.

    Ranges come from quantiles of a sample, so sparse, crowded and repeated keys are dealt alike, as long as
    ``order`` ends in something that varies. ``df`` is read twice, so it should be a written table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    split = {"_part": F.shiftright("_at", PLACE_BITS), "_at": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}
    return saved(dealt.withColumns(split), "ranged")


def before_each(totals: DataFrame, total: str) -> DataFrame:
    """(_part, _before), to be broadcast: the sum of ``total`` over the ranges before each. A shuffle's partitions are its rows."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_part", F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias("_before")))


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written in order, with ``name``: 1, 2, ... in order of ``order``, each row a number of its own.

    Rows that tie are numbered one after the other, nulls stand where ``order`` puts them, and an
    empty table gives no rows.
    """
    rows = ranged(df, order)
    before = before_each(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "n")
    return rows.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def running_sum(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """``df``, written in order, with ``name``: the sum of ``value`` over the rows before each, in order of ``order``."""
    rows = ranged(df.withColumn("_value", value), order)
    before = before_each(rows.groupBy("_part").agg(F.sum("_value").alias("n")), "n")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def cells_before(df: DataFrame, keys: list[str], cell: str, value: Column, over: str) -> DataFrame:
    """(``keys``, ``cell``, _earlier): what ``over`` (max or sum) makes of ``value`` in the cells before each, of the same keys.

    A row for each cell, so that no task has all rows of a key.
    """
    each = df.groupBy(*keys, cell).agg(getattr(F, over)(value).alias("_each"))
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, cell, getattr(F, over)("_each").over(earlier).alias("_earlier")).where("_earlier is not null")
