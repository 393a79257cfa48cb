"""Places of rows in an order over a whole table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.sources.scratch import stage

#: Bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a written table with ``row``, a long that no two rows share, so that an order can be made total."""
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), label)


def in_order(rows: DataFrame, *order: Column, label: str = "in-order") -> DataFrame:
    """``rows`` with ``place``, from 0 in the given order, and ``part``, the range that a row was sorted in; written once.

    Ranges are sorted apart, and then each place is moved by the number of rows in earlier ranges. ``order`` should be total (see
    ``numbered``): rows that it doesn't tell apart can't be split over ranges. What is broadcast has one row for each range, so at most one for
    each shuffle partition. ``rows`` are read twice, for a sample and for the sort, so give a written table.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    written = stage(sorted_.withColumn("part", F.shiftright("__id", _ROW_BITS).cast("int")).withColumn("__id", F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), label)
    sizes = written.groupBy("part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return written.join(F.broadcast(moved), "part").withColumn("place", F.col("__id") + F.col("__before")).drop("__id", "__before")


def within(placed: DataFrame, group: str) -> DataFrame:
    """Rows of ``in_order``, whose order begins with ``group``, with ``first``, the least place of the group, and ``size``, its number of rows.

    A group has at most one row for each range in what is joined, and a range's rows of a group are at most the range: neither is hot.
    """
    pieces = placed.groupBy(group, "part").agg(F.min("place").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    return placed.join(pieces.select(group, "part", F.min("__first").over(whole).alias("first"), F.sum("__n").over(whole).alias("size")), [group, "part"])
