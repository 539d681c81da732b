"""Running values over an order of all rows, however many rows one key has.

Rows are cut into ranges of the order; a range is a group of a window, and what a range needs of those beside it is one value for
each range. Ties in the order should be broken by its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.scratch import stored

PART, PLACE = "_part", "_place"


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with the range they fall in and their place in the order, as a stored table."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ranged.withColumn(PART, F.spark_partition_id()).withColumn(PLACE, F.monotonically_increasing_id()))


def _running(rows: DataFrame, value: str, out: str, forward: bool) -> DataFrame:
    """``rows``, of `in_order`, with the nearest ``value`` that is not null, at or before the row (forward) or at or after it."""
    turn = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    so_far = Window.orderBy(turn(PART)).rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.col(value).isNotNull(), F.col(PLACE))
    last = (F.max_by if forward else F.min_by)(value, some)
    # One row a range.
    beside = rows.groupBy(PART).agg(last.alias("_own")).select(PART, F.last("_own", ignorenulls=True).over(so_far).alias("_beside"))
    within = Window.partitionBy(PART).orderBy(turn(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_near", F.last(value, ignorenulls=True).over(within)).join(F.broadcast(beside), PART)
    return found.withColumn(out, F.coalesce("_near", "_beside")).drop("_near", "_beside")


def nearest_before(rows: DataFrame, value: str, out: str) -> DataFrame:
    return _running(rows, value, out, True)


def nearest_after(rows: DataFrame, value: str, out: str) -> DataFrame:
    return _running(rows, value, out, False)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, of `in_order`, with their ``number`` in the order, from 0."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_size"), F.min(PLACE).alias("_first"))
    sizes = sizes.select(PART, "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # Places follow each other within a range.
    return rows.join(F.broadcast(sizes), PART).withColumn("number", F.col(PLACE) - F.col("_first") + F.col("_before")).drop("_first", "_before")
