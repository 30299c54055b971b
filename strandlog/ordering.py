"""Order-dependent operations that do not put one group into one task.

Rows are range-partitioned by group and order together, so a group of any size spreads
over as many partitions as it needs; what crosses a partition's edge is one row per
partition, fetched from a table that has as many rows as there are partitions. Of rows
that are few in all (``SMALL_ROWS``, counted by the caller) no group can be large, so a
window over each group does the same without the passes that ranges take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import materialise

#: Rows in all up to which groups are ordered by windows.
SMALL_ROWS = 100_000

_PID = "__pid"


def _ranged(df: DataFrame, columns: list[str], label: str, stored: bool) -> DataFrame:
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    if n > 1 and not stored:
        df = materialise(df, label + "-rows")  # range partitioning reads its input twice; what made the rows runs once
    spread = df.repartitionByRange(n, *columns) if n > 1 else df.coalesce(1)
    return materialise(spread.withColumn(_PID, F.spark_partition_id()), label)


def with_previous(df: DataFrame, group: list[str], order: list[str], value: str, name: str, stored: bool = False, at_most: int | None = None) -> DataFrame:
    """``df`` with column ``name``: ``value`` of the row before in its group, null for the first.

    ``order`` should be unique within a group; tied rows keep an arbitrary order. ``value`` should not be null.
    All columns are written out, so give only those needed; ``stored`` says that ``df``
    is read from a table already, which is then not written again. ``at_most`` is a number
    of rows that the caller has counted ``df`` not to exceed.
    """
    if at_most is not None and at_most <= SMALL_ROWS:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))
    placed = _ranged(df, [*group, *order], "ordered", stored)
    local = Window.partitionBy(_PID, *group).orderBy(*order)
    inside = placed.withColumn(name, F.lag(value).over(local)).withColumn("__first", F.row_number().over(local) == 1)
    # the last row of each partition, handed to the next partition that has rows
    ends = placed.groupBy(_PID).agg(F.max_by(F.struct(*group, F.col(value).alias("__carried")), F.struct(*group, *order)).alias("__end"))
    handed = ends.select(F.lead(_PID).over(Window.orderBy(_PID)).alias(_PID), F.col("__end"))
    joined = inside.join(F.broadcast(handed.where(F.col(_PID).isNotNull())), _PID, "left")  # one row per partition
    same = F.col("__first")
    for g in group:
        same = same & F.col(f"__end.{g}").eqNullSafe(F.col(g))
    carried = F.when(F.col(name).isNull() & same, F.col("__end.__carried")).otherwise(F.col(name))
    return joined.withColumn(name, carried).drop("__first", "__end", _PID)


def number_rows(df: DataFrame, group: str, order: list[str], name: str, stored: bool = False, at_most: int | None = None) -> DataFrame:
    """``df`` with column ``name``: 0, 1, 2 ... within each group in ``order``, without gaps; ``stored`` and ``at_most`` as in :func:`with_previous`."""
    if at_most is not None and at_most <= SMALL_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))
    placed = _ranged(df, [group, *order], "numbered", stored)
    counts = placed.groupBy(_PID, group).agg(F.count(F.lit(1)).alias("__n"))
    # at most one row per partition and group that begins in it; summed per group
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col(_PID).alias("__p"), F.col(group).alias("__g"), before.alias("__base"))
    local = F.row_number().over(Window.partitionBy(_PID, group).orderBy(*order)) - 1
    numbered = placed.withColumn("__local", local)
    joined = numbered.join(bases, (F.col(_PID) == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.withColumn(name, F.col("__base") + F.col("__local")).drop(_PID, "__p", "__g", "__base", "__local", "__n")
