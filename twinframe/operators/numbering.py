"""Consecutive numbers in a global order, without a single task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.operators.storage import settle

#: Up to so many rows one task numbers them.
SMALL = 100_000


def number(df: DataFrame, order: list[str], name: str, start: int = 0, small: int = SMALL) -> DataFrame:
    """``df`` with ``name`` (a long), the rows' place in ``order`` (unique keys) from ``start`` on.

    Larger inputs are dealt by ranges of the order, numbered within each range, and shifted by the sizes of the ranges
    before; only these sizes reach the driver. A range is sorted in one task: ``spark.sql.shuffle.partitions`` sets how
    many there are.
    """
    df = settle(df, "numbered")
    if df.count() <= small:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1 + start)
    ranged = settle(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before = dict(zip(sorted(sizes), accumulate([0, *[sizes[k] for k in sorted(sizes)]])))
    shifts = df.sparkSession.createDataFrame([*before.items()], "_range int, _before long")
    place = Window.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(place)).join(F.broadcast(shifts), "_range")
    return numbered.withColumn(name, F.col("_before") + F.col("_row") - 1 + start).drop("_range", "_row", "_before")
