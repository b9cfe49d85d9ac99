"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.operators.storage import discard, shared_dir
from twinframe.operators.storage import settle as materialise

__all__ = ["discard", "in_batches", "materialise", "remainder", "shared_dir", "without"]

#: Rows of a batch that goes to Python. Texts are kilobytes, so Spark's default of 10,000 takes tens of megabytes for each
#: task, several times over.
BATCH_ROWS = 1000


def in_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python ``BATCH_ROWS`` at a time, or fewer if it did already."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (compared as Spark compares names)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
