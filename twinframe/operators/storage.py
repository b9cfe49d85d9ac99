"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where none is set, a session on one machine (a ``local`` master) gets a
    temporary folder; on a cluster that is an error, as machines do not see each other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="twinframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a written table: computed once, and not again if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/twinframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._settled = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again. What was made from them must be settled itself."""
    for t in tables:
        path = getattr(t, "_settled", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
