"""Real directories as ``files`` and ``folders``.

Spark's own file sources leave out empty files, hidden names and folders without files. Here a frontier of folders is
listed in the tasks, level by level, so every name is found; the folders must be readable where tasks run. Links are not
followed. A folder that cannot be listed is kept with its error and counts as not hashable, as does an unreadable file.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators.storage import settle
from twinframe.operators.tree import HIDDEN

_COLUMNS = {"location_seq": "int", "root": "string", "path": "string", "is_file": "boolean", "size": "long", "attributes": "int", "created": "double", "error": "string", "not_folder": "boolean"}
_LISTED = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items())


def _attributes(name: str, stat: os.stat_result) -> int:
    """The system's attribute bits where it has them; a leading dot hides."""
    return getattr(stat, "st_file_attributes", 0) | (HIDDEN if name.startswith(".") else 0)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for seq, root, path in batch[["location_seq", "root", "path"]].itertuples(index=False):
            try:
                with os.scandir(path) as entries:
                    for e in entries:
                        try:
                            if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False):
                                own = e.stat(follow_symlinks=False)
                                is_file = not e.is_dir(follow_symlinks=False)
                                born = getattr(own, "st_birthtime", own.st_ctime)
                                rows.append((seq, root, f"{path}/{e.name}", is_file, own.st_size if is_file else 0, _attributes(e.name, own), born, None, False))
                        except OSError as x:
                            rows.append((seq, root, f"{path}/{e.name}", True, 0, 0, None, str(x), False))
            except OSError as x:
                rows.append((seq, root, path, False, 0, 0, None, str(x), isinstance(x, NotADirectoryError)))
        yield pd.DataFrame(rows, columns=[*_COLUMNS])


def listing(spark: SparkSession, roots: list[str], first_seq: int = 0, progress: Callable[[float], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, folders) below ``roots``: location_seq, root, path, attributes (bits; 2 hidden, 4 system), created (seconds
    since 1970), error; files with size, folders with not_folder (a root that is something else).

    ``progress`` is told the part of the folders found so far that is listed.
    """
    start = [(first_seq + n, r.rstrip("/") or "/", r.rstrip("/") or "/") for n, r in enumerate(roots)]
    frontier = spark.createDataFrame(start, "location_seq int, root string, path string")
    empty = {"is_file": F.lit(False), "size": F.lit(0), "attributes": F.lit(0), "created": F.lit(None), "error": F.lit(None), "not_folder": F.lit(False)}
    found = frontier.select("location_seq", "root", "path", *[c.cast(_COLUMNS[name]).alias(name) for name, c in empty.items()])
    width, listed, waiting = spark.sparkContext.defaultParallelism, 0, len(roots)
    while waiting:
        level = settle(frontier.repartition(width).mapInPandas(_list, _LISTED), "listing")
        found = found.unionByName(level)
        frontier = level.filter(~F.col("is_file") & F.col("error").isNull()).select("location_seq", "root", "path")
        listed, waiting = listed + waiting, frontier.count()
        if progress:
            progress(listed / (listed + waiting))
    # A folder that failed stands twice: as found, and with its error.
    rest = [c for c in _COLUMNS if c not in ("location_seq", "root", "path", "is_file")]
    merged = found.groupBy("location_seq", "root", "path", "is_file").agg(*[F.max(c).alias(c) for c in rest])
    return merged.filter("is_file").drop("is_file", "not_folder"), merged.filter(~F.col("is_file")).drop("is_file", "size")


def _digest(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "md5").hexdigest().upper()
    except OSError:
        return None


def file_checksums(files: DataFrame) -> DataFrame:
    """``files`` with checksum, read in pieces of constant memory; null where a file cannot be read."""

    @F.pandas_udf("string")
    def digests(paths: pd.Series) -> pd.Series:
        return paths.map(_digest)

    return files.withColumn("checksum", digests("path"))
