"""Folder checksums from below, and group ids by first sight over locations scanned one after another."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.operators.numbering import number
from twinframe.operators.storage import settle
from twinframe.operators.tree import FILE, collated, rollup, with_names


def file_epochs(files: DataFrame) -> DataFrame:
    """Adds epoch: the scan that hashes the file - its own, or the later one that brings the second file of its size;
    null if there is none. ``files`` have checksums of their content, gated or not."""
    per = files.groupBy("size", "location_seq").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("size").orderBy("location_seq")
    second = per.withColumn("upto", F.sum("n").over(run)).filter("upto > 1").groupBy("size").agg(F.min("location_seq").alias("second"))
    joined = files.join(second, "size", "left")
    epoch = F.when(F.col("second").isNotNull() & F.col("checksum").isNotNull(), F.greatest("location_seq", "second"))
    return joined.select(*files.columns, epoch.alias("epoch"))


_CHILD = "location_seq int, path string, rank int, name string, checksum string, epoch int, root string, parent_path string, own_name string"
_LEVEL = "location_seq int, root string, path string, parent_path string, name string, checksum string, epoch int"


def _digests(strict: bool):
    """Folders from their children in order (rank -1: the folder itself); a folder's rows may span batches, and its digest
    takes constant memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, own, digest, whole, latest = None, None, None, True, None
        names = [c.split()[0] for c in _LEVEL.split(", ")]
        kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in _LEVEL.split(", ")]

        def closed() -> list[tuple]:
            if own is None:
                return []
            seq, path = open_key
            root, parent, name = own
            return [(seq, root, path, parent, name, digest.hexdigest().upper() if whole else None, max(seq, seq if latest is None else latest) if whole else None)]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            found = []
            children = zip(*(b.column(n).to_pylist() for n in range(9)))
            for key, group in groupby(children, key=lambda r: r[:2]):
                if key != open_key:
                    found += closed()
                    open_key, own, digest, whole, latest = key, None, hashlib.md5(), True, None
                for _, _, rank, _, checksum, epoch, root, parent, own_name in group:
                    if rank < 0:
                        own = (root, parent, own_name)
                    elif checksum is None:
                        whole = False
                    else:
                        digest.update(f"{rank}{checksum}".encode() if strict else checksum.encode())
                        latest = epoch if latest is None else max(latest, epoch)
            yield rows(found)
        yield rows(closed())

    return work


def folder_checksums(
    files: DataFrame, all_folders: DataFrame, strict: bool = False, *, others: DataFrame | None = None, collation: str | None = None, progress: Callable[[float], None] | None = None
) -> DataFrame:
    """``all_folders`` with checksum and epoch.

    A folder's checksum is the MD5 of its children's checksums, files first, each kind by name (as bytes, or by
    ``collation``); a folder without children has that of no text; a child without one leaves the folder without. Names do
    not count, nor do kinds unless ``strict``. ``others`` (location_seq, root, path, checksum, epoch) are subfolders that
    are not among ``all_folders`` but count as children.

    One job for each level of depth. Items are written once, by depth, so a level reads what lies right below it only.
    Children meet by folder, sorted, and are digested as they come, so a folder of any size takes constant memory; it is
    one task, as it is one digest. ``progress`` is told the part of the levels that is done.
    """
    own = with_names(files.select("location_seq", "root", "path", "checksum", "epoch"), True).withColumn("rank", F.lit(0))
    if others is not None:
        own = own.unionByName(with_names(others.select("location_seq", "root", "path", "checksum", "epoch"), False).withColumn("rank", F.lit(1)))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("root", "parent_path", "own_name")]
    child = lambda df: df.select("location_seq", F.col("parent_path").alias("path"), "rank", "name", "checksum", "epoch", *nothing)
    own = settle(own.filter("parent_path is not null").select("location_seq", "parent_path", "rank", "name", "checksum", "epoch", "depth"), "items", ["depth"])
    named = with_names(all_folders.select("location_seq", "root", "path"), False).select("location_seq", "root", "path", "parent_path", "name", "depth")
    named = settle(named, "folders", ["depth"])
    depths = sorted((r["depth"] for r in named.select("depth").distinct().collect()), reverse=True)
    below, done = None, None
    for n, d in enumerate(depths, 1):
        itself = named.filter(F.col("depth") == d).select(
            "location_seq", "path", F.lit(-1).alias("rank"), F.lit("").alias("name"), F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("int").alias("epoch"), "root", "parent_path", F.col("name").alias("own_name")
        )
        rows = itself.unionByName(child(own.filter(F.col("depth") == d + 1)))
        rows = rows if below is None else rows.unionByName(child(below.withColumn("rank", F.lit(1)).filter("parent_path is not null")))
        by = F.col("name") if collation is None else F.collate(F.col("name"), collation)
        dealt = rows.repartition("location_seq", "path").sortWithinPartitions("location_seq", "path", "rank", by, "name")
        below = settle(dealt.mapInArrow(_digests(strict), _LEVEL), "merkle")
        done = below if done is None else done.unionByName(below)
        if progress:
            progress(n / len(depths))
    if done is None:
        done = named.select("location_seq", "root", "path", F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("int").alias("epoch"))
    return done.select("location_seq", "root", "path", "checksum", "epoch")


def nodes(
    files: DataFrame, all_folders: DataFrame, *, gated: bool = False, blocked: DataFrame | None = None, collation: str | None = None, progress: Callable[[float], None] | None = None
) -> DataFrame:
    """(location_seq, root, path, kind, size, file_count, folder_count, extension, checksum, epoch, ord) of every file and
    folder, not yet grouped.

    ``files`` have content checksums; the size gate is applied here unless they are ``gated`` already (then all that is
    hashed has epoch location_seq). ``blocked`` folders (location_seq, root, path) could not be read and get no checksum.
    """
    timed = files.withColumn("epoch", F.when(F.col("checksum").isNotNull(), F.col("location_seq"))) if gated else file_epochs(files)
    timed = timed.withColumn("checksum", F.when(F.col("epoch").isNotNull(), F.col("checksum")))
    timed = settle(timed.select("location_seq", "root", "path", "size", "checksum", "epoch"), "hashed")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    as_files = with_names(timed, True).select("location_seq", "root", "path", "kind", F.col("size").cast("long").alias("size"), *none("long", "file_count", "folder_count"), "extension", "checksum", "epoch", "ord")
    sums = rollup(timed, all_folders)
    if blocked is not None:
        # An item that cannot be hashed, in each.
        blocked = blocked.select("location_seq", "root", F.concat("path", F.lit("/\u0002")).alias("path"), *none("string", "checksum"), *none("int", "epoch"))
    summed = folder_checksums(timed, all_folders, others=blocked, collation=collation, progress=progress)
    hashed = with_names(summed, False).join(sums, ["location_seq", "path"])
    as_folders = hashed.select("location_seq", "root", "path", "kind", "size", "file_count", "folder_count", "extension", "checksum", "epoch", "ord")
    every = as_files.unionByName(as_folders)
    return settle(every if collation is None else collated(every, collation), "nodes")


def group_ids(found: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with group_id, groups). Each (kind, checksum) is numbered when first seen - by scan, then in traversal
    order - files and folders from one counter; ids of ``known`` groups (kind, checksum, group_id) stay. Unhashed files
    are in group -1, unhashed folders in -2."""
    first = found.filter(F.col("checksum").isNotNull()).groupBy("kind", "checksum").agg(F.min(F.struct("epoch", "ord")).alias("first"))
    start = 0
    if known is not None:
        first = first.join(known.select("kind", "checksum"), ["kind", "checksum"], "left_anti")
        start = known.agg(F.coalesce(F.max("group_id") + 1, F.lit(0))).first()[0]
    fresh = number(first.select("kind", "checksum", F.col("first.epoch").alias("e"), F.col("first.ord").alias("o")), ["e", "o"], "group_id", start)
    fresh = fresh.select("kind", "checksum", "group_id")
    every = settle(fresh if known is None else known.unionByName(fresh), "groups")
    none = F.when(F.col("kind") == FILE, -1).otherwise(-2)
    return found.join(every, ["kind", "checksum"], "left").withColumn("group_id", F.coalesce("group_id", none).cast("long")), every
