"""The size gate, checksums, groups of equal content and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.operators.storage import settle


def size_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("size").agg(F.count(F.lit(1)).alias("n_files"))


def colliding(files: DataFrame) -> DataFrame:
    """The files whose size another file has too, whatever their location. Sizes are counted before they are shuffled;
    contents stay where they are if few sizes collide (the join is then a broadcast)."""
    shared = size_histogram(files.select("size")).filter("n_files > 1").select("size")
    return files.join(shared, "size", "left_semi")


def content_checksum(content: str = "content"):
    """MD5 of a file's bytes in upper hex."""
    return F.upper(F.md5(F.col(content).cast("binary")))


#: Colliding sizes up to which they are broadcast (8 bytes each).
BROADCAST_SIZES = 1_000_000


def gated_checksums(files: DataFrame) -> DataFrame:
    """``files`` with checksum instead of content: null where no other file has the size, and where content is null.

    Up to ``BROADCAST_SIZES`` colliding sizes (they are counted first) go to where the contents are read, and only gated
    files are hashed. Beyond, nearly every file is gated; then the hash is taken first, so that the join moves sizes and
    hashes but no contents.
    """
    shared = size_histogram(files.select("size")).filter("n_files > 1").select(F.col("size").alias("shared_size"))
    shared = settle(shared, "shared-sizes")
    rest = [c for c in files.columns if c != "content"]
    gated = F.col("shared_size").isNotNull()
    if shared.count() <= BROADCAST_SIZES:
        joined = files.join(F.broadcast(shared), F.col("size") == F.col("shared_size"), "left")
        return joined.select(*rest, F.when(gated, content_checksum()).alias("checksum"))
    hashed = files.select(*rest, content_checksum().alias("checksum"))
    joined = hashed.join(shared, F.col("size") == F.col("shared_size"), "left")
    return joined.select(*rest, F.when(gated, F.col("checksum")).alias("checksum"))


def groups(hashed: DataFrame) -> DataFrame:
    """(size, checksum, n, first_ord): every content that occurs, unhashed files aside."""
    known = hashed.filter(F.col("checksum").isNotNull())
    return known.groupBy("size", "checksum").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    return groups(hashed).filter("n > 1")


def members(hashed: DataFrame) -> DataFrame:
    """The files of duplicate groups with the group's size and first member."""
    return hashed.join(duplicate_groups(hashed), ["size", "checksum"])


def redundant_copies(hashed: DataFrame) -> DataFrame:
    """Members but the first of each group."""
    return members(hashed).filter(F.col("ord") != F.col("first_ord"))


def summary(hashed: DataFrame) -> DataFrame:
    """One row: files scanned, copies beyond the first, and the bytes that these take."""
    dup = groups(hashed).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates_found"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).cast("long").alias("space_taken"),
    )
    return hashed.agg(F.count(F.lit(1)).alias("files_scanned")).crossJoin(dup)
