"""Scans one after another into one tree, with ids that never change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.paths import ancestors, parent_path
from twinframe.operators import duplicates, merkle, tree
from twinframe.operators.storage import settle
from twinframe.sources import csv_tree, directory

#: The steps of a scan, as told to its ``progress`` callback with the part of the step that is done.
STEPS = ("list", "hash", "fold", "group")


def part(x: float | None) -> float:
    """A fraction as progress shows it: within 0 to 1, none as 0."""
    return min(1.0, max(0.0, x or 0.0))


class Session:
    """State: the nodes of all locations (with the checksums computed so far), how many files have each size and which was
    the first, and the groups.

    A scan works on its own location and on what it changes in others: the one file of a size that now has a second, and
    the folders above it. Other nodes are neither summed, hashed nor numbered again.
    """

    def __init__(self, spark: SparkSession, include_hidden: bool = True, *, collation: str | None = None, refuse_overlap: bool = False):
        """``collation``: order names by it (for instance UNICODE), not as bytes. ``refuse_overlap``: a location above or
        below another one is an error; otherwise only the exact path is compared, and files may count twice."""
        self.spark, self.include_hidden, self.collation, self.refuse_overlap = spark, include_hidden, collation, refuse_overlap
        self.groups: DataFrame | None = None
        self.nodes: DataFrame | None = None
        self._tables: list[str] = []
        self._sizes: DataFrame | None = None
        self._unread: DataFrame | None = None
        self._sources: dict[int, DataFrame] = {}
        self._next = 0
        self._tag = f"scan-{uuid.uuid4().hex}"

    @property
    def files(self) -> DataFrame | None:
        return None if self.nodes is None else self.nodes.filter(F.col("kind") == tree.FILE)

    @property
    def folders(self) -> DataFrame | None:
        return None if self.nodes is None else self.nodes.filter(F.col("kind") == tree.FOLDER)

    def knows(self, root: str) -> bool:
        """Whether ``root`` is a folder of the tree, by its exact path."""
        return self.folders is not None and not self.folders.filter(F.col("path") == root).isEmpty()

    def overlaps(self, root: str) -> bool:
        """Whether a folder of the tree lies below ``root``, or ``root`` below a location."""
        if self.folders is None:
            return False
        inside = F.col("path").startswith(root + "/") | F.startswith(F.lit(root), F.concat("root", F.lit("/")))
        return not self.folders.filter(inside & (F.col("root") != "")).isEmpty()

    def cancel(self) -> None:
        """Stop this session's running scan, from another thread; the scan fails there, and the state stays as it was."""
        self.spark.sparkContext.cancelJobGroup(self._tag)

    def scan(
        self, source: str | DataFrame, root: str | None = None, folders: DataFrame | None = None, *, recompute: bool = False, hash_all: bool = False, progress: Callable[[str, float], None] | None = None
    ) -> Session:
        """Add a location: a directory, or a relation (path, size, content or checksum) below ``root``.

        A location that is already a folder of the tree is skipped. Only files whose size occurs twice, in any location,
        and that have no checksum yet are hashed (``recompute``: all such files on disk anew); folders and groups follow.
        A relation with content is read again when a later scan brings the second file of a size, so it must stay
        readable; ``hash_all`` hashes all its contents at once instead, for one that does not. A directory that cannot be
        listed is a folder without checksum; a location that is a file is an error.
        """
        root = source if root is None else root
        if not isinstance(root, str):
            raise TypeError("a location needs the path of its folder")
        root = root.rstrip("/") or root
        if self.knows(root):
            return self
        if self.refuse_overlap and self.overlaps(root):
            raise ValueError(f"{root} overlaps a location that was scanned")
        context = self.spark.sparkContext
        context.setJobGroup(self._tag, f"scan {root}", True)
        try:
            self._add(source, root, folders, recompute, hash_all, progress or (lambda step, done: None))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return self

    def _add(self, source: str | DataFrame, root: str, folders: DataFrame | None, recompute: bool, hash_all: bool, tell: Callable[[str, float], None]) -> None:
        seq = self._next
        at = (F.lit(seq).alias("location_seq"), F.lit(root).alias("root"), "path")
        tell(STEPS[0], 0.0)
        blocked, none = None, F.lit(None).cast("string")
        if isinstance(source, str):
            found, folders = directory.listing(self.spark, [root], seq, progress=lambda p: tell(STEPS[0], p))
            if not folders.filter(F.col("not_folder")).isEmpty():
                raise NotADirectoryError(root)
            if not self.include_hidden:
                shown = ~F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path")).rlike(r"/\.")
                found, folders = found.filter(shown), folders.filter(shown)
            blocked = folders.filter(F.col("error").isNotNull()).select("location_seq", "root", "path")
            new = found.select(*at, "size", none.alias("given"), F.lit(True).alias("on_disk"))
        else:
            given = F.col("checksum") if "checksum" in source.columns else duplicates.content_checksum() if hash_all else none
            new = source.select(*at, F.col("size").cast("long").alias("size"), given.alias("given"), F.lit(False).alias("on_disk"))
        new = settle(new, "location")
        own = self.spark.createDataFrame([(seq, root, root)], "location_seq int, root string, path string")
        listed = own if folders is None else own.unionByName(folders.select(*at))
        every = settle(tree.folders(new, listed), "location-folders")
        tell(STEPS[0], 1.0)

        tell(STEPS[1], 0.0)
        counted = new.groupBy("size").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.struct("location_seq", "path")).alias("first"))
        before = self._sizes
        sizes = counted if before is None else before.unionByName(counted).groupBy("size").agg(F.sum("n_files").alias("n_files"), F.min("first").alias("first"))
        sizes = settle(sizes, "sizes")
        shared = settle(sizes.filter("n_files > 1").select("size"), "shared-sizes")
        due = new.join(shared, "size", "left_semi")
        hashed = self._hashed(due, {seq: source})
        new = settle(new.join(hashed, "path", "left").select("location_seq", "root", "path", "size", "given", "on_disk", "checksum"), "location-hashed")
        changed = None
        if before is not None:
            # What this scan releases: files that were the only ones of their size, and those that could not be read before.
            alone = before.filter("n_files = 1").join(counted.select("size"), "size", "left_semi").select("first.location_seq", "first.path")
            again = alone if self._unread is None else alone.unionByName(self._unread)
            old = self.files.select("location_seq", "root", "path", "size", "given", "on_disk")
            pending = old.join(again.distinct(), ["location_seq", "path"], "left_semi")
            if recompute:
                pending = pending.unionByName(old.filter("on_disk").join(shared, "size", "left_semi")).distinct()
            pending = settle(pending, "pending")
            if not pending.isEmpty():
                read = self._hashed(pending, self._sources)
                changed = settle(pending.join(read, "path", "left").select("location_seq", "root", "path", "checksum"), "released")
        unread = new.join(shared, "size", "left_semi").filter("on_disk and checksum is null").select("location_seq", "path")
        if changed is not None:
            unread = unread.unionByName(changed.filter("checksum is null").select("location_seq", "path"))
        unread = settle(unread, "unread")
        tell(STEPS[1], 1.0)

        tell(STEPS[2], 0.0)
        fresh = merkle.nodes(new, every, gated=True, blocked=blocked, collation=self.collation, progress=lambda p: tell(STEPS[2], 0.9 * p))
        fresh = fresh.join(new.select("path", "given", "on_disk", F.lit(tree.FILE).alias("kind")), ["path", "kind"], "left").select(*_NODES)
        renewed = None if changed is None else self._renewed(changed)
        tell(STEPS[2], 1.0)

        tell(STEPS[3], 0.0)
        todo = fresh if renewed is None else fresh.unionByName(renewed)
        # Ids that exist stay; the new keys of this scan all rank by where they stand.
        todo = todo.withColumn("epoch", F.when(F.col("checksum").isNotNull(), F.lit(seq)))
        done, groups = merkle.group_ids(settle(todo, "grouped"), self.groups)
        done = done.select(*_NODES, "group_id")
        tables = [*self._tables]
        if renewed is not None:
            done = settle(done, "renewed")
            kept = self.nodes.join(done.select("location_seq", "path", "kind"), ["location_seq", "path", "kind"], "left_anti")
            done, tables = kept.select(*_NODES, "group_id").unionByName(done), []
        tables.append(settle(done, "session-nodes")._settled)
        # Only now does the state change, so a scan that fails leaves it as it was.
        self._keep(tables)
        self.groups, self._sizes, self._unread = groups, sizes, unread
        if not isinstance(source, str):
            self._sources[seq] = source
        self._next += 1
        tell(STEPS[3], 1.0)

    def _keep(self, tables: list[str]) -> None:
        self._tables, schema = tables, _SCHEMA
        self.nodes = self.spark.read.schema(schema).parquet(*tables)

    def _hashed(self, due: DataFrame, sources: dict[int, str | DataFrame]) -> DataFrame:
        """(path, checksum) of the files ``due``: given, read from disk, or read again from their relation."""
        out = due.filter("given is not null").select("path", F.col("given").alias("checksum"))
        out = out.unionByName(directory.file_checksums(due.filter("on_disk")).select("path", "checksum"))
        open_ = due.filter("given is null and not on_disk").select("location_seq", "path")
        readable = {n: s for n, s in sources.items() if isinstance(s, DataFrame) and "content" in s.columns}
        for r in open_.select("location_seq").distinct().collect() if readable else []:
            s = readable.get(r["location_seq"])
            if s is not None:
                wanted = open_.filter(F.col("location_seq") == r["location_seq"]).select("path")
                out = out.unionByName(s.select("path", "content").join(wanted, "path", "left_semi").select("path", duplicates.content_checksum().alias("checksum")))
        return out

    def _renewed(self, changed: DataFrame) -> DataFrame:
        """The nodes that ``changed`` files (with their new checksums) alter: themselves and the folders above them."""
        above = changed.select("location_seq", "root", F.explode(ancestors(F.col("path"), F.col("root"))).alias("path")).distinct()
        above = settle(above, "above")
        key = ["location_seq", "path"]
        nodes = self.nodes.withColumn("parent", F.when(F.col("path") != F.col("root"), parent_path(F.col("path"))))
        inside = nodes.join(above.select("location_seq", F.col("path").alias("parent")), ["location_seq", "parent"], "left_semi")
        inside = settle(inside.select(*_NODES), "inside")
        files = inside.filter(F.col("kind") == tree.FILE).join(changed.select(*key, F.col("checksum").alias("now"), F.lit(True).alias("is_new")), key, "left")
        files = files.withColumn("checksum", F.when(F.col("is_new"), F.col("now")).otherwise(F.col("checksum")))
        files = settle(files.withColumn("epoch", F.when(F.col("checksum").isNotNull(), F.col("location_seq"))), "inside-files")
        rest = inside.filter(F.col("kind") == tree.FOLDER).join(above, key, "left_anti")
        summed = merkle.folder_checksums(files, above, others=rest.withColumn("epoch", F.when(F.col("checksum").isNotNull(), F.col("location_seq"))), collation=self.collation)
        old = self.nodes.filter(F.col("kind") == tree.FOLDER).drop("checksum", "epoch", "group_id")
        folders = old.join(summed.select(*key, "checksum", "epoch"), key).select(*_NODES)
        return files.filter("is_new").select(*_NODES).unionByName(folders)

    def export_csv(self, path: str) -> None:
        """The listing as one local file; only the header before any scan."""
        if self.nodes is None:
            with open(path, "w", encoding="utf-8") as f:
                f.write(csv_tree.HEADER + "\n")
        else:
            csv_tree.export_file(self.nodes, path)

    def import_csv(self, path: str, lenient: bool = False) -> DataFrame:
        """Replace the tree by a listing; returns the files dropped for want of a folder. Sizes, checksums and groups are
        taken from the rows, so that later scans go on from them."""
        rows, lost = csv_tree.read(self.spark, path, lenient)
        listed = csv_tree.to_nodes(rows)
        empty = F.when(F.col("checksum") != "", F.col("checksum"))
        listed = listed.withColumns({"checksum": empty, "location_seq": F.lit(0), "root": F.lit(""), "epoch": F.when(empty.isNotNull(), F.lit(0)), "given": empty, "on_disk": F.lit(False)})
        listed = listed.withColumns({"file_count": F.col("file_count").cast("long"), "folder_count": F.lit(None).cast("long"), "group_id": F.col("group_id").cast("long")})
        self._keep([settle(listed.select(*_NODES, "group_id"), "imported")._settled])
        counted = self.files.groupBy("size").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.struct("location_seq", "path")).alias("first"))
        self._sizes, self._unread, self._sources = settle(counted, "sizes"), None, {}
        self.groups = settle(self.nodes.filter("checksum is not null and group_id >= 0").groupBy("kind", "checksum").agg(F.min("group_id").alias("group_id")), "groups")
        self._next = 1
        return lost


_NODES = ["location_seq", "root", "path", "kind", "size", "file_count", "folder_count", "extension", "checksum", "epoch", "ord", "given", "on_disk"]
_SCHEMA = (
    "location_seq int, root string, path string, kind string, size long, file_count long, folder_count long, extension string, checksum string, epoch int, ord string, "
    "given string, on_disk boolean, group_id long"
)
