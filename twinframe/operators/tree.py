"""Trees of named items as relations.

``files``: location_seq, root (the location's folder), path, size, and content or checksum. ``nodes``: one row per file
and folder with kind, parent_path, name, depth and ord.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.paths import END, SEQ_DIGITS, ancestors, base_name, depth, extension, order_key, parent_path
from twinframe.operators.numbering import number
from twinframe.operators.storage import settle

FILE, FOLDER = "File", "Folder"


def with_names(df: DataFrame, is_file: bool) -> DataFrame:
    """Adds kind, parent_path (null at the location's root), name, depth, extension and ord."""
    path = F.col("path")
    return df.select(
        "*",
        F.lit(FILE if is_file else FOLDER).alias("kind"),
        F.when(path != F.col("root"), parent_path(path)).alias("parent_path"),
        base_name(path).alias("name"),
        depth(path).alias("depth"),
        (extension(path) if is_file else F.lit(None).cast("string")).alias("extension"),
        order_key(F.col("location_seq"), path, F.lit(is_file)).alias("ord"),
    )


def folders(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(location_seq, root, path): every folder above a file, and those ``listed`` (for folders without files) with the
    folders above them."""
    above = files.select("location_seq", "root", F.explode(ancestors(F.col("path"), F.col("root"))).alias("path"))
    if listed is not None:
        own = listed.select("location_seq", "root", "path")
        above = above.unionByName(own).unionByName(own.select("location_seq", "root", F.explode(ancestors(F.col("path"), F.col("root"))).alias("path")))
    return above.distinct()


def rollup(files: DataFrame, all_folders: DataFrame) -> DataFrame:
    """(location_seq, path, size, file_count, folder_count): sums over everything below each folder.

    Each item is counted at all its ancestors in one aggregation; sums are partial before they are shuffled, so a folder
    that holds a third of the files costs no more than others.
    """
    key = ["location_seq", "path"]
    at = lambda df, own, size: df.select("location_seq", "root", F.explode(ancestors(F.col("path"), F.col("root"))).alias("path"), *own, size)
    of_files = at(files, [F.lit(1).alias("f"), F.lit(0).alias("d")], F.col("size").cast("long").alias("s"))
    of_folders = at(all_folders, [F.lit(0).alias("f"), F.lit(1).alias("d")], F.lit(0).cast("long").alias("s"))
    own = all_folders.select("location_seq", "root", "path", F.lit(0).alias("f"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("s"))
    every = of_files.unionByName(of_folders).unionByName(own)
    return every.groupBy(*key).agg(F.sum("s").alias("size"), F.sum("f").alias("file_count"), F.sum("d").alias("folder_count"))


def scan_totals(files: DataFrame, all_folders: DataFrame) -> DataFrame:
    """One row: locations, files, folders and bytes."""
    f = files.agg(F.countDistinct("location_seq").alias("locations"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return f.crossJoin(all_folders.agg(F.count(F.lit(1)).alias("folders")))


def top_level(files: DataFrame, search_paths: list[str] | DataFrame) -> DataFrame:
    """The files that lie directly in one of ``search_paths`` (a list, or a relation with column path), with it."""
    placed = files.withColumn("search_path", parent_path(F.col("path")))
    if isinstance(search_paths, list):
        return placed.filter(F.col("search_path").isin(search_paths))
    return placed.join(search_paths.select(F.col("path").alias("search_path")), "search_path", "left_semi")


#: Attribute bits of hidden and system items.
HIDDEN, SYSTEM = 2, 4


def visible(items: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Items that are neither hidden nor system ones; null attributes hide nothing."""
    return items.filter(F.coalesce(F.col(attributes), F.lit(0)).bitwiseAND(HIDDEN | SYSTEM) == 0)


def new_locations(requested: DataFrame, known_folders: DataFrame) -> DataFrame:
    """The requested paths (path) that are no folder of the tree yet: exact, case-sensitive; each once."""
    return requested.select("path").distinct().join(known_folders.select("path").distinct(), "path", "left_anti")


def collated(nodes: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """``nodes`` (location_seq, path, kind, ord) with an ``ord`` in which names stand by ``collation``, equals as bytes.

    The distinct names of the tree are numbered once in that order, and each segment of a path is replaced by its number.
    """
    parts = F.posexplode(F.split("path", "/")).alias("at", "name")
    segments = nodes.select("location_seq", "path", "kind", parts)
    names = segments.select("name").distinct().select("name", F.collate(F.col("name"), collation).alias("as_sorted"))
    numbered = number(names, ["as_sorted", "name"], "place").select("name", F.lpad(F.col("place").cast("string"), 19, "0").alias("place"))
    last = F.size(F.split("path", "/")) - 1
    mark = F.when((F.col("kind") == FILE) & (F.col("at") == last), "0").otherwise("1")
    keyed = segments.join(numbered, "name").select("location_seq", "path", "kind", "at", F.concat(mark, "place", F.lit(END)).alias("key"))
    keys = keyed.groupBy("location_seq", "path", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]), "").alias("key"))
    keys = keys.select("location_seq", "path", "kind", F.concat(F.lpad(F.col("location_seq").cast("string"), SEQ_DIGITS, "0"), F.lit(END), "key").alias("ord"))
    return nodes.drop("ord").join(keys, ["location_seq", "path", "kind"]).select(*nodes.columns)


def map_nodes(nodes: DataFrame, **columns: Column) -> DataFrame:
    """A visit on the way down: ``columns`` from each node's own columns."""
    return nodes.withColumns(columns)


def tree_fold(nodes: DataFrame, leaf: Mapping[str, Column], up: Mapping[str, Column], empty: Mapping[str, Column]) -> DataFrame:
    """A visit on the way up: (location_seq, path, and one column for each name) of every folder.

    ``leaf`` gives a file's values from its columns; ``up`` gives a folder's values by aggregates over its children's
    (their values, kind and name); ``empty`` gives those of a folder without children. ``nodes`` have location_seq, root,
    path and kind. One aggregation a level of depth, each level written, so that it is computed once.
    """
    values = [*leaf]
    own = nodes.withColumn("parent_path", F.when(F.col("path") != F.col("root"), parent_path(F.col("path")))).withColumn("depth", depth(F.col("path"))).withColumn("name", base_name(F.col("path")))
    files = own.filter(F.col("kind") == FILE).select("location_seq", "parent_path", "kind", "name", "depth", *[leaf[v].alias(v) for v in values])
    files = settle(files, "fold-files", ["depth"])
    folders = settle(own.filter(F.col("kind") == FOLDER).select("location_seq", "path", "parent_path", "kind", "name", "depth"), "fold-folders", ["depth"])
    below, done = None, None
    for d in sorted((r["depth"] for r in folders.select("depth").distinct().collect()), reverse=True):
        children = files.filter(F.col("depth") == d + 1).drop("depth")
        children = children if below is None else children.unionByName(below)
        summed = children.groupBy("location_seq", F.col("parent_path").alias("path")).agg(*[up[v].alias(v) for v in values], F.lit(True).alias("any_child"))
        here = folders.filter(F.col("depth") == d).join(summed, ["location_seq", "path"], "left")
        found = [F.when(F.col("any_child"), F.col(v)).otherwise(empty[v]).alias(v) for v in values]
        level = settle(here.select("location_seq", "path", "parent_path", "kind", "name", *found), "fold")
        below = level.drop("path")
        done = level if done is None else done.unionByName(level)
    if done is None:
        done = folders.select("location_seq", "path", *[empty[v].alias(v) for v in values])
    return done.select("location_seq", "path", *values)
