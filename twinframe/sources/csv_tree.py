"""The seven-column listing: written line by line, and read with its own grammar.

The writer quotes paths and extensions but escapes nothing; the reader splits at every comma. So a path with a comma does
not come back unless ``lenient`` is set, which splits from both ends instead.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.paths import base_name, order_key, parent_path
from twinframe.operators.numbering import number
from twinframe.operators.storage import settle, shared_dir
from twinframe.operators.tree import FILE, FOLDER

#: Fixed value: the header of a listing.
HEADER = "File/Folder,Path,Size,File Count,Extension,MD5,Group"
COLUMNS = "kind string, path string, size bigint, file_count int, extension string, checksum string, group_id bigint"

#: What is said of a listing that cannot be read.
EMPTY, FEW_HEADINGS, BAD_ROW = "Empty File", "Insufficient number of headings detected", "Error parsing data on row {}"


class InvalidFormat(ValueError):
    """A listing that cannot be read."""


def lines(nodes: DataFrame) -> DataFrame:
    """(ord, line) of each node; file rows have a blank before the group, and no file count."""
    q = F.lit('"')
    tail = F.coalesce(F.col("checksum"), F.lit(""))
    size, group = F.col("size").cast("string"), F.col("group_id").cast("string")
    as_file = F.concat(F.lit("File,"), q, "path", q, F.lit(","), size, F.lit(",,"), q, F.coalesce("extension", F.lit("")), q, F.lit(","), tail, F.lit(", "), group)
    as_folder = F.concat(F.lit("Folder,"), q, "path", q, F.lit(","), size, F.lit(","), F.coalesce(F.col("file_count").cast("string"), F.lit("")), F.lit(",,"), tail, F.lit(","), group)
    return nodes.select("ord", F.when(F.col("kind") == FILE, as_file).otherwise(as_folder).alias("line"))


def export(nodes: DataFrame, path: str) -> None:
    """Write the listing as text files in the folder ``path``: the header, then all rows in traversal order, sorted and
    written in parallel by ranges. The files in the order of their names are the listing."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([("", HEADER)], "ord string, line string")
    head.unionByName(lines(nodes)).orderBy("ord").select("line").write.mode("overwrite").text(path)


def export_file(nodes: DataFrame, path: str) -> None:
    """The same as one local file of the driver: the parallel files are copied one behind another, as bytes."""
    spark = nodes.sparkSession
    with open(path, "wb"):  # an OSError before any work
        pass
    parts = f"{shared_dir(spark)}/twinframe/export-{uuid.uuid4().hex}"
    export(nodes, parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    out = jvm.java.io.FileOutputStream(os.path.abspath(path))
    try:
        for name in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
            if name.startswith("part-"):
                held = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
                held.close()
    finally:
        out.close()
        fs.delete(folder, True)


def parse(rows: DataFrame, lenient: bool = False) -> DataFrame:
    """The columns of a listing's lines (row_number, line), and ``valid``.

    A row is valid with seven fields, a kind of exactly File or Folder, and whole numbers for size, group and (folders
    only) count; blanks around numbers are allowed. Quotes are dropped; checksums are taken as they stand.
    """
    bare = F.split(F.regexp_replace("line", '"', ""), ",")
    if lenient:
        n = F.size(bare)
        bare = F.when(n > 7, F.concat(F.slice(bare, 1, 1), F.array(F.array_join(F.slice(bare, 2, n - 6), ",")), F.slice(bare, n - 4, 5))).otherwise(bare)
    got = rows.withColumn("f", bare).withColumn("n", F.size("f"))
    number = lambda k, kind: F.get("f", F.lit(k)).try_cast(kind)
    kind = F.get("f", F.lit(0))
    count = F.when(kind == FOLDER, number(3, "int"))
    valid = (F.col("n") == 7) & kind.isin(FILE, FOLDER) & number(2, "long").isNotNull() & number(6, "long").isNotNull() & ((kind == FILE) | count.isNotNull())
    return got.select(
        "row_number",
        kind.alias("kind"),
        F.get("f", F.lit(1)).alias("path"),
        number(2, "long").alias("size"),
        count.alias("file_count"),
        F.get("f", F.lit(4)).alias("extension"),
        F.get("f", F.lit(5)).alias("checksum"),
        number(6, "long").alias("group_id"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def last_wins(parsed: DataFrame) -> DataFrame:
    """One row for each kind and path: the one that came last."""
    rest = [c for c in parsed.columns if c not in ("kind", "path")]
    last = parsed.groupBy("kind", "path").agg(F.max_by(F.struct(*rest), "row_number").alias("r"))
    return last.select("kind", "path", *[F.col(f"r.{c}").alias(c) for c in rest])


def folder_roots(parsed: DataFrame) -> DataFrame:
    """Folders whose parent folder is not in the listing: they hang below the root."""
    own = parsed.filter(F.col("kind") == FOLDER).withColumn("parent_path", parent_path(F.col("path")))
    known = own.select(F.col("path").alias("parent_path"))
    return own.join(known, "parent_path", "left_anti").select(*parsed.columns)


def orphans(parsed: DataFrame) -> DataFrame:
    """Files whose folder is not in the listing: they are dropped, and reported."""
    own = parsed.filter(F.col("kind") == FILE).withColumn("parent_path", parent_path(F.col("path")))
    known = parsed.filter(F.col("kind") == FOLDER).select(F.col("path").alias("parent_path"))
    return own.join(known, "parent_path", "left_anti").select(*parsed.columns)


def attached(parsed: DataFrame) -> DataFrame:
    """The listing less its orphans."""
    own = parsed.withColumn("parent_path", parent_path(F.col("path")))
    known = parsed.filter(F.col("kind") == FOLDER).select(F.col("path").alias("parent_path"))
    return parsed.filter(F.col("kind") == FOLDER).unionByName(own.filter(F.col("kind") == FILE).join(known, "parent_path", "left_semi").select(*parsed.columns))


def read(spark: SparkSession, path: str, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, orphans) of a listing file; InvalidFormat names what is wrong first. Row numbers count data rows from 1."""
    # Lines of one file are split in order, and ids rise with the splits.
    text = settle(spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at")), "listing")
    head = text.orderBy("at").first()
    if head is None:
        raise InvalidFormat(EMPTY)
    if len(head["line"].split(",")) < 7:
        raise InvalidFormat(FEW_HEADINGS)
    numbered = number(text.filter(F.col("at") != head["at"]), ["at"], "row_number", 1)
    parsed = settle(parse(numbered.select("row_number", "line"), lenient), "parsed")
    bad = parsed.filter(~F.col("valid")).agg(F.min("row_number")).first()[0]
    if bad is not None:
        raise InvalidFormat(BAD_ROW.format(bad))
    rows = last_wins(parsed.drop("valid"))
    return attached(rows), orphans(rows)


def to_nodes(rows: DataFrame) -> DataFrame:
    """Rows of a listing as nodes in traversal order, checksums and groups as they stand."""
    ord_ = order_key(F.lit(0), F.col("path"), F.col("kind") == FILE)
    return rows.select("*", base_name(F.col("path")).alias("name"), ord_.alias("ord"))
