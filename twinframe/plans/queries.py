"""The named queries over the synthetic tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.functions.paths import base_name, clamp, extension, long_date, negation, parent_path, percent, size_suffix
from twinframe.operators import duplicates, merkle, tree
from twinframe.operators.numbering import number
from twinframe.operators.session import Session
from twinframe.operators.storage import settle
from twinframe.plans import trees
from twinframe.plans.trees import DOC_FILES, GEO_FILES, LAST, LINE_FILES, PART_FILES, UP, nodes_sql
from twinframe.sources import csv_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with names, not hashed."""
    return tree.with_names(trees.doc_files(spark, sf_dir), True)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated: null where the size is unique. Written once, as groups and members both read it."""
    files = duplicates.gated_checksums(_docs(spark, sf_dir)).filter("checksum is not null")
    return settle(files.select("path", "parent_path", "name", "size", "checksum", "ord"), "hashed")


def _summed(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, duplicates.content_checksum().alias("checksum"))


def _nodes(files: DataFrame) -> DataFrame:
    """Only contents of shared sizes are hashed."""
    files = settle(duplicates.gated_checksums(files), "files")
    return merkle.nodes(files, tree.folders(files))


GATED = f"f as ({DOC_FILES}), shared as (select size from f group by size having count(*) > 1), h as (select f.* from f semi join shared using (size)), d as (select size, checksum, count(*) as n, min(path) as first_path from h group by all having count(*) > 1)"


@query(f"select location_seq, path, {UP.format('path')} as parent_path, {LAST.format('path')} as name, regexp_extract(path, '([.][^./]+)$', 1) as extension, len(string_split(path, '/'))::int as depth, size from ({DOC_FILES})")
def file_inventory(spark, sf_dir):
    return _docs(spark, sf_dir).select("location_seq", "path", "parent_path", "name", "extension", "depth", "size")


@query(r"select page_id, url as path, regexp_extract(url, '([.][^.\\/]+)$', 1) as extension from pages")
def file_extension(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("path"), extension(F.col("url")).alias("extension"))


@query(r"select page_id, url as path, nullif(regexp_replace(url, '[\\/][^\\/]+$', ''), url) as parent_path, regexp_extract(url, '([^\\/]*)$', 1) as name from pages")
def parent_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("path"), parent_path(F.col("url")).alias("parent_path"), base_name(F.col("url")).alias("name"))


QUERIES["parent_path"], ORACLE_SQL["parent_path"] = QUERIES.pop("parent_paths"), ORACLE_SQL.pop("parent_paths")


@query(f"select size, count(*) as n_files from ({DOC_FILES}) group by size")
def size_histogram(spark, sf_dir):
    return duplicates.size_histogram(trees.doc_files(spark, sf_dir))


@query(f"with {GATED} select path, size from h")
def size_collision_candidates(spark, sf_dir):
    return duplicates.colliding(trees.doc_files(spark, sf_dir).select("path", "size"))


@query(f"select path, checksum from ({DOC_FILES})")
def checksum_all(spark, sf_dir):
    return trees.doc_files(spark, sf_dir).select("path", duplicates.content_checksum().alias("checksum"))


@query(f"with {GATED} select f.path, f.size, h.checksum from f left join h using (path)")
def gated_checksum(spark, sf_dir):
    return duplicates.gated_checksums(trees.doc_files(spark, sf_dir)).select("path", "size", "checksum")


@query(f"with {GATED} select checksum, n from d")
def dup_groups(spark, sf_dir):
    files = duplicates.gated_checksums(trees.doc_files(spark, sf_dir)).filter("checksum is not null")
    return files.groupBy("checksum").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"with {GATED} select path, size, checksum, n as n_copies from h join d using (size, checksum)")
def dup_members(spark, sf_dir):
    return duplicates.members(_hashed(spark, sf_dir)).select("path", "size", "checksum", F.col("n").alias("n_copies"))


@query(f"with {GATED}, r as (select size, checksum, row_number() over (order by first_path) as group_no from d) select group_no, size, path from h join r using (size, checksum)")
def dup_group_members(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    numbered = number(duplicates.duplicate_groups(hashed), ["first_ord"], "group_no", 1)
    return hashed.join(numbered, ["size", "checksum"]).select("group_no", "size", "path")


@query(f"with {GATED} select size, checksum as md5, count(*) as n from h group by all")
def dup_groups_size_md5(spark, sf_dir):
    return duplicates.groups(_hashed(spark, sf_dir)).select("size", F.col("checksum").alias("md5"), "n")


@query(f"with {GATED} select (select count(*) from f) as files_scanned, coalesce(sum(n - 1), 0)::bigint as duplicates_found, coalesce(sum((n - 1) * size), 0)::bigint as space_taken from d")
def dup_summary(spark, sf_dir):
    files = duplicates.gated_checksums(_docs(spark, sf_dir))
    return duplicates.summary(settle(files.select("path", "size", "checksum", "ord"), "hashed"))


@query(f"with {GATED} select path, size, first_path as original from h join d using (size, checksum) where path <> first_path")
def redundant_copies(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    first = hashed.select(F.col("ord").alias("first_ord"), F.col("path").alias("original"))
    return duplicates.redundant_copies(hashed).join(first, "first_ord").select("path", "size", "original")


@query(f"with {GATED}, r as (select size, checksum, row_number() over (order by first_path) as file_group from d) select {LAST.format('path')} as file_name, size as file_size, {UP.format('path')} as folder, file_group from h join r using (size, checksum)")
def dup_report(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    numbered = number(duplicates.duplicate_groups(hashed), ["first_ord"], "file_group", 1)
    return hashed.join(numbered, ["size", "checksum"]).select(F.col("name").alias("file_name"), F.col("size").alias("file_size"), F.col("parent_path").alias("folder"), "file_group")


_OUT = ["path", "kind", "checksum", "group_id"]


@query(f"with {nodes_sql(LINE_FILES, 2)} select path, kind, ck as checksum, group_id from g")
def group_ids(spark, sf_dir):
    return merkle.group_ids(_nodes(trees.line_files(spark, sf_dir)))[0].select(*_OUT)


@query(f"with {nodes_sql(GEO_FILES, 4)} select path, size, file_count, folder_count from n where kind = 'Folder'")
def folder_rollup(spark, sf_dir):
    files = settle(trees.geo_files(spark, sf_dir).drop("content"), "files")
    return tree.rollup(files, tree.folders(files)).select("path", F.col("size").cast("long").alias("size"), "file_count", "folder_count")


@query(f"with {nodes_sql(PART_FILES, 3)} select count(distinct location_seq) as locations, count(*) filter (kind = 'File') as files, count(*) filter (kind = 'Folder') as folders, sum(size) filter (kind = 'File')::bigint as bytes from n")
def scan_totals(spark, sf_dir):
    files = trees.part_files(spark, sf_dir).drop("content")
    return tree.scan_totals(files, tree.folders(files))


@query(f"with {nodes_sql(DOC_FILES, 3)} select row_number() over (order by ord) - 1 as position, kind, path from n")
def tree_preorder(spark, sf_dir):
    files = trees.doc_files(spark, sf_dir).drop("content")
    folders = tree.folders(files).select("location_seq", "root", "path")
    every = tree.with_names(files.select("location_seq", "root", "path"), True).unionByName(tree.with_names(folders, False))
    return number(every.select("ord", "kind", "path"), ["ord"], "position").select("position", "kind", "path")


@query(f"with {nodes_sql(LINE_FILES, 2)} select path, ck as checksum, size, file_count from n where kind = 'Folder'")
def merkle_folders(spark, sf_dir):
    return _nodes(trees.line_files(spark, sf_dir)).filter("kind = 'Folder'").select("path", "checksum", "size", "file_count")


@query(f"with {nodes_sql(LINE_FILES, 2)} select ck as checksum, count(*) as n, min(path) as first_path from n where kind = 'Folder' and ck is not null group by ck having count(*) > 1")
def dup_folders(spark, sf_dir):
    found = _nodes(trees.line_files(spark, sf_dir)).filter("kind = 'Folder' and checksum is not null")
    return found.groupBy("checksum").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")


_SCANNED = f"with {nodes_sql(PART_FILES, 3)} select location_seq, path, kind, ck as checksum, group_id from g"


@query(_SCANNED)
def multi_location_scan(spark, sf_dir):
    return merkle.group_ids(_nodes(trees.part_files(spark, sf_dir)))[0].select("location_seq", *_OUT)


@query(_SCANNED)
def incremental_scan(spark, sf_dir):
    files, session = trees.part_files(spark, sf_dir), Session(spark)
    for n in range(3):
        own = files.filter(F.col("location_seq") == n)
        session.scan(own.select("path", "size", "content"), root=f"part{n}")
    return session.nodes.select("location_seq", *_OUT)


@query(f"with {nodes_sql(DOC_FILES, 3)}, r as (select distinct 'docs/' || source as path from documents union select distinct source || '/' || lang from documents) select r.path from r anti join (select path from n where kind = 'Folder') k using (path)")
def location_dedup(spark, sf_dir):
    files = trees.doc_files(spark, sf_dir).drop("content")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = docs.select(F.concat(F.lit("docs/"), "source").alias("path")).unionByName(docs.select(F.concat("source", F.lit("/"), "lang").alias("path")))
    return tree.new_locations(asked, tree.folders(files))


_LINE = """case when kind = 'File' then 'File,"' || path || '",' || size || ',,"' || coalesce(extension, '') || '",' || coalesce(ck, '') || ', ' || group_id
    else 'Folder,"' || path || '",' || size || ',' || file_count || ',,' || coalesce(ck, '') || ',' || group_id end"""


@query(f"with {nodes_sql(DOC_FILES, 3)} select row_number() over (order by ord) - 1 as line_no, {_LINE} as line from g")
def csv_export_lines(spark, sf_dir):
    found = merkle.group_ids(_nodes(trees.doc_files(spark, sf_dir)))[0]
    return number(csv_tree.lines(found), ["ord"], "line_no").select("line_no", "line")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a listing of documents without folder rows for ``src1`` and ``src2``'s parents, some paths twice and some
    rows broken: (row_number, line)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.octet_length("text").alias("size"))
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), F.lit(".txt"))
    size = F.when(F.col("doc_id") % 50 == 7, F.lit("many")).otherwise(F.concat(F.lit(" "), F.col("size").cast("string")))
    files = d.select(F.col("doc_id").alias("row_number"), F.concat(F.lit('File,"'), path, F.lit('",'), size, F.lit(',,".txt",, '), (F.col("doc_id") % 9).cast("string")).alias("line"))
    at = F.when(F.col("source") == "src2", F.concat(F.lit("docs/"), "source")).otherwise(F.concat(F.lit("docs/"), "source", F.lit("/"), "lang"))
    folders = d.filter("source <> 'src1'").select(at.alias("p"), "doc_id").groupBy("p").agg(F.min("doc_id").alias("m"))
    folders = folders.select((-F.col("m") - 1).alias("row_number"), F.concat(F.lit('Folder,"'), "p", F.lit('",0,1,,,-2')).alias("line"))
    top = spark.createDataFrame([(-(10**12), 'Folder,"docs",0,0,,,-2')], "row_number long, line string")
    return files.unionByName(folders).unionByName(top)


_LISTING = """l as (select doc_id as row_number, 'File' as kind, 'docs/' || source || '/' || lang || '/' || (doc_id - doc_id % 2) || '.txt' as path, case when doc_id % 50 = 7 then null else strlen(text)::bigint end as size, null::int as file_count, '.txt' as extension, '' as checksum, (doc_id % 9)::bigint as group_id from documents
    union all select -min(doc_id) - 1, 'Folder', case when source = 'src2' then 'docs/' || source else 'docs/' || source || '/' || lang end as p, 0, 1, '', '', -2 from documents where source <> 'src1' group by p
    union all select -1000000000000, 'Folder', 'docs', 0, 0, '', '', -2),
    w as (select * from l where size is not null qualify row_number() over (partition by kind, path order by row_number desc) = 1)"""
_CSV = "kind, path, size, file_count, extension, checksum, group_id"
_CSV_COLUMNS = _CSV.split(", ")


@query(f"with {_LISTING} select row_number, {_CSV}, true as valid from l where size is not null union all select row_number, kind, path, null, file_count, extension, checksum, group_id, false from l where size is null")
def csv_import(spark, sf_dir):
    return csv_tree.parse(_listing(spark, sf_dir)).select("row_number", *_CSV_COLUMNS, "valid")


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_tree.last_wins(csv_tree.parse(_listing(spark, sf_dir)).filter("valid").drop("valid"))


@query(f"with {_LISTING} select {_CSV} from w")
def csv_import_last_wins(spark, sf_dir):
    return _imported(spark, sf_dir).select(*_CSV_COLUMNS)


@query(f"with {_LISTING} select {_CSV} from w where kind = 'Folder' and coalesce(nullif({UP.format('path')}, path), '') not in (select path from w where kind = 'Folder')")
def csv_import_roots(spark, sf_dir):
    return csv_tree.folder_roots(_imported(spark, sf_dir)).select(*_CSV_COLUMNS)


@query(f"with {_LISTING} select {_CSV} from w where kind = 'File' and {UP.format('path')} not in (select path from w where kind = 'Folder')")
def csv_import_orphans(spark, sf_dir):
    return csv_tree.orphans(_imported(spark, sf_dir)).select(*_CSV_COLUMNS)


@query(f"select size, checksum as md5, count(*) as n from ({DOC_FILES}) where {UP.format('path')} in (select 'docs/' || source || '/' || lang from documents) group by all")
def flat_scan_dups(spark, sf_dir):
    """Every folder that holds documents is searched, not what lies deeper."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    searched = docs.select(F.concat(F.lit("docs/"), "source", F.lit("/"), "lang").alias("path")).distinct()
    files = tree.top_level(_summed(trees.doc_files(spark, sf_dir)), searched)
    return files.groupBy("size", F.col("checksum").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_brand as folder, p_name || '#' || p_partkey as name, row_number() over (partition by p_brand order by p_name || '#' || p_partkey)::int as position from part where (p_size & 6) = 0")
def visible_children(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("folder"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("attributes"))
    return tree.visible(items).select("folder", "name", F.row_number().over(Window.partitionBy("folder").orderBy("name")).alias("position"))


def _suffix_sql(v: str) -> str:
    """Thresholds written out: in each unit, tenths rounded half up must stay under 1000."""
    cases = []
    for n, unit in enumerate(("bytes", "KB", "MB", "GB", "TB", "PB")):
        u = 1024**n
        tenths = f"((abs({v})::hugeint * 20 + {u}) // {2 * u})"
        fits = f"abs({v})::hugeint < {1024**6}" if n == 5 else f"{tenths} < 10000"
        whole = f"({tenths} // 10)"
        shown = f"case when {whole} >= 1000 then ({whole} // 1000)::varchar || ',' || lpad(({whole} % 1000)::varchar, 3, '0') else {whole}::varchar end"
        cases.append(f"when {fits} then {shown} || '.' || ({tenths} % 10)::varchar || ' {unit}'")
    return f"case when {v} < 0 then '-' else '' end || case {' '.join(cases)} end"


@query(f"select o_orderkey, v, {_suffix_sql('v')} as shown from (select o_orderkey, (case when o_orderkey % 7 = 0 then -1 else 1 end * (o_orderkey % 1100) * (1::bigint << ((o_orderkey % 6) * 10)::int) // (o_orderkey % 3 + 1))::bigint as v from orders)")
def size_suffixes(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = F.expr("case when o_orderkey % 7 = 0 then -1L else 1L end * (o_orderkey % 1100) * shiftleft(1L, cast((o_orderkey % 6) * 10 as int)) div (o_orderkey % 3 + 1)")
    return orders.select("o_orderkey", v.alias("v")).select("o_orderkey", "v", size_suffix(F.col("v")).alias("shown"))


QUERIES["size_suffix"], ORACLE_SQL["size_suffix"] = QUERIES.pop("size_suffixes"), ORACLE_SQL.pop("size_suffixes")


@query("select l_orderkey, l_linenumber, l_quantity, greatest(0.0, least(1.0, l_quantity / 25 - 0.5))::double as progress from lineitem")
def clamp_progress(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", clamp(F.col("l_quantity") / 25 - 0.5).alias("progress"))


@query("select o_orderkey, strftime(o_orderdate, '%A, %B %-d, %Y') as day from orders")
def long_dates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", long_date(F.col("o_orderdate")).alias("day"))


@query("select l_orderkey, l_linenumber, l_quantity, floor(greatest(0.0, least(1.0, l_quantity / 40 - 0.1)) * 100)::int as shown, not (l_quantity > 25) as small from lineitem")
def progress_percent(spark, sf_dir):
    q = F.col("l_quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", percent(q / 40 - 0.1).alias("shown"), negation(q > 25).alias("small"))


@query(
    f"""with f as materialized ({DOC_FILES}), l3 as (select {UP.format('path')} as path, max(size) as largest, 1 as height, count(*) as files from f group by all),
    l2 as (select {UP.format('path')} as path, max(largest) as largest, max(height) + 1 as height, sum(files) as files from l3 group by {UP.format('path')}),
    l1 as (select {UP.format('path')} as path, max(largest) as largest, max(height) + 1 as height, sum(files) as files from l2 group by {UP.format('path')})
    select path, largest, height::int as height, files::bigint as files from (from l1 union all from l2 union all from l3)"""
)
def tree_visit(spark, sf_dir):
    """A visit down (each node's own columns) and up (a folder from its children)."""
    files = trees.doc_files(spark, sf_dir).drop("content")
    both = files.select("location_seq", "root", "path", "size", F.lit(tree.FILE).alias("kind")).unionByName(
        tree.folders(files).select("location_seq", "root", "path", F.lit(None).cast("long").alias("size"), F.lit(tree.FOLDER).alias("kind"))
    )
    down = tree.map_nodes(both, largest=F.col("size"), height=F.lit(0), files=F.when(F.col("kind") == tree.FILE, 1).otherwise(0).cast("long"))
    found = tree.tree_fold(
        down,
        {c: F.col(c) for c in ("largest", "height", "files")},
        {"largest": F.max("largest"), "height": (F.max("height") + 1).cast("int"), "files": F.sum("files")},
        {"largest": F.lit(None).cast("long"), "height": F.lit(0), "files": F.lit(0).cast("long")},
    )
    return found.select("path", "largest", "height", "files")
