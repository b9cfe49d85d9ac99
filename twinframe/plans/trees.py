"""The synthetic tables seen as trees of files, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(col: str, n: int):
    return F.lpad(F.col(col).cast("string"), n, "0")


def doc_files(spark: SparkSession, sf_dir: str, locations: int = 1) -> DataFrame:
    """``docs/{source}/{lang}/{doc_id}.txt``; with more locations, one tree each by doc_id."""
    d = _table(spark, sf_dir, "documents")
    seq = (F.col("doc_id") % locations).cast("int")
    root = F.lit("docs") if locations == 1 else F.concat(F.lit("docs"), seq.cast("string"))
    path = F.concat(root, F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), _padded("doc_id", 12), F.lit(".txt"))
    return d.select(seq.alias("location_seq"), root.alias("root"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


DOC_FILES = """select 0 as location_seq, 'docs' as root, 'docs/' || source || '/' || lang || '/' || lpad(doc_id::varchar, 12, '0') || '.txt' as path,
    strlen(text)::bigint as size, upper(md5(text)) as checksum from documents"""


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders/{order}/{line}-{k}``: every size collides, and many folders are equal."""
    x = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("content"))
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.md5("content")))
    x = x.withColumn("k", k)
    path = F.concat(F.lit("orders/"), _padded("l_orderkey", 10), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("-"), _padded("k", 3))
    return x.select(F.lit(0).alias("location_seq"), F.lit("orders").alias("root"), path.alias("path"), F.octet_length("content").cast("long").alias("size"), "content")


LINE_FILES = """select 0 as location_seq, 'orders' as root, 'orders/' || lpad(l_orderkey::varchar, 10, '0') || '/' || l_linenumber || '-' || lpad(k::varchar, 3, '0') as path,
    strlen(content)::bigint as size, upper(md5(content)) as checksum
    from (select *, row_number() over (partition by l_orderkey, l_linenumber order by md5(content)) as k from (select l_orderkey, l_linenumber, l_returnflag || l_linestatus as content from lineitem))"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three locations of ``part{n}/{brand}/{type}/{part}``."""
    x = _table(spark, sf_dir, "part")
    seq = (F.col("p_partkey") % 3).cast("int")
    root = F.concat(F.lit("part"), seq.cast("string"))
    path = F.concat(root, F.lit("/"), "p_brand", F.lit("/"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.lit("/"), _padded("p_partkey", 9))
    return x.select(seq.alias("location_seq"), root.alias("root"), path.alias("path"), F.octet_length("p_name").cast("long").alias("size"), F.col("p_name").alias("content"))


PART_FILES = """select (p_partkey % 3)::int as location_seq, 'part' || (p_partkey % 3) as root,
    'part' || (p_partkey % 3) || '/' || p_brand || '/' || replace(p_type, ' ', '_') || '/' || lpad(p_partkey::varchar, 9, '0') as path,
    strlen(p_name)::bigint as size, upper(md5(p_name)) as checksum from part"""


def geo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``world/{region}/{nation}/{customer}/{order}``, four levels deep."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("world/"), "r_name", F.lit("/"), "n_name", F.lit("/"), _padded("c_custkey", 9), F.lit("/"), _padded("o_orderkey", 10))
    return x.select(F.lit(0).alias("location_seq"), F.lit("world").alias("root"), path.alias("path"), F.octet_length("o_orderpriority").cast("long").alias("size"), F.col("o_orderpriority").alias("content"))


GEO_FILES = """select 0 as location_seq, 'world' as root, 'world/' || r_name || '/' || n_name || '/' || lpad(c_custkey::varchar, 9, '0') || '/' || lpad(o_orderkey::varchar, 10, '0') as path,
    strlen(o_orderpriority)::bigint as size, upper(md5(o_orderpriority)) as checksum
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

UP = "regexp_replace({0}, '[/][^/]+$', '')"
LAST = "regexp_extract({0}, '([^/]*)$', 1)"


def _ord(path: str, is_file: bool) -> str:
    parts = f"string_split({path}, '/')"
    folders = f"{parts}[:-2]" if is_file else parts
    marked = f"coalesce(array_to_string(list_transform({folders}, lambda s: '1' || s || chr(1)), ''), '')"
    last = f" || '0' || {LAST.format(path)} || chr(1)" if is_file else ""
    return f"lpad(location_seq::varchar, 10, '0') || chr(1) || {marked}{last}"


def nodes_sql(files: str, levels: int) -> str:
    """CTEs f, h, fold_1..fold_n, n, g: nodes and their groups, for trees whose files all lie ``levels`` folders deep."""
    out = [
        f"f as materialized ({files})",
        "sz as (select size, location_seq, count(*) as c from f group by all)",
        "run as (select size, location_seq, sum(c) over (partition by size order by location_seq) as upto from sz)",
        "sec as (select size, min(location_seq) as second from run where upto > 1 group by size)",
        "h as materialized (select f.*, case when second is not null then greatest(location_seq, second) end as epoch, case when second is not null then checksum end as ck from f left join sec using (size))",
    ]
    for d in range(levels, 0, -1):
        below = f"(select location_seq, {UP.format('path')} as parent, {LAST.format('path')} as name, ck, epoch, size, 1 as fc, 0 as dc from h)" if d == levels else f"(select location_seq, {UP.format('path')} as parent, {LAST.format('path')} as name, ck, epoch, size, fc, dc + 1 as dc from fold_{d + 1})"
        out.append(
            f"fold_{d} as materialized (select location_seq, parent as path, sum(size)::bigint as size, sum(fc)::bigint as fc, sum(dc)::bigint as dc, "
            f"case when bool_and(ck is not null) then upper(md5(string_agg(ck, '' order by name))) end as ck, case when bool_and(ck is not null) then greatest(location_seq, max(epoch)) end as epoch from {below} group by location_seq, parent)"
        )
    folds = " union all ".join(f"select * from fold_{d}" for d in range(1, levels + 1))
    out += [
        f"n as materialized (select location_seq, path, 'File' as kind, size, null::bigint as file_count, null::bigint as folder_count, regexp_extract(path, '([.][^./]+)$', 1) as extension, ck, epoch, {_ord('path', True)} as ord from h"
        f" union all select location_seq, path, 'Folder', size, fc, dc, null, ck, epoch, {_ord('path', False)} from ({folds}))",
        "firsts as materialized (select kind, ck, min(lpad(epoch::varchar, 10, '0') || ord) as first_seen from n where ck is not null group by kind, ck)",
        "keys as materialized (select kind, ck, row_number() over (order by first_seen) - 1 as group_id from firsts)",
        "g as (select n.*, coalesce(group_id, case when n.kind = 'File' then -1 else -2 end)::bigint as group_id from n left join keys on n.kind = keys.kind and n.ck = keys.ck)",
    ]
    return ", ".join(out)
