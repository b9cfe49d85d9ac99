"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only.

Leaves are paths of a tree (domain, language, source). The token budget runs down the tree: among siblings it is split
by weight, but no child gets more than the tokens below it can fill (``max_epochs`` passes over them). What a child
cannot fill goes to its siblings; only what all siblings together cannot fill is missing from the parent, and so goes to
the parent's siblings. Sizes are exact integers.

Each leaf then reads its documents in seeded epochs: as many whole epochs as fit its budget, and of the next epoch, in
that epoch's own seeded order, the prefix of documents whose tokens come nearest to what is left (the document that
crosses the mark is read if at least half of it fits).

A leaf may hold a third of all rows, so no leaf is sorted: the prefix is found over 4096 hash ranges of the leaf, whose
sums are aggregated map-side, and only the range that holds the prefix's end is ordered by document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.llm.common import materialise

#: Hash ranges of a leaf: the leading hex digits of the order key.
RANGE_DIGITS = 3
WORD = r"[^ \t\n\r\f\x0B]+"


def n_tokens(text_col: str) -> Column:
    """The size of a document for budgeting: words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    """The weight of a node by its name at ``level``; 1 unless listed."""
    listed = F.lit(None).cast("long")
    for name, w in weights.items():
        listed = F.when(F.col(level) == name, F.lit(int(w)).cast("long")).otherwise(listed)
    return F.coalesce(listed, F.lit(1).cast("long"))


def split_budget(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget`` to ``children`` (parent columns, name, weight, capacity, parent_budget).

    Children in the order of capacity per weight fill up one after another while what is left would give them at least
    their capacity; the rest share what is left by weight, rounded so that the parts add up. A weight of 0 gets nothing.
    """
    group = [F.col(c) for c in parent] or [F.lit(0)]
    live = children.withColumn("w", F.when(F.col("capacity") > 0, F.col("weight")).otherwise(0).cast("long"))
    live = live.withColumn("turn", F.when(F.col("w") > 0, F.col("capacity") / F.col("w").cast("double")))
    order = Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_last(), F.col(name))
    here = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    live = (
        live.withColumn("w_left", F.sum("w").over(here))
        .withColumn("c_before", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("capacity")).otherwise(0)).over(before), F.lit(0)))
        .withColumn("full", (F.col("w") > 0) & (F.col("capacity").cast("decimal(38,0)") * F.col("w_left") <= F.col("w").cast("decimal(38,0)") * (F.col("parent_budget") - F.col("c_before"))))
        .withColumn("open_w", F.when(F.col("full"), 0).otherwise(F.col("w")).cast("long"))
    )
    whole = Window.partitionBy(*group)
    live = (
        live.withColumn("rest", F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
        .withColumn("w_open", F.sum("open_w").over(whole))
        .withColumn("w_to", F.sum("open_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    part = lambda w: F.expr(f"(cast(rest as decimal(38,0)) * ({w})) div w_open")
    share = F.when(F.col("w_open") > 0, part("w_to") - part("w_to - open_w")).otherwise(0)
    budget = F.when(F.col("full"), F.col("capacity")).when(F.col("open_w") > 0, share).otherwise(0).cast("long")
    return live.withColumn("budget", budget).drop("w", "turn", "w_left", "c_before", "full", "open_w", "rest", "w_open", "w_to")


def leaf_budgets(sizes: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves of the tree with ``available``, ``capacity`` and ``budget``.

    ``sizes`` has the level columns and ``available`` tokens; ``budget`` is a column over ``total`` (all available tokens).
    """
    # What lies below a weight of 0 cannot be filled, so that its share goes to siblings that can.
    weighted = [_weight(level, weights.get(level, {})) > 0 for level in levels]
    leaves = sizes.withColumn("capacity", F.when(reduce(Column.__and__, weighted), F.col("available") * max_epochs).otherwise(0))
    root = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("most"))
    root = root.select(F.least(budget.cast("long"), F.col("most")).alias("parent_budget"))
    above, on = root, []
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        # One row stands above the first level.
        nodes = nodes.join(above, on) if on else nodes.withColumn("one", F.lit(1)).join(F.broadcast(above.withColumn("one", F.lit(1))), "one").drop("one")
        above = split_budget(nodes, path[:-1], level)
        on = path
        if depth + 1 < len(levels):
            above = above.select(*path, F.col("budget").alias("parent_budget"))
    return above.select(*levels, "available", "capacity", "weight", "budget")


def mix(
    df: DataFrame,
    *,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    budget: Column,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The documents to read: id, domain, lang, source, n_tokens, epoch (from 1), leaf_budget, and the columns ``carry``; one
    row for each reading.

    ``budget`` is a column expression over ``total``, the tokens of the whole table. Null language or source: the leaf
    ``unknown``. Null or empty texts have no tokens; they are read whenever the prefix reaches them, and a leaf
    without tokens is not read. Rows with equal id are ordered by their size, then as they lie. Null ids count as the empty
    id. Other columns are not carried. An empty table gives no rows.
    """
    levels, more = ["domain", "lang", "source"], ["carried.*"] if carry else []
    slim = df.select(
        F.col(id_col).alias("record_id"),
        F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("unknown")).alias("source"),
        n_tokens(text_col).alias("n_tokens"),
        F.spark_partition_id().alias("lies_in"),
        *([F.struct(*[c.alias(name) for name, c in carry.items()]).alias("carried")] if carry else []),
    )
    slim = materialise(slim, "mixing-sizes")
    sizes = slim.groupBy(*levels).agg(F.sum("n_tokens").alias("available"))
    leaves = materialise(leaf_budgets(sizes, levels, weights, budget, max_epochs).coalesce(1), "mixing-budgets")
    leaves = leaves.select(
        *levels,
        F.col("budget").alias("leaf_budget"),
        F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0).alias("whole"),
        F.when(F.col("available") > 0, F.expr("budget % available")).otherwise(0).alias("rest"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("record_id").cast("string"), F.lit(""))).cast("binary"))
    placed = slim.join(leaves, levels).withColumn("key", key).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = placed.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranges.withColumn("to", F.sum("held").over(run)).filter(F.col("to") > F.col("rest"))
    ends = ends.groupBy(*levels).agg(F.min(F.struct("range", (F.col("to") - F.col("held")).alias("before"))).alias("e"))
    ends = ends.select(*levels, F.col("e.range").alias("end_range"), F.col("e.before").alias("before"))
    leaves = materialise(leaves.join(ends, levels, "left").coalesce(1), "mixing-ends")
    placed = slim.join(leaves, levels).withColumn("key", key).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    # A leaf without an end range has no tokens at all, hence no budget.
    inner = placed.filter(F.col("range") == F.col("end_range"))
    # Rows that agree in key, size and place are one group, so that many rows of one id are no more than a few. The prefix
    # ends in one group at most.
    group = [*levels, "key", "n_tokens", "lies_in"]
    groups = inner.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.first("before").alias("start"), F.first("rest").alias("goal"))
    upto = Window.partitionBy(*levels).orderBy("key", "n_tokens", "lies_in").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("start", F.col("start") + F.sum(F.expr("rows * n_tokens")).over(upto) - F.expr("rows * n_tokens"))
    fit = F.when(F.col("n_tokens") > 0, F.expr("(2 * goal - 2 * start + n_tokens) div (2 * n_tokens)")).when(F.col("start") <= F.col("goal"), F.col("rows"))
    fit = F.when((F.col("goal") > 0) & (F.expr("2 * goal - 2 * start + n_tokens") >= 0), F.coalesce(fit, F.lit(0)))
    groups = groups.select(*group, F.least("rows", F.coalesce(fit, F.lit(0))).alias("fit"))
    within = F.row_number().over(Window.partitionBy(*group).orderBy("record_id"))
    inner = inner.join(groups, group).withColumn("partial", within <= F.col("fit")).drop("fit")
    outer = placed.filter(F.coalesce(F.col("range") != F.col("end_range"), F.lit(True)))
    outer = outer.withColumn("partial", (F.col("rest") > 0) & (F.col("range") < F.col("end_range")))
    epochs = F.col("whole").cast("int") + F.when(F.col("partial"), 1).otherwise(0)
    return (
        outer.unionByName(inner)
        .withColumn("n", epochs)
        .filter(F.col("n") > 0)
        .select(F.col("record_id").alias(id_col), *levels, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("epoch"), "leaf_budget", *more)
    )


#: What the query and the pipeline mix to.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SEED = 17


def source_domain(source_col: str = "source") -> Column:
    """The domain of a source: its trailing number modulo 4."""
    number = F.regexp_extract(F.col(source_col), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def _names(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.get(level, {}).items()) + " else 1 end" if level in WEIGHTS else "1"


def _level_sql(level: str, path: list[str], above: str) -> str:
    """DuckDB: the budgets of one level, as tables ``<level>_n``, ``_o``, ``_f``, ``_b``."""
    keys, parent = ", ".join(path), ", ".join(path[:-1])
    by = f"partition by {parent}" if parent else ""
    on = f"join {above} using ({parent})" if parent else f"cross join {above}"
    return f"""
    {level}_n as (select n.*, p.parent_budget from (select {keys}, sum(capacity)::bigint capacity, sum(available)::bigint available, {_names(level)}::bigint weight from leaves group by {keys}) n {on.replace(f"join {above}", f"join {above} p", 1)}),
    {level}_w as (select *, case when capacity > 0 then weight else 0 end w from {level}_n),
    {level}_t as (select *, case when w > 0 then capacity / w::double end turn from {level}_w),
    {level}_o as (select *, sum(w) over ({by} order by turn nulls last, {level} rows between current row and unbounded following)::hugeint w_left, coalesce(sum(case when w > 0 then capacity else 0 end) over ({by} order by turn nulls last, {level} rows between unbounded preceding and 1 preceding), 0)::hugeint c_before from {level}_t),
    {level}_f as (select *, w > 0 and capacity::hugeint * w_left <= w::hugeint * (parent_budget - c_before) is_full from {level}_o),
    {level}_g as (select *, case when is_full then 0 else w end open_w from {level}_f),
    {level}_r as (select *, (parent_budget - sum(case when is_full then capacity else 0 end) over ({by}))::hugeint rest, sum(open_w) over ({by})::hugeint w_open, sum(open_w) over ({by} order by turn nulls last, {level} rows between unbounded preceding and current row)::hugeint w_to from {level}_g),
    {level}_b as (select {keys}, available, (case when is_full then capacity when open_w > 0 then (rest * w_to) // w_open - (rest * (w_to - open_w)) // w_open else 0 end)::bigint parent_budget from {level}_r)"""


OP10_SQL = (
    """with slim as (select doc_id,
        case when regexp_extract(source, '([0-9]{1,9})$', 1) <> '' then 'domain' || (regexp_extract(source, '([0-9]{1,9})$', 1)::int % 4) else 'unknown' end as domain,
        coalesce(lang, 'unknown') lang, coalesce(source, 'unknown') source,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::bigint n_tokens from documents),
    leaves as (select *, (case when """
    + " and ".join(f"{_names(level)} > 0" for level in ("domain", "lang", "source"))
    + """ then 2 * available else 0 end)::bigint capacity from (select domain, lang, source, sum(n_tokens)::bigint available from slim group by all)),
    root as (select least(sum(available)::bigint * 3 // 5, sum(capacity))::bigint parent_budget from leaves),"""
    + _level_sql("domain", ["domain"], "root")
    + ","
    + _level_sql("lang", ["domain", "lang"], "domain_b")
    + ","
    + _level_sql("source", ["domain", "lang", "source"], "lang_b")
    + f""",
    placed as (select s.*, b.parent_budget leaf_budget, case when available > 0 then parent_budget // available else 0 end whole, case when available > 0 then parent_budget % available else 0 end rest from slim s join source_b b using (domain, lang, source)),
    keyed as (select *, md5('{SEED}:' || whole || ':' || coalesce(doc_id::varchar, '')) k from placed),
    run as (select *, sum(n_tokens) over (partition by domain, lang, source order by k, n_tokens rows between unbounded preceding and current row) upto from keyed),
    times as (select *, whole + case when rest > 0 and 2 * upto - n_tokens <= 2 * rest then 1 else 0 end n from run)
    select doc_id, domain, lang, source, n_tokens, unnest(range(1, n::bigint + 1))::int as epoch, leaf_budget from times where n > 0"""
)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed to three fifths of their tokens, at most two epochs of any leaf."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, domain=source_domain(), weights=WEIGHTS, budget=F.expr("total * 3 div 5"), max_epochs=2, seed=SEED)
