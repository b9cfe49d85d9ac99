"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014).

Links stay distributed: a round is two aggregations and two equi-joins over the links, written to the shared folder, so a
lost executor costs at most one round. Hubs are joined by broadcast (``with_group``), so no task gets all links of one. Only a
count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import discard, materialise

#: A group with more than this part of all rows is joined by broadcast; there are fewer than so many of them.
HUBS = 1024


def with_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row a ``key``, with n, its number of rows): an equi-join whose large
    groups do not meet in one task. ``total`` is the number of rows. Null keys find nothing."""
    large = F.col("n") * HUBS > total
    hubs = groups.filter(large).drop("n").select(F.col(key).alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in groups.columns if c not in (key, "n")])
    marked = rows.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left")
    added = [c for c in groups.columns if c not in (key, "n")]
    hot = marked.filter("hub is not null").select(*rows.columns, *[F.col(f"hub_{c}").alias(c) for c in added])
    cold = marked.filter("hub is null").select(*rows.columns).join(groups.filter(~large).drop("n"), key)
    return hot.unionAll(cold.select(*rows.columns, *added))


def _large_star(links: DataFrame, count: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest node that it sees: as many links as before."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return with_group(both.filter("b > a"), least, "a", 2 * count).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, count: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    down = with_group(links, least, "a", count).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), mark).first())


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): every node of ``links`` (columns a, b; same orderable type) with the smallest node of its component.

    Self-links, repeated links and links with a null end are allowed; nodes that only link to themselves are not
    returned. No links: no rows.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    before = _state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = materialise(_large_star(links, before[0]), "links-large")
        small = materialise(_small_star(large, before[0]), "links")
        discard(links, large)
        links, now = small, _state(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
