"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step over links ``u > v``; minima are aggregated before they meet the links again, so
    a hub's links are never gathered in one row."""
    if small:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        met = links.join(least, "u")
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has a link to another; root is the smallest node reachable.

    ``links`` holds two bigint columns ``a`` and ``b`` without nulls, in any order, with repeats.
    Every round is written to the shared folder, so lineage stays short and a lost executor costs
    one round. An empty table gives an empty table.
    """
    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        after = settle(_star(_star(now, small=False), small=True), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_settled(now)
        now = after
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
