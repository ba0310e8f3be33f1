"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import dropped, written


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "k")


def _large(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.filter("v > u").join(_nearest(both), F.col("u") == F.col("k"))
    return met.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _nearest(down)
    met = down.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return met.unionAll(low.select(F.col("k").alias("u"), F.col("low").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the least id that it reaches.

    Each round is written to the shared folder, so that neither lineage nor
    loss of an executor reaches back; rounds grow with the logarithm of the
    number of nodes.  Links with a null end are ignored; no links, no rows.
    """
    spark = links.sparkSession
    at, path = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        new, new_path = written(_small(_large(at)))
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        dropped(spark, path)
        at, path = new, new_path
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = at.select(F.col("v").alias("node")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
