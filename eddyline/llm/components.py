"""Connected components of a link table, by alternating star contraction.

Each round is two joins and two aggregations on plain edge rows: neighbours of a node move to its least
neighbour (large star), then to the least among those not above it (small star). Minima are aggregated before they are
shuffled, and a node with more than one edge row in ``PARTS`` is dealt in parts for its join, so no task gets all
rows of a hub. A round's edges are written to the shared folder, so lineage stays short; the number of rounds grows
with the logarithm of the longest path. Nothing but the two numbers that tell whether to stop reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import PARTS, discard, saved

#: Edge rows of which no hub is worth a part of its own.
FEW = 8192


def _with_least(edges: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """``edges`` (u, v) with m of ``least`` (u, m, n rows of u among ``n_rows``). Hubs, of which there are ``PARTS`` at most, are
    broadcast; their edges are dealt by v and their least copied to each part."""
    if n_rows <= FEW:
        return edges.join(least.select("u", "m"), "u")
    limit = max(64, n_rows // PARTS)
    hubs = least.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.ceil(F.col("n") / limit).alias("parts"))
    dealt = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)))).drop("hub", "parts")
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / limit), F.lit(1)) - 1)).alias("part"))
    return dealt.join(copies, ["u", "part"]).drop("part")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node reachable.

    Self-links and repeats are fine; an empty table gives an empty one. Node ids need an order."""
    edges = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), tag)
    before, n = None, edges.count()
    while n:
        old, edges = edges, saved(_small_star(_large_star(edges, n), n), tag)
        discard(old)
        # stars only: no node is both above another and below a third; the sums settle it with equal edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
