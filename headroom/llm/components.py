"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.session import settle


def _with_least(links: DataFrame) -> DataFrame:
    """Each link (a, b) with the least number among a and all partners of a."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return links.join(least, "a")


def _large_stars(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    joined = _with_least(links)
    kept = joined.select("a", F.col("least").alias("b"))
    moved = joined.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return kept.unionByName(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of a link that is not its own root; the root is the least node.

    ``links`` has numbers ``a, b``; order, repeats and links of a node to itself do not matter. Large
    and small stars alternate until nothing changes, in rounds that grow with the logarithm of the
    longest path. Minima are combined before they are shuffled, and joins on a node with
    many partners are plain equality joins that the adaptive planner may split.
    Every round is written to the shared folder.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current, before = settle(ordered), None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(seen)
        current = settle(_small_stars(_large_stars(current)))
