"""Connected components over a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import discard, shuffles_released, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of links (u, v: long), root the least node of its component.

    Each round replaces the links of a node by links to its least neighbour, so every component turns into
    a star around its least node in O(log^2 n) rounds. The minima are pre-aggregated before each shuffle,
    so a node with very many links meets no single task; the joins are ones that AQE splits.
    Nodes without links are not listed. An empty table gives an empty table.
    """
    links = stored(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())

    def mark(df: DataFrame):
        with shuffles_released(df.sparkSession):
            return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    before = mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        old, links = links, stored(_small_star(_large_star(links)))
        discard(old)
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
