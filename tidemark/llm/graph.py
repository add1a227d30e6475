"""Connected components of a large sparse graph, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

FILE_LINKS = 1 << 18  # links in a file of a round, about


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the ``a, b`` links; the root is the smallest node reachable.

    Alternates two star operations until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows. The number of edges never
    grows, rounds grow with the logarithm of the longest path, and every round is checkpointed,
    in files by the number of links, whatever the number of shuffle partitions.
    """
    links = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, files = None, None

    def kept(df: DataFrame) -> DataFrame:
        return cut_lineage(df.coalesce(files) if files else df)

    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = kept(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
        after = tuple(links.agg(F.count("*"), mark).first())
        if after == before:
            break
        before, files = after, 1 + after[0] // FILE_LINKS
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())
