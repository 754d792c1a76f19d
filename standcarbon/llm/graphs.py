"""Connected components of a graph of links, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standcarbon.session import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    larger = both.join(low, "a").filter("b > a")
    return larger.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    others = links.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), "low")
    return others.unionByName(low).withColumnRenamed("low", "b").distinct()


def stars(links: DataFrame) -> DataFrame:
    """(a, b) for every node `a` with a link, but the smallest of its component, which is `b`.

    `links` holds unordered pairs (a, b) of one integer type; loops, nulls and repeats are ignored.
    Both steps are an aggregation with partial sums and an equi-join, so a node with very many
    links is split by adaptive execution. Each round is written to the shared folder; only a
    checksum reaches the driver. The number of rounds grows with the logarithm of the length of
    the longest chain.
    """
    links = staged(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        sums = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        now = tuple(links.agg(F.count(F.lit(1)), sums).first())
        if now == before or now[0] == 0:
            return links
        before = now
        newer = staged(_small_star(_large_star(links)))
        discard(links)
        links = newer
