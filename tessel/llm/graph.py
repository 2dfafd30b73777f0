"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store


def components(spark: SparkSession, links: DataFrame, store: Store | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from every id in links (a, b).

    Each round sends every vertex's larger neighbours, then its smaller ones, to the
    smallest neighbour; paths halve, so the rounds grow with the logarithm of the
    longest path.  The minimum per vertex is pre-aggregated before its shuffle and
    written before it is joined back, so that both sides of the join come straight
    from an exchange and a hub's rows can be split over tasks.  Nothing but two
    numbers for each round reaches the driver.  The tables are the store's to drop.
    """
    store = store or Store(spark, "components")
    a, b = F.col("a"), F.col("b")

    def tidy(df: DataFrame) -> DataFrame:
        return df.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(a, b).cast("decimal(38,0)"))).first())

    edges = store.table("edges0", tidy(links.select(a.cast("long"), b.cast("long"))))
    before, turn = state(edges), 0
    while before[0]:
        turn += 1
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = store.table("least", both.groupBy("a").agg(F.min("b").alias("m")))
        large = store.table("large", both.join(least, "a").where(b > a).select(b.alias("a"), F.least(a, "m").alias("b")).where(a != b).distinct())
        least2 = store.table("least", large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least2, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(least2.select("a", F.col("m").alias("b")))
        edges = store.table(f"edges{turn}", tidy(small))
        after = state(edges)
        store.drop("least", "large", f"edges{turn - 1}")
        if after == before:
            break
        before = after
    return edges.select(a.alias("id"), b.alias("component")).unionByName(edges.select(b.alias("id"), b.alias("component")).distinct())
