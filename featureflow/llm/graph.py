"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.common import materialise

#: Links up to which a step is one task: dealing so few out takes longer than the work.
FEW = 50_000


def components(links: DataFrame, few_links: int = FEW) -> DataFrame:
    """links (a, b) of any orderable type -> (node, root): root is the smallest node reachable.

    Every node of a link has one row; links to itself and repeated links are allowed, links with a
    null are ignored. The number of steps grows with the logarithm of the longest chain; each step
    is one aggregation and one join on the node, whose large groups adaptive execution splits. No
    links give no rows; other columns are ignored. Up to FEW links a step is one task; rows are the same.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    few = edges.count() <= few_links  # steps never add links

    def apart(df: DataFrame) -> DataFrame:
        """As a table of its own: what is joined with it can be split then, however many links a node has."""
        return df if few else materialise(df, "low")

    def together(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    before = None
    while True:
        edges = together(edges)
        both = together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = together(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
        edges = materialise(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        before = now
