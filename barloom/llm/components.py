"""Connected components of an edge table, by stars (the distributed form of union-find)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, written


class UnionFind:
    """Union-find over the keys of one block of rows."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b), component the smallest node reachable.

    Every round hooks each node's larger neighbours to its smallest one (large
    star), then the smaller ones too (small star), until every edge leads to its
    component's smallest node. Rounds grow with the logarithm of the nodes; the
    neighbours of one node are never gathered in a task.
    """
    with Scratch(edges.sparkSession) as keep:
        edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
        mark = None
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = edges.select(F.col("a").alias("v"), F.col("b").alias("a")).join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
            large = keep(large.where("a != b").distinct())
            keep.drop(edges)
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
            edges = keep(small.where("a != b").distinct())
            keep.drop(large)
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == mark:
                return written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
            mark = now
