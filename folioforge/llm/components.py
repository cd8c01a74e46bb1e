"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node.

    Nulls and self loops are ignored; repeated edges count once; no edges give no rows. Every round
    moves at most as many rows as there are edges, and is written so that a lost executor repeats
    one round only. Rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    e = written(e.where("x is not null and y is not null and x <> y").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        star = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        nxt = written(star.union(least.select("x", F.col("m").alias("y"))).distinct(), "edges")
        old, e = e, nxt
        now = _state(e)
        drop_written(old)
        if now == state:
            break
        state = now
    roots = e.select(F.col("y").alias("x")).distinct().select(F.col("x").alias("node"), F.col("x").alias("component"))
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots)
