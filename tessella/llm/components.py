"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large_star(e: DataFrame, keep) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, keep) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = keep(down.groupBy("u").agg(F.min("v").alias("m")), "small")
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc", max_rounds: int = 64) -> DataFrame:
    """(u, v) pairs -> (node, component) for every node of an edge; component is the smallest node.

    Each round takes minima with map-side sums and joins them back.  The minima are written
    first, so that both sides of the join are plain shuffles: a hub is then split by AQE's skew
    join, never gathered.  Rounds grow with the logarithm of the nodes; `max_rounds` only guards against a
    bug and raises.  Self loops and nulls are dropped; no edges give an empty table.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct()
    e = ws.save(e, f"{name}-0")
    mark = None
    for k in range(1, max_rounds + 1):
        keep = lambda df, step: ws.save(df, f"{name}-{k}-{step}")  # noqa: B023, E731
        large = ws.save(_large_star(e, keep), f"{name}-{k}-edges")
        e = ws.save(_small_star(large, keep), f"{name}-{k}")
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        ws.drop(f"{name}-{k - 1}", *(f"{name}-{k}-{step}" for step in ("large", "small", "edges")))
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
