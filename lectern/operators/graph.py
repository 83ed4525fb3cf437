"""Bounded walks over the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import checkpointed
from .works import in_degree


def walk(citations: DataFrame, start: int | str, direction: str = "out", depth: int = 1, per_node: int = 50, total: int = 500) -> DataFrame:
    """work_id, depth of what is reached in at most ``depth`` (3) steps. Of each node's
    edges the ``per_node`` most cited ends are followed, and the nearest ``total`` works
    are kept; ``truncated`` tells of either cap. One join a step, on the frontier."""
    depth = max(1, min(depth, 3))
    a, b = ("citing_work_id", "cited_work_id") if direction == "out" else ("cited_work_id", "citing_work_id")
    edges = citations.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    frontier = citations.sparkSession.range(1).select(F.lit(start).alias("work_id"))
    seen = frontier.select("work_id", F.lit(0).alias("depth"), F.lit(False).alias("cut"))
    for step in range(1, depth + 1):
        out = edges.join(frontier.select(F.col("work_id").alias("src")), "src").distinct()
        # The degree of what the frontier reaches, not of every work.
        met = citations.join(out.select(F.col("dst").alias("cited_work_id")).distinct(), "cited_work_id", "left_semi")
        out = out.join(in_degree(met).withColumnRenamed("work_id", "dst"), "dst", "left").na.fill(0, ["n_citations"])
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n_citations"), "dst"))
        ranked = out.withColumn("rank", rank)
        cut = F.max("rank").over(Window.partitionBy("src")) > per_node
        kept = ranked.withColumn("cut", cut).where(F.col("rank") <= per_node).groupBy("dst").agg(F.max("cut").alias("cut"))
        fresh = kept.select(F.col("dst").alias("work_id"), F.lit(step).alias("depth"), "cut").join(seen.select("work_id"), "work_id", "left_anti")
        frontier = checkpointed(fresh) if step < depth else fresh
        seen = seen.unionByName(frontier)
    reached = seen.where("depth > 0")
    return reached.orderBy("depth", "work_id").limit(total).select("work_id", "depth", F.col("cut").alias("truncated"))


def neighbourhood(citations: DataFrame, start: int | str, direction: str = "both", depth: int = 1, per_node: int = 50, total: int = 500) -> DataFrame:
    sides = ["out", "in"] if direction == "both" else [direction]
    parts = [walk(citations, start, s, depth, per_node, total).withColumn("direction", F.lit(s)) for s in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
