"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, comp) for all ends of edges (a, b): comp is the least id of the component.

    In each round every vertex points at the vertex of least rank around it, ranks being hashes anew each round; that map is
    followed twice, and the edges are contracted. So the vertices of any component, long chains too, become fewer by a
    constant factor a round. At the end the rounds' maps, each much smaller than the one before, are joined in turn. Only
    sums by key and joins on it are needed; results are written tables, nothing is collected.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        around = edges.union(edges.select("b", "a")).toDF("v", "u")
        own, other = (F.struct(F.xxhash64(F.lit(len(steps)), c).alias("rank"), F.col(c).alias("id")) for c in ("v", "u"))
        step = around.groupBy("v").agg(F.min(other).alias("best")).select("v", F.least(own, "best")["id"].alias("p"))
        far = step.select(F.col("v").alias("w"), F.col("p").alias("q"))
        steps.append(scratch.keep(step.join(far, F.col("p") == F.col("w"), "left").select("v", F.col("q").alias("p"))))
        x, y = steps[-1].toDF("v1", "p1"), steps[-1].toDF("v2", "p2")
        mapped = edges.join(x, F.col("a") == F.col("v1")).join(y, F.col("b") == F.col("v2"))
        contracted = scratch.keep(mapped.select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).where("a <> b").distinct())
        scratch.drop(edges)
        edges = contracted
    if not steps:
        return edges.toDF("id", "comp")
    assign = steps[-1].toDF("id", "comp")
    for step in reversed(steps[:-1]):
        assign = step.join(assign, F.col("p") == F.col("id"), "left").select(F.col("v").alias("id"), F.coalesce("comp", "p").alias("comp"))
    assign = scratch.keep(assign)
    least = assign.groupBy("comp").agg(F.min("id").alias("least"))
    out = scratch.keep(assign.join(least, "comp").select("id", F.col("least").alias("comp")))
    scratch.drop(assign, *steps)
    return out
