"""Minimum spanning forest by Boruvka rounds over a graph that is contracted each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.operators.components import connected_components
from strainweave.plans.shared import cut, scope


def spanning_forest(edges: DataFrame, weight: str = "composite_weight", max_rounds: int = 64) -> DataFrame:
    """(src, dst, weight) of the forest that is smallest by (weight, src, dst), which makes it unique.

    Each round every tree takes its smallest edge to another tree, and the trees so joined become one node: of parallel
    edges only the smallest stays. Trees at least halve in number, so each round works on a smaller graph.
    """
    with scope() as keep:
        return keep(_forest(edges, weight, max_rounds), "forest")


def _forest(edges: DataFrame, weight: str, max_rounds: int) -> DataFrame:
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col(weight).alias("w")).filter("src < dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    live = cut(e.select(F.struct("w", "src", "dst").alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b")), "live")
    taken = live.limit(0).select("edge")
    for k in range(max_rounds):
        ends = live.select(F.explode(F.array("a", "b")).alias("tree"), F.struct("edge", "a", "b").alias("m"))
        best = cut(ends.groupBy("tree").agg(F.min("m").alias("m")).select("m.*").distinct(), f"best-{k}")
        if not best.limit(1).count():
            return taken.select("edge.src", "edge.dst", F.col("edge.w").alias(weight))
        taken = taken.unionByName(best.select("edge"))
        comp = connected_components(best.select(F.col("a").alias("node")), best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        at = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"new_{end}"))  # noqa: E731, B023
        joined = live.join(at("a"), "a").join(at("b"), "b").filter("new_a <> new_b")
        live = cut(joined.groupBy(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).agg(F.min("edge").alias("edge")), f"live-{k}")
    raise RuntimeError("trees still grow: max_rounds is too small")
