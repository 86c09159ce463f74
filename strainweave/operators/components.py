"""Connected components, and numbering without a single sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.plans.shared import cut, scope, write_counted, write_step


#: Edges that a task contracts at once.
CHUNK = 500_000


def _contracted(parts: list[pd.DataFrame]) -> pd.DataFrame:
    edges = pd.concat(parts)
    at, names = pd.factorize(np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy()]), sort=True)
    a, b = at[: len(edges)], at[len(edges) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    far = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"src": names[far], "dst": names[label[far]]})


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts, size = [], 0
    for pdf in batches:
        parts.append(pdf)
        size += len(pdf)
        if size >= CHUNK:
            yield _contracted(parts)
            parts, size = [], 0
    if size:
        yield _contracted(parts)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): component is the smallest node of each connected component.

    nodes has the column node, edges src and dst (either direction, ends outside nodes allowed). First every task replaces
    its edges, CHUNK at a time, by one from each node to the smallest it is linked with among them. Then every round takes
    the smallest label among a node and its neighbours and then the label's own label, so paths halve.
    """
    with scope() as keep:
        return keep(_components(nodes, edges, max_rounds), "components")


def _components(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    known = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).filter("node is not null").distinct()
    kind = edges.schema["src"].dataType.simpleString()
    stars = edges.select("src", "dst").filter("src <> dst").mapInPandas(_stars, f"src {kind}, dst {kind}").distinct()
    stars = cut(stars, "stars")
    sym = cut(stars.union(stars.select("dst", "src")), "neighbours")
    now = write_step(known.select("node", F.col("node").alias("label")), "labels")
    for k in range(max_rounds):
        near = sym.join(now.df, sym["dst"] == now.df["node"]).groupBy("src").agg(F.min("label").alias("near"))
        low = now.df.join(near, now.df["node"] == near["src"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = now.df.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = low.join(up, "label", "left").select("node", "old", F.least("label", "root").alias("label"))
        new, seen = write_counted(step, f"labels-{k}", moved=F.count_if(F.col("old") != F.col("label")))
        now.drop()
        now = new
        if not seen["moved"]:
            return now.df.select("node", F.col("label").alias("component"))
    raise RuntimeError("no fixpoint: max_rounds is too small")


def number_rows(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """df with 0, 1, 2, ... in the given order: a range-partitioned sort, then each partition's rows after those before it."""
    rows = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    starts = {r["__part"]: r["__n"] for r in sizes.collect()}
    offsets, total = [], 0
    for p in sorted(starts):
        offsets.append((p, total))
        total += starts[p]
    off = df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    return rows.withColumn("__part", part).join(F.broadcast(off), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.shiftleft("__part", 33)).select(*df.columns, name)


def component_of(node, components: DataFrame) -> DataFrame:
    """All nodes of the component that holds the given node."""
    return components.join(F.broadcast(components.filter(F.col("node") == node).select("component")), "component", "left_semi")
