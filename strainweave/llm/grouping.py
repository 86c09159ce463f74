"""Consolidating pairwise matches into groups by alternating large-star and small-star rewrites.

Identifiers become numbers in their byte order, so the smallest number of a component is its smallest identifier. Edges
point from the higher end (hi) to the lower (lo). Large-star moves every higher neighbour of a node to the node's
smallest neighbour; small-star moves every lower neighbour of a node, and the node, to the smallest of them. When
neither changes anything, each edge leads from a node to the minimum of its component.

A hub may hold a third of all edges: minima are pre-aggregated per node before the shuffle, and the edges of heavy nodes
meet their minimum in a broadcast of at most MAX_HEAVY rows instead of a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id
from strainweave.operators.skew import HEAVY_ROWS, MAX_HEAVY
from strainweave.plans.shared import Written, cut, write_step


def links(pairs: DataFrame, a: str, b: str, weight: str, low: float, high: float) -> DataFrame:
    """Distinct (lo, hi) of the rows whose ends are both present and different and whose weight is from low to high. Null weights link nothing."""
    x, y = clean_id(F.col(a)), clean_id(F.col(b))
    d = pairs.filter((F.col(weight) >= low) & (F.col(weight) <= high)).select(x.alias("x"), y.alias("y")).filter("x is not null and y is not null and x <> y")
    return d.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def _numbered(nodes: DataFrame) -> DataFrame:
    """(id, n) with n ascending in the byte order of id: the position in a global sort, partition by partition."""
    return cut(nodes.orderBy("id").select("id", F.monotonically_increasing_id().alias("n")), "nodes")


def _moves(edges: DataFrame, by: str, least: DataFrame, heavy_rows: int) -> tuple[DataFrame, Written]:
    """edges with `m`, the minimum that `least` (columns by, m, n_edges) has for their end `by`; and the written minima.

    The minima are aggregated once. Where any node is heavy, the edges of at most MAX_HEAVY such nodes meet a broadcast.
    """
    seen = Observation()
    minima = write_step(least.observe(seen, F.count_if(F.col("n_edges") >= heavy_rows).alias("heavy")), "minima")
    if not seen.get["heavy"]:
        return edges.join(minima.df.select(by, "m"), by), minima
    few = minima.df.filter(F.col("n_edges") >= heavy_rows).orderBy(F.desc("n_edges"), by).limit(MAX_HEAVY).select(by, "m")
    hot = edges.join(F.broadcast(few), by)
    cold = edges.join(F.broadcast(few.select(by)), by, "left_anti").join(minima.df.select(by, "m"), by)
    return hot.unionByName(cold), minima


def _step(moved: DataFrame, edges: DataFrame, name: str) -> tuple[Written, int]:
    """Writes the distinct edges; and the number of rewrites that changed one."""
    seen = Observation()
    counted = moved.observe(seen, F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0).cast("long")).alias("changed"))
    new = counted.select(edges.columns).distinct()
    written = write_step(new, name)
    return written, seen.get["changed"]


def large_star(edges: DataFrame, heavy_rows: int) -> tuple[DataFrame, Written]:
    """(lo, hi, changed): every edge hangs on the smallest neighbour of its lower end; and the minima that it reads."""
    both = edges.select(F.col("lo").alias("lo"), F.col("hi").alias("other")).unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("other")))
    least = both.groupBy("lo").agg(F.min("other").alias("m"), F.count("*").alias("n_edges"))
    moved, minima = _moves(edges, "lo", least, heavy_rows)
    m = F.least("m", "lo")
    return moved.select(m.alias("lo"), "hi", (m != F.col("lo")).alias("changed")), minima


def small_star(edges: DataFrame, heavy_rows: int) -> tuple[DataFrame, Written]:
    """(lo, hi, changed): the lower neighbours of a node, and the node, hang on the smallest of them; and the minima that it reads."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n_edges"))
    moved, minima = _moves(edges, "hi", least, heavy_rows)
    ends = F.when(F.col("lo") == F.col("m"), F.array("hi")).otherwise(F.array("hi", "lo"))
    return moved.select(F.col("m").alias("lo"), F.explode(ends).alias("hi"), (F.col("lo") != F.col("m")).alias("changed")), minima


def star_edges(edges: DataFrame, heavy_rows: int = HEAVY_ROWS, max_rounds: int = 100) -> DataFrame:
    """One edge (lo, hi) for every node hi that isn't the minimum of its component, lo being that minimum.

    Every half round is written to the shared folder and the one before removed. Stops when a whole round changes nothing.
    """
    now = write_step(edges.select("lo", "hi"), "stars")
    if not now.df.limit(1).count():
        return now.df
    for k in range(max_rounds):
        total = 0
        for star in (large_star, small_star):
            moved, minima = star(now.df, heavy_rows)
            after, changed = _step(moved, now.df, f"stars-{k}")
            now.drop()
            minima.drop()
            now, total = after, total + changed
        if not total:
            return now.df
    raise RuntimeError("no fixpoint: max_rounds is too small")


def group_ids(pairs: DataFrame, a: str = "source", b: str = "target", weight: str = "snp_distance", low: float = 0, high: float = 20, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(isolate_id, group_id) for every identifier that is an end of any row; group_id is the smallest of its group.

    Ends are trimmed; null and blank are no identifiers. Rows with one end, with two equal ends or a weight out of
    range link nothing, but their ends are listed. An empty input gives an empty result.
    """
    ids = pairs.select(F.explode(F.array(clean_id(F.col(a)), clean_id(F.col(b)))).alias("id")).filter("id is not null").distinct()
    linked = cut(links(pairs, a, b, weight, low, high), "links")
    ends = linked.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    number = _numbered(ends)
    edges = linked.join(number.select(F.col("id").alias("lo"), F.col("n").alias("lo_n")), "lo").join(number.select(F.col("id").alias("hi"), F.col("n").alias("hi_n")), "hi").select(F.col("lo_n").alias("lo"), F.col("hi_n").alias("hi"))
    stars = star_edges(edges, heavy_rows)
    low_names = number.select(F.col("n").alias("lo"), F.col("id").alias("group_id"))
    of = stars.join(number.select(F.col("n").alias("hi"), F.col("id").alias("isolate_id")), "hi").join(low_names, "lo").select("isolate_id", "group_id")
    return ids.select(F.col("id").alias("isolate_id")).join(of, "isolate_id", "left").select("isolate_id", F.coalesce("group_id", "isolate_id").alias("group_id"))
