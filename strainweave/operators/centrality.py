"""Centrality of the temporal graph, risk, and index cases.

Shortest paths stay within a weak component. Components of up to WHOLE arcs are packed into groups, as many as their arcs
ask for; one of more than BLOCK nodes is given to several groups, each with a block of its nodes as sources, and the
shares are summed. In larger components distances, numbers of paths and shares are tables that joins bring forward until
nothing changes, a block of sources at a time, so that no task holds a component.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainweave.functions.weights import floor_weight
from strainweave.operators.components import connected_components
from strainweave.plans.shared import cut, scope, write_counted, write_step

#: Source nodes of one group at most, for a component larger than that.
BLOCK = 512
#: Most arcs of a component that a group holds, and arcs of a group on average.
WHOLE, GROUP = 200_000, 20_000
#: Rows (source, node) that a block of sources of the large components has at most, about.
STATE = 200_000_000
_TIE = 1e-10


def paths_from(source: int, out: list[list[tuple[int, float]]], n: int) -> tuple[dict, list, dict, dict]:
    """Dijkstra: (distance, nodes in settling order, number of shortest paths, predecessors)."""
    dist, sigma, before, order, heap, done = {source: 0.0}, {source: 1.0}, {}, [], [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w, length in out[v]:
            new = d + length
            old = dist.get(w)
            if old is None or new < old - _TIE * max(1.0, old):
                dist[w], sigma[w], before[w] = new, sigma[v], [v]
                heapq.heappush(heap, (new, w))
            elif abs(new - old) <= _TIE * max(1.0, old) and w not in done:
                sigma[w] += sigma[v]
                before[w].append(v)
    return dist, order, sigma, before


def _shares(directed: bool):
    def work(key: tuple, arcs: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([arcs["src"].to_numpy(object), arcs["dst"].to_numpy(object), sources["node"].to_numpy(object)]).astype(str))
        at = {x: i for i, x in enumerate(names)}
        out: list[list] = [[] for _ in names]
        around: list[list] = [[] for _ in names]
        for s, t, w in zip(arcs["src"], arcs["dst"], arcs["w"]):
            out[at[s]].append((at[t], w))
            around[at[s]].append((at[t], w))
            around[at[t]].append((at[s], w))
        between, close = np.zeros(len(names)), {}
        for name in sources["node"]:
            s = at[name]
            _, order, sigma, before = paths_from(s, out if directed else around, len(names))
            delta = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before.get(w, ()):
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                if w != s:
                    between[w] += delta[w]
            dist = paths_from(s, around, len(names))[0]
            total = sum(dist.values())
            close[name] = (len(dist) - 1) / total if total else 0.0
        return pd.DataFrame({"node": names, "betweenness": between if directed else between / 2, "closeness": [close.get(x) for x in names]})

    return work


def _near(a: Column, b: Column) -> Column:
    """Whether two path lengths count as equal."""
    return F.abs(a - b) <= _TIE * F.greatest(F.lit(1.0), b)


def _distances(sources: DataFrame, arcs: DataFrame, max_rounds: int) -> DataFrame:
    """(s, v, d): the shortest distance from every source to every node it reaches; only what got shorter is sent on."""
    now = write_step(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("changed")), "reached")
    for r in range(max_rounds):
        sent = now.df.filter("changed").join(arcs, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        step = now.df.select("s", "v", "d").join(sent, ["s", "v"], "full_outer").select("s", "v", F.least("d", "new").alias("d"), (F.col("d").isNull() | (F.col("new") < F.col("d"))).alias("changed"))
        new, seen = write_counted(step.withColumn("changed", F.coalesce("changed", F.lit(False))), f"reached-{r}", changed=F.count_if("changed"))
        now.drop()
        now = new
        if not seen["changed"]:
            return now.df.select("s", "v", "d")
    raise RuntimeError("distances still change: max_rounds is too small")


def _settle(start: DataFrame, steps: DataFrame, share: Column, max_rounds: int) -> DataFrame:
    """(s, v, x): x = base + the sum of `share` over the steps (s, u, v) that lead from u to v, brought forward until nothing changes.

    start (s, v, base); share reads x of the end u, and what else the steps carry. The steps have no cycle, so a node's
    value stands once those before it do.
    """
    now = write_step(start.select("s", "v", "base", F.col("base").alias("x")), "values")
    for r in range(max_rounds):
        got = steps.join(now.df.select("s", F.col("v").alias("u"), "x"), ["s", "u"]).groupBy("s", "v").agg(F.sum(share).alias("got"))
        step = now.df.join(got, ["s", "v"], "left").select("s", "v", "base", F.col("x").alias("old"), (F.col("base") + F.coalesce("got", F.lit(0.0))).alias("x"))
        new, seen = write_counted(step, f"values-{r}", changed=F.count_if(F.abs(F.col("x") - F.col("old")) > 1e-12 * F.greatest(F.lit(1.0), F.abs("x"))))
        now.drop()
        now = new
        if not seen["changed"]:
            return now.df.select("s", "v", "x")
    raise RuntimeError("values still change: max_rounds is too small")


def _by_joins(arcs: DataFrame, nodes: DataFrame, directed: bool, state: int, max_rounds: int = 100_000) -> DataFrame:
    """(node, betweenness, closeness) of components of any size; nodes (node, n) with the size of their component."""
    around = cut(arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "around")
    out = cut(arcs.groupBy("src", "dst").agg(F.min("w").alias("w")), "out") if directed else around
    rows = nodes.agg(F.sum(F.col("n").cast("double"))).first()[0]
    blocks = max(1, math.ceil(rows / state))
    found = None
    for b in range(blocks):
        sources = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b).select(F.col("node").alias("s"))
        every = _distances(sources, around, max_rounds)
        close = every.groupBy("s").agg(F.try_divide(F.count("*") - 1, F.sum("d")).alias("closeness")).select(F.col("s").alias("node"), F.lit(0.0).alias("betweenness"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"))
        d = _distances(sources, out, max_rounds) if directed else every
        on = d.select("s", F.col("v").alias("u"), F.col("d").alias("du")).join(out.withColumnRenamed("src", "u"), "u").join(d.withColumnRenamed("v", "dst"), ["s", "dst"])
        steps = cut(on.filter(_near(F.col("du") + F.col("w"), F.col("d"))).select("s", "u", F.col("dst").alias("v")), "steps")
        sigma = cut(_settle(d.select("s", "v", F.when(F.col("s") == F.col("v"), 1.0).otherwise(0.0).alias("base")), steps, F.col("x"), max_rounds), "sigma")
        at = lambda end: sigma.select("s", F.col("v").alias(end), F.col("x").alias(f"{end}_paths"))  # noqa: E731, B023
        back = cut(steps.join(at("u"), ["s", "u"]).join(at("v"), ["s", "v"]).select("s", F.col("v").alias("u"), F.col("u").alias("v"), (F.col("u_paths") / F.col("v_paths")).alias("part")), "back")
        delta = _settle(d.select("s", "v", F.lit(0.0).alias("base")), back, F.col("part") * (1 + F.col("x")), max_rounds)
        between = delta.filter("s <> v").groupBy(F.col("v").alias("node")).agg((F.sum("x") / (1 if directed else 2)).alias("betweenness"))
        one = cut(close.unionByName(between.withColumn("closeness", F.lit(0.0))), "shares")
        found = one if found is None else found.unionByName(one)
    return found


def path_centrality(arcs: DataFrame, nodes: DataFrame, directed: bool = True, block: int = BLOCK, whole: int = WHOLE, state: int = STATE) -> DataFrame:
    """(node, betweenness, closeness) from arcs (src, dst, w): betweenness by direction and not normalised, closeness
    without direction over the reached nodes. Weights are floored at 1e-6; a node without arcs has zeros."""
    with scope() as keep:
        return keep(_path_centrality(arcs, nodes, directed, block, whole, state), "path-centrality")


def _path_centrality(arcs: DataFrame, nodes: DataFrame, directed: bool, block: int, whole: int, state: int) -> DataFrame:
    a = cut(arcs.select("src", "dst", floor_weight(F.col("w")).alias("w")), "weighted")
    comp = connected_components(a.select(F.col("src").alias("node")), a)
    arc = cut(a.join(comp.select(F.col("node").alias("src"), "component"), "src"), "arcs")
    sizes = comp.groupBy("component").agg(F.count("*").alias("n")).join(arc.groupBy("component").agg(F.count("*").alias("m")), "component")
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sizes")
    said = sizes.agg(F.count_if(F.col("m") > whole).alias("large"), F.coalesce(F.sum(F.when(F.col("m") <= whole, F.col("m"))), F.lit(0)).alias("arcs")).first()
    packs = max(1, -(-said["arcs"] // GROUP))
    small = sizes.filter(F.col("m") <= whole)
    pack = F.when(F.col("blocks") == 1, F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(packs)).cast("string")))
    src = comp.join(small, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("node", F.coalesce(pack, F.concat_ws("#", "component", "part")).alias("pack"))
    own = arc.join(small, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("src", "dst", "w", F.coalesce(pack, F.concat_ws("#", "component", "part")).alias("pack"))
    shares = own.groupBy("pack").cogroup(src.groupBy("pack")).applyInPandas(_shares(directed), "node string, betweenness double, closeness double")
    if said["large"]:
        large = sizes.filter(F.col("m") > whole)
        wide = cut(arc.join(large.select("component"), "component", "left_semi").select("src", "dst", "w"), "large-arcs")
        shares = shares.unionByName(_by_joins(wide, cut(comp.join(large, "component").select("node", "n"), "large-nodes"), directed, state))
    sums = shares.groupBy("node").agg(F.sum("betweenness").alias("betweenness"), F.max("closeness").alias("closeness"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def scale_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """df with <column>_scaled for each column. The groups' ranges are aggregated first, so a group of any size is spread."""
    v = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    ranges = df.groupBy(group).agg(*[f(v[c]).alias(f"__{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    d = df.join(ranges.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")), "left")
    scaled = {f"{c}_scaled": F.when(F.col(f"__high_{c}") - F.col(f"__low_{c}") < 1e-12, 0.0).otherwise((v[c] - F.col(f"__low_{c}")) / (F.col(f"__high_{c}") - F.col(f"__low_{c}"))) for c in columns}
    return d.withColumns(scaled).select(*df.columns, *scaled)


def risk(df: DataFrame, group: str = "cluster_id") -> DataFrame:
    """df with transmission_risk_score = 0.5 betweenness + 0.3 out_degree + 0.2 closeness, each scaled within the cluster."""
    s = scale_by_group(df, group, ["betweenness", "out_degree", "closeness"])
    return s.withColumn("transmission_risk_score", 0.5 * F.col("betweenness_scaled") + 0.3 * F.col("out_degree_scaled") + 0.2 * F.col("closeness_scaled")).select(*df.columns, "transmission_risk_score")


def centrality(arcs: DataFrame, iso: DataFrame, clusters: DataFrame) -> DataFrame:
    """The centrality table: clusters (isolate_id, cluster_id) left-joined, -1 where there is none."""
    a = cut(arcs.select("src", "dst", F.col("composite_weight").alias("w")), "arcs")
    paths = path_centrality(a, iso.select(F.col("isolate_id").alias("node"))).withColumnRenamed("node", "isolate_id")
    degree = lambda end, name: a.groupBy(F.col(end).alias("isolate_id")).agg(F.count("*").cast("int").alias(name))
    d = paths.join(clusters.select("isolate_id", "cluster_id"), "isolate_id", "left").join(degree("dst", "in_degree"), "isolate_id", "left").join(degree("src", "out_degree"), "isolate_id", "left")
    d = d.select("isolate_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "betweenness", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "closeness")
    return risk(d)


def index_cases(scores: DataFrame, iso: DataFrame) -> DataFrame:
    """Per cluster the isolate of highest risk (of equal ones the first by id), its place by day, and whether that is late.

    temporal_mismatch: more isolates than a quarter of the cluster (rounded down) come before it. The place is counted
    by aggregation against the candidate, not by sorting the cluster.
    """
    d = scores.join(iso.select("isolate_id", "collection_date"), "isolate_id")
    top = d.groupBy("cluster_id").agg(F.min_by(F.struct("isolate_id", "transmission_risk_score", "betweenness", "out_degree", "closeness", F.col("collection_date").alias("day")), F.struct(-F.col("transmission_risk_score"), F.col("isolate_id"))).alias("c"), F.min("collection_date").alias("earliest_date"), F.count("*").alias("n_isolates_in_cluster"))
    before = (F.col("collection_date") < F.col("c.day")) | ((F.col("collection_date") == F.col("c.day")) & (F.col("isolate_id") < F.col("c.isolate_id")))
    rank = d.select("cluster_id", "isolate_id", "collection_date").join(top, "cluster_id").groupBy("cluster_id").agg(F.count_if(before).alias("rank0"))
    out = top.join(rank, "cluster_id")
    return out.select("cluster_id", F.col("c.isolate_id").alias("index_case_candidate"), "c.transmission_risk_score", "c.betweenness", "c.out_degree", "c.closeness", "earliest_date", (F.col("rank0") + 1).alias("candidate_date_rank"), "n_isolates_in_cluster", (F.col("rank0") > F.floor(F.col("n_isolates_in_cluster") / 4)).alias("temporal_mismatch"))
