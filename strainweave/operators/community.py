"""Communities of many graphs at once by modularity: moves, refinement, and merging, until nothing moves.

The quality is the sum over pairs in one community of A_ij - gamma k_i k_j / 2m. In a round every node looks at the
communities of its neighbours and prefers the one of highest gain. For LOOSE rounds those that want to move do so if a
bit of their hash says so; after that only moves go that are the best of both communities they touch, each of which
raises the quality, so the rounds end when no node wants to move. Then every community is refined: its nodes start
alone and move for FINE rounds within it; what they form becomes the nodes of the next level, which start in their
communities. When a level merges nothing, communities are cut into their connected parts, and everything begins again
from the single nodes, now with the careful moves only, until a whole pass moves nothing. Ties go to the smaller label;
nothing is drawn at random, and no decision looks beyond a component of one graph.

So components are solved apart: those of up to UNIT pairs in groups, many to a task, by arrays; larger ones by DataFrame
rounds, all together. Both follow the same rules on whole numbers and give the same communities (tested).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainweave.operators.components import connected_components
from strainweave.plans.shared import cut, scope, write_counted, write_step

#: Gains are whole numbers of this part; a move has to gain more than _LEAST of them.
_PART, _LEAST = 1e10, 10
#: Rounds in which a hashed half of the willing nodes moves, and rounds of a refinement.
LOOSE, FINE = 24, 4
#: Most pairs (both directions) of a component that is solved in a group, and how many pairs a group has on average.
UNIT, GROUP = 200_000, 200_000
#: Guards: passes and levels, and rounds of a phase. More is an error.
_PASSES, _ROUNDS = 1000, 100_000


def _salt(turn: int, level: int, fine: bool) -> int:
    return 31 * turn + 17 * level + (7 if fine else 0)


def _move_arrays(unit, src, dst, w, k, gk, h, c, salt, calm, most=_ROUNDS):
    """(labels, units that moved) after the rounds of one phase; a unit at rest takes no further part, a node without pairs never moves."""
    n, c = len(k), c.copy()
    moved = np.zeros(int(unit.max()) + 1, dtype=bool)
    own = np.flatnonzero(np.bincount(src, minlength=n))
    for r in range(most):
        mass = np.bincount(c, k, minlength=n)
        key, at = np.unique(np.concatenate([src * n + c[dst], own * n + c[own]]), return_inverse=True)
        i, to = key // n, key % n
        here = to == c[i]
        sums = np.bincount(at, np.concatenate([w, np.zeros(len(own))]), minlength=len(key))
        gain = np.rint((sums - gk[i] * (mass[to] - here * k[i])) * _PART).astype(np.int64)
        order = np.lexsort((to, -gain, i))
        first = order[np.append(True, i[order][1:] != i[order][:-1])[: len(order)]]
        up, target = gain[first] - gain[here], to[first]
        wants = up > _LEAST
        if not wants.any():
            return c, moved
        who, up, target = own[wants], up[wants], target[wants]
        if calm or r >= LOOSE:
            touched, node, gains = np.concatenate([c[who], target]), np.concatenate([who, who]), np.concatenate([up, up])
            order = np.lexsort((node, gains, touched))
            last = order[np.append(touched[order][1:] != touched[order][:-1], True)]
            goes = np.bincount(node[last], minlength=n)[who] == 2
        else:
            goes = (h[who] >> ((salt + r) % 62)) & 1 == 0
        c[who[goes]] = target[goes]
        moved[unit[who[goes]]] = True
        live = np.zeros(len(moved), dtype=bool)
        live[unit[who]] = True
        if not live[unit[own]].all():
            own, keep = own[live[unit[own]]], live[unit[src]]
            src, dst, w = src[keep], dst[keep], w[keep]
    if most == _ROUNDS:
        raise RuntimeError("nodes still want to move")
    return c, moved


def _named(c: np.ndarray) -> np.ndarray:
    """The labels with each community named by its smallest member."""
    low = np.full(int(c.max()) + 1, len(c))
    np.minimum.at(low, c, np.arange(len(c)))
    return low[c]


def _parts_arrays(src, dst, c):
    """The smallest node of each connected part of each community."""
    inside = c[src] == c[dst]
    s, d, label = src[inside], dst[inside], np.arange(len(c))
    while True:
        new = label.copy()
        np.minimum.at(new, s, label[d])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pass_arrays(unit, src, dst, w, k, gk, h, c, turn):
    """(communities, units that moved) of one pass over all levels, from the communities c."""
    top, moved = np.arange(len(k)), np.zeros(int(unit.max()) + 1, dtype=bool)
    for level in range(_PASSES):
        c, some = _move_arrays(unit, src, dst, w, k, gk, h, c, _salt(turn, level, False), turn > 0)
        moved |= some
        c = _named(c)
        inside = c[src] == c[dst]
        part, _ = _move_arrays(unit, src[inside], dst[inside], w[inside], k, gk, h, np.arange(len(k)), _salt(turn, level, True), False, FINE)
        single = np.bincount(c[np.unique(part)], minlength=len(k)) == np.bincount(c, minlength=len(k))
        part = np.where(single[c], c, part)  # a community that stayed in single nodes becomes one node
        names, new = np.unique(part, return_inverse=True)
        if len(names) == len(k):
            return _named(c[top]), moved
        s, d = new[src], new[dst]
        between = s != d
        pair, at = np.unique(s[between] * len(names) + d[between], return_inverse=True)
        src, dst, w = pair // len(names), pair % len(names), np.bincount(at, w[between], minlength=len(pair))
        c, k, gk = _named(c[names]), np.bincount(new, k), np.bincount(new, gk)
        unit, h, top = unit[names], h[names], new[top]
    raise RuntimeError("communities still merge")


def _solve_arrays(unit, src, dst, w, k, gk, h) -> np.ndarray:
    """The community of every node, named by its smallest member."""
    found = np.arange(len(k))
    for turn in range(_PASSES):
        c, moved = _pass_arrays(unit, src, dst, w, k, gk, h, found, turn)
        live = np.zeros(len(moved), dtype=bool)
        live[unit[src]] = True
        found = np.where(live[unit], _parts_arrays(src, dst, c), found)
        moved[unit[found != c]] = True
        if not moved.any():
            return found
        keep = moved[unit[src]]
        src, dst, w = src[keep], dst[keep], w[keep]
    raise RuntimeError("communities still move")


def _solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """(g, node, community) of a group of whole components; a row a pair, with the attributes of its first end."""
    key = pdf["unit"] + "\u0001"
    src, names = pd.factorize(key + pdf["src"], sort=True)
    dst = names.get_indexer(key + pdf["dst"])
    one = np.zeros(len(names), dtype=np.int64)
    one[src] = np.arange(len(pdf))
    unit = pd.factorize(pdf["unit"])[0][one]
    k, gk, h = (pdf[c].to_numpy()[one] for c in ("k", "gk", "h"))
    found = _solve_arrays(unit, src, dst, pdf["w"].to_numpy(), k, gk, h)
    node = pdf["src"].to_numpy()[one]
    return pd.DataFrame({"g": pdf["g"].to_numpy()[one], "node": node, "community": node[found]})


def _hash(node: str = "node") -> Column:
    return F.xxhash64(node).bitwiseAND(F.lit((1 << 62) - 1))


def _best_moves(best: DataFrame) -> DataFrame:
    """(unit, node) of the moves that are the best of both communities they touch; the best of all is among them."""
    touched = best.filter("wants").select("unit", "node", F.struct("up", "node").alias("move"), F.explode(F.array("old", "c")).alias("at"))
    top = touched.groupBy("unit", "at").agg(F.max("move").alias("move"))
    return top.groupBy("unit", F.col("move.node").alias("node")).agg(F.count("*").alias("n")).filter("n = 2").select("unit", "node")


def _move_rounds(nodes: DataFrame, pairs: DataFrame, salt: int, calm: bool, most: int = _ROUNDS) -> DataFrame:
    """nodes (unit, node, k, gk, c) after the rounds of one phase, with `moved`: the same as _move_arrays.

    The attributes of a pair's first end are joined once, and the mass of a community travels with the nodes in it, so a
    round joins the pairs with one table only. Sums per node and community are combined before they shuffle.
    """
    now = write_step(nodes.select("unit", "node", "k", "gk", "c", F.lit(False).alias("moved")), "move")
    # an edge of weight 0 to itself keeps a node's own community among its options, and marks it
    own = nodes.select("unit", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w"), "k", "gk")
    full = write_step(pairs.join(nodes.select("unit", F.col("node").alias("src"), "k", "gk"), ["unit", "src"]).select("unit", "src", "dst", "w", "k", "gk").unionByName(own), "move-pairs")
    for r in range(most):
        mass = now.df.groupBy("unit", "c").agg(F.sum("k").alias("mass"))
        held = now.df.select("unit", "c", F.col("node").alias("dst"), "moved").join(mass, ["unit", "c"])
        mine = F.col("src") == F.col("dst")
        options = full.df.join(held, ["unit", "dst"]).groupBy("unit", F.col("src").alias("node"), "c").agg(F.sum("w").alias("w"), F.max(mine).alias("here"), F.max(mine & F.col("moved")).alias("moved"), F.first("k").alias("k"), F.first("gk").alias("gk"), F.first("mass").alias("mass"))
        rest = F.col("mass") - F.when(F.col("here"), F.col("k")).otherwise(0.0)
        scored = options.withColumn("gain", F.rint((F.col("w") - F.col("gk") * rest) * _PART).cast("bigint"))
        at_home = lambda c: F.max(F.when(F.col("here"), F.col(c)))
        best = scored.groupBy("unit", "node").agg(F.first("k").alias("k"), F.first("gk").alias("gk"), F.max("moved").alias("moved"), at_home("c").alias("old"), F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("c"), (F.max("gain") - at_home("gain")).alias("up"))
        best, tried = best.withColumn("wants", F.col("up") > _LEAST), None
        if calm or r >= LOOSE:
            tried = write_step(best, f"move-best-{r}")
            best = tried.df.join(_best_moves(tried.df).withColumn("goes", F.lit(True)), ["unit", "node"], "left")
            turn = F.coalesce("goes", F.lit(False))
        else:
            turn = F.shiftright(_hash(), (salt + r) % 62).bitwiseAND(F.lit(1)) == 0
        goes = F.col("wants") & turn
        step = best.select("unit", "node", "k", "gk", F.when(goes, F.col("c")).otherwise(F.col("old")).alias("c"), (F.col("moved") | goes).alias("moved"), "wants")
        new, seen = write_counted(step, f"move-{r}", wants=F.count_if("wants"))
        for t in (now, tried):
            if t:
                t.drop()
        now = new
        if not seen["wants"]:
            break
    else:
        if most == _ROUNDS:
            raise RuntimeError("nodes still want to move")
    full.drop()
    return now.df


def _pass_rounds(nodes: DataFrame, pairs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(unit, node, c) and the units that moved: the same as _pass_arrays."""
    top, moved = nodes.select("unit", "node", F.col("node").alias("at")), None
    lowest = lambda t, by: t.join(t.groupBy("unit", "c").agg(F.min(by).alias("low")), ["unit", "c"]).drop("c").withColumnRenamed("low", "c")
    for level in range(_PASSES):
        state = cut(lowest(_move_rounds(nodes, pairs, _salt(turn, level, False), turn > 0), "node"), "state")
        some = state.filter("moved").select("unit").distinct()
        moved = some if moved is None else moved.unionByName(some)
        at = lambda end, t, c: t.select("unit", F.col("node").alias(end), F.col(c).alias(f"{end}_c"))
        inside = pairs.join(at("src", state, "c"), ["unit", "src"]).join(at("dst", state, "c"), ["unit", "dst"]).filter("src_c = dst_c").select("unit", "src", "dst", "w")
        fine = _move_rounds(state.withColumn("c", F.col("node")), inside, _salt(turn, level, True), False, FINE).select("unit", "node", F.col("c").alias("part"))
        both = cut(state.select("unit", "node", "k", "gk", "c").join(fine, ["unit", "node"]), "parts")
        single = both.groupBy("unit", "c").agg((F.count("*") == F.countDistinct("part")).alias("single"))
        part = cut(both.join(single, ["unit", "c"]).withColumn("part", F.when(F.col("single"), F.col("c")).otherwise(F.col("part"))).drop("single"), "parts")
        if part.select("unit", "part").distinct().count() == part.count():
            found = top.join(part.select("unit", F.col("node").alias("at"), "c"), ["unit", "at"]).select("unit", "node", "c")
            return cut(lowest(found, "node"), "found"), moved
        merged = part.groupBy("unit", F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.sum("gk").alias("gk"), F.min("c").alias("c"))
        nodes = cut(lowest(merged, "node"), "merged")
        ends = pairs.join(at("src", part, "part"), ["unit", "src"]).join(at("dst", part, "part"), ["unit", "dst"]).filter("src_c <> dst_c")
        pairs = cut(ends.groupBy("unit", F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")), "merged-pairs")
        top = cut(top.join(part.select("unit", F.col("node").alias("at"), "part"), ["unit", "at"]).select("unit", "node", F.col("part").alias("at")), "member")
    raise RuntimeError("communities still merge")


def _solve_rounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, node, c) for nodes (unit, node, k, gk) and pairs (unit, src, dst, w): the same as _solve_arrays."""
    now, done = nodes.withColumn("c", F.col("node")), None
    name = lambda c: F.concat_ws("\u0001", "unit", c)
    for turn in range(_PASSES):
        found, moved = _pass_rounds(now, pairs, turn)
        at = lambda end: found.select("unit", F.col("node").alias(end), F.col("c").alias(f"{end}_c"))  # noqa: E731, B023
        inside = pairs.filter("src < dst").join(at("src"), ["unit", "src"]).join(at("dst"), ["unit", "dst"]).filter("src_c = dst_c").select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))
        parts = connected_components(found.select(name(F.col("node")).alias("node")), inside)
        split = cut(found.withColumn("key", name(F.col("node"))).join(parts.withColumnRenamed("node", "key"), "key").select("unit", "node", F.col("c").alias("old"), F.element_at(F.split("component", "\u0001"), -1).alias("c")), "split")
        again = cut(moved.unionByName(split.filter("old <> c").select("unit")).distinct(), "again")
        rest = split.join(again, "unit", "left_anti").select("unit", "node", "c")
        done = rest if done is None else done.unionByName(rest)
        if not again.limit(1).count():
            return done
        now = cut(nodes.join(split.join(again, "unit", "left_semi").select("unit", "node", "c"), ["unit", "node"]), "again-nodes")
        pairs = cut(pairs.join(again, "unit", "left_semi"), "again-pairs")
    raise RuntimeError("communities still move")


def communities(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, unit: int = UNIT, group: int = GROUP, totals: DataFrame | None = None) -> DataFrame:
    """(g, node, community): community is the smallest node of each, a connected set.

    nodes (g, node), edges (g, src, dst, w) with w > 0, one row a pair; graphs (g, gamma), one row a graph, bounded by
    its nature (resolutions or replicates). Nodes without edges stay alone. In the result no move of a node or of a
    level's part to a neighbour raises the quality. unit and group only say how the work is done, not what comes out.
    totals (g, two_m) has the strength of each whole graph where edges are only some of its components.
    """
    with scope() as keep:
        return keep(_communities(nodes, edges, graphs, unit, group, totals), "communities")


def _communities(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, unit: int, group: int, totals: DataFrame | None) -> DataFrame:
    base = edges.select("g", "src", "dst", "w").union(edges.select("g", "dst", "src", "w"))
    # components over all graphs: what one graph links lies in one of them
    comp = connected_components(edges.select(F.col("src").alias("node")), edges.select("src", "dst").distinct())
    paired = cut(base.join(comp.withColumnRenamed("node", "src"), "src").select(F.concat_ws("\u0001", F.col("g").cast("string"), "component").alias("unit"), "g", "src", "dst", "w"), "pairs")
    strength = paired.groupBy("unit", "g", F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    two_m = strength.groupBy("g").agg(F.sum("k").alias("two_m")) if totals is None else totals
    totals = two_m.join(graphs, "g").select("g", (F.col("gamma") / F.col("two_m")).alias("per_k"))
    linked = cut(strength.join(F.broadcast(totals), "g").select("unit", "g", "node", "k", (F.col("per_k") * F.col("k")).alias("gk")), "strengths")  # one row a graph
    sizes = cut(paired.groupBy("unit").agg(F.count("*").alias("n")), "sizes")
    said = sizes.agg(F.count_if(F.col("n") > unit).alias("large"), F.coalesce(F.sum(F.when(F.col("n") <= unit, F.col("n"))), F.lit(0)).alias("pairs")).first()
    groups = max(1, -(-said["pairs"] // group))
    full = paired.join(linked.select("unit", F.col("node").alias("src"), "k", "gk"), ["unit", "src"])
    found = None
    if said["large"]:
        large = sizes.filter(F.col("n") > unit).select("unit")
        full = full.join(large, "unit", "left_anti")
        big = cut(linked.join(large, "unit", "left_semi").select("unit", "node", "k", "gk"), "large-nodes")
        solved = _solve_rounds(big, cut(paired.join(large, "unit", "left_semi").select("unit", "src", "dst", "w"), "large-pairs"))
        found = solved.join(linked.select("unit", "g", "node"), ["unit", "node"]).select("g", "node", F.col("c").alias("community"))
    g_type = edges.schema["g"].dataType.simpleString()
    packed = full.select("unit", "g", "src", "dst", "w", "k", "gk", _hash("src").alias("h"), F.pmod(F.xxhash64("unit"), F.lit(groups)).alias("pack"))
    small = packed.groupBy("pack").applyInPandas(_solve_group, f"g {g_type}, node string, community string")
    found = small if found is None else found.unionByName(small)
    return nodes.select("g", "node").distinct().join(found, ["g", "node"], "left").select("g", "node", F.coalesce("community", "node").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, modularity) of a labelling (g, node, community), weighted, at resolution 1."""
    at = lambda end: labels.select("g", F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    e = edges.join(at("src"), ["g", "src"]).join(at("dst"), ["g", "dst"])
    m = e.groupBy("g").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    ends = e.select("g", F.col("c_src").alias("c"), "w").unionByName(e.select("g", F.col("c_dst").alias("c"), "w")).groupBy("g", "c").agg(F.sum("w").alias("k")).groupBy("g").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return m.join(ends, "g").select("g", (F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def leiden(iso: DataFrame, edges: DataFrame, resolution: float | str = 1.0) -> DataFrame:
    """(isolate_id, community). resolution `auto` takes the first of 0.5, 0.6 .. 2.0 with the highest modularity."""
    gammas = [round(0.5 + 0.1 * i, 2) for i in range(16)] if resolution == "auto" else [float(resolution)]
    graphs = cut(iso.sparkSession.createDataFrame(list(enumerate(gammas)), "g int, gamma double"), "resolutions")
    each = F.explode(F.sequence(F.lit(0), F.lit(len(gammas) - 1))).alias("g")
    nodes = iso.select(each, F.col("isolate_id").alias("node"))
    e = cut(edges.select(each, "src", "dst", F.exp(-F.col("composite_weight")).alias("w")), "similar")
    found = communities(nodes, e, graphs)
    if resolution == "auto":
        best = modularity(e, found).agg(F.min_by("g", F.struct(-F.round("modularity", 12), F.col("g"))).alias("g"))
        found = found.join(F.broadcast(best), "g", "left_semi") if e.limit(1).count() else found.filter("g = 0")
    return found.select(F.col("node").alias("isolate_id"), "community")
