"""Stability of clusters under perturbed distances.

All replicates count, but what is the same in many of them is worked out once. A pair that is an edge under any
perturbation is sure; sure pairs join isolates to parts, and only uncertain pairs between parts (cross pairs) tell
replicates apart. A component in which any two linked communities gain by merging, whatever the perturbation, ends as
its connected parts: no search for communities is needed. Two of them with strengths a and b and a link of w gain if
resolution * a * b / 2m < w, so resolution * K * K / 4 < w * 2m is enough for a component of strength K whose least
link is w, with bounds of K, w and 2m over all perturbations. Other components are open: each replicate is clustered.

Labels are matched within units: components that share no cluster with others. Replicates that give a unit the same
cross pairs are one variant of it, with their number. A plain unit is one cluster in one part: nothing can part it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainweave.functions.weights import composite_weight, grade, st_mismatch, stability_class
from strainweave.operators.community import communities
from strainweave.operators.components import connected_components, number_rows
from strainweave.operators.consensus import matched_labels
from strainweave.plans.shared import cut

#: Cross pairs of a unit up to which its replicates are gathered to variants; beyond that each is one.
FEW = 64


def noise(seed: Column, a: Column, b: Column, most: float = 2.0) -> Column:
    """The mean of two uniform numbers in (-most, most), hashed from seed and the ordered pair: the same wherever it is computed."""
    u = lambda x, y: (F.pmod(F.xxhash64(seed, x, y), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return (u(a, b) + u(b, a) - 1.0) * most


def candidate_pairs(dist: DataFrame, iso: DataFrame, snp_cutoff: float, day_cutoff: int, most: float = 2.0) -> DataFrame:
    """Pairs that any perturbation can make an edge: within snp_cutoff + most and the day cutoff."""
    at = lambda p: iso.select(F.col("isolate_id").alias(p), F.col("collection_date").alias(f"{p}_day"), F.col("sequence_type").alias(f"{p}_st"))
    d = dist.filter(F.col("d") <= snp_cutoff + most).join(at("src"), "src").join(at("dst"), "dst").withColumn("day_delta", F.abs(F.datediff("src_day", "dst_day")))
    return d.filter(F.col("day_delta") <= day_cutoff).select("src", "dst", "d", "day_delta", st_mismatch(F.col("src_st"), F.col("dst_st")).alias("mm"))


def _perturbed(pairs: DataFrame, n_boot: int, seed: int, snp_cutoff: float, most: float = 2.0) -> DataFrame:
    """The pairs that are edges of replicate g, for every g, with d as perturbed."""
    d = pairs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("d", F.greatest(F.col("d") + noise(F.xxhash64(F.lit(seed), "g"), F.col("src"), F.col("dst"), most), F.lit(0.0)))
    return d.filter(F.col("d") <= snp_cutoff)


def perturbed_edges(pairs: DataFrame, n_boot: int, seed: int = 42, snp_cutoff: float = 20, day_cutoff: int = 14, most: float = 2.0) -> DataFrame:
    """(g, src, dst, d, composite_weight) of every replicate g."""
    return _perturbed(pairs, n_boot, seed, snp_cutoff, most).select("g", "src", "dst", "d", composite_weight(F.col("d"), F.col("day_delta"), F.col("mm"), snp_cutoff, day_cutoff).alias("composite_weight"))


def _bounded(pairs: DataFrame, snp_cutoff: float, day_cutoff: int, most: float = 2.0) -> DataFrame:
    """pairs with sure (an edge of every replicate) and low and high, which bound exp(-weight) wherever the pair is an edge."""
    d, end = F.col("d"), float(snp_cutoff)
    at = lambda x: F.exp(-composite_weight(F.least(F.greatest(x, F.lit(0.0)), F.lit(end)), F.col("day_delta"), F.col("mm"), snp_cutoff, day_cutoff))
    return pairs.withColumns({"sure": F.greatest(d + most, F.lit(0.0)) <= end, "low": at(d + most), "high": at(d - most)})


def _parts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, part, component) of all ends, each named by its smallest node, and the cross pairs with their parts a and b and their component."""
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst"))
    part = connected_components(ends, pairs.filter("sure").select("src", "dst")).withColumnRenamed("component", "part")
    at = lambda end, name: part.select(F.col("node").alias(end), F.col("part").alias(name))
    cross = cut(pairs.filter("not sure").join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a <> b").select("src", "dst", "d", "a", "b"), "cross")
    links = cross.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = connected_components(links.select(F.col("src").alias("node")), links).withColumnRenamed("node", "part")
    parts = part.join(comp, "part", "left").select("node", "part", F.coalesce("component", "part").alias("component"))
    return cut(parts, "parts"), cut(cross.join(comp.withColumnRenamed("part", "a"), "a"), "cross-pairs")


def _open_components(pairs: DataFrame, parts: DataFrame, resolution: float) -> DataFrame:
    """(component) of those that are not proven to end as their connected parts."""
    floor = pairs.filter("sure").agg(F.sum("low")).first()[0] or 0.0
    held = pairs.join(parts.select(F.col("node").alias("src"), "component"), "src").groupBy("component").agg((2 * F.sum("high")).alias("strength"), F.min("low").alias("link"))
    # a little less than the link: sums are rounded, and a move has to gain something
    closed = F.lit(float(resolution)) * F.col("strength") * F.col("strength") / 4 < (F.col("link") * (1 - 1e-6) - 1e-8) * F.lit(2 * floor)
    return held.filter(~closed).select("component")


def _units(member: DataFrame) -> DataFrame:
    """member with its unit: the smallest of all components that clusters link with its own."""
    low = member.groupBy("label").agg(F.min("component").alias("dst"))
    ties = cut(member.join(low, "label").filter("component <> dst").select(F.col("component").alias("src"), "dst").distinct(), "ties")
    tied = connected_components(ties.select(F.col("src").alias("node")), ties).select(F.col("node").alias("component"), F.col("component").alias("unit"))
    return member.join(tied, "component", "left").withColumn("unit", F.coalesce("unit", "component"))


def _plain(member: DataFrame, open_: DataFrame) -> DataFrame:
    """(unit) of those with one cluster and one part, in no open component: every replicate gives them their label."""
    one = lambda c: F.min(c) == F.max(c)
    known = member.join(open_.withColumn("open", F.lit(1)), "component", "left")
    return known.groupBy("unit").agg((one("label") & one("part") & (F.count("label") == F.count("*")) & (F.count("open") == 0)).alias("plain")).filter("plain").select("unit")


def _variants(member: DataFrame, cross: DataFrame, open_: DataFrame, n_boot: int, seed: int, snp_cutoff: float) -> tuple[DataFrame, DataFrame]:
    """(unit, v, n): the variants of each unit and their replicates; (v, a, b): the parts that cross pairs link in them.

    In units with open components or more than FEW cross pairs every replicate is a variant, v = g.
    """
    unit = member.select("component", "unit").distinct()
    pairs = cut(cross.join(unit, "component"), "unit-cross")
    units = unit.join(open_.withColumn("open", F.lit(1)), "component", "left").groupBy("unit").agg(F.max("open").alias("open"))
    counted = units.join(pairs.groupBy("unit").agg(F.count("*").alias("n_cross")), "unit", "left")
    kinds = cut(counted.select("unit", (F.col("open").isNotNull() | (F.coalesce("n_cross", F.lit(0)) > FEW)).alias("apart")), "kinds")
    drawn = lambda p: _perturbed(p, n_boot, seed, snp_cutoff).select("unit", F.col("g").cast("int").alias("g"), "a", "b")
    few = drawn(pairs.join(kinds.filter("not apart"), "unit", "left_semi"))
    states = few.groupBy("unit", "g").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("links")).groupBy("unit", "links").agg(F.count("*").alias("n"))
    states = cut(states.withColumn("v", F.row_number().over(Window.partitionBy("unit").orderBy("links"))), "states")  # 0 is the one without links
    bare = kinds.filter("not apart").join(states.groupBy("unit").agg(F.sum("n").alias("taken")), "unit", "left").select("unit", F.lit(0).alias("v"), (F.lit(n_boot) - F.coalesce("taken", F.lit(0))).alias("n"))
    each = kinds.filter("apart").select("unit", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("v"), F.lit(1).cast("bigint").alias("n"))
    variants = bare.filter("n > 0").unionByName(states.select("unit", "v", "n")).unionByName(each)
    apart = drawn(pairs.join(kinds.filter("apart"), "unit", "left_semi").join(open_, "component", "left_anti"))
    links = states.select("v", F.explode("links").alias("link")).select("v", "link.a", "link.b").unionByName(apart.select(F.col("g").alias("v"), "a", "b"))
    return cut(variants, "variants"), links


def _roots(links: DataFrame) -> DataFrame:
    """(v, part, root): the smallest part that links join with each in variant v."""
    key = lambda c: F.concat_ws("\u0001", F.col("v").cast("string"), c)
    e = cut(links.select(key("a").alias("src"), key("b").alias("dst")).distinct(), "links")
    after = lambda c: F.split(c, "\u0001", 2)
    return connected_components(e.select(F.col("src").alias("node")), e).select(after("node")[0].cast("int").alias("v"), after("node")[1].alias("part"), after("component")[1].alias("root"))


def bootstrap_stability(dist: DataFrame, iso: DataFrame, clusters: DataFrame, n_boot: int = 500, seed: int = 42, snp_cutoff: float = 20, day_cutoff: int = 14, resolution: float = 1.0) -> DataFrame:
    """(isolate_id, cluster_id, stability_score, classification): the share of replicates that give an isolate its label.

    Each replicate is clustered and aligned to clusters (isolate_id, cluster_id); see above for what is done once.
    n_boot 0 or less gives 1.0 and `stable`.
    """
    if n_boot <= 0:
        return clusters.select("isolate_id", "cluster_id", F.lit(1.0).alias("stability_score"), F.lit("stable").alias("classification"))
    return stability(cut(candidate_pairs(dist, iso, snp_cutoff, day_cutoff), "candidates"), iso, clusters, n_boot, seed, snp_cutoff, day_cutoff, resolution)


def stability(pairs: DataFrame, iso: DataFrame, clusters: DataFrame, n_boot: int, seed: int = 42, snp_cutoff: float = 20, day_cutoff: int = 14, resolution: float = 1.0) -> DataFrame:
    """The same from written candidate_pairs, for n_boot of at least 1."""
    gold = clusters.select("isolate_id", F.col("cluster_id").cast("bigint").alias("label"))
    pairs = _bounded(pairs, snp_cutoff, day_cutoff)
    parts, cross = _parts(pairs)
    named = gold.join(iso.select("isolate_id"), "isolate_id", "left_semi").join(parts.withColumnRenamed("node", "isolate_id"), "isolate_id", "left")
    named = cut(named.select("isolate_id", "label", F.coalesce("part", "isolate_id").alias("part"), F.coalesce("component", "isolate_id").alias("component")), "named")
    open_ = cut(_open_components(pairs, parts, resolution), "open")
    every = cut(_units(named), "members")
    plain = cut(_plain(every, open_), "plain")
    member = cut(every.join(plain, "unit", "left_anti"), "others")
    variants, links = _variants(member, cross, open_, n_boot, seed, snp_cutoff)
    closed = member.join(open_, "component", "left_anti").join(variants, "unit").join(_roots(links), ["v", "part"], "left")
    found = closed.select(F.col("v").alias("g"), "isolate_id", "n", F.col("label").alias("gold"), F.coalesce("root", "part").alias("community"))
    if open_.limit(1).count():
        inside = parts.join(open_, "component").select("node")
        weights = lambda p: perturbed_edges(p, n_boot, seed, snp_cutoff, day_cutoff).select("g", "src", "dst", F.exp(-F.col("composite_weight")).alias("w"))
        e = cut(weights(pairs.join(inside.withColumnRenamed("node", "src"), "src")), "replicates")
        totals = cut(weights(pairs).groupBy("g").agg((2 * F.sum("w")).alias("two_m")), "totals")
        graphs = iso.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("g"), F.lit(float(resolution)).alias("gamma"))
        nodes = inside.select(F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("g"), "node")
        solved = communities(nodes, e, graphs, totals=totals).join(member.withColumnRenamed("isolate_id", "node"), "node")
        found = found.unionByName(solved.select("g", F.col("node").alias("isolate_id"), F.lit(1).cast("bigint").alias("n"), F.col("label").alias("gold"), "community"))
    found = cut(found, "replicate-labels")
    number = number_rows(found.select("community").distinct(), ["community"], "label")
    labelled = cut(found.join(number, "community").select("g", "isolate_id", "n", "gold", "label"), "numbered")
    matched = matched_labels(labelled, gold).withColumnRenamed("other", "label")
    kept = labelled.join(matched, ["g", "label"]).filter("ref = gold").groupBy("isolate_id").agg((F.sum("n") / F.lit(n_boot)).alias("share"))
    kept = kept.unionByName(every.join(plain, "unit", "left_semi").select("isolate_id", F.lit(1.0).alias("share")))
    score = gold.join(kept, "isolate_id", "left").withColumn("stability_score", F.coalesce("share", F.lit(0.0)))
    return score.select("isolate_id", F.col("label").cast("int").alias("cluster_id"), "stability_score", stability_class(F.col("stability_score")).alias("classification"))


def stability_summary(stability: DataFrame) -> DataFrame:
    """Per cluster its size, mean stability, isolates of each class, and grade."""
    kind = lambda k: F.count_if(F.col("classification") == k)
    return stability.groupBy("cluster_id").agg(F.count("*").alias("n_isolates"), F.avg("stability_score").alias("mean_stability"), kind("stable").alias("n_stable"), kind("uncertain").alias("n_uncertain"), kind("unstable").alias("n_unstable")).withColumn("confidence_grade", grade(F.col("mean_stability")))
