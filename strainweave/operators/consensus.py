"""Labels of several methods brought onto one and voted on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.operators.components import connected_components, number_rows
from strainweave.plans.shared import cut, scope


#: Cells of the contingency table that a group has on average.
GROUP = 20_000


def contingency(other: DataFrame, reference: DataFrame) -> DataFrame:
    """(g, other, ref, n): how many isolates have both labels. Inputs (g, isolate_id, label); those in one only do not count."""
    return other.select("g", "isolate_id", F.col("label").alias("other")).join(reference.select("isolate_id", F.col("label").alias("ref")), "isolate_id").groupBy("g", "other", "ref").agg(F.count("*").alias("n"))


def best_matching(overlap: np.ndarray) -> np.ndarray:
    """The column of each row in a one-to-one matching of largest sum (rows <= columns), by shortest augmenting paths."""
    rows, cols = overlap.shape
    cost = -overlap.astype(float)
    u, v, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.full(cols + 1, -1)
    for r in range(rows):
        owner[cols], at = r, cols
        least, back, used = np.full(cols, np.inf), np.full(cols, cols), np.zeros(cols + 1, dtype=bool)
        while owner[at] >= 0:
            used[at] = True
            free = ~used[:cols]
            slack = cost[owner[at]] - u[owner[at]] - v[:cols]
            better = free & (slack < least)
            least[better], back[better] = slack[better], at
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            at = nxt
        while at != cols:
            owner[at] = owner[back[at]]
            at = back[at]
    out = np.full(rows, -1)
    for c in range(cols):
        if owner[c] >= 0:
            out[owner[c]] = c
    return out


def _match_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of one connected block of the contingency table, matched for the largest overlap."""
    out = []
    for (g, _), block in pdf.groupby(["g", "block"], sort=True):
        others, i = np.unique(block["other"].to_numpy(), return_inverse=True)
        refs, j = np.unique(block["ref"].to_numpy(), return_inverse=True)
        m = np.zeros((len(others), len(refs)), dtype=np.int64)
        np.add.at(m, (i, j), block["n"].to_numpy())
        pick = best_matching(m) if m.shape[0] <= m.shape[1] else _inverse(best_matching(m.T), m.shape[0])
        out += [(g, o, refs[c]) for i, (o, c) in enumerate(zip(others, pick)) if c >= 0 and m[i, c] > 0]
    return pd.DataFrame(out, columns=["g", "other", "ref"])


def _inverse(pick: np.ndarray, rows: int) -> np.ndarray:
    out = np.full(rows, -1)
    out[pick] = np.arange(len(pick))
    return out


def align_labels(other: DataFrame, reference: DataFrame) -> DataFrame:
    """(g, other, label): for every label of each graph g of `other` the reference's label of the best one-to-one matching.

    A label without an overlapping partner gets the next free number: the largest of the reference + 1, + 2, .. in the
    order of (g, other), for each g anew. The table falls into blocks without common labels, matched apart: the sum over
    blocks is the best sum. Labels are whole numbers.
    """
    with scope() as keep:
        return keep(_align(other, reference), "aligned")


def matched_labels(other: DataFrame, reference: DataFrame) -> DataFrame:
    """(g, other, ref): the labels of `other` that have a partner in that matching."""
    with scope() as keep:
        return keep(_matched(other, reference), "matched")


def _matched(other: DataFrame, reference: DataFrame) -> DataFrame:
    table = cut(contingency(other, reference), "contingency")
    o = F.concat(F.col("g").cast("string"), F.lit("o"), F.col("other").cast("string"))
    r = F.concat(F.col("g").cast("string"), F.lit("r"), F.col("ref").cast("string"))
    links = table.select(o.alias("src"), r.alias("dst"))
    blocks = connected_components(links.select(F.col("src").alias("node")), links)
    keyed = table.withColumn("node", o).join(blocks, "node").select("g", "other", "ref", "n", F.col("component").alias("block"))
    keyed = cut(keyed, "keyed")
    shape = cut(keyed.groupBy("block").agg(F.least(F.countDistinct("other"), F.countDistinct("ref")).alias("side"), F.count("*").alias("cells")), "shapes")
    # a block with one label on a side keeps its largest overlap, of equal ones the first
    easy = keyed.join(shape.filter("side = 1").select("block"), "block", "left_semi").groupBy("block").agg(F.min_by(F.struct("g", "other", "ref"), F.struct(-F.col("n"), F.col("other"), F.col("ref"))).alias("m")).select("m.*")
    hard = shape.filter("side > 1")
    packs = max(1, -(-(hard.agg(F.sum("cells")).first()[0] or 0) // GROUP))
    solved = keyed.join(hard.select("block"), "block", "left_semi").withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs))).groupBy("pack").applyInPandas(_match_block, "g int, other bigint, ref bigint")
    return easy.unionByName(solved)


def _align(other: DataFrame, reference: DataFrame) -> DataFrame:
    matched = cut(_matched(other, reference), "matched")
    labels = other.select("g", F.col("label").alias("other")).distinct()
    free = number_rows(labels.join(matched, ["g", "other"], "left_anti"), ["g", "other"], "__n")
    first = free.groupBy("g").agg(F.min("__n").alias("__first"))
    top = reference.agg(F.max("label").alias("__top"))
    fresh = free.join(first, "g").join(F.broadcast(top)).select("g", "other", (F.col("__top") + 1 + F.col("__n") - F.col("__first")).alias("label"))
    return matched.select("g", "other", F.col("ref").alias("label")).unionByName(fresh)


def majority_vote(votes: DataFrame, n_methods: int) -> DataFrame:
    """(isolate_id, cluster_id, agreement_score, ambiguous) from (isolate_id, position, label).

    The label with most votes; of equal ones that of the first method. The score is its share of all n_methods, and
    below two thirds the isolate is ambiguous.
    """
    counts = votes.groupBy("isolate_id", "label").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    best = counts.groupBy("isolate_id").agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("first"))).alias("b"))
    score = F.col("b.n") / F.lit(float(n_methods))
    return best.select("isolate_id", F.col("b.label").alias("cluster_id"), score.alias("agreement_score"), (score < 2.0 / 3.0).alias("ambiguous"))


def consensus(assignments: list[DataFrame]) -> DataFrame:
    """The vote over (isolate_id, label) of several methods, all aligned to the first. One method is copied, fully agreed."""
    first = assignments[0]
    votes = first.select("isolate_id", F.lit(0).alias("position"), F.col("label").cast("bigint").alias("label"))
    if len(assignments) > 1:
        others = None
        for g, a in enumerate(assignments[1:], 1):
            x = a.select(F.lit(g).alias("g"), "isolate_id", F.col("label").cast("bigint").alias("label"))
            others = x if others is None else others.unionByName(x)
        others = cut(others, "others")
        mapped = others.withColumnRenamed("label", "other").join(align_labels(others, votes), ["g", "other"])
        votes = votes.unionByName(mapped.select("isolate_id", F.col("g").alias("position"), "label"))
    return majority_vote(votes, len(assignments))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari) of two labellings (isolate_id, label); 1 where both are trivial and equal."""
    t = contingency(a.withColumn("g", F.lit(0)), b)
    two = lambda c: c * (c - 1) / 2
    cells = t.agg(F.sum(two(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    side = lambda c, name: t.groupBy(c).agg(F.sum("n").alias("k")).agg(F.sum(two(F.col("k"))).alias(name))
    one = cells.join(side("other", "x")).join(side("ref", "y"))  # one row each
    expected = F.col("x") * F.col("y") / two(F.col("n"))
    top = (F.col("x") + F.col("y")) / 2 - expected
    return one.select(F.when(top == 0, 1.0).otherwise(F.try_divide(F.col("cells") - expected, top)).alias("ari"))


def assignment_pivot(assignments: DataFrame, methods: list[str]) -> DataFrame:
    """One row an isolate, one column a method, from (isolate_id, method, label)."""
    return assignments.groupBy("isolate_id").pivot("method", methods).agg(F.first("label"))
