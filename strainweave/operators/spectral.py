"""Spectral clustering with the number of clusters read off the eigengap.

The normalised Laplacian falls into blocks, one a component, so its spectrum is the union of theirs. Every component is
one cluster of the zero eigenspace; its own eigengap says into how many it falls, 1 included. A number of clusters given
for the whole goes to the components by the smallest eigenvalues of the union. Candidates k - 1, k and k + 1 are
clustered by k-means on row-normalised eigenvectors, and the best Euclidean silhouette wins.

Components of up to DENSE isolates are solved in groups. Of larger ones the same eigenvectors come from a subspace that
joins of edges and vectors multiply and small sums of products rotate, and k-means is rounds over all points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainweave.operators.components import connected_components
from strainweave.plans.shared import cut, scope, write_counted, write_step

#: Most isolates of a component that a group solves, and pairs of a group on average.
DENSE, GROUP = 1500, 100_000
MAX_K = 12
#: Vectors of a subspace, multiplications between two rotations, and when the eigenvalues before the widest gap count as
#: settled; no other one may still change by more than a twentieth of that gap.
WIDTH, DEGREE, SETTLED = 18, 10, 1e-6
#: Points of a large component whose silhouettes judge a candidate.
JUDGES = 500


def eigengap(values: np.ndarray, max_k: int = MAX_K) -> int:
    """The number of eigenvalues before the widest gap, 1 to max_k; 1 for fewer than three."""
    if len(values) < 3:
        return 1
    return int(np.argmax(np.diff(values[: min(max_k, len(values) - 1) + 1]))) + 1


def laplacian(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """I - D^-1/2 A D^-1/2; a degree of 0 counts as 1."""
    a = np.zeros((n, n))
    a[src, dst] = a[dst, src] = w
    s = 1 / np.sqrt(np.where(a.sum(1) > 0, a.sum(1), 1.0))
    return np.eye(n) - s[:, None] * a * s[None, :]


def k_means(x: np.ndarray, k: int, seed: int, starts: int = 10, steps: int = 50) -> np.ndarray:
    """Labels of the best of several k-means++ starts."""
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            d = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(steps):
            label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[label == c].mean(0) if (label == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        loss = ((x - centre[label]) ** 2).sum()
        if loss < best[0] - 1e-12:
            best = (loss, label)
    return best[1]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean Euclidean silhouette; a label of one point scores 0; needs 2 to n - 1 labels, else -inf."""
    kinds = np.unique(label)
    if not 2 <= len(kinds) <= len(x) - 1:
        return -np.inf
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sums = np.stack([d[:, label == c].sum(1) for c in kinds], 1)
    size = np.array([(label == c).sum() for c in kinds])
    own = np.searchsorted(kinds, label)
    rows = np.arange(len(x))
    inner = sums[rows, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[rows, own] = np.inf
    outer = other.min(1)
    s = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
    return float(s.mean())


def _values(pdf: pd.DataFrame) -> pd.DataFrame:
    """(block, value) of the smallest eigenvalues of each block."""
    out = []
    for block, e in pdf.groupby("block", sort=True):
        names = np.unique(np.concatenate([e["src"].to_numpy(object), e["dst"].to_numpy(object)]).astype(str))
        m = laplacian(len(names), np.searchsorted(names, e["src"].to_numpy(str)), np.searchsorted(names, e["dst"].to_numpy(str)), e["w"].to_numpy())
        out += [(block, float(v)) for v in np.linalg.eigvalsh(m)[: MAX_K + 1]]
    return pd.DataFrame(out, columns=["block", "value"])


def _solve(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    out = []
    for block, e in pdf.groupby("block", sort=True):
        names = np.unique(np.concatenate([e["src"].to_numpy(object), e["dst"].to_numpy(object)]).astype(str))
        src, dst = np.searchsorted(names, e["src"].to_numpy(str)), np.searchsorted(names, e["dst"].to_numpy(str))
        values, vectors = np.linalg.eigh(laplacian(len(names), src, dst, e["w"].to_numpy()))
        k, best = int(e["k"].iloc[0]) or eigengap(values), (-np.inf, np.zeros(len(names), dtype=int))
        for c in sorted({max(2, k - 1), k, min(len(names) - 1, k + 1)}) if k > 1 else ():
            x = vectors[:, :c]
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1.0)
            label = k_means(x, c, seed)
            if (s := silhouette(x, label)) > best[0]:
                best = (s, label)
        first = {c: names[np.argmax(best[1] == c)] for c in np.unique(best[1])}  # names are sorted
        out += [(n, first[c], k, float(values[k] - values[k - 1]) if k < len(values) else 0.0) for n, c in zip(names, best[1])]
    return pd.DataFrame(out, columns=["isolate_id", "cluster", "k", "gap"])


def eigengap_k(values: DataFrame, block: str = "block", value: str = "value", max_k: int = MAX_K) -> DataFrame:
    """(block, k, gap): the number of smallest values before the widest gap, of equal gaps the first; 1 and 0 for fewer than three.

    Only the max_k + 1 smallest values of a block count. Null and NaN values are left out.
    """
    w = Window.partitionBy(block).orderBy(value)
    low = values.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(block, value).withColumn("__at", F.row_number().over(w)).filter(F.col("__at") <= max_k + 1)
    gaps = low.withColumn("__gap", F.lead(value).over(Window.partitionBy(block).orderBy("__at")) - F.col(value))
    d = gaps.groupBy(block).agg(F.count("*").alias("__n"), F.min_by(F.struct(F.col("__at").alias("k"), F.col("__gap").alias("gap")), F.when(F.col("__gap").isNotNull(), F.struct(-F.col("__gap"), F.col("__at")))).alias("__best"))
    some = F.col("__n") >= 3
    return d.select(block, F.when(some, F.col("__best.k")).otherwise(1).alias("k"), F.when(some, F.col("__best.gap")).otherwise(0.0).alias("gap"))


def share_out(values: DataFrame, k: int) -> DataFrame:
    """(block, k): how many of the k smallest values of all blocks are each one's, at least 1."""
    w = Window.partitionBy(F.lit(0)).orderBy("value", "block")
    low = values.orderBy("value", "block").limit(k).withColumn("at", F.row_number().over(w))  # k rows
    return values.select("block").distinct().join(low.groupBy("block").agg(F.count("*").cast("int").alias("k")), "block", "left").select("block", F.coalesce("k", F.lit(1)).alias("k"))


_V = [f"v{j}" for j in range(WIDTH)]


def _times(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(block, node, v0, v1, ...): the normalised affinities (block, src, dst, a) times the vectors."""
    sums = [F.sum(F.col("a") * F.col(c)).alias(c) for c in _V]
    return pairs.join(v.withColumnRenamed("node", "dst"), ["block", "dst"]).groupBy("block", F.col("src").alias("node")).agg(*sums)


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block of one task the sums of products of the vectors v with each other and with u, their images."""
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        for block, rows in pdf.groupby("block"):
            v = rows[_V].to_numpy()
            both = np.stack([v.T @ v, v.T @ rows[[f"u_{c}" for c in _V]].to_numpy()])
            sums[block] = sums[block] + both if block in sums else both
    yield pd.DataFrame({"block": list(sums), "sums": [x.tobytes() for x in sums.values()]}, columns=["block", "sums"])


def _rotation(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rotation that makes a block's vectors orthonormal and diagonal, and the diagonal, descending."""
    g, h = sum(np.frombuffer(x, float).reshape(2, WIDTH, WIDTH) for x in pdf["sums"])
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    extent, u = np.linalg.eigh(g / np.outer(size, size))
    whiten = u / np.sqrt(np.maximum(extent, 1e-14)) / size[:, None]
    m = whiten.T @ h @ whiten
    values, q = np.linalg.eigh((m + m.T) / 2)
    values = values[::-1]
    k = eigengap(1 - values[: MAX_K + 1])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "turn": [(whiten @ q[:, ::-1]).T.ravel()], "values": [values], "k": [k], "gap": [values[k - 1] - values[k]]})


def _vectors(pairs: DataFrame, nodes: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(block, node, v0, v1, ...) the leading vectors of every block, and (block, value) the smallest eigenvalues of its Laplacian.

    Between two rotations the vectors go through a Chebyshev polynomial that holds down what lies below the last of them.
    """
    begin = [F.sqrt("d"), *[(F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) - 0.5) * F.sqrt("d") for j in range(1, WIDTH)]]
    v, was = write_step(nodes.select("block", "node", *[c.alias(n) for n, c in zip(_V, begin)]), "vectors"), None
    for _ in range(max_rounds):
        image = _times(pairs, v.df)
        both = v.df.join(image.select("block", "node", *[F.col(c).alias(f"u_{c}") for c in _V]), ["block", "node"])
        turns = cut(both.mapInPandas(_products, "block string, sums binary").groupBy("block").applyInPandas(_rotation, "block string, turn array<double>, values array<double>, k int, gap double"), "turns")
        # the vectors of a node times the columns of the rotation
        column = lambda j: F.slice("turn", j * WIDTH + 1, F.lit(WIDTH))
        turned = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.aggregate(F.zip_with(F.array(*_V), column(j), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        low = F.get("values", F.lit(WIDTH - 1))
        d = v.df.join(turns, "block").select("block", "node", "values", F.explode(F.array(turned)).alias("turned"))
        new = write_step(d.select("block", "node", *[F.get("turned", F.lit(j)).alias(c) for j, c in enumerate(_V)], ((low - 1) / 2).alias("centre"), F.greatest((low + 1) / 2, F.lit(1e-3)).alias("half")), "turned")
        v.drop()
        if was is not None:
            off = F.slice(F.zip_with("values", "old", lambda a, b: F.abs(a - b)), 1, MAX_K + 1)
            open_ = (F.array_max(F.slice(off, F.lit(1), F.col("k"))) > SETTLED) | (F.array_max(off) > F.col("gap") / 20)
            if not turns.join(was.select("block", F.col("values").alias("old")), "block").filter(open_).limit(1).count():
                values = turns.select("block", F.explode(F.transform(F.slice("values", 1, MAX_K + 1), lambda x: F.lit(1.0) - x)).alias("value"))
                return new.df.select("block", "node", *_V), cut(values, "eigenvalues")
        was, before, now = turns, None, new
        for _ in range(DEGREE):
            image = _times(pairs, now.df.select("block", "node", *_V))
            d = now.df.join(image.select("block", "node", *[F.col(c).alias(f"u_{c}") for c in _V]), ["block", "node"])
            by = 1.0 if before is None else 2.0
            step = {c: F.lit(by) * (F.col(f"u_{c}") - F.col("centre") * F.col(c)) / F.col("half") for c in _V}
            if before is not None:
                d = d.join(before.df.select("block", "node", *[F.col(c).alias(f"b_{c}") for c in _V]), ["block", "node"])
                step = {c: x - F.col(f"b_{c}") for c, x in step.items()}
            after = write_step(d.select("block", "node", *[x.alias(c) for c, x in step.items()], "centre", "half"), "filtered")
            if before is not None:
                before.drop()
            before, now = now, after
        before.drop()
        v = now
    raise RuntimeError("eigenvalues do not settle")


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _k_means_rounds(points: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(block, k, node, x, label) from points (block, k, node, x): k-means of every block for every k, from far-off points.

    The first centre is the smallest node, each next one the point farthest from those before. Centres of a block, at most
    MAX_K + 1, are one small row.
    """
    key = ["block", "k"]
    near = write_step(points.join(points.groupBy(*key).agg(F.min_by("x", "node").alias("c")), key).select(*key, "node", "x", _square(F.col("x"), F.col("c")).alias("far"), F.lit(0).alias("label")), "points")
    for j in range(1, MAX_K + 1):
        c = near.df.filter(F.col("k") > j).groupBy(*key).agg(F.max_by("x", F.struct("far", "node")).alias("c"))
        d = near.df.join(c, key, "left").withColumn("new", _square(F.col("x"), F.col("c")))
        closer = F.coalesce(F.col("new") < F.col("far"), F.lit(False))
        nxt = write_step(d.select(*key, "node", "x", F.when(closer, F.col("new")).otherwise(F.col("far")).alias("far"), F.when(closer, j).otherwise(F.col("label")).alias("label")), "points")
        near.drop()
        near = nxt
    now = near
    for _ in range(max_rounds):
        means = now.df.groupBy(*key, "label").agg(F.array_compact(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(MAX_K + 1)])).alias("c"))
        centres = means.groupBy(*key).agg(F.collect_list(F.struct("label", "c")).alias("centres"))
        best = F.array_min(F.transform("centres", lambda m: F.struct(_square(F.col("x"), m["c"]).alias("far"), m["label"].alias("label"))))
        new, seen = write_counted(now.df.select(*key, "node", "x", F.col("label").alias("old")).join(centres, key).select(*key, "node", "x", best["label"].alias("label"), "old"), "points", moved=F.count_if(F.col("label") != F.col("old")))
        now.drop()
        now = new
        if not seen["moved"]:
            return now.df.drop("old")
    raise RuntimeError("k-means does not settle")


def _judged(labelled: DataFrame) -> DataFrame:
    """(block, k, score): the mean silhouette of JUDGES points of every block, by their hash, among all its points."""
    key = ["block", "k"]
    salts = max(1, -(-labelled.count() // 50_000))
    first = labelled.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("node"), "node"))).filter(F.col("at") <= JUDGES)
    q = first.select(*key, F.col("node").alias("q"), F.col("x").alias("qx"), F.col("label").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    far = labelled.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(q, [*key, "salt"]).filter("node <> q")
    means = far.groupBy(*key, "q", "own", "label").agg(F.avg(F.sqrt(_square(F.col("x"), F.col("qx")))).alias("d"))
    own = F.col("label") == F.col("own")
    s = means.groupBy(*key, "q").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    one = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.filter("b is not null").groupBy(*key).agg(F.avg(one).alias("score"))


def _normalised(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (block, src, dst, a) both ways, a the normalised affinity, and nodes (block, node, d) with their degree."""
    both = cut(e.select("block", "src", "dst", "w").unionByName(e.select("block", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "affinities")
    nodes = cut(both.groupBy("block", F.col("src").alias("node")).agg(F.sum("w").alias("d")), "degrees")
    at = lambda end: nodes.select("block", F.col("node").alias(end), F.col("d").alias(f"{end}_d"))
    return cut(both.join(at("src"), ["block", "src"]).join(at("dst"), ["block", "dst"]).select("block", "src", "dst", (F.col("w") / F.sqrt(F.col("src_d") * F.col("dst_d"))).alias("a")), "normalised"), nodes


def _solve_rounds(vectors: DataFrame, ks: DataFrame) -> DataFrame:
    """(isolate_id, cluster, k, gap) of blocks of any size from their vectors and (block, k, gap)."""
    d = vectors.join(ks, "block")
    wanted = F.array_distinct(F.array(F.greatest(F.col("k") - 1, F.lit(2)), F.col("k"), F.least(F.col("k") + 1, F.lit(MAX_K + 1))))
    x = F.slice(F.array(*_V[: MAX_K + 1]), F.lit(1), F.col("c"))
    norm = F.sqrt(_square(x, F.transform(x, lambda _: F.lit(0.0))))
    points = cut(d.filter("k > 1").withColumn("c", F.explode(wanted)).select("block", F.col("c").alias("k"), "node", F.transform(x, lambda v: v / F.when(norm > 0, norm).otherwise(1.0)).alias("x")), "embedded")
    whole = d.filter("k = 1").select("node", F.lit(0).alias("label"), "block", "k", "gap")
    if not points.limit(1).count():
        labelled = whole
    else:
        tried = _k_means_rounds(points)
        best = _judged(tried).groupBy("block").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("best"))
        labelled = tried.select("block", F.col("k").alias("best"), "node", "label").join(best, ["block", "best"]).join(ks, "block").select("node", "label", "block", "k", "gap").unionByName(whole)
    first = labelled.groupBy("block", "label").agg(F.min("node").alias("cluster"))
    return labelled.join(first, ["block", "label"]).select(F.col("node").alias("isolate_id"), "cluster", "k", "gap")


def spectral(iso: DataFrame, edges: DataFrame, seed: int = 42, dense: int = DENSE, k: int | None = None) -> DataFrame:
    """(isolate_id, cluster, k, gap): the cluster is named by its smallest isolate; k and gap are those of its component.

    Isolates without edges are clusters of their own (k 1, gap 0). k: clusters of the whole, shared out to the components
    that have edges; each has at least one, and at most MAX_K eigenvalues of one component count. dense says how a component is solved.
    """
    with scope() as keep:
        return keep(_spectral(iso, edges, seed, dense, k), "spectral")


def _spectral(iso: DataFrame, edges: DataFrame, seed: int, dense: int, k: int | None) -> DataFrame:
    e = cut(edges.select("src", "dst", F.exp(-F.col("composite_weight")).alias("w")), "spectral-edges")
    comp = connected_components(e.select(F.col("src").alias("node")), e)
    e = cut(e.join(comp.select(F.col("node").alias("src"), F.col("component").alias("block")), "src"), "spectral-edges")
    large = cut(comp.groupBy(F.col("component").alias("block")).agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("block"), "large")
    some = large.limit(1).count() > 0
    small, vectors, ks = e, None, None
    if some:
        small = e.join(large, "block", "left_anti")
        vectors, values = _vectors(*_normalised(e.join(large, "block", "left_semi")))
    packs = max(1, -(-small.count() // GROUP))
    packed = small.withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs)))
    if k is not None:
        low = packed.groupBy("pack").applyInPandas(_values, "block string, value double")
        ks = cut(share_out(cut(low.unionByName(values) if some else low, "values"), k), "shared-out")
        packed = packed.join(ks, "block")
    else:
        packed = packed.withColumn("k", F.lit(0))
    found = packed.groupBy("pack").applyInPandas(lambda pdf: _solve(pdf, seed), "isolate_id string, cluster string, k int, gap double")
    if some:
        gaps = eigengap_k(values) if ks is None else ks.join(large, "block", "left_semi").withColumn("gap", F.lit(0.0))
        found = found.unionByName(_solve_rounds(vectors, cut(gaps, "gaps")))
    return iso.select("isolate_id").join(found, "isolate_id", "left").select("isolate_id", F.coalesce("cluster", "isolate_id").alias("cluster"), F.coalesce("k", F.lit(1)).alias("k"), F.coalesce("gap", F.lit(0.0)).alias("gap"))


def silhouette_of(queries: DataFrame, points: DataFrame, node: str, label: str, vector: str, block: int = 1024) -> DataFrame:
    """(node, label, silhouette) of a stated set of points against all points, Euclidean, in blocks.

    The mean distance to every label is aggregated per query before anything is compared. A query that is its label's
    only point scores 0; with a single label overall the silhouette is null.
    """
    n = max(1, -(-queries.count() // block))
    q = queries.select(F.pmod(F.xxhash64(node), F.lit(n)).alias("__b"), F.col(node).alias("__q"), F.col(label).alias("__own"), F.col(vector).alias("__v"))
    r = points.select(F.col(node).alias("__p"), F.col(label).alias("__l"), F.col(vector).alias("__w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("__b"))
    square = F.aggregate(F.zip_with("__v", "__w", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    means = r.join(q, "__b").filter(F.col("__p") != F.col("__q")).groupBy("__q", "__own", "__l").agg(F.avg(F.sqrt(square)).alias("d"))
    own = F.col("__l") == F.col("__own")
    s = means.groupBy("__q", "__own").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    score = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.select(F.col("__q").alias(node), F.col("__own").alias(label), score.alias("silhouette"))
