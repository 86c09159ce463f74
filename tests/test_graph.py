import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainweave.operators import bootstrap, centrality, chains, community, components, consensus, dag, forest, graph, hamming, ingest, plane, spectral, summary

ISO = "isolate_id string, collection_date date, facility string, ward string, sequence_type string"


def random_graph(n=40, p=0.06, seed=1):
    rng = random.Random(seed)
    iso = [(f"I{i:02d}", date(2020, 1, 1) + timedelta(rng.randrange(25)), "f", rng.choice("xyz"), rng.choice(["1", "2", "", None])) for i in range(n)]
    dist = [(iso[i][0], iso[j][0], float(rng.randrange(0, 25)) + rng.choice([0, 0.5])) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    return iso, dist


def by_hand(iso, dist, cs=20, cd=14):
    at = {r[0]: r for r in iso}
    out = []
    for s, t, d in dist:
        days = abs((at[s][1] - at[t][1]).days)
        if d <= cs and days <= cd:
            mm = bool(at[s][4] and at[t][4] and at[s][4] != at[t][4])
            out.append((s, t, round(d), days, mm, 0.4 * (d / cs) + 0.4 * (days / cd) + 0.2 * (1.0 if mm else 0.0)))
    return out


def tables(spark, seed=1, **kw):
    iso, dist = random_graph(seed=seed, **kw)
    i, d = spark.createDataFrame(iso, ISO), spark.createDataFrame(dist, "src string, dst string, d double")
    return iso, by_hand(iso, dist), i, graph.edges(d, i).persist(), d


def parts(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_edges_and_summary(spark):
    iso, edges, i, e, _ = tables(spark)
    assert sorted(map(tuple, e.collect())) == sorted(edges)
    want = parts([r[0] for r in iso], [x[:2] for x in edges])
    comp = components.connected_components(i.select(F.col("isolate_id").alias("node")), e)
    assert {r.node: r.component for r in comp.collect()} == want
    s = graph.graph_summary(e, i, comp).first()
    assert (s.n_vertices, s.n_edges, s.n_components) == (len(iso), len(edges), len(set(want.values())))
    none = graph.graph_summary(e.limit(0), i.limit(0), comp.limit(0)).first()
    assert none.n_edges == 0 and none.density == 0 and none.mean_degree == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_as_the_greedy_walk(spark, seed):
    iso, edges, i, e, _ = tables(spark, seed)
    near, clusters, of = {}, [], {}
    for s, t, *_ in edges:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    for r in sorted(iso, key=lambda r: (r[1], r[0])):
        hit = next((k for k, m in enumerate(clusters) if m & near.get(r[0], set())), None)
        if hit is None:
            clusters.append(set())
            hit = len(clusters) - 1
        clusters[hit].add(r[0])
        of[r[0]] = hit
    assert {r.isolate_id: r.cluster_id for r in chains.chain_clusters(i, e).collect()} == of


def test_temporal_graph(spark):
    iso, edges, i, e, _ = tables(spark)
    day = {r[0]: r[1] for r in iso}
    both = dag.orient(e, i).collect()
    assert len(both) == sum(2 if abs((day[a] - day[b]).days) <= 2 else 1 for a, b, *_ in edges)
    arcs = dag.temporal_dag(e, i).persist()
    rows = [(r.src, r.dst) for r in arcs.collect()]
    assert len(rows) == len(edges) and all((day[a], a) < (day[b], b) for a, b in rows)
    level = {r[0]: 0 for r in iso}
    for a, b in sorted(rows, key=lambda r: (day[r[0]], r[0])):
        level[b] = max(level[b], level[a] + 1)
    assert {r.isolate_id: r.chain_length for r in dag.longest_paths(arcs, i).collect()} == level
    with pytest.raises(RuntimeError):
        dag.longest_paths(spark.createDataFrame([("I00", "I01"), ("I01", "I00")], "src string, dst string"), i, max_rounds=6)


def brute_betweenness(ids, arcs, directed):
    out = {i: {} for i in ids}
    for a, b, w in arcs:
        out[a][b] = max(w, 1e-6)
        if not directed:
            out[b][a] = max(w, 1e-6)

    def simple_paths(v, t, seen, d):
        if v == t:
            yield d, seen
            return
        for w, x in out[v].items():
            if w not in seen:
                yield from simple_paths(w, t, [*seen, w], d + x)

    got = dict.fromkeys(ids, 0.0)
    for s in ids:
        for t in ids:
            if s == t:
                continue
            found = list(simple_paths(s, t, [s], 0.0))
            if found:
                low = min(d for d, _ in found)
                best = [p for d, p in found if d <= low + 1e-9]
                for p in best:
                    for v in p[1:-1]:
                        got[v] += 1 / len(best)
    return got if directed else {k: v / 2 for k, v in got.items()}


@pytest.mark.parametrize(("directed", "block", "whole"), [(True, 3, 10**6), (False, 3, 10**6), (True, 500, 10**6), (True, 500, 0)])
def test_betweenness_as_all_simple_paths(spark, directed, block, whole):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(9)]
    arcs = [(a, b, rng.choice([0.0, 1.0, 1.0, 2.0])) for i, a in enumerate(ids[:8]) for b in ids[i + 1 : 8] if rng.random() < 0.45]
    df, nodes = spark.createDataFrame(arcs, "src string, dst string, w double"), spark.createDataFrame([(i,) for i in ids], "node string")
    rows = centrality.path_centrality(df, nodes, directed, block, whole, 40).collect()
    got = {r.node: r.betweenness for r in rows}
    want = brute_betweenness(ids, arcs, directed)
    apart = {a: {b: 0.0 if a == b else math.inf for b in ids} for a in ids}
    for a, b, w in arcs:
        apart[a][b] = apart[b][a] = max(w, 1e-6)
    for m in ids:
        for a in ids:
            for b in ids:
                apart[a][b] = min(apart[a][b], apart[a][m] + apart[m][b])
    for r in rows:
        near = [d for b, d in apart[r.node].items() if b != r.node and d < math.inf]
        assert abs(r.closeness - (len(near) / sum(near) if near else 0.0)) < 1e-6
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in ids)


def test_risk_and_index_case(spark):
    rows = [("A", 1, 0.0, 0, float("nan")), ("B", 1, 4.0, 2, 1.0), ("C", 1, 2.0, 4, 0.5), ("D", 2, 9.0, 1, 1.0), ("E", None, 1.0, 1, 1.0)]
    s = centrality.risk(spark.createDataFrame(rows, "isolate_id string, cluster_id int, betweenness double, out_degree int, closeness double"))
    risk = {r.isolate_id: r.transmission_risk_score for r in s.collect()}
    assert risk["A"] == 0 and abs(risk["B"] - 0.85) < 1e-12 and abs(risk["C"] - 0.65) < 1e-12 and risk["D"] == 0
    days = spark.createDataFrame([("A", date(2020, 1, 1)), ("B", date(2020, 1, 9)), ("C", date(2020, 1, 1)), ("D", date(2020, 2, 1))], "isolate_id string, collection_date date")
    c = {r.cluster_id: r for r in centrality.index_cases(s, days).collect()}
    assert (c[1].index_case_candidate, c[1].candidate_date_rank, c[1].temporal_mismatch) == ("B", 3, True)
    assert (c[2].candidate_date_rank, c[2].temporal_mismatch) == (1, False)


def test_forest_as_kruskal(spark):
    _, edges, _, e, _ = tables(spark, p=0.15)
    up, want = {}, set()

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, t, *_, w in sorted(edges, key=lambda x: (x[5], x[0], x[1])):
        if top(s) != top(t):
            up[top(s)] = top(t)
            want.add((s, t))
    assert {(r.src, r.dst) for r in forest.spanning_forest(e).collect()} == want


def planted(spark, k=3, size=8):
    ids = [(c, f"c{c}n{i}") for c in range(k) for i in range(size)]
    rng = random.Random(5)
    e = [(a, b, 0.1 if x == y else 2.5) for i, (x, a) in enumerate(ids) for y, b in ids[i + 1 :] if x == y or rng.random() < 0.04]
    iso = [(n, date(2020, 1, 1), "f", "w", None) for _, n in ids] + [("alone", date(2020, 1, 1), "f", "w", None)]
    return dict((n, c) for c, n in ids), spark.createDataFrame(iso, ISO), spark.createDataFrame(e, "src string, dst string, composite_weight double")


def test_communities_find_what_was_planted(spark):
    truth, iso, e = planted(spark)
    for resolution in (1.0, "auto"):
        got = {r.isolate_id: r.community for r in community.leiden(iso, e, resolution).collect()}
        assert got.pop("alone") == "alone"
        assert len(set(got.values())) == 3 and len({(got[n], truth[n]) for n in truth}) == 3
    again = {r.isolate_id: r.community for r in community.leiden(iso.repartition(7), e.repartition(5), 1.0).collect()}
    assert len(set(again.values())) == 4 and all(again[n] == again[f"c{c}n0"] for n, c in truth.items())
    assert {r.community for r in community.leiden(iso, e.limit(0), "auto").collect()} == {r.isolate_id for r in iso.collect()}


def test_communities_are_moved_until_none_wants_to(spark):
    n, gamma = 300, 0.02
    ids = [f"p{i:03d}" for i in range(n)]
    iso = spark.createDataFrame([(i, date(2020, 1, 1), "f", "w", None) for i in ids], ISO)
    e = spark.createDataFrame([(a, b, 0.5) for a, b in zip(ids, ids[1:])], "src string, dst string, composite_weight double")
    got = {r.isolate_id: r.community for r in community.leiden(iso, e, gamma).collect()}
    runs = [[i] for i in ids[:1]]
    for a, b in zip(ids, ids[1:]):
        runs[-1].append(b) if got[a] == got[b] else runs.append([b])
    assert len(runs) == len(set(got.values())) and all(got[i] == r[0] for r in runs for i in r)  # connected, named by the smallest
    mass = [2 * len(r) - (r[0] == ids[0]) - (r[-1] == ids[-1]) for r in runs]
    assert all(1 - gamma * x * y / (2 * (n - 1)) <= 1e-9 for x, y in zip(mass, mass[1:]))  # no two neighbours should be one


def test_communities_by_rounds_and_by_arrays(spark):
    rng = random.Random(11)
    rows = []
    for g in (0, 1):
        for i in range(18):
            for j in range(i):
                if rng.random() < (0.5 if i % 3 == j % 3 and i % 2 == j % 2 else 0.06):
                    rows.append((g, f"n{j:02d}", f"n{i:02d}", rng.choice([0.4, 0.7, 1.0])))
    e = spark.createDataFrame(rows, "g int, src string, dst string, w double")
    nodes = spark.createDataFrame([(g, f"n{i:02d}") for g in (0, 1) for i in range(18)] + [(0, "x"), (0, "x")], "g int, node string")
    graphs = spark.createDataFrame([(0, 1.0), (1, 1.5)], "g int, gamma double")
    arrays = sorted(map(tuple, community.communities(nodes, e, graphs).collect()))
    assert arrays == sorted(map(tuple, community.communities(nodes, e, graphs, unit=0).collect()))
    assert len(arrays) == 37 and (0, "x", "x") in arrays and len({r[2] for r in arrays}) < 19


def greedy_modularity(n, pairs):
    """Modularity of a sequential greedy run: moves in random order until none gains, then merging, again and again."""
    rng, two_m = random.Random(1), 2 * sum(w for *_, w in pairs)
    near = [{} for _ in range(n)]
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    within = 0.0
    mass = [sum(x.values()) for x in near]
    while True:
        c, held = list(range(len(near))), list(mass)
        going = any_moved = True
        while going:
            going, order = False, list(range(len(near)))
            rng.shuffle(order)
            for i in order:
                to = {c[i]: 0.0}
                for j, w in near[i].items():
                    to[c[j]] = to.get(c[j], 0.0) + w
                held[c[i]] -= mass[i]
                best = max(to, key=lambda x: (to[x] - mass[i] * held[x] / two_m, x == c[i]))
                going |= best != c[i]
                c[i] = best
                held[best] += mass[i]
        names = sorted(set(c))
        if len(names) == len(near):
            return within / two_m - sum(m * m for m in mass) / two_m**2
        at, merged, total = {x: k for k, x in enumerate(names)}, [{} for _ in names], [0.0] * len(names)
        for i, x in enumerate(near):
            total[at[c[i]]] += mass[i]
            for j, w in x.items():
                if c[i] == c[j]:
                    within += w
                else:
                    merged[at[c[i]]][at[c[j]]] = merged[at[c[i]]].get(at[c[j]], 0.0) + w
        near, mass = merged, total


@pytest.mark.parametrize(("n", "k", "inner", "outer"), [(1600, 20, 0.15, 0.006), (1000, 5, 0.03, 0.01)])
def test_communities_are_as_good_as_a_sequential_run(spark, n, k, inner, outer):
    rng = np.random.default_rng(n)
    truth = rng.integers(0, k, n)
    a, b = np.triu_indices(n, 1)
    there = rng.random(len(a)) < np.where(truth[a] == truth[b], inner, outer)
    pairs = [(int(x), int(y), round(math.exp(-z), 6)) for x, y, z in zip(a[there], b[there], rng.uniform(0.1, 0.9, there.sum()))]
    e = spark.createDataFrame([(0, f"n{x:04d}", f"n{y:04d}", w) for x, y, w in pairs], "g int, src string, dst string, w double")
    nodes = spark.createDataFrame([(0, f"n{i:04d}") for i in range(n)], "g int, node string")
    found = community.communities(nodes, e, spark.createDataFrame([(0, 1.0)], "g int, gamma double"))
    got = community.modularity(e, found).first().modularity
    planted = community.modularity(e, nodes.join(spark.createDataFrame([(f"n{i:04d}", int(c)) for i, c in enumerate(truth)], "node string, community int"), "node")).first().modularity
    assert got >= greedy_modularity(n, pairs) - 1e-6 and got >= planted - 0.01


def test_spectral_blocks(spark):
    truth, iso, e = planted(spark)
    dense = {r.isolate_id: (r.cluster, r.k) for r in spectral.spectral(iso, e).collect()}
    assert dense["alone"] == ("alone", 1) and len({(dense[n][0], truth[n]) for n in truth}) == 3
    assert {r.isolate_id: (r.cluster, r.k) for r in spectral.spectral(iso, e, dense=4).collect()} == dense
    inside = e.filter("composite_weight < 1")
    apart = {r.isolate_id: r.cluster for r in spectral.spectral(iso, inside, k=3).collect()}
    assert len({(apart[n], truth[n]) for n in truth}) == 3
    assert len({r.cluster for r in spectral.spectral(iso, e, k=5).collect()}) in (4, 5, 6, 7)


def test_eigengap_rule(spark):
    rng = np.random.default_rng(2)
    values = {f"b{n}": np.sort(rng.choice([0.0, 0.1, 0.5, 0.9, 1.0, 1.4], n)) for n in range(1, 20)}
    rows = [(b, float(x)) for b, v in values.items() for x in v] + [("b4", None), ("b5", float("nan"))]
    got = {r.block: (r.k, r.gap) for r in spectral.eigengap_k(spark.createDataFrame(rows, "block string, value double")).collect()}
    assert {b: k for b, (k, _) in got.items()} == {b: spectral.eigengap(v) for b, v in values.items()}
    assert all(abs(g - (values[b][k] - values[b][k - 1])) < 1e-12 for b, (k, g) in got.items() if len(values[b]) > 2)


def test_spectral_of_a_component_of_two_thousand(spark):
    rng = np.random.default_rng(7)
    truth = rng.integers(0, 5, 2000)
    a, b = np.triu_indices(2000, 1)
    there = rng.random(len(a)) < np.where(truth[a] == truth[b], 0.06, 0.001)
    pairs = [(f"n{x:04d}", f"n{y:04d}", 0.3) for x, y in zip(a[there], b[there])]
    e = spark.createDataFrame(pairs, "src string, dst string, composite_weight double")
    iso = spark.createDataFrame([(f"n{i:04d}",) for i in range(2000)], "isolate_id string")
    got = {r.isolate_id: r for r in spectral.spectral(iso, e).collect()}
    assert {r.k for r in got.values()} == {5} and len({r.cluster for r in got.values()}) == 5
    assert sum(len({truth[int(n[1:])] for n in got if got[n].cluster == c}) for c in {r.cluster for r in got.values()}) == 5


def test_matching_and_consensus(spark):
    rng = np.random.default_rng(1)
    from itertools import permutations

    for shape in ((3, 3), (2, 4), (4, 5)):
        for _ in range(20):
            m = rng.integers(0, 6, shape)
            pick = consensus.best_matching(m)
            assert len(set(pick)) == shape[0] and sum(m[i, c] for i, c in enumerate(pick)) == max(sum(m[i, c] for i, c in enumerate(p)) for p in permutations(range(shape[1]), shape[0]))
    label = lambda d: spark.createDataFrame(list(d.items()), "isolate_id string, label long")
    c = {r.isolate_id: (r.cluster_id, r.agreement_score, r.ambiguous) for r in consensus.consensus([label({"p": 0, "q": 0, "r": 1, "s": 1}), label({"p": 7, "q": 7, "r": 2, "s": 2})]).collect()}
    assert c == {"p": (0, 1.0, False), "q": (0, 1.0, False), "r": (1, 1.0, False), "s": (1, 1.0, False)}
    a = {r.other: r.label for r in consensus.align_labels(label({"k": 7, "l": 8, "m": 9}).withColumn("g", F.lit(1)), label({"k": 3, "l": 3})).collect()}
    assert a in ({7: 3, 8: 4, 9: 5}, {8: 3, 7: 4, 9: 5})
    assert abs(consensus.adjusted_rand(label({"k": 1, "l": 1, "m": 2, "n": 3}), label({"k": 8, "l": 8, "m": 4, "n": 6})).first().ari - 1) < 1e-12


def test_labels_of_one_block_are_matched_for_the_largest_sum(spark):
    from itertools import permutations

    rng = random.Random(6)
    rows = [(g, f"i{k:02d}", rng.randrange(4) + 10 * g, rng.randrange(4)) for g in (1, 2) for k in range(30)]
    rows = [(g, i, o, next(r for h, j, _, r in rows if j == i)) for g, i, o, _ in rows]  # one reference label an isolate
    other = spark.createDataFrame([(g, i, o) for g, i, o, _ in rows], "g int, isolate_id string, label long")
    reference = spark.createDataFrame(sorted({(i, r) for _, i, _, r in rows}), "isolate_id string, label long")
    got = {(r.g, r.other): r.label for r in consensus.align_labels(other, reference).collect()}
    for g in (1, 2):
        names = sorted({o for h, _, o, _ in rows if h == g})
        kept = lambda to: sum(1 for h, _, o, r in rows if h == g and to[o] == r)  # noqa: E731, B023
        assert kept({o: got[g, o] for o in names}) == max(kept(dict(zip(names, p))) for p in permutations(range(4), len(names)))
        assert len({got[g, o] for o in names}) == len(names)


def test_stability(spark):
    truth, iso, _ = planted(spark, k=2, size=5)
    d = spark.createDataFrame([(a, b, 3.0 if truth[a] == truth[b] else 90.0) for a in truth for b in truth if a < b], "src string, dst string, d double")
    gold = iso.select("isolate_id", F.when(F.col("isolate_id") == "alone", 2).otherwise(F.substring("isolate_id", 2, 1).cast("int")).alias("cluster_id"))
    got = bootstrap.bootstrap_stability(d, iso, gold, n_boot=4)
    assert {r.stability_score for r in got.collect()} == {1.0}
    assert [tuple(r)[1:] for r in bootstrap.stability_summary(got).orderBy("cluster_id").collect()] == [(5, 1.0, 5, 0, 0, "A"), (5, 1.0, 5, 0, 0, "A"), (1, 1.0, 1, 0, 0, "A")]
    assert {r.classification for r in bootstrap.bootstrap_stability(d, iso, gold, n_boot=0).collect()} == {"stable"}
    n = spark.range(2000).select(bootstrap.noise(F.lit(1), F.col("id").cast("string"), F.lit("x")).alias("n"), bootstrap.noise(F.lit(1), F.lit("x"), F.col("id").cast("string")).alias("m")).collect()
    assert all(r.n == r.m and abs(r.n) < 2 for r in n) and abs(sum(r.n for r in n) / 2000) < 0.1


def stability_of_every_replicate(dist, iso, gold, n_boot, resolution=1.0):
    """The scores from all replicates, each clustered and aligned as a whole."""
    e = bootstrap.perturbed_edges(bootstrap.candidate_pairs(dist, iso, 20, 14), n_boot).select("g", "src", "dst", F.exp(-F.col("composite_weight")).alias("w"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("g")
    graphs = iso.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("g"), F.lit(resolution).alias("gamma"))
    found = community.communities(iso.select(each, F.col("isolate_id").alias("node")), e, graphs).toPandas()
    found["label"] = found["community"].rank(method="dense").astype(int)
    other = iso.sparkSession.createDataFrame(found.rename(columns={"node": "isolate_id"})[["g", "isolate_id", "label"]], "g int, isolate_id string, label long")
    to = {(r.g, r.other): r.label for r in consensus.align_labels(other, gold.select("isolate_id", F.col("cluster_id").cast("bigint").alias("label"))).collect()}
    truth = {r.isolate_id: r.cluster_id for r in gold.collect()}
    hits = dict.fromkeys(truth, 0)
    for g, i, label in found[["g", "node", "label"]].itertuples(index=False):
        if i in truth:
            hits[i] += to[g, label] == truth[i]
    return {i: n / n_boot for i, n in hits.items()}


def loose_outbreak(spark, sizes, seed):
    """Distances, isolates and clusters: groups of the given sizes with close, uncertain and missing pairs; some clusters span or part groups."""
    rng, names, pairs, gold = random.Random(seed), [], [], []
    for k, n in enumerate(sizes):
        own = [f"g{k:03d}_{i:02d}" for i in range(n)]
        names += own
        pairs += [(a, b, rng.uniform(1, 17) if rng.random() < 0.5 else rng.uniform(18, 22)) for a in own for b in own if a < b and rng.random() < 0.7]
        gold += [(i, 1000 if rng.random() < 0.02 else 2 * k + (rng.random() < 0.2)) for i in own]
    days = [(i, date(2024, 1, 1) + timedelta(rng.randrange(15)), f"ST{rng.randrange(3)}") for i in names]
    gold = [*gold[1:], ("unknown", 3)]  # an isolate without cluster, and a cluster's member without metadata
    return spark.createDataFrame(pairs, "src string, dst string, d double"), spark.createDataFrame(days, "isolate_id string, collection_date date, sequence_type string"), spark.createDataFrame(gold, "isolate_id string, cluster_id int")


def test_stability_counts_every_replicate(spark, monkeypatch):
    tables = loose_outbreak(spark, [1, 2, 2, 3, 3, 4, 5, 6, 14], 3)
    want = stability_of_every_replicate(*tables, 12)
    got = lambda: {r.isolate_id: r.stability_score for r in bootstrap.bootstrap_stability(*tables, n_boot=12).collect()}
    assert got() == want and len(set(want.values())) > 3 and want["unknown"] == 0
    monkeypatch.setattr(bootstrap, "FEW", 0)  # every replicate of a unit with cross pairs apart
    assert got() == want


def test_stability_searches_no_communities_in_small_components(spark, monkeypatch):
    tables = loose_outbreak(spark, [2, 3, 4, 5] * 30, 4)
    want = stability_of_every_replicate(*tables, 6)
    monkeypatch.setattr(bootstrap, "communities", None)
    assert {r.isolate_id: r.stability_score for r in bootstrap.bootstrap_stability(*tables, n_boot=6).collect()} == want
    assert len(set(want.values())) > 3


def test_sequences(spark):
    seqs = spark.createDataFrame([("A", "GATTACAGATTA"), ("B", "gattccagatta"), ("C", "CATTACAGATTA"), ("D", "NNNNACAGATT-"), ("E", "CCCCCCCCCCCC")], "isolate_id string, seq string")
    got = {(r.src, r.dst): r.d for r in hamming.close_sequences(seqs, 2).collect()}
    assert got == {("A", "B"): 1, ("A", "C"): 1, ("A", "D"): 0, ("B", "C"): 2, ("B", "D"): 1, ("C", "D"): 0}
    rng = random.Random(8)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(3)]
    texts = {}
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(60)] = rng.choice("ACGT")
        at = rng.randrange(50)
        for k in range(at, min(60, at + rng.choice([0, 0, 3, 9, 40]))):
            t[k] = rng.choice("N-")
        texts[f"s{i:02d}"] = "".join(t)
    apart = lambda x, y: sum(a != b and a not in "N-" and b not in "N-" for a, b in zip(x, y))
    want = {(a, b): apart(x, y) for a, x in texts.items() for b, y in texts.items() if a < b and apart(x, y) <= 3}
    got = {(r.src, r.dst): r.d for r in hamming.close_sequences(spark.createDataFrame(list(texts.items()), "isolate_id string, seq string"), 3).collect()}
    assert got == want
    with pytest.raises(ValueError):
        hamming.check_sequences(spark.createDataFrame([("A", "AC"), ("B", "A")], "isolate_id string, seq string"))
    words = [(i, random.Random(i).getrandbits(64) - 2**63) for i in range(60)] + [(100, -1), (101, -2), (102, 0), (103, -(2**63))]
    df = spark.createDataFrame(words, "n long, word long")
    for most in (0, 3, 5, 15, 20, 63):
        want = {(a, b): bin((x ^ y) & (2**64 - 1)).count("1") for a, x in words for b, y in words if a < b}
        assert {(r.src, r.dst): r.distance for r in hamming.close_words(df, "n", most).collect()} == {k: d for k, d in want.items() if d <= most}
    assert [sum(math.comb(h - low, i) for low, h, r in hamming.probe_plan(15) for i in range(r + 1))] == [2788] and hamming.probe_plan(0) == [(0, 64, 0)]
    copies = spark.createDataFrame([*words, (200, words[0][1]), (201, words[0][1])], "n long, word long")
    both = [*words, (200, words[0][1]), (201, words[0][1])]
    want = sorted((a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for a, x in both for b, y in both if a < b)
    assert sorted(map(tuple, hamming.close_rows(copies, "n", 26).collect())) == [w for w in want if w[2] <= 26]


def test_copies_are_members_not_pairs(spark):
    words = [(9, 5), (1, 5), (4, 5), (4, 5), (2, 7), (3, -1), (None, 5), (8, None), (6, 7)]
    df = spark.createDataFrame([(*w, "b", 0) for w in words], "n long, word long, band string, distance int")
    got = sorted(tuple(r) for r in hamming.close_classes(df, "n", 3).collect())
    assert got == [(1, 2, 1), (1, 4, 0), (1, 9, 0), (2, 6, 0)]
    assert hamming.close_classes(df.limit(0), "n", 3).count() == 0


def test_places_as_classical_scaling(spark):
    rng = random.Random(12)
    words = [(i, rng.getrandbits(64) - 2**63) for i in range(20)]
    df = spark.createDataFrame([*words, (100, words[3][1]), (None, words[4][1]), (101, None)], "n long, word long").withColumn("x", F.lit("clash"))
    at = {r.n: (r.x, r.y) for r in plane.place_words(df, "n").collect() if r.n is not None}
    assert set(at) == {*range(20), 100} and at[100] == at[3]
    d = np.array([[bin((a ^ b) & (2**64 - 1)).count("1") for _, b in words] for _, a in words], dtype=float)
    centre = np.eye(20) - 1 / 20
    values, vectors = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    want = vectors[:, -2:] * np.sqrt(values[-2:])
    between = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
    assert np.allclose(between(np.array([at[i] for i in range(20)])), between(want), atol=1e-6)
    assert len(plane.place_words(df, "n", landmarks=8).collect()) == 22
    assert {(r.x, r.y) for r in plane.place_words(df.filter("n < 2"), "n").collect()} == {(0.0, 0.0)}
    assert plane.place_words(df.limit(0), "n").count() == 0


def test_all_patterns_are_scaled(spark):
    rng = random.Random(4)
    flip = lambda w, p: sum(1 << b for b in range(64) if ((w >> b) & 1) ^ (rng.random() < p))
    centres = [rng.getrandbits(64) for _ in range(2)]
    words = sorted({flip(centres[i % 2], 0.15) for i in range(300)} | {flip(0xF0F0, 0.02) for _ in range(4)})
    df = spark.createDataFrame([(i, w - 2**63) for i, w in enumerate(words)], "n long, word long")
    at = {r.n: (r.x, r.y) for r in plane.place_words(df, "n").collect()}
    d = np.array([[(a ^ b).bit_count() for b in words] for a in words], dtype=float)
    centre = np.eye(len(words)) - 1 / len(words)
    values, vectors = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    want = vectors[:, -2:] * np.sqrt(values[-2:])
    between = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
    assert np.allclose(between(np.array([at[i] for i in range(len(words))])), between(want), atol=1e-6)


def test_ingest_edges(spark):
    snp = spark.createDataFrame([(1, " A", "B", 3.0), (2, "B", "A\t", 4.0), (3, "A", "A", 1.0), (4, None, "A", 1.0), (5, "A", "C", None), (6, "", "C", -1.0)], "row_id long, isolate_id string, dst string, d double")
    assert [tuple(r) for r in ingest.distances(snp).collect()] == [("A", "B", 3.5)]
    v = ingest.matrix_violations(snp).first()
    assert (v.n_cells, v.n_null, v.n_negative, v.n_diagonal, v.n_asymmetric, v.worst) == (6, 1, 1, 1, 1, 1.0)
    epi = spark.createDataFrame([(1, "A", "2020-1-2", " ", None), (3, "A ", "3/1/2020", "F", "W"), (2, "A", "2021-01-01", "G", "X"), (4, "A", "never", "G", "X"), (5, None, "2020-1-1", "", "")], "row_id long, isolate_id string, collection_date string, facility string, ward string")
    mlst = spark.createDataFrame([(1, "A", "ST 12"), (2, "A", "st")], "row_id long, isolate_id string, st string")
    assert [tuple(r) for r in ingest.isolates(epi, mlst).collect()] == [("A", date(2020, 1, 3), "F", "W", "novel")]
    s = ingest.ingest_summary(ingest.isolates(epi.limit(0), mlst)).first()
    assert (s.n_isolates, s.first_day, s.span_warning) == (0, None, False)
    assert summary.kpis(spark.createDataFrame([], "isolate_id string, cluster_id int")).first().n_isolates == 0
