"""Queries on clusters, centrality, stability, trees, distances, figures and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id
from strainweave.functions.labels import or_unknown, sequence_type
from strainweave.operators import bootstrap, centrality, chains, community, components, consensus, dag, forest, hamming, plane, spectral, summary
from strainweave.plans import sql_parts as q
from strainweave.plans import views
from strainweave.plans.registry import query
from strainweave.plans.shared import cut, shared_folder
from strainweave.plans.tables import table
from strainweave.streaming import incremental

_VOTES = f"""votes AS (SELECT {q.clean('isolate_id')} AS isolate_id, row_id AS position, {q.st('st')} AS label FROM mlst),
counted AS (SELECT isolate_id, label, count(*) AS n, min(position) AS first FROM votes WHERE isolate_id IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
vote AS (SELECT isolate_id, label, n / 3.0::DOUBLE AS agreement_score FROM (SELECT *, row_number() OVER (PARTITION BY isolate_id ORDER BY n DESC, first) AS r FROM counted) WHERE r = 1)"""
#: Replicates of a bootstrap: the settings' default.
REPLICATES = 500
_CHAINS_COMP = f"{q.CHAINS},\n{q.SYM},\n{q.REACH}"


def _chains(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    iso, e = views.graph_tables(spark, folder)
    return iso, e, cut(chains.chain_clusters(iso, e), "chains")


def _component(iso: DataFrame, e: DataFrame) -> DataFrame:
    return components.connected_components(iso.select(F.col("isolate_id").alias("node")), e).select(F.col("node").alias("isolate_id"), "component")


@query("leiden")
def leiden(spark: SparkSession, folder: str) -> DataFrame:
    """Communities at resolution 1, numbered by size and first isolate."""
    found = cut(community.leiden(*views.graph_tables(spark, folder)), "leiden")
    sizes = found.groupBy("community").agg(F.count("*").alias("n_isolates"))
    number = components.number_rows(sizes, [F.desc("n_isolates"), F.asc("community")], "cluster_id")
    return found.join(number, "community").select("isolate_id", F.col("cluster_id").cast("int").alias("cluster_id"))


@query("leiden_auto")
def leiden_auto(spark: SparkSession, folder: str) -> DataFrame:
    """Communities at the resolution of highest modularity."""
    return community.leiden(*views.graph_tables(spark, folder), "auto")


_MODULARITY = q.with_(
    _CHAINS_COMP,
    """, lab AS (SELECT isolate_id, cluster_id AS c FROM chains),
e2 AS (SELECT x.c AS cs, y.c AS cd, exp(-composite_weight) AS w FROM edges JOIN lab x ON x.isolate_id = src JOIN lab y ON y.isolate_id = dst),
k AS (SELECT c, sum(w) AS k FROM (SELECT cs AS c, w FROM e2 UNION ALL SELECT cd, w FROM e2) GROUP BY c)
SELECT round((SELECT sum(w) FILTER (cs = cd) / sum(w) FROM e2) - (SELECT sum(k * k) FROM k) / (4 * (SELECT sum(w) * sum(w) FROM e2)), 9) AS modularity""",
    True,
).replace("\n, lab", ", lab")


@query("modularity_of_partition", _MODULARITY)
def modularity_of_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Modularity of the chain clusters."""
    _, e, c = _chains(spark, folder)
    pairs = e.select(F.lit(0).alias("g"), "src", "dst", F.exp(-F.col("composite_weight")).alias("w"))
    return community.modularity(pairs, c.select(F.lit(0).alias("g"), F.col("isolate_id").alias("node"), F.col("cluster_id").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


@query("spectral")
def spectral_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Spectral clusters, each named by its first isolate."""
    return spectral.spectral(*views.graph_tables(spark, folder)).select("isolate_id", "cluster")


@query("eigengap")
def eigengap(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks by the number of clusters that their eigengap gives."""
    return spectral.spectral(*views.graph_tables(spark, folder)).groupBy("k").agg(F.count("*").alias("n_isolates"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query(
    "eigengap_rule",
    """WITH v AS (SELECT cluster_id AS block, betweenness AS x FROM centrality_scores WHERE cluster_id IS NOT NULL AND betweenness IS NOT NULL AND NOT isnan(betweenness)),
r AS (SELECT block, x, row_number() OVER (PARTITION BY block ORDER BY x) AS place FROM v),
g AS (SELECT block, place, lead(x) OVER (PARTITION BY block ORDER BY place) - x AS gap, count(*) OVER (PARTITION BY block) AS n FROM r WHERE place <= 13)
SELECT block, CAST(CASE WHEN n < 3 THEN 1 ELSE place END AS INT) AS k, round(CASE WHEN n < 3 THEN 0 ELSE gap END, 9) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY gap DESC NULLS LAST, place) AS best FROM g) WHERE best = 1""",
)
def eigengap_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The rule of the widest gap among the thirteen smallest values, on the betweenness of every delivered cluster."""
    v = table(spark, folder, "centrality_scores").filter("cluster_id is not null").select(F.col("cluster_id").alias("block"), F.col("betweenness").alias("value"))
    return spectral.eigengap_k(v).withColumn("gap", F.round("gap", 9))


@query(
    "silhouette_euclidean",
    """WITH d AS (SELECT a.vec_id AS i, a.label AS own, b.label AS l, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS d
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
m AS (SELECT i, own, l, avg(d) AS d FROM d GROUP BY ALL),
s AS (SELECT i, own, max(d) FILTER (l = own) AS a, min(d) FILTER (l <> own) AS b FROM m GROUP BY ALL)
SELECT i AS vec_id, own AS label, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""",
)
def silhouette_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouettes of every fiftieth vector among all, by label."""
    e = table(spark, folder, "embeddings")
    return spectral.silhouette_of(e.filter("vec_id % 50 = 0"), e, "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 6))


@query("label_contingency", q.with_(_CHAINS_COMP, "SELECT cluster_id AS other, g AS ref, count(*) AS n FROM chains JOIN reach ON id = isolate_id GROUP BY ALL", True))
def label_contingency(spark: SparkSession, folder: str) -> DataFrame:
    """Chain clusters against components."""
    iso, e, c = _chains(spark, folder)
    return consensus.contingency(c.select(F.lit(0).alias("g"), "isolate_id", F.col("cluster_id").alias("label")), _component(iso, e).withColumnRenamed("component", "label")).select("other", "ref", "n")


@query(
    "adjusted_rand",
    q.with_(
        _CHAINS_COMP,
        """SELECT round((c - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 9) AS ari FROM
(SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS c, sum(k)::DOUBLE AS n FROM (SELECT count(*)::DOUBLE AS k FROM chains JOIN reach ON id = isolate_id GROUP BY cluster_id, g)),
(SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS x FROM (SELECT count(*)::DOUBLE AS k FROM chains GROUP BY cluster_id)), (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS y FROM (SELECT count(*)::DOUBLE AS k FROM reach GROUP BY g))""",
        True,
    ),
)
def adjusted_rand(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of chain clusters with components."""
    iso, e, c = _chains(spark, folder)
    return consensus.adjusted_rand(c.withColumnRenamed("cluster_id", "label"), _component(iso, e).withColumnRenamed("component", "label")).select(F.round("ari", 9).alias("ari"))


@query("hungarian_overlap", q.with_(_CHAINS_COMP, "SELECT count(*) AS n_matched, CAST(sum(n) AS BIGINT) AS overlap FROM (SELECT g, max(n) AS n FROM (SELECT cluster_id, g, count(*) AS n FROM chains JOIN reach ON id = isolate_id GROUP BY ALL) GROUP BY g)", True))
def hungarian_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates that keep their label when chain clusters are matched to components.

    A chain lies in one component, so the best sum is that of every component's largest chain: what the SQL takes.
    """
    iso, e, c = _chains(spark, folder)
    comp = _component(iso, e)
    number = components.number_rows(comp.select("component").distinct(), ["component"], "label")
    reference = cut(comp.join(number, "component").select("isolate_id", "label"), "reference")
    other = c.select(F.lit(1).alias("g"), "isolate_id", F.col("cluster_id").cast("bigint").alias("label"))
    found = consensus.align_labels(other, reference).select("other", F.col("label").alias("ref"))
    return consensus.contingency(other, reference).join(found, ["other", "ref"]).agg(F.count("*").alias("n_matched"), F.sum("n").alias("overlap"))


@query("hungarian_align")
def hungarian_align(spark: SparkSession, folder: str) -> DataFrame:
    """The number of every chain cluster after matching to the numbered components."""
    iso, e, c = _chains(spark, folder)
    comp = _component(iso, e)
    number = components.number_rows(comp.select("component").distinct(), ["component"], "label")
    other = c.select(F.lit(1).alias("g"), "isolate_id", F.col("cluster_id").cast("bigint").alias("label"))
    return consensus.align_labels(other, comp.join(number, "component").select("isolate_id", "label")).select("other", "label")


@query("consensus")
def consensus_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Chains, communities and spectral clusters voted on."""
    iso, e, c = _chains(spark, folder)
    named = lambda d, col: d.join(components.number_rows(d.select(col).distinct(), [col], "label"), col).select("isolate_id", "label")
    le = named(cut(community.leiden(iso, e), "leiden"), "community")
    sp = named(cut(spectral.spectral(iso, e).select("isolate_id", "cluster"), "spectral"), "cluster")
    return consensus.consensus([c.select("isolate_id", F.col("cluster_id").alias("label")), le, sp])


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "mlst").select(clean_id(F.col("isolate_id")).alias("isolate_id"), F.col("row_id").alias("position"), sequence_type(F.col("st")).alias("label"))
    return consensus.majority_vote(v.filter("isolate_id is not null and label is not null"), 3)


@query("majority_vote", q.with_(_VOTES, "SELECT isolate_id, label AS cluster_id, round(agreement_score, 9) AS agreement_score, agreement_score < 2.0::DOUBLE / 3 AS ambiguous FROM vote"))
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The sequence type that most deliveries of an isolate name."""
    return _votes(spark, folder).withColumn("agreement_score", F.round("agreement_score", 9))


@query("assignment_pivot", q.with_(_CHAINS_COMP, "SELECT c.isolate_id, c.cluster_id::VARCHAR AS snp_chains, g AS component FROM chains c JOIN reach ON id = c.isolate_id", True))
def assignment_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """One column a method."""
    iso, e, c = _chains(spark, folder)
    long = c.select("isolate_id", F.lit("snp_chains").alias("method"), F.col("cluster_id").cast("string").alias("label")).unionByName(_component(iso, e).select("isolate_id", F.lit("component").alias("method"), F.col("component").alias("label")))
    return consensus.assignment_pivot(long, ["snp_chains", "component"])


@query("betweenness", q.with_(f"{q.ARCS},\n{q.PATHS}", "SELECT isolate_id, round(betweenness, 8) AS betweenness, round(closeness, 8) AS closeness FROM paths", True))
def betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Betweenness and closeness in the temporal graph."""
    iso, e = views.graph_tables(spark, folder)
    arcs = dag.temporal_dag(e, iso).select("src", "dst", F.col("composite_weight").alias("w"))
    found = centrality.path_centrality(arcs, iso.select(F.col("isolate_id").alias("node")))
    return found.select(F.col("node").alias("isolate_id"), F.round("betweenness", 8).alias("betweenness"), F.round("closeness", 8).alias("closeness"))


@query("closeness", q.with_(f"{q.ARCS},\n{q.PATHS}", "SELECT isolate_id, round(closeness, 8) AS closeness FROM paths", True))
def closeness(spark: SparkSession, folder: str) -> DataFrame:
    """Closeness in the temporal graph, direction ignored."""
    return betweenness(spark, folder).select("isolate_id", "closeness")


_TIMELINE = q.CHAINS + ",\n" + q.ARCS[len(q.EDGES) + 2 :].replace("arcs AS", "dagarcs AS")
_RANGE = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0::DOUBLE ELSE ({c} - min({c}) OVER w)::DOUBLE / (max({c}) OVER w - min({c}) OVER w) END"
_CENTRALITY = f"""{_TIMELINE},
{q.PATHS.replace("FROM arcs", "FROM dagarcs")},
degree AS (SELECT isolate_id, cluster_id, betweenness, closeness, (SELECT count(*) FROM dagarcs WHERE dst = isolate_id)::INT AS in_degree, (SELECT count(*) FROM dagarcs WHERE src = isolate_id)::INT AS out_degree FROM paths JOIN chains USING (isolate_id)),
central AS (SELECT *, 0.5::DOUBLE * {_RANGE("betweenness")} + 0.3::DOUBLE * {_RANGE("out_degree")} + 0.2::DOUBLE * {_RANGE("closeness")} AS risk FROM degree WINDOW w AS (PARTITION BY cluster_id))"""


@query("compute_centrality", q.with_(_CENTRALITY, "SELECT isolate_id, cluster_id, round(betweenness, 8) AS betweenness, in_degree, out_degree, round(closeness, 8) AS closeness, round(risk, 8) AS transmission_risk_score FROM central", True))
def compute_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """The centrality table of the chain clusters."""
    iso, e, c = _chains(spark, folder)
    return centrality.centrality(dag.temporal_dag(e, iso), iso, c).withColumns({x: F.round(x, 8) for x in ("betweenness", "closeness", "transmission_risk_score")})


@query(
    "cluster_records",
    q.with_(
        f"""{_CENTRALITY},
{_VOTES}""",
        """SELECT cluster_id, count(*) AS n_isolates, coalesce(array_to_string(list_sort(list(DISTINCT nullif(sequence_type, '')) FILTER (nullif(sequence_type, '') IS NOT NULL)), ','), '') AS sequence_types, array_to_string(list_sort(list(DISTINCT ward)), ',') AS wards,
min(i.collection_date) AS first_day, max(i.collection_date) AS last_day, arg_min(isolate_id, struct_pack(a := -round(risk, 9), b := isolate_id)) AS index_case_candidate, round(coalesce(sum(agreement_score), 0) / count(*), 6) AS confidence
FROM central JOIN iso i USING (isolate_id) LEFT JOIN vote USING (isolate_id) GROUP BY cluster_id""",
        True,
    ),
)
def cluster_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every chain cluster with its index case, and the agreement of its typing as confidence."""
    iso, e, c = _chains(spark, folder)
    scores = centrality.centrality(dag.temporal_dag(e, iso), iso, c).withColumn("transmission_risk_score", F.round("transmission_risk_score", 9))
    s = summary.cluster_summary(c, iso, scores, _votes(spark, folder).withColumnRenamed("agreement_score", "stability_score"))
    return s.withColumns({"sequence_types": F.array_join("sequence_types", ","), "wards": F.array_join("wards", ","), "confidence": F.round("confidence", 6)})


_SCALE = lambda c: f"CASE WHEN max(coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c} END, 0)) OVER w - min(coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c} END, 0)) OVER w < 1e-12 THEN 0::DOUBLE ELSE (coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c} END, 0)::DOUBLE - min(coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c} END, 0)) OVER w) / (max(coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c} END, 0)) OVER w - min(coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c} END, 0)) OVER w) END"
_SCALED = f"scaled AS (SELECT row_id, cluster_id, {_SCALE('betweenness')} AS b, {_SCALE('out_degree')} AS o, {_SCALE('closeness')} AS c FROM centrality_scores WINDOW w AS (PARTITION BY cluster_id))"


@query("minmax_by_cluster", q.with_(_SCALED, "SELECT row_id, round(b, 9) AS betweenness_scaled, round(o, 9) AS out_degree_scaled, round(c, 9) AS closeness_scaled FROM scaled"))
def minmax_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Centralities scaled within their cluster."""
    cols = ["betweenness", "out_degree", "closeness"]
    s = centrality.scale_by_group(table(spark, folder, "centrality_scores"), "cluster_id", cols)
    return s.select("row_id", *[F.round(f"{c}_scaled", 9).alias(f"{c}_scaled") for c in cols])


@query("risk_score", q.with_(_SCALED, "SELECT row_id, round(0.5::DOUBLE * b + 0.3::DOUBLE * o + 0.2::DOUBLE * c, 9) AS risk FROM scaled"))
def risk_score(spark: SparkSession, folder: str) -> DataFrame:
    """Risk of every row from its scaled centralities."""
    return centrality.risk(table(spark, folder, "centrality_scores").drop("transmission_risk_score")).select("row_id", F.round("transmission_risk_score", 9).alias("risk"))


_SCORES = f"""s1 AS (SELECT {q.clean('isolate_id')} AS isolate_id, cluster_id, row_id, betweenness, out_degree, closeness, CASE WHEN transmission_risk_score IS NULL OR isnan(transmission_risk_score) THEN 0 ELSE transmission_risk_score END AS risk FROM centrality_scores WHERE cluster_id IS NOT NULL),
scores AS (SELECT s.*, a.collection_date FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, isolate_id ORDER BY row_id) AS n FROM s1 WHERE isolate_id IS NOT NULL) s JOIN alliso a USING (isolate_id) WHERE n = 1)"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "centrality_scores").withColumn("isolate_id", clean_id(F.col("isolate_id"))).filter("isolate_id is not null and cluster_id is not null")
    risk = F.coalesce(F.nanvl("transmission_risk_score", F.lit(0.0)), F.lit(0.0)).alias("transmission_risk_score")
    return d.groupBy("cluster_id", "isolate_id").agg(F.min_by(F.struct("betweenness", "out_degree", "closeness", risk), "row_id").alias("s")).select("cluster_id", "isolate_id", "s.*")


@query(
    "index_cases",
    q.with_(
        f"{q.ISO},\n{_SCORES},\nr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY risk DESC, isolate_id) AS k, row_number() OVER (PARTITION BY cluster_id ORDER BY collection_date, isolate_id) AS p, count(*) OVER (PARTITION BY cluster_id) AS size, min(collection_date) OVER (PARTITION BY cluster_id) AS earliest FROM scores)",
        "SELECT cluster_id, isolate_id AS index_case_candidate, risk AS transmission_risk_score, betweenness, out_degree, closeness, earliest AS earliest_date, p AS candidate_date_rank, size AS n_isolates_in_cluster, p - 1 > size // 4 AS temporal_mismatch FROM r WHERE k = 1",
    ),
)
def index_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Per delivered cluster its candidate for the index case."""
    return centrality.index_cases(_scores(spark, folder), views.all_isolates(spark, folder))


_SUMMARY = f"""SELECT cluster_id, count(*) AS n_isolates, list_sort(list(DISTINCT nullif(sequence_type, '')) FILTER (nullif(sequence_type, '') IS NOT NULL)) AS sequence_types, list_sort(list(DISTINCT ward)) AS wards,
min(collection_date) AS first_day, max(collection_date) AS last_day FROM chains JOIN iso USING (isolate_id) GROUP BY cluster_id"""


@query("cluster_summary", q.with_(q.CHAINS, f"SELECT cluster_id, n_isolates, coalesce(array_to_string(sequence_types, ','), '') AS sequence_types, array_to_string(wards, ',') AS wards, first_day, last_day FROM ({_SUMMARY})", True))
def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Types, wards and span of every chain cluster."""
    iso, _, c = _chains(spark, folder)
    s = summary.cluster_summary(c, iso)
    return s.select("cluster_id", "n_isolates", F.array_join("sequence_types", ",").alias("sequence_types"), F.array_join("wards", ",").alias("wards"), "first_day", "last_day")


@query("console_summary", q.with_(q.CHAINS, f"SELECT cluster_id, n_isolates, coalesce(array_to_string(sequence_types[1:3], ', '), '') AS sequence_types, array_to_string(wards[1:3], ', ') AS wards, first_day, last_day FROM ({_SUMMARY})", True))
def console_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The same with three types and wards at most."""
    iso, _, c = _chains(spark, folder)
    return summary.console_summary(summary.cluster_summary(c, iso)).drop("index_case_candidate")


_STABLE = f"st AS (SELECT isolate_id, c.cluster_id, v.agreement_score AS s, CASE WHEN v.agreement_score >= 0.9 THEN 'stable' WHEN v.agreement_score >= 0.7 THEN 'uncertain' ELSE 'unstable' END AS k FROM chains c JOIN vote v USING (isolate_id))"


def _typing_stability(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from strainweave.functions.weights import stability_class

    _, _, c = _chains(spark, folder)
    v = _votes(spark, folder).select("isolate_id", F.col("agreement_score").alias("stability_score"))
    return c, c.join(v, "isolate_id").withColumn("classification", stability_class(F.col("stability_score")))


@query(
    "stability_summary",
    q.with_(
        f"{q.CHAINS},\n{_VOTES},\n{_STABLE}",
        """SELECT cluster_id, count(*) AS n_isolates, round(avg(s), 9) AS mean_stability, count(*) FILTER (k = 'stable') AS n_stable, count(*) FILTER (k = 'uncertain') AS n_uncertain, count(*) FILTER (k = 'unstable') AS n_unstable,
CASE WHEN avg(s) >= 0.9 THEN 'A' WHEN avg(s) >= 0.75 THEN 'B' ELSE 'C' END AS confidence_grade FROM st GROUP BY cluster_id""",
        True,
    ),
)
def stability_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of the chain clusters by the agreement of their typing."""
    return bootstrap.stability_summary(_typing_stability(spark, folder)[1]).withColumn("mean_stability", F.round("mean_stability", 9))


@query(
    "kpis",
    q.with_(
        f"{q.CHAINS},\n{_VOTES},\n{_STABLE}",
        "SELECT (SELECT count(*) FROM chains) AS n_isolates, (SELECT count(DISTINCT cluster_id) FROM chains) AS n_clusters, (SELECT count(*) FROM (SELECT cluster_id FROM chains GROUP BY 1 HAVING count(*) > 1)) AS n_multi_isolate_clusters, (SELECT count(*) FROM st WHERE k = 'stable') AS n_stable",
        True,
    ),
)
def kpis(spark: SparkSession, folder: str) -> DataFrame:
    """Key figures of the chain clusters."""
    return summary.kpis(*_typing_stability(spark, folder))


@query("bootstrap_noise")
def bootstrap_noise(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate pairs over all replicates: in how many each is an edge, and its distances there."""
    pairs = bootstrap.candidate_pairs(views.distances(spark, folder), views.isolates(spark, folder), views.SNP_CUTOFF, views.DAY_CUTOFF)
    e = bootstrap.perturbed_edges(pairs, REPLICATES).groupBy("src", "dst")
    return e.agg(F.count("*").alias("n_replicates"), F.round(F.min("d"), 6).alias("low"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("high"))


@query("bootstrap_stability")
def bootstrap_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Stability of the chain clusters over all replicates."""
    iso = cut(views.isolates(spark, folder), "isolates")
    pairs = cut(bootstrap.candidate_pairs(views.distances(spark, folder), iso, views.SNP_CUTOFF, views.DAY_CUTOFF), "candidates")
    c = cut(chains.chain_clusters(iso, pairs.filter(F.col("d") <= views.SNP_CUTOFF)), "chains")  # the edges are candidates too
    return bootstrap.stability(pairs, iso, c, REPLICATES)


@query("mst_edges", q.with_(f"{q.EDGES},\n{q.FOREST}", "SELECT src, dst, round(composite_weight, 9) AS composite_weight, snp_distance, greatest(0.3::DOUBLE, 2.5::DOUBLE / greatest(1, snp_distance)) AS width FROM forest", True))
def mst_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The minimum spanning forest with the width of its lines."""
    _, e = views.graph_tables(spark, folder)
    return summary.tree_drawing(forest.spanning_forest(e), e).withColumn("composite_weight", F.round("composite_weight", 9))


@query("mst_weight", q.with_(f"{q.EDGES},\n{q.FOREST}", "SELECT count(*) AS n_edges, round(sum(composite_weight), 6) AS weight FROM forest", True))
def mst_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and weight of the forest."""
    return forest.spanning_forest(views.graph_tables(spark, folder)[1]).agg(F.count("*").alias("n_edges"), F.round(F.sum("composite_weight"), 6).alias("weight"))


_ORDER = "o AS (SELECT isolate_id, cluster_id, ward, coalesce(sequence_type, '?') AS sequence_type, row_number() OVER (ORDER BY cluster_id, collection_date, isolate_id) - 1 AS position FROM chains JOIN iso USING (isolate_id))"


@query("heatmap_order", q.with_(f"{q.CHAINS},\n{_ORDER}", "SELECT * FROM o", True))
def heatmap_order(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates in the order of the heat map."""
    iso, _, c = _chains(spark, folder)
    return summary.heatmap_order(c, iso)


@query("heatmap_cells", q.with_(f"{q.CHAINS},\n{_ORDER}", 'SELECT least(x.position, y.position) AS "row", greatest(x.position, y.position) AS col, d FROM dist JOIN o x ON x.isolate_id = src JOIN o y ON y.isolate_id = dst', True))
def heatmap_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Distances in the order of the heat map."""
    iso, _, c = _chains(spark, folder)
    return summary.heatmap_cells(cut(summary.heatmap_order(c, iso), "order"), views.distances(spark, folder))


@query("timeline_bands", q.with_(q.CHAINS, "SELECT cluster_id, a AS first_day, b AS last_day, n AS n_isolates, row_number() OVER (ORDER BY a, cluster_id) - 1 AS band FROM (SELECT cluster_id, min(collection_date) AS a, max(collection_date) AS b, count(*) AS n FROM chains JOIN iso USING (isolate_id) GROUP BY 1)", True))
def timeline_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of the chain clusters in the order of their start."""
    iso, _, c = _chains(spark, folder)
    return summary.timeline_bands(c, iso)


@query("timeline_arcs", q.with_(_TIMELINE, "SELECT x.cluster_id, src, dst FROM dagarcs JOIN chains x ON x.isolate_id = src JOIN chains y ON y.isolate_id = dst WHERE x.cluster_id = y.cluster_id", True))
def timeline_arcs(spark: SparkSession, folder: str) -> DataFrame:
    """Arcs within one chain cluster."""
    iso, e, c = _chains(spark, folder)
    return summary.timeline_arcs(dag.temporal_dag(e, iso), c)


@query("top20_risk", "SELECT row_id, isolate_id, cluster_id, transmission_risk_score FROM centrality_scores WHERE transmission_risk_score IS NOT NULL AND NOT isnan(transmission_risk_score) ORDER BY transmission_risk_score DESC, isolate_id NULLS FIRST, cluster_id NULLS FIRST, row_id LIMIT 20")
def top20_risk(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty rows of highest risk."""
    return summary.top_risk(table(spark, folder, "centrality_scores")).select("row_id", "isolate_id", "cluster_id", "transmission_risk_score")


@query("method_labels", q.with_(f"{_CHAINS_COMP},\n{_VOTES}", """SELECT m.isolate_id, method, m.label, coalesce(agreement_score < 2.0::DOUBLE / 3, false) AS ambiguous
FROM (SELECT isolate_id, 'snp_chains' AS method, cluster_id::VARCHAR AS label FROM chains UNION ALL SELECT id, 'component', g FROM reach) m LEFT JOIN vote v ON v.isolate_id = m.isolate_id""", True))
def method_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of every method beside each other, and whether the isolate's typing is ambiguous."""
    iso, e, c = _chains(spark, folder)
    long = c.select("isolate_id", F.lit("snp_chains").alias("method"), F.col("cluster_id").cast("string").alias("label")).unionByName(_component(iso, e).select("isolate_id", F.lit("component").alias("method"), F.col("component").alias("label")))
    return summary.method_labels(long, _votes(spark, folder))


@query("mst_nodes", q.with_(_CENTRALITY, "SELECT isolate_id, cluster_id, round(60 + 240 * risk, 4) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY round(risk, 9) DESC, isolate_id) = 1 AS is_index_case FROM central", True))
def mst_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The isolates of the drawn forest: size by risk, and whether each is its cluster's index case."""
    iso, e, c = _chains(spark, folder)
    scores = cut(centrality.centrality(dag.temporal_dag(e, iso), iso, c).withColumn("transmission_risk_score", F.round("transmission_risk_score", 9)), "scores")
    return summary.tree_nodes(scores).withColumn("size", F.round("size", 4))


@query("method_counts", q.with_(_CHAINS_COMP, "SELECT 'snp_chains' AS method, count(*) AS n_isolates, count(DISTINCT cluster_id) AS n_clusters FROM chains UNION ALL SELECT 'component', count(*), count(DISTINCT g) FROM reach", True))
def method_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates and clusters per method."""
    iso, e, c = _chains(spark, folder)
    return summary.method_counts(c.select("isolate_id", F.lit("snp_chains").alias("method"), F.col("cluster_id").cast("string").alias("label")).unionByName(_component(iso, e).select("isolate_id", F.lit("component").alias("method"), F.col("component").alias("label"))))


@query("agreement_counts", q.with_(_VOTES, "SELECT round(agreement_score, 9) AS agreement_score, agreement_score < 2.0::DOUBLE / 3 AS ambiguous, count(*) AS n_isolates FROM vote GROUP BY ALL"))
def agreement_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates per agreement of their typing."""
    return summary.agreement_counts(_votes(spark, folder).withColumn("agreement_score", F.round("agreement_score", 9)))


@query("score_statistics", "SELECT count(transmission_risk_score) AS n, round(avg(transmission_risk_score), 9) AS mean, min(transmission_risk_score) AS low, max(transmission_risk_score) AS high FROM centrality_scores WHERE NOT isnan(transmission_risk_score)")
def score_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Number, mean and range of the risk scores."""
    s = F.col("transmission_risk_score")
    return table(spark, folder, "centrality_scores").filter(~F.isnan(s)).agg(F.count(s).alias("n"), F.round(F.avg(s), 9).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"))


_DIFF = f"""k AS (SELECT isolate_id, row_id, facility, ward FROM epi1 WHERE isolate_id IS NOT NULL),
f AS (SELECT isolate_id, min_by(facility, row_id) AS facility, min_by(ward, row_id) AS ward FROM k GROUP BY 1), l AS (SELECT isolate_id, max_by(facility, row_id) AS facility, max_by(ward, row_id) AS ward FROM k GROUP BY 1),
a AS (SELECT isolate_id || '.facility' AS key, facility AS v FROM f UNION ALL SELECT isolate_id || '.ward', ward FROM f), b AS (SELECT isolate_id || '.facility' AS key, facility AS v FROM l UNION ALL SELECT isolate_id || '.ward', ward FROM l)"""


def key_value_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, before, after) of the keys that differ between two (key, value) tables, missing ones included."""
    x, y = a.select("key", F.col("value").alias("before")), b.select("key", F.col("value").alias("after"))
    return x.join(y, "key", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


@query("config_diff", q.with_(f"{q.EPI},\n{_DIFF}", "SELECT key, a.v AS before, b.v AS after FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v"))
def config_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Key and value pairs that differ between an isolate's first and last record."""
    d = table(spark, folder, "epi").select(clean_id(F.col("isolate_id")).alias("isolate_id"), "row_id", or_unknown(F.col("facility")).alias("facility"), or_unknown(F.col("ward")).alias("ward")).filter("isolate_id is not null")
    r = F.struct("facility", "ward")
    ends = d.groupBy("isolate_id").agg(F.min_by(r, "row_id").alias("f"), F.max_by(r, "row_id").alias("l"))
    flat = lambda c: ends.select("isolate_id", F.explode(F.create_map(F.lit(".facility"), F.col(f"{c}.facility"), F.lit(".ward"), F.col(f"{c}.ward"))).alias("k", "value")).select(F.concat("isolate_id", "k").alias("key"), "value")
    return key_value_diff(flat("f"), flat("l"))


_WORDS = "w AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS s, list_transform(embedding, lambda x: abs(x) >= 0.02::FLOAT) AS v FROM embeddings)"
_DISTANCE = "CAST(len(list_filter(list_zip(a.s, b.s, a.v, b.v), lambda p: p[1] <> p[2]{})) AS INT)"


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", hamming.sign_word(F.col("embedding")).alias("word"), hamming.valid_word(F.col("embedding"), 0.02).alias("valid"))


@query("pairwise_hamming", q.with_(_WORDS, f"SELECT a.vec_id AS query_id, b.vec_id, {_DISTANCE.format('')} AS distance FROM w a, w b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"))
def pairwise_hamming(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of every fiftieth sign pattern to all others."""
    w = _words(spark, folder)
    return hamming.search_words(w, w.filter("vec_id % 50 = 0"), "vec_id", 64)


@query("masked_hamming", q.with_(_WORDS, f"SELECT a.vec_id AS query_id, b.vec_id, {_DISTANCE.format(' AND p[3] AND p[4]')} AS distance FROM w a, w b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND {_DISTANCE.format(' AND p[3] AND p[4]')} <= 20"))
def masked_hamming(spark: SparkSession, folder: str) -> DataFrame:
    """The same with unsure places masked, up to 20."""
    w = _words(spark, folder)
    return hamming.search_words(w, w.filter("vec_id % 50 = 0"), "vec_id", 20, masked=True)


_CLASSES = _WORDS + """,
cl AS (SELECT s, any_value(v) AS v, min(vec_id) AS vec_id FROM w GROUP BY s)"""


@query(
    "hamming_close_pairs",
    q.with_(
        _CLASSES,
        f"""SELECT a.vec_id AS src, b.vec_id AS dst, {_DISTANCE.format('')} AS distance FROM cl a, cl b WHERE a.vec_id < b.vec_id AND {_DISTANCE.format('')} <= 15
UNION ALL SELECT DISTINCT cl.vec_id, w.vec_id, 0 FROM w JOIN cl ON cl.s = w.s WHERE w.vec_id > cl.vec_id""",
    ),
)
def hamming_close_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of distinct sign patterns that differ in at most 15 places, and the copies of each pattern."""
    return hamming.close_classes(_words(spark, folder), "vec_id", 15)


@query("terrain_points")
def terrain_points(spark: SparkSession, folder: str) -> DataFrame:
    """Places in the plane by the distances of sign patterns."""
    placed = plane.place_words(_words(spark, folder), "vec_id")
    return placed.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_VECTORS = """vi AS (SELECT vec_id AS ord, DATE '2024-01-01' + CAST(vec_id * 37 % 90 AS INT) AS day, CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST(label AS VARCHAR) END AS st, list_transform(embedding, lambda x: x >= 0) AS s FROM embeddings),
vp AS (SELECT a.ord AS src, b.ord AS dst, len(list_filter(list_zip(a.s, b.s), lambda p: p[1] <> p[2])) AS d, abs(date_diff('day', a.day, b.day)) AS days, coalesce(a.st <> b.st, false) AS mm FROM vi a, vi b WHERE a.ord < b.ord)"""


@query(
    "edges_band_join",
    q.with_(
        _VECTORS,
        "SELECT src, dst, CAST(d AS INT) AS snp_distance, CAST(days AS INT) AS day_delta, mm AS mlst_mismatch, round(CAST(0.4 AS DOUBLE) * (d::DOUBLE / 15) + CAST(0.4 AS DOUBLE) * (days::DOUBLE / 60) + CAST(0.2 AS DOUBLE) * (CASE WHEN mm THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS composite_weight FROM vp WHERE d <= 15 AND days <= 60",
    ),
)
def edges_band_join(spark: SparkSession, folder: str) -> DataFrame:
    """Edges straight from sign patterns: pairs meet in bands of the pattern, then the days are compared."""
    from strainweave.operators import graph

    v = table(spark, folder, "embeddings")
    iso = v.select(F.col("vec_id").alias("isolate_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") * 37 % 90).cast("int")).alias("collection_date"), F.when(F.col("vec_id") % 17 != 0, F.col("label").cast("string")).alias("sequence_type"))
    pairs = hamming.close_rows(v.select("vec_id", hamming.sign_word(F.col("embedding")).alias("word")), "vec_id", 15).select("src", "dst", F.col("distance").cast("double").alias("d"))
    return graph.edges(pairs, iso, 15, 60).withColumn("composite_weight", F.round("composite_weight", 9))


_NEW = f"""p1 AS (SELECT row_id, {q.clean('isolate_id')} AS isolate_id, {q.day('collection_date')} AS collection_date, {q.st('sequence_type')} AS sequence_type, snp_distances FROM isolate_payload),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isolate_id ORDER BY row_id) AS n FROM p1 WHERE isolate_id IS NOT NULL AND collection_date IS NOT NULL) WHERE n = 1 AND isolate_id NOT IN (SELECT isolate_id FROM known)),
there AS (SELECT isolate_id, collection_date, sequence_type, CAST(NULL AS BIGINT) AS tr FROM known UNION ALL SELECT isolate_id, collection_date, sequence_type, row_id FROM p2),
near AS (SELECT isolate_id AS source, row_id AS sr, collection_date AS sd, sequence_type AS ss, {q.clean('u.e.key')} AS target, u.e.value AS d FROM p2, unnest(map_entries(snp_distances)) AS u(e) WHERE u.e.value <= 20),
ne AS (SELECT source, target, abs(date_diff('day', sd, collection_date)) AS days, coalesce(nullif(ss, '') <> nullif(k.sequence_type, ''), false) AS mm, min(d) AS d FROM near JOIN there k ON k.isolate_id = target WHERE source <> target AND (k.tr IS NULL OR k.tr < sr) GROUP BY ALL)"""
_NEW_EDGES = """SELECT source, target, CAST(round_even(d, 0) AS INT) AS snp_distance, CAST(days AS INT) AS day_delta, mm AS mlst_mismatch,
round(CAST(0.4 AS DOUBLE) * (d / CAST(20 AS DOUBLE)) + CAST(0.4 AS DOUBLE) * (CAST(days AS DOUBLE) / CAST(14 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * (CASE WHEN mm THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS composite_weight FROM ne WHERE days <= 14"""


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates known before the messages: those with metadata that no message names."""
    rows = table(spark, folder, "isolate_payload").select(clean_id(F.col("isolate_id")).alias("isolate_id")).filter("isolate_id is not null").distinct()
    return views.all_isolates(spark, folder).join(rows, "isolate_id", "left_anti").select("isolate_id", "collection_date", "sequence_type")


_KNOWN = f"known AS (SELECT isolate_id, collection_date, sequence_type FROM alliso WHERE isolate_id NOT IN (SELECT {q.clean('isolate_id')} FROM isolate_payload WHERE {q.clean('isolate_id')} IS NOT NULL))"


@query("incremental_edges", q.with_(f"{q.ISO},\n{_KNOWN},\n{_NEW}", _NEW_EDGES))
def incremental_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of newly reported isolates to the known ones and to those reported before them."""
    known = _known(spark, folder)
    new = incremental.new_isolates(table(spark, folder, "isolate_payload"), known)
    return incremental.incremental_edges(new, known).withColumn("composite_weight", F.round("composite_weight", 9))


# where the messages are one file, they are one batch, and the stream gives what the batch query gives
@query("stream_replay", q.with_(f"{q.ISO},\n{_KNOWN},\n{_NEW}", _NEW_EDGES))
def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The same by a streaming job that takes the messages file by file."""
    out = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    known = cut(_known(spark, folder), "known")
    e = incremental.replay_edges(spark, f"{folder}/isolate_payload.parque[t]", known, out, f"{out}/checkpoint")
    return e.withColumn("composite_weight", F.round("composite_weight", 9))


@query("stream_updates")
def stream_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, risk and alert of every newly reported isolate."""
    known = cut(_known(spark, folder), "known")
    from strainweave.operators import graph

    e = cut(graph.edges(views.distances(spark, folder), known), "known-edges")
    new = cut(incremental.new_isolates(table(spark, folder, "isolate_payload"), known), "new")
    before = community.leiden(known, e).withColumnRenamed("community", "cluster")
    return incremental.updates(new, incremental.incremental_edges(new, known), e, before, known)[0]
