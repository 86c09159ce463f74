"""The whole analysis: from files to clusters, centrality, stability and the written results."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.config import Config
from strainweave.operators import bootstrap, centrality, chains, community, components, consensus, dag, graph, spectral, summary
from strainweave.plans.shared import cut, scope
from strainweave.sources import readers, writers


@dataclass
class Result:
    """Tables of a run."""

    isolates: DataFrame
    distances: DataFrame
    edges: DataFrame
    arcs: DataFrame
    assignments: DataFrame
    clusters: DataFrame
    centrality: DataFrame
    index_cases: DataFrame
    stability: DataFrame
    summary: DataFrame
    metadata: dict = field(default_factory=dict)


def _labels(found: DataFrame, column: str) -> DataFrame:
    """(isolate_id, label): clusters numbered from 0 by size, then first isolate."""
    d = cut(found.select("isolate_id", F.col(column).alias("__c")), "labels")
    sizes = d.groupBy("__c").agg(F.count("*").alias("n"), F.min("isolate_id").alias("first"))
    number = components.number_rows(sizes, [F.desc("n"), F.asc("first")], "label").select("__c", "label")
    return d.join(number, "__c").select("isolate_id", "label")


def cluster_by(method: str, iso: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """(isolate_id, label) of one method."""
    if method == "snp_chains":
        return chains.chain_clusters(iso, edges).withColumnRenamed("cluster_id", "label")
    if method == "leiden":
        return _labels(community.leiden(iso, edges, config.clustering.leiden_resolution), "community")
    if method == "spectral":
        return _labels(spectral.spectral(iso, edges, config.clustering.random_state), "cluster")
    raise ValueError(f"unknown method: {method}")


def analyse(dist: DataFrame, iso: DataFrame, config: Config) -> Result:
    """All tables of a run over distances (src, dst, d) and isolates."""
    with scope() as keep:
        return _analyse(keep(dist, "distances"), keep(iso, "isolates"), config, keep)


def _analyse(dist: DataFrame, iso: DataFrame, config: Config, keep: Callable[[DataFrame, str], DataFrame]) -> Result:
    t, c = config.thresholds, config.clustering
    edges = keep(graph.edges(dist, iso, t.snp_cutoff, t.day_cutoff, t.edge_weight_alpha, t.edge_weight_beta, t.edge_weight_gamma), "edges")
    by = {m: keep(cluster_by(m, iso, edges, config), m) for m in c.methods}
    voted = keep(consensus.consensus([by[m] for m in c.methods]).withColumn("cluster_id", F.col("cluster_id").cast("int")), "consensus")
    arcs = keep(dag.temporal_dag(edges, iso, c.uncertainty_days), "dag")
    scores = keep(centrality.centrality(arcs, iso, voted), "centrality")
    stable = keep(bootstrap.bootstrap_stability(dist, iso, voted.select("isolate_id", "cluster_id"), c.bootstrap_n, c.random_state, t.snp_cutoff, t.day_cutoff, 1.0 if c.leiden_resolution == "auto" else float(c.leiden_resolution)), "stability")
    long = None
    for m in c.methods:
        one = by[m].select("isolate_id", F.lit(m).alias("method"), F.col("label").cast("int").alias("label"))
        long = one if long is None else long.unionByName(one)
    return Result(iso, dist, edges, arcs, long, voted, scores, keep(centrality.index_cases(scores, iso), "index-cases"), stable, keep(summary.cluster_summary(voted, iso, scores, stable), "summary"), {"project": config.project_name, "methods": list(c.methods), "bootstrap_n": c.bootstrap_n})


def write_results(r: Result, config: Config) -> None:
    """CSV, JSON, graph and report of a run."""
    out = config.output_dir
    os.makedirs(out, exist_ok=True)
    wide = consensus.assignment_pivot(r.assignments, r.metadata["methods"]).join(r.clusters.withColumnRenamed("cluster_id", "consensus"), "isolate_id")
    writers.write_csv(wide, f"{out}/cluster_assignments", ["isolate_id"])
    writers.write_csv(r.centrality, f"{out}/centrality_scores", ["isolate_id"])
    writers.write_csv(r.index_cases, f"{out}/index_case_candidates", ["cluster_id"])
    writers.write_csv(r.stability, f"{out}/bootstrap_stability", ["isolate_id"])
    writers.write_csv(bootstrap.stability_summary(r.stability), f"{out}/cluster_stability_summary", ["cluster_id"])
    writers.write_json(r.summary.orderBy("cluster_id"), f"{out}/clusters")
    writers.save_graph(r.isolates, r.edges, f"{out}/transmission_graph")
    writers.write_graphml(r.isolates, r.edges, f"{out}/transmission_graph.graphml")
    writers.write_graphml(r.isolates, r.arcs, f"{out}/transmission_dag.graphml", directed=True)
    comp = components.connected_components(r.isolates.select(F.col("isolate_id").alias("node")), r.edges)
    graph_row = graph.graph_summary(r.edges, r.isolates, comp).first().asDict()
    writers.dump_json(graph_row, f"{out}/graph_summary.json")
    writers.dump_json(dag.dag_summary(r.arcs, r.isolates).first().asDict(), f"{out}/dag_summary.json")
    kpi = summary.kpis(r.clusters, r.stability).first().asDict()
    writers.dump_json({"project": config.project_name, **kpi, "bootstrap_replicates": config.clustering.bootstrap_n, "graph": graph_row}, f"{out}/pipeline_summary.json")
    if config.visualization.static:
        write_html(r, f"{out}/report.html", config.project_name, kpi)


def write_html(r: Result, path: str, title: str, kpi: dict) -> None:
    """The report; its tables hold the first rows only."""
    clusters = summary.console_summary(r.summary).orderBy("cluster_id").limit(201)
    cases = r.index_cases.orderBy("cluster_id").limit(201)
    top = summary.top_risk(r.centrality)
    bands = summary.timeline_bands(r.clusters, r.isolates).orderBy("band").limit(61)
    each = summary.method_counts(r.assignments).orderBy("method")
    part = lambda df: writers.table_html(df.collect(), df.columns)
    writers.write_report(path, title, kpi, [("Clusters", part(clusters)), ("Timeline", writers.timeline_svg(bands.collect())), ("Index cases", part(cases)), ("Highest risk", part(top)), ("Methods", part(each)), ("Agreement", part(summary.agreement_counts(r.clusters).orderBy("agreement_score")))])


def run(spark: SparkSession, config: Config) -> Result:
    """Loads, analyses and writes."""
    dist, iso = readers.load(spark, config.inputs.snp_matrix, config.inputs.epi_metadata, config.inputs.mlst_profiles)
    r = analyse(dist, iso, config)
    with scope():  # what only the results' files needed
        write_results(r, config)
    return r


def reload(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a former run, from its files."""
    csv = lambda name: spark.read.csv(f"{folder}/{name}", header=True, inferSchema=True)
    return {n: csv(n) for n in ("cluster_assignments", "centrality_scores", "index_case_candidates", "bootstrap_stability")} | {"clusters": spark.read.json(f"{folder}/clusters")}
