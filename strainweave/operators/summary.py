"""Clusters, key figures, and the data behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.operators.components import number_rows


def cluster_summary(clusters: DataFrame, iso: DataFrame, scores: DataFrame | None = None, stability: DataFrame | None = None) -> DataFrame:
    """Per cluster: size, sorted types and wards, span of days, the isolate of highest risk (of equal ones the first), confidence.

    Lists hold distinct types and wards, not the members, so a cluster of any size stays one small row. Members are in
    the table of assignments. confidence is the summed stability over the size; isolates without one count as 0.
    """
    d = clusters.select("isolate_id", "cluster_id").join(iso.select("isolate_id", "collection_date", "ward", "sequence_type"), "isolate_id")
    if scores is not None:
        d = d.join(scores.select("isolate_id", "transmission_risk_score"), "isolate_id", "left")
    else:
        d = d.withColumn("transmission_risk_score", F.lit(None).cast("double"))
    if stability is not None:
        d = d.join(stability.select("isolate_id", "stability_score"), "isolate_id", "left")
    else:
        d = d.withColumn("stability_score", F.lit(None).cast("double"))
    best = F.when(F.col("transmission_risk_score").isNotNull(), F.struct(-F.col("transmission_risk_score"), F.col("isolate_id")))
    return d.groupBy("cluster_id").agg(
        F.count("*").alias("n_isolates"),
        F.array_sort(F.collect_set(F.nullif(F.col("sequence_type"), F.lit("")))).alias("sequence_types"),
        F.array_sort(F.collect_set("ward")).alias("wards"),
        F.min("collection_date").alias("first_day"),
        F.max("collection_date").alias("last_day"),
        F.min_by("isolate_id", best).alias("index_case_candidate"),
        (F.coalesce(F.sum("stability_score"), F.lit(0.0)) / F.count("*")).alias("confidence"),
    )


def console_summary(summary: DataFrame) -> DataFrame:
    """Clusters with their first three types and wards as text."""
    three = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    return summary.select("cluster_id", "n_isolates", three("sequence_types").alias("sequence_types"), three("wards").alias("wards"), "first_day", "last_day", "index_case_candidate")


def kpis(clusters: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """One row: isolates, clusters, clusters of several isolates, stable isolates."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_isolates"), F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_multi_isolate_clusters"))
    if stability is None:
        return sizes.withColumn("n_stable", F.lit(0).cast("bigint"))
    return sizes.join(stability.agg(F.count_if(F.col("classification") == "stable").alias("n_stable")))  # one row each


def heatmap_order(clusters: DataFrame, iso: DataFrame) -> DataFrame:
    """(isolate_id, cluster_id, ward, sequence_type, position): isolates by cluster, day and id; `?` for a missing type."""
    d = clusters.select("isolate_id", "cluster_id").join(iso, "isolate_id").select("isolate_id", "cluster_id", "collection_date", "ward", F.coalesce("sequence_type", F.lit("?")).alias("sequence_type"))
    return number_rows(d, ["cluster_id", "collection_date", "isolate_id"], "position").select("isolate_id", "cluster_id", "ward", "sequence_type", "position")


def heatmap_cells(order: DataFrame, dist: DataFrame) -> DataFrame:
    """(row, col, d): the known distances in the order of the figure, row before col."""
    at = lambda end, name: order.select(F.col("isolate_id").alias(end), F.col("position").alias(name))
    d = dist.join(at("src", "a"), "src").join(at("dst", "b"), "dst")
    return d.select(F.least("a", "b").alias("row"), F.greatest("a", "b").alias("col"), "d")


def timeline_bands(clusters: DataFrame, iso: DataFrame) -> DataFrame:
    """(cluster_id, first_day, last_day, n_isolates, band): clusters by first day."""
    d = clusters.select("isolate_id", "cluster_id").join(iso.select("isolate_id", "collection_date"), "isolate_id").groupBy("cluster_id").agg(F.min("collection_date").alias("first_day"), F.max("collection_date").alias("last_day"), F.count("*").alias("n_isolates"))
    return number_rows(d, ["first_day", "cluster_id"], "band")


def timeline_arcs(arcs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, src, dst) of the arcs within one cluster."""
    at = lambda end, name: clusters.select(F.col("isolate_id").alias(end), F.col("cluster_id").alias(name))
    return arcs.select("src", "dst").join(at("src", "c"), "src").join(at("dst", "d"), "dst").filter("c = d").select(F.col("c").alias("cluster_id"), "src", "dst")


def tree_drawing(forest: DataFrame, edges: DataFrame) -> DataFrame:
    """The forest with the width of each line: 2.5 / SNPs (at least one), no less than 0.3."""
    d = forest.join(edges.select("src", "dst", "snp_distance"), ["src", "dst"])
    return d.select("src", "dst", "composite_weight", "snp_distance", F.greatest(F.lit(0.3), F.lit(2.5) / F.greatest(F.lit(1), F.col("snp_distance"))).alias("width"))


def tree_nodes(scores: DataFrame) -> DataFrame:
    """(isolate_id, cluster_id, size, is_index_case) of the drawn forest: 60 + 240 risk, and the isolate of highest risk, of equal ones the first."""
    best = scores.groupBy("cluster_id").agg(F.min_by("isolate_id", F.struct(-F.col("transmission_risk_score"), F.col("isolate_id"))).alias("first"))
    d = scores.join(best, "cluster_id")
    return d.select("isolate_id", "cluster_id", (F.lit(60.0) + 240 * F.col("transmission_risk_score")).alias("size"), (F.col("isolate_id") == F.col("first")).alias("is_index_case"))


def method_labels(assignments: DataFrame, consensus: DataFrame) -> DataFrame:
    """(isolate_id, method, label, ambiguous) from (isolate_id, method, label) and the flags of a vote; without one it's false."""
    d = assignments.join(consensus.select("isolate_id", "ambiguous"), "isolate_id", "left")
    return d.select("isolate_id", "method", "label", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def top_risk(scores: DataFrame, n: int = 20) -> DataFrame:
    """The n rows of highest risk, of equal ones the first by isolate, cluster and row. Null and NaN scores are left out."""
    good = scores.filter(F.col("transmission_risk_score").isNotNull() & ~F.isnan("transmission_risk_score"))
    return good.orderBy(F.desc("transmission_risk_score"), "isolate_id", "cluster_id", *[c for c in ("row_id",) if c in scores.columns]).limit(n)


def method_counts(assignments: DataFrame) -> DataFrame:
    """Per method its isolates and clusters, from (isolate_id, method, label)."""
    return assignments.groupBy("method").agg(F.count("*").alias("n_isolates"), F.countDistinct("label").alias("n_clusters"))


def agreement_counts(consensus: DataFrame) -> DataFrame:
    """Isolates per agreement score."""
    return consensus.groupBy("agreement_score", "ambiguous").agg(F.count("*").alias("n_isolates"))
