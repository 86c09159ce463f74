"""The graph's inputs over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strainweave.operators import graph, ingest
from strainweave.plans.shared import cut
from strainweave.plans.tables import table

SNP_CUTOFF, DAY_CUTOFF = 20, 14


def all_isolates(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.isolates(table(spark, folder, "epi"), table(spark, folder, "mlst"))


def isolates(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates with metadata that the matrix names: the graph's vertices."""
    return ingest.matched_isolates(all_isolates(spark, folder), table(spark, folder, "snp_matrix"))


def distances(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.distances(table(spark, folder, "snp_matrix"))


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(isolates, edges), written once for the operators that read them again and again."""
    iso = cut(isolates(spark, folder), "isolates")
    return iso, cut(graph.edges(distances(spark, folder), iso, SNP_CUTOFF, DAY_CUTOFF), "edges")
