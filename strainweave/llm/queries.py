"""The package's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.llm import chunking, grouping, leakage, mixing, topn
from strainweave.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_TRIM = f"nullif(trim({{}}, {_WS}), '')"


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_GROUPS = f"""
WITH RECURSIVE w AS (SELECT {_TRIM.format('source')} AS s, {_TRIM.format('target')} AS t, snp_distance AS d FROM weighted_edges),
ids AS (SELECT s AS id FROM w WHERE s IS NOT NULL UNION SELECT t FROM w WHERE t IS NOT NULL),
l AS (SELECT s AS a, t AS b FROM w WHERE s IS NOT NULL AND t IS NOT NULL AND d BETWEEN 0 AND 20 UNION SELECT t, s FROM w WHERE s IS NOT NULL AND t IS NOT NULL AND d BETWEEN 0 AND 20),
reach(id, g) USING KEY (id) AS (
  SELECT id, id FROM ids
  UNION
  SELECT l.b, min(r.g) FROM reach r JOIN l ON l.a = r.id JOIN recurring.reach cur ON cur.id = l.b WHERE r.g < cur.g GROUP BY l.b)
"""


@query("p2_found", _GROUPS + "SELECT id AS isolate_id, g AS group_id FROM reach")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every isolate that weighted_edges names."""
    return grouping.group_ids(table(spark, folder, "weighted_edges"))


@query("p2_group_sizes", _GROUPS + "SELECT g AS group_id, count(*) AS n_isolates FROM reach GROUP BY g")
def p2_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates per group."""
    return grouping.group_ids(table(spark, folder, "weighted_edges")).groupBy("group_id").agg(F.count("*").alias("n_isolates"))


_TOP = f"""
WITH c AS (SELECT cluster_id, {_TRIM.format('isolate_id')} AS isolate_id, max(transmission_risk_score) AS s FROM centrality_scores
WHERE cluster_id IS NOT NULL AND cluster_id <> -1 AND transmission_risk_score IS NOT NULL AND NOT isnan(transmission_risk_score) AND {_TRIM.format('isolate_id')} IS NOT NULL GROUP BY ALL),
r AS (SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, isolate_id) AS INT) AS rank_no, isolate_id, s FROM c)
"""


def _top(spark: SparkSession, folder: str, n: int) -> DataFrame:
    rows = table(spark, folder, "centrality_scores").filter("cluster_id is not null and cluster_id <> -1")
    return topn.top_items(rows, "cluster_id", "isolate_id", "transmission_risk_score", n)


@query("p3_found", _TOP + "SELECT cluster_id, rank_no, isolate_id FROM r WHERE rank_no <= 5")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five isolates of highest risk in every cluster."""
    return _top(spark, folder, 5).select("cluster_id", "rank_no", "isolate_id")


@query("p3_top_20_scores", _TOP + "SELECT cluster_id, rank_no, isolate_id, s AS transmission_risk_score FROM r WHERE rank_no <= 20")
def p3_top_20_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty isolates of highest risk in every cluster, with their scores."""
    return _top(spark, folder, 20)


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage of an evaluation item."""
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "eval_id").distinct()


@query("p6_passages")
def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The longest leaked passage of each document and item, as it stands in the text."""
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query("p6_leaked_items")
def p6_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items that leaked, with the documents that hold them."""
    items = table(spark, folder, "eval_items")
    n = leakage.find_leaks(table(spark, folder, "documents"), items).groupBy("eval_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_run"))
    return items.select("eval_id", "split_name", "lang").join(n, "eval_id")


@query("p7_mixture")
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of documents, in global random order."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each source reaches in the mixture."""
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query("p8_pieces")
def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 512 tokens of every longer document."""
    return chunking.split_texts(table(spark, folder, "documents"))
