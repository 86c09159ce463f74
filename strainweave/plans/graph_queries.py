"""Queries on ingestion, the graph, its components, chains and dated arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id
from strainweave.functions.labels import or_unknown, parse_day, sequence_type
from strainweave.operators import chains, components, dag, graph, ingest
from strainweave.plans import sql_parts as q
from strainweave.plans import views
from strainweave.plans.registry import query
from strainweave.plans.tables import table


@query("edges_theta_join", q.with_(q.EDGES, "SELECT src, dst, snp_distance, day_delta, mlst_mismatch, round(composite_weight, 9) AS composite_weight FROM edges"))
def edges_theta_join(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs within 20 SNPs and 14 days, with their composite weight."""
    return views.graph_tables(spark, folder)[1].withColumn("composite_weight", F.round("composite_weight", 9))


@query("mlst_left_join", q.with_(q.ISO, "SELECT isolate_id, collection_date, facility, ward, sequence_type FROM alliso"))
def mlst_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates with their sequence type, kept where there is none."""
    return views.all_isolates(spark, folder)


@query("ids_anti_join", q.with_(f"{q.ISO}, {q.IDS}", "SELECT isolate_id FROM ids WHERE isolate_id NOT IN (SELECT isolate_id FROM alliso)"))
def ids_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates of the matrix without metadata."""
    return ingest.unmatched_ids(table(spark, folder, "snp_matrix"), views.all_isolates(spark, folder))


@query("epi_semi_join", q.with_(q.V, "SELECT isolate_id, collection_date, facility, ward, sequence_type FROM iso"))
def epi_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates with metadata that the matrix names."""
    return views.isolates(spark, folder)


@query("st_normalise", f"SELECT row_id, {q.st('st')} AS sequence_type FROM mlst")
def st_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence types in one spelling."""
    return table(spark, folder, "mlst").select("row_id", sequence_type(F.col("st")).alias("sequence_type"))


@query("date_parse_multi", f"SELECT row_id, {q.day('collection_date')} AS collection_day FROM epi")
def date_parse_multi(spark: SparkSession, folder: str) -> DataFrame:
    """Days in the reader's formats."""
    return table(spark, folder, "epi").select("row_id", parse_day(F.col("collection_date")).alias("collection_day"))


@query("default_fill", f"SELECT row_id, coalesce({q.clean('facility')}, 'unknown') AS facility, coalesce({q.clean('ward')}, 'unknown') AS ward FROM epi")
def default_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Blank facility and ward become unknown."""
    return table(spark, folder, "epi").select("row_id", or_unknown(F.col("facility")).alias("facility"), or_unknown(F.col("ward")).alias("ward"))


@query("mlst_coverage", q.with_(q.V, "SELECT count(*) AS n_isolates, count(sequence_type) AS n_covered, round(100.0::DOUBLE * count(sequence_type) / count(*), 6) AS percent_covered FROM iso"))
def mlst_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of isolates with a sequence type."""
    s = ingest.ingest_summary(views.isolates(spark, folder))
    return s.select("n_isolates", "n_covered", F.round(F.try_divide(F.lit(100.0) * F.col("n_covered"), F.col("n_isolates")), 6).alias("percent_covered"))


@query("ingest_summary", q.with_(q.V, "SELECT count(*) AS n_isolates, count(DISTINCT ward) AS n_wards, count(DISTINCT sequence_type) AS n_sequence_types FROM iso"))
def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates, wards and sequence types."""
    return ingest.ingest_summary(views.isolates(spark, folder)).select("n_isolates", "n_wards", "n_sequence_types")


@query("date_span", q.with_(q.V, "SELECT min(collection_date) AS first_day, max(collection_date) AS last_day, date_diff('day', min(collection_date), max(collection_date)) AS span_days, date_diff('day', min(collection_date), max(collection_date)) > 1825 AS span_warning, count(*) FILTER (collection_date > current_date) AS n_future FROM iso"))
def date_span(spark: SparkSession, folder: str) -> DataFrame:
    """Span of the days, whether it is suspicious, and days in the future."""
    return ingest.ingest_summary(views.isolates(spark, folder)).select("first_day", "last_day", "span_days", "span_warning", "n_future")


@query("matrix_symmetrise", q.with_(q.DIST, "SELECT src, dst, d FROM dist"))
def matrix_symmetrise(spark: SparkSession, folder: str) -> DataFrame:
    """One distance a pair."""
    return views.distances(spark, folder)


@query(
    "matrix_violations",
    f"""WITH c AS (SELECT {q.clean('isolate_id')} AS a, {q.clean('dst')} AS b, d FROM snp_matrix),
p AS (SELECT max(d) - min(d) AS s FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND d IS NOT NULL GROUP BY least(a, b), greatest(a, b))
SELECT (SELECT count(*) FROM c) AS n_cells, (SELECT count(*) FROM c WHERE d IS NULL) AS n_null, (SELECT count(*) FROM c WHERE d < 0) AS n_negative,
(SELECT count(*) FROM c WHERE a = b AND abs(d) > 1e-6) AS n_diagonal, (SELECT count(*) FROM p WHERE s > 1e-6) AS n_asymmetric, (SELECT coalesce(max(s), 0) FROM p) AS worst""",
)
def matrix_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What the matrix breaks of its rules."""
    return ingest.matrix_violations(table(spark, folder, "snp_matrix"))


@query("vertex_strength", q.with_(f"{q.EDGES}, {q.SYM}", "SELECT isolate_id, count(b) AS degree, round(coalesce(sum(exp(-w)), 0), 9) AS strength FROM iso LEFT JOIN sym ON a = isolate_id GROUP BY isolate_id"))
def vertex_strength(spark: SparkSession, folder: str) -> DataFrame:
    """Degree and summed similarity of every isolate."""
    iso, e = views.graph_tables(spark, folder)
    return graph.degrees(e, iso).withColumn("strength", F.round("strength", 9))


@query("similarity_weights", q.with_(q.EDGES, "SELECT src, dst, round(exp(-composite_weight), 9) AS similarity FROM edges"))
def similarity_weights(spark: SparkSession, folder: str) -> DataFrame:
    """exp(-weight) of every edge."""
    _, e = views.graph_tables(spark, folder)
    return e.select("src", "dst", F.round(F.exp(-F.col("composite_weight")), 9).alias("similarity"))


def _components(iso: DataFrame, e: DataFrame) -> DataFrame:
    return components.connected_components(iso.select(F.col("isolate_id").alias("node")), e).select(F.col("node").alias("isolate_id"), "component")


@query("connected_components", q.with_(q.COMP, "SELECT id AS isolate_id, g AS component FROM reach", True))
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every isolate."""
    return _components(*views.graph_tables(spark, folder))


@query(
    "component_of_vertex",
    q.with_(q.COMP, "SELECT id AS isolate_id, g AS component FROM reach WHERE g = (SELECT g FROM reach WHERE id = (SELECT src FROM edges ORDER BY src LIMIT 1))", True),
)
def component_of_vertex(spark: SparkSession, folder: str) -> DataFrame:
    """The component that holds the first isolate with an edge."""
    iso, e = views.graph_tables(spark, folder)
    first = e.agg(F.min("src").alias("v")).first()["v"]
    c = components.connected_components(iso.select(F.col("isolate_id").alias("node")), e)
    return components.component_of(first, c).select(F.col("node").alias("isolate_id"), "component")


@query(
    "graph_summary",
    q.with_(
        q.COMP,
        """SELECT v.n AS n_vertices, e.n AS n_edges, round(e.n / (v.n::DOUBLE * (v.n - 1) / 2), 12) AS density, c.n AS n_components, c.m AS largest_component_size, round(2.0::DOUBLE * e.n / v.n, 9) AS mean_degree,
round(e.w0, 9) AS weight_min, round(e.w1, 9) AS weight_max, round(e.w2, 9) AS weight_mean, e.s0 AS snp_min, e.s1 AS snp_max
FROM (SELECT count(*) AS n FROM iso) v, (SELECT count(*) AS n, min(composite_weight) AS w0, max(composite_weight) AS w1, avg(composite_weight) AS w2, min(snp_distance) AS s0, max(snp_distance) AS s1 FROM edges) e,
(SELECT count(*) AS n, max(k) AS m FROM (SELECT count(*) AS k FROM reach GROUP BY g)) c""",
        True,
    ),
)
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, density and ranges of the graph."""
    iso, e = views.graph_tables(spark, folder)
    s = graph.graph_summary(e, iso, _components(iso, e))
    return s.withColumns({"density": F.round("density", 12)} | {c: F.round(c, 9) for c in ("mean_degree", "weight_min", "weight_max", "weight_mean")})


@query("snp_chains", q.with_(q.CHAINS, "SELECT isolate_id, cluster_id FROM chains", True))
def snp_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Date-ordered chain clusters."""
    return chains.chain_clusters(*views.graph_tables(spark, folder))


@query("temporal_orientation", q.with_(q.ARCS, "SELECT a AS src, b AS dst, CAST(delta AS INT) AS day_delta FROM oriented"))
def temporal_orientation(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge from the earlier isolate to the later one, both ways within two days."""
    iso, e = views.graph_tables(spark, folder)
    return dag.orient(e, iso).select("src", "dst", "day_delta")


@query("temporal_dag", q.with_(q.ARCS, "SELECT src, dst, round(composite_weight, 9) AS composite_weight FROM arcs"))
def temporal_dag(spark: SparkSession, folder: str) -> DataFrame:
    """The oriented edges without cycles."""
    iso, e = views.graph_tables(spark, folder)
    return dag.temporal_dag(e, iso).select("src", "dst", F.round("composite_weight", 9).alias("composite_weight"))


@query("sources_sinks", q.with_(q.ARCS, "SELECT isolate_id, isolate_id NOT IN (SELECT dst FROM arcs) AS is_source, isolate_id NOT IN (SELECT src FROM arcs) AS is_sink FROM iso"))
def sources_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Isolates without an earlier or a later neighbour."""
    iso, e = views.graph_tables(spark, folder)
    return dag.sources_sinks(dag.temporal_dag(e, iso), iso)


@query(
    "longest_chain",
    q.with_(
        q.ARCS + ",\nlong(id, l) AS (SELECT isolate_id, 0 FROM iso UNION SELECT a.dst, l + 1 FROM long JOIN arcs a ON a.src = id)",
        "SELECT id AS isolate_id, CAST(max(l) AS INT) AS chain_length FROM long GROUP BY id",
        True,
    ),
)
def longest_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Longest dated path that ends in every isolate."""
    iso, e = views.graph_tables(spark, folder)
    return dag.longest_paths(dag.temporal_dag(e, iso), iso)


@query(
    "topological_order",
    q.with_(
        q.ARCS + ",\nlong(id, l) AS (SELECT isolate_id, 0 FROM iso UNION SELECT a.dst, l + 1 FROM long JOIN arcs a ON a.src = id)",
        "SELECT id AS isolate_id, level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM (SELECT id, CAST(max(l) AS INT) AS level FROM long GROUP BY id)",
        True,
    ),
)
def topological_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every isolate's level and place in an order that all arcs follow."""
    iso, e = views.graph_tables(spark, folder)
    return components.number_rows(dag.topological_rank(dag.temporal_dag(e, iso), iso), ["level", "isolate_id"], "position")


@query(
    "dag_summary",
    q.with_(
        q.ARCS + ",\nsym AS (SELECT src AS a, dst AS b FROM arcs UNION ALL SELECT dst, src FROM arcs),\n" + q.REACH + ",\nlong(id, l) AS (SELECT isolate_id, 0 FROM iso UNION SELECT a.dst, l + 1 FROM long JOIN arcs a ON a.src = id),\nbehind(a, b) AS (SELECT src, dst FROM arcs UNION SELECT h.a, x.dst FROM behind h JOIN arcs x ON x.src = h.b)",
        """SELECT (SELECT count(*) FROM iso) AS n_vertices, (SELECT count(*) FROM arcs) AS n_edges, (SELECT count(*) FROM iso WHERE isolate_id NOT IN (SELECT dst FROM arcs)) AS n_source_nodes,
(SELECT count(*) FROM iso WHERE isolate_id NOT IN (SELECT src FROM arcs)) AS n_sink_nodes, (SELECT count(DISTINCT g) FROM reach) AS n_weakly_connected_components, (SELECT CAST(max(l) AS INT) FROM long) AS max_chain_length,
(SELECT count(*) = 0 FROM behind WHERE a = b) AS is_dag""",
        True,
    ),
)
def dag_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Structure of the acyclic graph."""
    iso, e = views.graph_tables(spark, folder)
    return dag.dag_summary(dag.temporal_dag(e, iso), iso)


@query("matrix_point_lookup", q.with_(q.DIST, "SELECT src, dst, d FROM dist WHERE src = (SELECT min(src) FROM dist)"))
def matrix_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """All distances from the first isolate."""
    d = views.distances(spark, folder)
    return d.join(F.broadcast(d.agg(F.min("src").alias("src"))), "src").select("src", "dst", "d")


@query("epi_row_counts", f"SELECT coalesce({q.clean('ward')}, 'unknown') AS ward, count(*) AS n_rows, count(DISTINCT {q.clean('isolate_id')}) AS n_isolates FROM epi GROUP BY 1")
def epi_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and isolates per ward."""
    return table(spark, folder, "epi").groupBy(or_unknown(F.col("ward")).alias("ward")).agg(F.count("*").alias("n_rows"), F.countDistinct(clean_id(F.col("isolate_id"))).alias("n_isolates"))
