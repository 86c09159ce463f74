"""New isolates arriving as messages: edges to the isolates known so far and to earlier messages, clusters, risk, alerts.

Every micro-batch is one idempotent step: its edges and updates are written under the batch's number, so a batch that
is run again after a failure overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from strainweave.functions.ids import clean_id
from strainweave.functions.labels import or_unknown, parse_day, sequence_type
from strainweave.functions.weights import composite_weight, st_mismatch
from strainweave.operators.centrality import path_centrality
from strainweave.operators.community import leiden
from strainweave.operators.components import connected_components
from strainweave.plans.shared import cut, scope

#: The messages' columns.
MESSAGE = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("isolate_id", T.StringType()), T.StructField("collection_date", T.StringType()), T.StructField("facility", T.StringType()), T.StructField("ward", T.StringType()), T.StructField("sequence_type", T.StringType()), T.StructField("snp_distances", T.MapType(T.StringType(), T.DoubleType())), T.StructField("received_at", T.TimestampNTZType())])


def new_isolates(messages: DataFrame, known: DataFrame) -> DataFrame:
    """The first message (lowest row_id) of every isolate that isn't known and has a readable day; repeats are refused."""
    d = messages.select("row_id", clean_id(F.col("isolate_id")).alias("isolate_id"), parse_day(F.col("collection_date")).alias("collection_date"), or_unknown(F.col("facility")).alias("facility"), or_unknown(F.col("ward")).alias("ward"), sequence_type(F.col("sequence_type")).alias("sequence_type"), "snp_distances").filter("isolate_id is not null and collection_date is not null")
    first = d.groupBy("isolate_id").agg(F.min_by(F.struct(*[c for c in d.columns if c != "isolate_id"]), "row_id").alias("m")).select("isolate_id", "m.*")
    return first.join(known.select("isolate_id"), "isolate_id", "left_anti")


def incremental_edges(new: DataFrame, known: DataFrame, snp_cutoff: float = 20, day_cutoff: int = 14) -> DataFrame:
    """(source, target, snp_distance, day_delta, mlst_mismatch, composite_weight): source is the new isolate.

    new has the column row_id: an edge between two new isolates forms when the later row names the earlier, as if every
    message had been taken before the next one. Only distances within the cutoff leave the map, so the join sees few rows. A missing distance gives no edge.
    """
    near = F.map_filter(F.col("snp_distances"), lambda k, d: d <= snp_cutoff)
    pairs = new.select(F.col("isolate_id").alias("source"), F.col("row_id").alias("s_row"), F.col("collection_date").alias("s_day"), F.col("sequence_type").alias("s_st"), F.explode(near).alias("target", "d")).withColumn("target", clean_id(F.col("target")))
    at = lambda t, row: t.select(F.col("isolate_id").alias("target"), F.col("collection_date").alias("t_day"), F.col("sequence_type").alias("t_st"), row.cast("bigint").alias("t_row"))
    t = at(known, F.lit(None)).unionByName(at(new, F.col("row_id")))
    e = pairs.filter("source <> target").join(t, "target").filter("t_row is null or t_row < s_row").withColumn("day_delta", F.abs(F.datediff("s_day", "t_day"))).filter(F.col("day_delta") <= day_cutoff)
    e = e.groupBy("source", "target", "day_delta", "s_st", "t_st").agg(F.min("d").alias("d")).withColumn("mlst_mismatch", st_mismatch(F.col("s_st"), F.col("t_st")))
    return e.select("source", "target", F.bround("d").cast("int").alias("snp_distance"), "day_delta", "mlst_mismatch", composite_weight(F.col("d"), F.col("day_delta"), F.col("mlst_mismatch"), snp_cutoff, day_cutoff).alias("composite_weight"))


def follow(spark: SparkSession, source: str, known: DataFrame, out: str, checkpoint: str, snp_cutoff: float = 20, day_cutoff: int = 14, kind: str = "json", files_per_batch: int = 4, once: bool = False, known_edges: DataFrame | None = None, known_clusters: DataFrame | None = None, threshold: float = 0.7) -> StreamingQuery:
    """Starts a job that takes message files from source and writes accepted isolates and their edges to out.

    A batch's output lies under its number. An isolate that a batch before has accepted is refused, by an anti-join
    against what those have written; edges among new isolates form when the later one names the earlier. once: ends
    when all files that are there have been taken. With known_edges (src, dst, composite_weight) and known_clusters
    (isolate_id, cluster) every batch also clusters anew and writes updates, alerts and clusters.
    """
    stream = spark.readStream.schema(MESSAGE).format(kind).option("maxFilesPerTrigger", files_per_batch).load(source)

    def step(batch: DataFrame, number: int) -> None:
        with scope():
            take(batch, number)

    def take(batch: DataFrame, number: int) -> None:
        before = known
        if number:
            done = spark.read.schema(T.StructType([*known.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/isolates").filter(F.col("batch") < number)
            before = known.unionByName(done.drop("batch"))
        new = new_isolates(batch, before)
        new.select(known.columns).write.mode("overwrite").parquet(f"{out}/isolates/batch={number}")
        incremental_edges(new, before, snp_cutoff, day_cutoff).write.mode("overwrite").parquet(f"{out}/edges/batch={number}")
        if known_edges is None or known_clusters is None:
            return
        ends = [F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "composite_weight"]
        all_edges = spark.read.parquet(f"{out}/edges")
        edges = all_edges.filter(F.col("batch") == number).drop("batch")
        old = known_edges.select("src", "dst", "composite_weight").unionByName(all_edges.filter(F.col("batch") < number).select(*ends))
        was = spark.read.parquet(f"{out}/clusters/batch={number - 1}") if number else known_clusters
        update, clusters = updates(spark.read.schema(known.schema).parquet(f"{out}/isolates/batch={number}"), edges, old, was, before, threshold)
        clusters.write.mode("overwrite").parquet(f"{out}/clusters/batch={number}")
        update.write.mode("overwrite").parquet(f"{out}/updates/batch={number}")
        alerts(spark.read.parquet(f"{out}/updates/batch={number}")).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")

    job = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (job.trigger(availableNow=True) if once else job).start()


def replay_edges(spark: SparkSession, source: str, known: DataFrame, out: str, checkpoint: str, kind: str = "parquet", files_per_batch: int = 4) -> DataFrame:
    """The edges of all messages under source, taken once by the streaming job."""
    follow(spark, source, known, out, checkpoint, kind=kind, files_per_batch=files_per_batch, once=True).awaitTermination()
    return spark.read.parquet(f"{out}/edges").drop("batch")


def updates(new: DataFrame, edges: DataFrame, known_edges: DataFrame, known_clusters: DataFrame, iso: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(isolate_id, cluster, new_cluster_formed, centrality_score, transmission_alert) of every new isolate; and the clusters of all.

    All isolates are clustered anew with the new edges. A cluster is new if no cluster had its label before. The score
    is the isolate's betweenness over the largest of its component, without direction; 0 in a component without edges.
    Only components that hold a new isolate are measured.
    """
    with scope() as keep:
        update, clusters = _updates(new, edges, known_edges, known_clusters, iso, threshold)
        return keep(update, "updates"), keep(clusters, "clusters")


def _updates(new: DataFrame, edges: DataFrame, known_edges: DataFrame, known_clusters: DataFrame, iso: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    e = cut(known_edges.select("src", "dst", "composite_weight").unionByName(edges.select(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "composite_weight")), "all-edges")
    everyone = cut(iso.select("isolate_id").union(new.select("isolate_id")).distinct(), "all-isolates")
    label = cut(leiden(everyone, e), "labels-of-all")
    comp = connected_components(everyone.select(F.col("isolate_id").alias("node")), e)
    touched = new.select(F.col("isolate_id").alias("node")).join(comp, "node").select("component").distinct()
    comp = cut(comp.join(touched, "component", "left_semi"), "touched")
    arcs = e.join(comp.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst", F.col("composite_weight").alias("w"))
    between = cut(path_centrality(arcs, comp.select("node"), directed=False), "between")
    most = between.join(comp, "node").groupBy("component").agg(F.max("betweenness").alias("most"))
    score = between.join(comp, "node").join(most, "component").select(F.col("node").alias("isolate_id"), F.when(F.col("most") > 0, F.col("betweenness") / F.col("most")).otherwise(0.0).alias("centrality_score"))
    known = known_clusters.select(F.col("cluster").alias("community")).distinct().withColumn("was", F.lit(True))
    d = new.select("isolate_id").join(label, "isolate_id").join(score, "isolate_id").join(known, "community", "left")
    update = d.select("isolate_id", F.col("community").alias("cluster"), F.col("was").isNull().alias("new_cluster_formed"), "centrality_score", (F.col("centrality_score") >= threshold).alias("transmission_alert"))
    return update, label.select("isolate_id", F.col("community").alias("cluster"))


def alerts(update: DataFrame) -> DataFrame:
    """(isolate_id, cluster, risk, reason) of the updates that raise one."""
    return update.filter("transmission_alert").select("isolate_id", "cluster", F.col("centrality_score").alias("risk"), F.when(F.col("new_cluster_formed"), "new cluster").otherwise("central isolate").alias("reason"))


def status(isolates: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of what the job holds: isolates, edges, clusters."""
    return isolates.agg(F.count("*").alias("n_isolates")).join(edges.agg(F.count("*").alias("n_edges"))).join(clusters.agg(F.countDistinct("cluster").alias("n_clusters")))  # one row each
