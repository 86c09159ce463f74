"""The temporal graph: edges oriented by collection day, made acyclic, and read by level.

Within the uncertainty both directions hold, and each such pair is a cycle of two. Of every pair the direction against
the order (day, id) is dropped. All arcs then follow that order, so no cycle is left, and no arc is dropped that does
not lie on a cycle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strainweave.operators.components import connected_components
from strainweave.plans.shared import Written, cut, shared_folder, write_step


def orient(edges: DataFrame, iso: DataFrame, uncertainty_days: int = 2) -> DataFrame:
    """The edges' attributes with src, dst in transmission direction and the signed day_delta; both ways up to the uncertainty."""
    at = lambda p: iso.select(F.col("isolate_id").alias(p), F.col("collection_date").alias(f"{p}_day"))
    d = edges.join(at("src"), "src").join(at("dst"), "dst").withColumn("__delta", F.datediff("dst_day", "src_day"))
    rest = [c for c in edges.columns if c not in ("src", "dst", "day_delta")]
    there = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("__delta").alias("delta"))
    back = F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), (-F.col("__delta")).alias("delta"))
    ways = F.when(F.col("__delta") > uncertainty_days, F.array(there)).when(F.col("__delta") < -uncertainty_days, F.array(back)).otherwise(F.array(there, back))
    return d.withColumn("__way", F.explode(ways)).select(F.col("__way.a").alias("src"), F.col("__way.b").alias("dst"), F.col("__way.delta").alias("day_delta"), *rest)


def temporal_dag(edges: DataFrame, iso: DataFrame, uncertainty_days: int = 2) -> DataFrame:
    """The oriented edges, of ambiguous pairs only the direction that follows (day, id)."""
    follows = (F.col("day_delta") > 0) | ((F.col("day_delta") == 0) & (F.col("src") < F.col("dst")))
    return orient(edges, iso, uncertainty_days).filter(follows)


def sources_sinks(arcs: DataFrame, iso: DataFrame) -> DataFrame:
    """(isolate_id, is_source, is_sink); an isolate without arcs is both."""
    end = lambda c, name: arcs.select(F.col(c).alias("isolate_id")).distinct().withColumn(name, F.lit(True))
    d = iso.select("isolate_id").join(end("dst", "has_in"), "isolate_id", "left").join(end("src", "has_out"), "isolate_id", "left")
    return d.select("isolate_id", F.col("has_in").isNull().alias("is_source"), F.col("has_out").isNull().alias("is_sink"))


def peel(arcs: DataFrame, iso: DataFrame, max_rounds: int = 100_000) -> tuple[DataFrame, bool]:
    """(isolate_id, chain_length) of the isolates on no cycle and behind none; and whether that is all of them.

    Round by round the isolates without an arc to them leave, and their arcs with them: the round's number is the number
    of arcs on the longest path that ends there. What is left gets smaller every round; when nothing leaves, it holds cycles.
    """
    spark = iso.sparkSession
    root = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    rest = write_step(arcs.select("src", "dst").distinct(), "rest")
    left = write_step(iso.select("isolate_id").distinct(), "left")
    if not left.df.limit(1).count():
        return left.df.withColumn("chain_length", F.lit(0)), not rest.df.limit(1).count()
    for k in range(max_rounds):
        # one table a round, cut in two: who leaves, under the round's number, and who stays
        blocked = rest.df.select(F.col("dst").alias("isolate_id")).distinct()
        marked = left.df.select("isolate_id").join(blocked.withColumn("stays", F.lit(True)), "isolate_id", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
        seen = Observation()
        marked.observe(seen, F.count_if(~F.col("stays")).alias("free"), F.count_if("stays").alias("stay")).write.partitionBy("stays").parquet(f"{root}/chain_length={k}")
        n, now = seen.get, spark.read.schema("isolate_id string, stays boolean").parquet(f"{root}/chain_length={k}")
        last, left = (left, rest), Written(spark, f"{root}/chain_length={k}/stays=true", now.filter("stays").select("isolate_id"))
        rest = write_step(rest.df.join(now.filter("not stays").select(F.col("isolate_id").alias("src")), "src", "left_anti"), f"rest-{k}")
        for t in last:
            t.drop()
        if not n["free"] or not n["stay"]:
            found = spark.read.schema("isolate_id string, chain_length int, stays boolean").parquet(root)
            return found.filter("not stays").select("isolate_id", "chain_length"), not n["stay"] and not rest.df.limit(1).count()
    raise RuntimeError("a path is longer than max_rounds")


def longest_paths(arcs: DataFrame, iso: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(isolate_id, chain_length): arcs on the longest path that ends there. Raises on a cycle."""
    found, acyclic = peel(arcs, iso, max_rounds)
    if not acyclic:
        raise RuntimeError("the arcs hold a cycle")
    return found


def topological_rank(arcs: DataFrame, iso: DataFrame) -> DataFrame:
    """(isolate_id, level): every arc leads to a higher level."""
    return longest_paths(arcs, iso).withColumnRenamed("chain_length", "level")


def dag_summary(arcs: DataFrame, iso: DataFrame) -> DataFrame:
    """One row: sizes, sources, sinks, weak components, longest chain (of the part without cycles), and whether there is no cycle."""
    arcs = cut(arcs, "dag")
    ends = sources_sinks(arcs, iso).agg(F.count("*").alias("n_vertices"), F.count_if("is_source").alias("n_source_nodes"), F.count_if("is_sink").alias("n_sink_nodes"))
    comps = connected_components(iso.select(F.col("isolate_id").alias("node")), arcs).agg(F.countDistinct("component").alias("n_weakly_connected_components"))
    levels, acyclic = peel(arcs, iso)
    chain = levels.agg(F.coalesce(F.max("chain_length"), F.lit(0)).alias("max_chain_length"))
    one = ends.join(arcs.agg(F.count("*").alias("n_edges"))).join(comps).join(chain)  # one row each
    return one.select("n_vertices", "n_edges", "n_source_nodes", "n_sink_nodes", "n_weakly_connected_components", "max_chain_length", F.lit(acyclic).alias("is_dag"))
