"""Date-ordered chain clusters.

A greedy walk in the order of (day, id) puts an isolate into the oldest cluster that has a neighbour of it, else opens
one; clusters never merge. Said declaratively: orient every edge from the earlier end to the later one; an isolate
without an earlier neighbour founds a cluster; all others take the smallest founder among their earlier neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.operators.components import number_rows
from strainweave.plans.shared import cut, write_counted, write_step


def chain_clusters(iso: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(isolate_id, cluster_id): 0-based, by the founder's place in the order of (day, id).

    As many rounds as the longest dated chain; in each only the isolates whose founder changed in the one before send it
    on. A chain longer than max_rounds is an error.
    """
    ranked = cut(number_rows(iso.select("isolate_id", "collection_date"), ["collection_date", "isolate_id"], "place").select("isolate_id", "place"), "places")
    at = lambda p: ranked.select(F.col("isolate_id").alias(p), F.col("place").alias(f"{p}_at"))
    e = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    arcs = cut(e.select(F.least("src_at", "dst_at").alias("early"), F.greatest("src_at", "dst_at").alias("late")).distinct(), "arcs")
    first = ranked.join(arcs.select(F.col("late").alias("place")).distinct(), "place", "left_anti").select("place", F.col("place").alias("founder"))
    later = arcs.select(F.col("late").alias("place")).distinct().select("place", F.lit(None).cast("bigint").alias("founder"))
    now = write_step(first.unionByName(later).withColumn("changed", F.col("founder").isNotNull()), "founders")
    for k in range(max_rounds):
        got = arcs.join(now.df.filter("changed"), F.col("early") == F.col("place")).groupBy(F.col("late").alias("place")).agg(F.min("founder").alias("got"))
        step = now.df.select("place", F.col("founder").alias("old")).join(got, "place", "left").select("place", F.least("old", "got").alias("founder"), (~F.least("old", "got").eqNullSafe(F.col("old"))).alias("changed"))
        new, seen = write_counted(step, f"founders-{k}", changed=F.count_if("changed"))
        now.drop()
        now = new
        if not seen["changed"]:
            break
    else:
        raise RuntimeError("a chain is longer than max_rounds")
    ids = number_rows(now.df.select("founder").distinct(), ["founder"], "cluster_id")
    return ranked.join(now.df.select("place", "founder"), "place").join(ids, "founder").select("isolate_id", F.col("cluster_id").cast("int").alias("cluster_id"))
