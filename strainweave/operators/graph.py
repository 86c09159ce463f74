"""The weighted transmission graph: edges, degrees, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.functions.weights import composite_weight, st_mismatch


def edges(dist: DataFrame, iso: DataFrame, snp_cutoff: float = 20, day_cutoff: int = 14, alpha: float = 0.4, beta: float = 0.4, gamma: float = 0.2) -> DataFrame:
    """(src, dst, snp_distance, day_delta, mlst_mismatch, composite_weight) of the pairs within both cutoffs, inclusive.

    The distance filter comes before both lookups, so only close pairs are shuffled. Pairs with an isolate that iso
    lacks give no edge. snp_distance is rounded half to even; the weight uses the exact distance.
    """
    side = lambda p: iso.select(F.col("isolate_id").alias(p), F.col("collection_date").alias(f"{p}_day"), F.col("sequence_type").alias(f"{p}_st"))
    close = dist.filter(F.col("d") <= snp_cutoff).join(side("src"), "src").join(side("dst"), "dst")
    days = F.abs(F.datediff("src_day", "dst_day"))
    d = close.withColumn("day_delta", days).filter(F.col("day_delta") <= day_cutoff).withColumn("mlst_mismatch", st_mismatch(F.col("src_st"), F.col("dst_st")))
    weight = composite_weight(F.col("d"), F.col("day_delta"), F.col("mlst_mismatch"), snp_cutoff, day_cutoff, alpha, beta, gamma)
    return d.select("src", "dst", F.bround("d").cast("int").alias("snp_distance"), "day_delta", "mlst_mismatch", weight.alias("composite_weight"))


def both_ways(e: DataFrame, *columns: str) -> DataFrame:
    """Every edge in both directions, with the named columns."""
    return e.select("src", "dst", *columns).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))


def degrees(e: DataFrame, iso: DataFrame) -> DataFrame:
    """(isolate_id, degree, strength) of every isolate; strength sums exp(-weight)."""
    ends = both_ways(e, "composite_weight").groupBy("src").agg(F.count("*").alias("degree"), F.sum(F.exp(-F.col("composite_weight"))).alias("strength"))
    return iso.select("isolate_id").join(ends.withColumnRenamed("src", "isolate_id"), "isolate_id", "left").select("isolate_id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def graph_summary(e: DataFrame, iso: DataFrame, component: DataFrame) -> DataFrame:
    """One row of sizes, density, components, degree, and the ranges of weights and distances; zeros without edges."""
    n = iso.agg(F.count("*").alias("n_vertices"))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    m = e.agg(F.count("*").alias("n_edges"), zero(F.min("composite_weight"), 0.0).alias("weight_min"), zero(F.max("composite_weight"), 0.0).alias("weight_max"), zero(F.avg("composite_weight"), 0.0).alias("weight_mean"), zero(F.min("snp_distance"), 0).alias("snp_min"), zero(F.max("snp_distance"), 0).alias("snp_max"))
    c = component.groupBy("component").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_components"), zero(F.max("k"), 0).alias("largest_component_size"))
    nv, ne = F.col("n_vertices").cast("double"), F.col("n_edges").cast("double")
    one = n.join(m).join(c)  # one row each
    return one.select("n_vertices", "n_edges", F.when(F.col("n_vertices") < 2, 0.0).otherwise(F.try_divide(ne, nv * (nv - 1) / 2)).alias("density"), "n_components", "largest_component_size", zero(F.try_divide(2 * ne, nv), 0.0).alias("mean_degree"), "weight_min", "weight_max", "weight_mean", "snp_min", "snp_max")
