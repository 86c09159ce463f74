"""Top N items within every group, in descending bands of the score.

Band edges are approximate quantiles of all scores; equal scores always share a band, so a tie is never cut by an edge.
The rows, an item once per group, are written once, partitioned by band; then each band is read alone, from the top. A
group with N items from higher bands is filled: its rows in lower bands are dropped by an anti-join before any ranking.
The band in which a group fills up is finished with an exact ranking by score and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id
from strainweave.operators.skew import HEAVY_ROWS, MAX_HEAVY
from strainweave.plans.shared import write_step

#: Shares of the rows above each inner band edge.
SHARES = (0.02, 0.1, 0.35)


def band_edges(quantiles: list[float] | None) -> list[float]:
    """Distinct inner edges, descending; none for an empty input. They only place the work: any edges give the same result."""
    return sorted({float(x) for x in quantiles or []}, reverse=True)


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The n best (g, i, s) of each group with rank_no; rows hold an item once a group.

    The ranking keeps at most n rows a group in every map task before it shuffles, so a group of any size is spread.
    """
    w = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))
    return rows.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= n)


def _band(score: Column, edges: list[float]) -> Column:
    """The number of the band: how many edges lie above the score."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in edges]).cast("array<double>"), lambda x: x > score))


def _open(band: DataFrame, filled: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows of the band whose group isn't filled: those of heavy groups meet a broadcast of the filled ones among them."""
    hot = band.filter("hot").join(F.broadcast(filled.join(F.broadcast(heavy), "g", "left_semi")), "g", "left_anti")
    return hot.unionByName(band.filter("not hot").join(filled, "g", "left_anti"))


def top_items(df: DataFrame, group: str, item: str, score: str, n: int = 5, shares: tuple[float, ...] = SHARES, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(group, rank_no, item, score): the n highest items of every group by score, then item in byte order.

    An item counts once per group with its highest score. Rows with a null group, item or score or a NaN score do not
    count; items are trimmed. -0.0 equals 0.0. Groups with fewer than n items give them all; an empty input gives none.
    The input is read twice: for the edges and the heavy groups, and to be written; then every band once.
    """
    s = F.col(score).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(group).isNotNull()).select(F.col(group).alias("g"), clean_id(F.col(item)).alias("i"), (s + F.lit(0.0)).alias("s")).filter("i is not null")
    seen = Observation()
    sizes = write_step(rows.observe(seen, F.percentile_approx("s", [1.0 - x for x in shares], 10_000).alias("q")).groupBy("g").agg(F.count("*").alias("k")), "group-sizes").df
    edges = band_edges(seen.get["q"]) if sizes.limit(1).count() else []  # without rows nothing is observed
    heavy = sizes.filter(F.col("k") >= heavy_rows).orderBy(F.desc("k"), "g").limit(MAX_HEAVY).select("g")
    # an item's best score decides its band; combined before the shuffle, and no group is gathered by it
    once = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
    hot = once.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "g", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    bands = write_step(hot.withColumn("band", _band(F.col("s"), edges)), "bands", ["band", "hot"])
    kept = None
    for k in range(len(edges) + 1):
        band = bands.df.filter(F.col("band") == k).select("g", "i", "s", "hot")
        if kept is not None:
            filled = kept.df.groupBy("g").agg(F.count("*").alias("k")).filter(F.col("k") >= n).select("g")
            band = _open(band, filled, heavy).drop("hot").unionByName(kept.df)
        best = _best(band.select("g", "i", "s"), n)
        if k == len(edges):
            return best.select(F.col("g").alias(group), F.col("rank_no").cast("int").alias("rank_no"), F.col("i").alias(item), F.col("s").alias(score))
        kept = write_step(best.select("g", "i", "s"), "kept")
    raise AssertionError("the last band is always reached")
