"""From delivered rows to isolates and distances, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id
from strainweave.functions.labels import or_unknown, parse_day, sequence_type


def epi_records(epi: DataFrame) -> DataFrame:
    """One row an isolate: its last record (highest row_id) with a readable day. Blank facility and ward are `unknown`."""
    d = epi.select(clean_id(F.col("isolate_id")).alias("isolate_id"), "row_id", parse_day(F.col("collection_date")).alias("collection_date"), or_unknown(F.col("facility")).alias("facility"), or_unknown(F.col("ward")).alias("ward")).filter("isolate_id is not null and collection_date is not null")
    last = d.groupBy("isolate_id").agg(F.max_by(F.struct("collection_date", "facility", "ward"), "row_id").alias("r"))
    return last.select("isolate_id", "r.collection_date", "r.facility", "r.ward")


def mlst_profiles(mlst: DataFrame) -> DataFrame:
    """One row an isolate: the sequence type of its last row (highest row_id), null where that has none."""
    d = mlst.select(clean_id(F.col("isolate_id")).alias("isolate_id"), "row_id", sequence_type(F.col("st")).alias("sequence_type")).filter("isolate_id is not null")
    return d.groupBy("isolate_id").agg(F.max_by("sequence_type", "row_id").alias("sequence_type"))


def isolates(epi: DataFrame, mlst: DataFrame) -> DataFrame:
    """The isolates with metadata, their sequence type left-joined."""
    return epi_records(epi).join(mlst_profiles(mlst), "isolate_id", "left")


def distances(snp: DataFrame) -> DataFrame:
    """(src, dst, d), src < dst: the mean of all rows of a pair in either direction. Null distances and pairs of one isolate are left out."""
    a, b = clean_id(F.col("isolate_id")), clean_id(F.col("dst"))
    d = snp.select(a.alias("a"), b.alias("b"), "d").filter("a is not null and b is not null and a <> b and d is not null")
    return d.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.avg("d").alias("d"))


def matrix_ids(snp: DataFrame) -> DataFrame:
    """The distinct isolates of the matrix."""
    return snp.select(F.explode(F.array(clean_id(F.col("isolate_id")), clean_id(F.col("dst")))).alias("isolate_id")).filter("isolate_id is not null").distinct()


def unmatched_ids(snp: DataFrame, iso: DataFrame) -> DataFrame:
    """Isolates of the matrix without metadata: a load of these would be refused."""
    return matrix_ids(snp).join(iso, "isolate_id", "left_anti")


def matched_isolates(iso: DataFrame, snp: DataFrame) -> DataFrame:
    """The isolates that the matrix names."""
    return iso.join(matrix_ids(snp), "isolate_id", "left_semi")


def matrix_violations(snp: DataFrame, atol: float = 1e-6) -> DataFrame:
    """One row: counts of null and negative distances, of non-zero diagonal cells, and of pairs that differ by direction or row."""
    a, b = clean_id(F.col("isolate_id")), clean_id(F.col("dst"))
    d = snp.select(a.alias("a"), b.alias("b"), "d")
    cells = d.agg(F.count("*").alias("n_cells"), F.count_if(F.col("d").isNull()).alias("n_null"), F.count_if(F.col("d") < 0).alias("n_negative"), F.count_if((F.col("a") == F.col("b")) & (F.abs("d") > atol)).alias("n_diagonal"))
    pairs = d.filter("a is not null and b is not null and a <> b and d is not null").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg((F.max("d") - F.min("d")).alias("spread"))
    spread = pairs.agg(F.count_if(F.col("spread") > atol).alias("n_asymmetric"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("worst"))
    return cells.join(spread)  # one row each


def ingest_summary(iso: DataFrame) -> DataFrame:
    """One row: isolates, wards, sequence types, coverage by types, and the span of days."""
    days = F.datediff(F.max("collection_date"), F.min("collection_date"))
    return iso.agg(F.count("*").alias("n_isolates"), F.countDistinct("ward").alias("n_wards"), F.countDistinct("sequence_type").alias("n_sequence_types"), F.count("sequence_type").alias("n_covered"), F.min("collection_date").alias("first_day"), F.max("collection_date").alias("last_day"), days.cast("bigint").alias("span_days"), F.coalesce(days > 1825, F.lit(False)).alias("span_warning"), F.count_if(F.col("collection_date") > F.current_date()).alias("n_future"))
