"""Readers of matrices, metadata, profiles and sequences, with the checks of a load."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.functions.ids import strip
from strainweave.functions.labels import or_unknown, parse_day, sequence_type
from strainweave.operators.components import number_rows
from strainweave.operators.raw_records import tokenise
from strainweave.plans.shared import cut


class IngestionError(Exception):
    """Input that cannot be loaded, with the first thing that is wrong."""


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab, comma, semicolon or pipe, from the first 8192 characters; else tab where there is one, else comma."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(200).collect())[:8192]
    try:
        return csv.Sniffer().sniff(head, delimiters="\t,;|").delimiter
    except csv.Error:
        return "\t" if "\t" in head else ","


def _exists(spark: SparkSession, path: str, what: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise IngestionError(f"{what} file not found: {path}")


def read_matrix(spark: SparkSession, path: str, atol: float = 1e-6) -> DataFrame:
    """(src, dst, d), src_at < dst_at, with the places src_at and dst_at in the header: a checked square matrix in long form.

    Lines become cells (row, column, value), so the number of columns is no limit. Checks in order: file, empty, square,
    equal ids, numbers, missing, negative, diagonal, symmetry; the first that fails raises. Ids stay texts, zeros in
    front of them included. Distances of both directions are averaged.
    """
    _exists(spark, path, "matrix")
    sep = sniff_delimiter(spark, path)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("record_id"), F.lit(sep).alias("sep"), F.col("value").alias("line")).filter(strip(F.col("line")) != "")
    rows = number_rows(tokenise(lines).select("record_id", "fields"), ["record_id"], "line_no")
    head = rows.filter("line_no = 0").select("fields").head()
    ids = list(head["fields"][1:]) if head else []
    if not ids:
        raise IngestionError(f"matrix is empty: {path}")
    names = spark.createDataFrame(list(enumerate(ids)), "at bigint, id string")
    body = rows.filter("line_no > 0").select((F.col("line_no") - 1).alias("row"), F.get("fields", F.lit(0)).alias("row_id"), (F.size("fields") - 1).alias("width"), F.posexplode(F.slice("fields", F.lit(2), F.greatest(F.size("fields"), F.lit(1)))).alias("col", "text"))
    cells = cut(body.withColumn("d", F.col("text").try_cast("double")), "cells")
    shape = cells.agg(F.count_distinct("row").alias("rows"), F.min("width").alias("low"), F.max("width").alias("high")).first()
    if not shape["rows"]:
        raise IngestionError(f"matrix is empty: {path}")
    if shape["rows"] != len(ids) or shape["low"] != len(ids) or shape["high"] != len(ids):
        raise IngestionError(f"matrix is not square ({shape['rows']} rows, {len(ids)} columns): {path}")

    def first(bad: DataFrame, say) -> None:
        if r := bad.orderBy("row", "col").limit(1).collect():
            raise IngestionError(say(r[0]))

    named = cells.join(names.select(F.col("at").alias("col"), F.col("id").alias("col_id")), "col")
    first(named.filter("row = col and row_id <> col_id"), lambda r: f"row and column ids differ first at {r['row']}: {r['row_id']!r}, {r['col_id']!r}")
    blank = F.lower("text").isin("", "na", "nan", "null")
    first(named.filter(F.col("d").isNull() & ~blank), lambda r: f"not a number at ({r['row_id']}, {r['col_id']}): {r['text']!r}")
    first(named.filter(F.col("d").isNull() | F.isnan("d")), lambda r: f"missing value at ({r['row_id']}, {r['col_id']})")
    first(named.filter("d < 0"), lambda r: f"negative distance at ({r['row_id']}, {r['col_id']}): {r['d']}")
    first(named.filter((F.col("row") == F.col("col")) & (F.abs("d") > atol)), lambda r: f"non-zero diagonal at {r['row_id']}: {r['d']}")
    upper = named.filter("row < col").select("row", "col", "row_id", "col_id", "d")
    lower = cells.filter("row > col").select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("d").alias("back"))
    both = cut(upper.join(lower, ["row", "col"]), "matrix")
    if r := both.filter(F.abs(F.col("d") - F.col("back")) > atol).orderBy(F.desc(F.abs(F.col("d") - F.col("back"))), "row", "col").limit(1).collect():
        raise IngestionError(f"asymmetric distance at ({r[0]['row_id']}, {r[0]['col_id']}): {r[0]['d']} and {r[0]['back']}")
    return both.select(F.col("row_id").alias("src"), F.col("col_id").alias("dst"), ((F.col("d") + F.col("back")) / 2).alias("d"), F.col("row").alias("src_at"), F.col("col").alias("dst_at"))


def _table(spark: SparkSession, path: str, what: str, needed: list[str]) -> DataFrame:
    _exists(spark, path, what)
    raw = spark.read.csv(path, header=True, sep=sniff_delimiter(spark, path), multiLine=True, escape='"')
    have = {c.strip().lower(): c for c in raw.columns}
    if missing := [c for c in needed if c not in have]:
        raise IngestionError(f"{what} lacks the columns {', '.join(missing)}: {path}")
    return raw.select(F.monotonically_increasing_id().alias("row_id"), *[F.col(f"`{have[c]}`").alias(c) for c in needed])


def read_epi(spark: SparkSession, path: str) -> DataFrame:
    """(isolate_id, collection_date, facility, ward). Of repeated ids the last row wins. A day that cannot be read or lies ahead raises."""
    d = _table(spark, path, "metadata", ["isolate_id", "collection_date", "facility", "ward"]).withColumn("isolate_id", strip(F.col("isolate_id"))).filter("isolate_id is not null").withColumn("day", parse_day(F.col("collection_date")))
    if r := d.filter("day is null").orderBy("row_id").limit(1).collect():
        raise IngestionError(f"day of {r[0]['isolate_id']} cannot be read: {r[0]['collection_date']!r}")
    if r := d.filter(F.col("day") > F.current_date()).orderBy("row_id").limit(1).collect():
        raise IngestionError(f"day of {r[0]['isolate_id']} lies in the future: {r[0]['day']}")
    last = d.groupBy("isolate_id").agg(F.max_by(F.struct(F.col("day").alias("collection_date"), or_unknown(F.col("facility")).alias("facility"), or_unknown(F.col("ward")).alias("ward")), "row_id").alias("r"))
    return last.select("isolate_id", "r.*")


def read_mlst(spark: SparkSession, path: str) -> DataFrame:
    """(isolate_id, sequence_type); further columns are not read. Of repeated ids the last row wins."""
    d = _table(spark, path, "profiles", ["isolate_id", "st"]).withColumn("isolate_id", strip(F.col("isolate_id"))).filter("isolate_id is not null")
    return d.groupBy("isolate_id").agg(F.max_by(sequence_type(F.coalesce("st", F.lit(""))), "row_id").alias("sequence_type"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(isolate_id, seq) of the first record of every file: the first word after >, or the file's stem; in upper case."""
    d = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    d = d.select("file", lines.alias("lines")).withColumn("first", F.array_position(F.transform("lines", lambda x: x.startswith(">")), True))
    after = F.slice("lines", F.col("first").cast("int") + 1, F.size("lines"))
    stop = F.array_position(F.transform(after, lambda x: x.startswith(">")), True).cast("int")
    own = F.when(F.col("first") == 0, F.col("lines")).otherwise(F.concat(F.slice("lines", F.lit(1), F.greatest(F.col("first").cast("int") - 1, F.lit(0))), F.when(stop == 0, after).otherwise(F.slice(after, F.lit(1), F.greatest(stop - 1, F.lit(0))))))
    name = F.when(F.col("first") > 0, F.element_at(F.split(F.regexp_replace(F.element_at("lines", F.greatest(F.col("first").cast("int"), F.lit(1))), r"^>\s*", ""), r"\s+"), 1)).otherwise(F.regexp_replace("file", r"\.[^.]*$", ""))
    return d.select(name.alias("isolate_id"), F.upper(F.array_join(own, "")).alias("seq"))


def load(spark: SparkSession, matrix: str, epi: str, mlst: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(distances, isolates) of one run. An isolate of the matrix without metadata raises, naming the first five; further metadata is dropped."""
    dist = cut(read_matrix(spark, matrix), "distances")
    iso = read_epi(spark, epi)
    iso = iso.join(read_mlst(spark, mlst), "isolate_id", "left") if mlst else iso.withColumn("sequence_type", F.lit(None).cast("string"))
    iso = cut(iso, "isolates")
    ids = dist.select(F.col("src").alias("isolate_id")).union(dist.select("dst")).distinct()
    if missing := [r["isolate_id"] for r in ids.join(iso, "isolate_id", "left_anti").orderBy("isolate_id").limit(5).collect()]:
        raise IngestionError(f"isolates without metadata: {', '.join(missing)}")
    return dist.select("src", "dst", "d"), iso.join(ids, "isolate_id", "left_semi")
