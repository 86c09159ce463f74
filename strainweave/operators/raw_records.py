"""Delivered lines that fail to parse, with the reason, and all others as typed rows.

Lines are cut into cells by one pattern that knows quotes. Cells become rows (record, column, value), a table of rules
says which check a column of a kind of file gets, failed checks are aggregated to the first reason per record, and an
anti-join leaves the clean records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id, strip
from strainweave.operators.skew import heavy_keys, lookup_join
from strainweave.plans.shared import cut

#: Reasons in the order in which they apply.
REASONS = ["quoting", "columns", "id", "value"]

#: (kind of file, column, check, reason). Column * stands for every column after the first of a matrix.
RULES = [
    ("kp_snp_matrix", "isolate_id", "id in header", "id"),
    ("kp_snp_matrix", "*", "distance", "value"),
    ("kp_epi", "isolate_id", "id", "id"),
    ("kp_epi", "collection_date", "day", "value"),
]

#: Columns of the delivered lines that are read; further ones are left out.
COLUMNS = ["record_id", "file_name", "file_kind", "line_no", "sep", "line"]

_NUMBER = r"^\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _line(c: Column) -> Column:
    """The line without a final carriage return."""
    return F.when(c.endswith("\r"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(c)


def _tokens(line: Column, sep: Column) -> Column:
    """The raw fields of a line, quotes included, up to the first place that breaks the quoting rules."""
    d = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    not_sep = F.concat(F.lit('(?:(?!'), d, F.lit(')[^"])*+'))
    pattern = F.concat(F.lit("\\G"), d, F.lit('("[^"]*+(?:""[^"]*+)*+"|'), not_sep, F.lit(")(?="), d, F.lit("|\\z)"))
    return F.regexp_extract_all(F.concat(sep, line), pattern, F.lit(1))


def _unquote(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def tokenise(raw: DataFrame, *more: str) -> DataFrame:
    """The columns of COLUMNS that raw has, and those of `more`, with `fields` (trimmed texts of the cells) and `well_quoted`. Null lines count as blank."""
    d = raw.select(*[c for c in (*COLUMNS, *more) if c in raw.columns]).withColumn("line", F.coalesce(_line(F.col("line")), F.lit("")))
    d = d.select("*", F.explode(F.array(_tokens(F.col("line"), F.col("sep")))).alias("__tokens"))
    covered = F.aggregate("__tokens", F.lit(0), lambda n, t: n + F.length(t)) + F.size("__tokens") * F.length("sep")
    return d.withColumn("well_quoted", covered == F.length("line") + F.length("sep")).withColumn("fields", F.transform("__tokens", lambda t: strip(_unquote(t)))).drop("__tokens")


def headers(tokens: DataFrame) -> DataFrame:
    """(file_name, column names in lower case, ids of a matrix header as they are, number of columns), one row a file.

    A file with several header lines keeps the one with the smallest record_id.
    """
    h = tokens.filter("line_no = 1").groupBy("file_name").agg(F.min_by("fields", "record_id").alias("header"))
    return h.select("file_name", F.transform("header", F.lower).alias("columns"), F.slice("header", F.lit(2), F.greatest(F.size("header"), F.lit(1))).alias("header_ids"), F.size("header").alias("n_columns"))


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: four rows."""
    return spark.createDataFrame(RULES, "file_kind string, rule_column string, check string, reason string")


def parse_records(raw: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """The records of raw (neither header nor a line of spaces only) with their cells, and the header of their file.

    Every line is cut into cells once, and the result is written for all that reads it. Files may be very unequal:
    headers of files with many lines are broadcast, others joined by a shuffle, before the lines are cut. A file
    without a header gives null header columns; a line without a number is a record.
    """
    raw = raw.select(*[c for c in COLUMNS if c in raw.columns])
    named = headers(tokenise(raw.filter("line_no = 1")))
    body = raw.filter(F.col("line_no").isNull() | (F.col("line_no") != 1))
    joined = lookup_join(body, named, "file_name", heavy_keys(raw, "file_name", heavy_rows))
    tokens = tokenise(joined, "columns", "header_ids", "n_columns")
    return cut(tokens.filter(F.btrim("line", F.lit(" ")) != "").drop("line"), "records")  # a line of tabs has cells


def cells(records: DataFrame) -> DataFrame:
    """(record_id, file_kind, column, value, in_header): one row a cell of the records with the right number of fields."""
    fit = records.filter(F.col("well_quoted") & (F.size("fields") == F.col("n_columns")))
    e = fit.select("record_id", "file_kind", "columns", "header_ids", F.posexplode("fields").alias("pos", "value"))
    matrix = F.col("file_kind") == "kp_snp_matrix"
    first_of_name = F.array_position("columns", F.get("columns", F.col("pos"))) == F.col("pos") + 1
    column = F.when(matrix, F.when(F.col("pos") == 0, "isolate_id").otherwise("*")).when(first_of_name, F.get("columns", F.col("pos")))
    return e.select("record_id", "file_kind", column.alias("rule_column"), "value", F.when(matrix & (F.col("pos") == 0), F.array_contains("header_ids", F.col("value"))).alias("in_header"))


def existing_day(text: Column) -> Column:
    """The day written yyyy-M-d, yyyy/M/d, d/M/yyyy or d-M-yyyy, or null where it does not exist."""
    first = r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})$"
    last = r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})$"
    iso = F.when(text.rlike(first), F.regexp_replace(text, first, "$1-$3-$4")).when(text.rlike(last), F.regexp_replace(text, last, "$4-$3-$1"))
    return F.when(~iso.startswith("0000"), iso.try_cast("date"))


def distance(text: Column) -> Column:
    """The plain finite number >= 0 in text, or null."""
    n = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(n < F.lit(float("inf")), n)


def reject_reasons(raw: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """(record_id, reason): the first reason that applies, for every record that cannot be loaded.

    Null cells do not occur (an empty cell is an empty text). Records of a file without a header, or whose kp_epi
    header lacks a needed column, fail by `columns` and by `id` or `value`. An unknown kind of file is checked for
    quoting and number of columns only. Records repeated under one record_id give one row.
    """
    return _rejects(parse_records(raw, heavy_rows))


def _rejects(records: DataFrame) -> DataFrame:
    line_level = records.select("record_id", F.when(~F.col("well_quoted"), 0).when(F.col("n_columns").isNull() | (F.size("fields") != F.col("n_columns")), 1).when((F.col("file_kind") == "kp_epi") & ~F.array_contains("columns", "isolate_id"), 2).when((F.col("file_kind") == "kp_epi") & ~F.array_contains("columns", "collection_date"), 3).alias("rank"))
    checked = cells(records).join(F.broadcast(rules(records.sparkSession)), ["file_kind", "rule_column"])  # four rules
    v, check = F.col("value"), F.col("check")
    failed = F.when(check == "id", v == "").when(check == "id in header", (v == "") | ~F.coalesce("in_header", F.lit(False))).when(check == "distance", distance(v).isNull()).when(check == "day", existing_day(v).isNull())
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).cast("int") - 1
    bad = checked.filter(failed).select("record_id", rank.alias("rank"))
    first = line_level.filter("rank is not null").unionByName(bad).groupBy("record_id").agg(F.min("rank").alias("rank"))
    return first.select("record_id", F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("rank") + 1).alias("reason"))


def _clean(raw: DataFrame, kind: str, heavy_rows: int) -> DataFrame:
    records = parse_records(raw.filter(F.col("file_kind") == kind), heavy_rows)
    return records.join(_rejects(records), "record_id", "left_anti")


def clean_epi(raw: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """Typed kp_epi rows: (record_id, isolate_id, collection_date DATE, facility, ward). Blank or absent texts are null."""
    named = lambda c: clean_id(F.get("fields", F.array_position("columns", F.lit(c)).cast("int") - 1))
    return _clean(raw, "kp_epi", heavy_rows).select("record_id", named("isolate_id").alias("isolate_id"), existing_day(named("collection_date")).alias("collection_date"), named("facility").alias("facility"), named("ward").alias("ward"))


def clean_distances(raw: DataFrame, heavy_rows: int = 50_000) -> DataFrame:
    """Typed matrix cells: (record_id, isolate_id, dst, d DOUBLE), one row a cell, the diagonal included."""
    rows = _clean(raw, "kp_snp_matrix", heavy_rows)
    e = rows.select("record_id", F.get("fields", F.lit(0)).alias("isolate_id"), "header_ids", F.posexplode(F.slice("fields", F.lit(2), F.greatest(F.size("fields"), F.lit(1)))).alias("pos", "text"))
    return e.select("record_id", "isolate_id", F.get("header_ids", F.col("pos")).alias("dst"), distance(F.col("text")).alias("d"))
