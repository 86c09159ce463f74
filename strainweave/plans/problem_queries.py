"""Queries on damaged input: orphan references, mixed timestamps, lines that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainweave.operators import orphans, raw_records, timestamps
from strainweave.plans import timestamp_sql
from strainweave.plans.registry import query
from strainweave.plans.tables import table

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_TRIM = f"nullif(trim({{}}, {_WS}), '')"

_P1_CASES = f"""
WITH e AS (SELECT row_id, {_TRIM.format('isolate_id')} AS k, received_at, withdrawn_at FROM epi),
r AS (SELECT 'snp_matrix' AS ref_table, row_id, {_TRIM.format('isolate_id')} AS k, loaded_at AS t FROM snp_matrix
      UNION ALL SELECT 'mlst', row_id, {_TRIM.format('isolate_id')}, received_at FROM mlst),
named AS (SELECT {_TRIM.format('isolate_id')} AS k FROM snp_matrix UNION SELECT {_TRIM.format('dst')} FROM snp_matrix),
cases AS (
SELECT ref_table, strftime(t, '%Y-%m') AS period, row_id FROM r
WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.k = r.k AND e.received_at <= r.t AND (e.withdrawn_at IS NULL OR e.withdrawn_at > r.t))
UNION ALL
SELECT 'epi', strftime(received_at, '%Y-%m'), row_id FROM e WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM named WHERE named.k = e.k))
"""


def _three(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, folder, "snp_matrix"), table(spark, folder, "mlst"), table(spark, folder, "epi")


@query("p1_found", _P1_CASES + "SELECT * FROM cases")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference without a counterpart."""
    return orphans.isolate_orphans(*_three(spark, folder)).select("ref_table", "period", "row_id")


@query(
    "p1_orphan_report",
    _P1_CASES
    + f""", allrefs AS (SELECT ref_table, strftime(t, '%Y-%m') AS period FROM r WHERE k IS NOT NULL
UNION ALL SELECT 'epi', strftime(received_at, '%Y-%m') FROM e WHERE k IS NOT NULL)
SELECT a.ref_table, a.period, a.n_refs, coalesce(c.n_orphans, 0) AS n_orphans
FROM (SELECT ref_table, period, count(*) AS n_refs FROM allrefs GROUP BY ALL) a
LEFT JOIN (SELECT ref_table, period, count(*) AS n_orphans FROM cases GROUP BY ALL) c ON a.ref_table = c.ref_table AND a.period = c.period""",
)
def p1_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans per table and month."""
    return orphans.isolate_report(*_three(spark, folder))


# lines as lists of fields; a field is a quoted text or one without quotes, and a good line is nothing but fields and delimiters
_P5 = f"""
WITH lines AS (SELECT record_id, file_name, file_kind, line_no, sep, coalesce(CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END, '') AS line,
  '("(?:[^"]|"")*"|[^"' || sep || ']*)' AS field FROM raw_records),
cut AS (SELECT *, regexp_full_match(line, field || '(?:[' || sep || ']' || field || ')*') AS good,
  list_transform(regexp_extract_all(sep || line, '[' || sep || ']' || field, 1), lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END, {_WS})) AS f FROM lines),
heads AS (SELECT file_name, list_transform(arg_min(f, record_id), lambda x: lower(x)) AS names, arg_min(f, record_id)[2:] AS ids FROM cut WHERE line_no = 1 GROUP BY file_name),
recs AS (SELECT c.*, names, ids, list_position(names, 'isolate_id') AS at_id, list_position(names, 'collection_date') AS at_day FROM cut c LEFT JOIN heads USING (file_name) WHERE line_no IS DISTINCT FROM 1 AND trim(line, ' ') <> ''),
days AS (SELECT *, CASE WHEN file_kind = 'kp_epi' THEN {{day}} END AS day FROM (SELECT *, f[at_day] AS v FROM recs)),
judged AS (SELECT *, CASE WHEN NOT good THEN 'quoting' WHEN names IS NULL OR len(f) <> len(names) THEN 'columns'
  WHEN file_kind = 'kp_snp_matrix' AND (f[1] = '' OR NOT list_contains(ids, f[1])) OR file_kind = 'kp_epi' AND (at_id IS NULL OR f[at_id] = '') THEN 'id'
  WHEN file_kind = 'kp_snp_matrix' AND len(list_filter(f[2:], lambda x: NOT regexp_full_match(x, '[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') OR coalesce(TRY_CAST(ltrim(x, '+') AS DOUBLE), 'inf'::DOUBLE) = 'inf'::DOUBLE)) > 0
    OR file_kind = 'kp_epi' AND day IS NULL THEN 'value' END AS reason FROM days)
"""


def _one_day(pattern: str, out: str) -> str:
    return f"CASE WHEN regexp_full_match(v, '{pattern}') AND NOT starts_with(regexp_replace(v, '{pattern}', '{out}'), '0000') THEN TRY_CAST(regexp_replace(v, '{pattern}', '{out}') AS DATE) END"


_Y, _D = "([0-9]{4})", "([0-9]{1,2})"
_P5 = _P5.replace("{day}", "coalesce(" + ", ".join(_one_day(s.join(p), o) for s in "-/" for p, o in (((_Y, _D, _D), r"\1-\2-\3"), ((_D, _D, _Y), r"\3-\2-\1"))) + ")")


def _normalised(spark: SparkSession, folder: str) -> DataFrame:
    zones = table(spark, folder, "facilities")
    cols = ["row_id", "collection_date", "facility"]
    both = table(spark, folder, "epi").select(F.lit("epi").alias("src_table"), *cols).unionByName(table(spark, folder, "isolate_payload").select(F.lit("isolate_payload").alias("src_table"), *cols))
    return timestamps.normalise_timestamps(both, "collection_date", "facility", zones)


@query("p4_found", timestamp_sql.FOUND)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered collection date that can be read, in one form."""
    return _normalised(spark, folder).filter("normalised is not null").select("src_table", "row_id", "normalised")


@query("p4_pattern_report", timestamp_sql.REPORT)
def p4_pattern_report(spark: SparkSession, folder: str) -> DataFrame:
    """Values per table and pattern; pattern null: cannot be read."""
    return _normalised(spark, folder).groupBy("src_table", "pattern").agg(F.count("*").alias("n_rows"), F.count_if(F.length("normalised") == 10).alias("n_days"))


@query("p5_found", _P5 + "SELECT record_id, reason FROM judged WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that cannot be loaded, with the reason."""
    return raw_records.reject_reasons(table(spark, folder, "raw_records"))


@query("p5_clean_epi", _P5 + "SELECT record_id, nullif(f[at_id], '') AS isolate_id, day AS collection_date, nullif(f[list_position(names, 'facility')], '') AS facility, nullif(f[list_position(names, 'ward')], '') AS ward FROM judged WHERE file_kind = 'kp_epi' AND reason IS NULL")
def p5_clean_epi(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of the valid kp_epi lines."""
    return raw_records.clean_epi(table(spark, folder, "raw_records"))


@query("p5_clean_distances", _P5 + "SELECT record_id, f[1] AS isolate_id, ids[i] AS dst, TRY_CAST(ltrim(f[i + 1], '+') AS DOUBLE) AS d FROM judged, unnest(range(1, len(f))) AS u(i) WHERE file_kind = 'kp_snp_matrix' AND reason IS NULL")
def p5_clean_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Typed cells of the valid kp_snp_matrix lines."""
    return raw_records.clean_distances(table(spark, folder, "raw_records"))
