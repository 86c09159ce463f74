"""The SQL of the timestamp queries: the same notations, each read by its own expression."""

from __future__ import annotations

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAME = "((?i:" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS) + "))[.]?"
_WEEKDAY = r"(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])[.]?[Mm][.]?)?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?|\s*\[([^\]]+)\]|\s+\(?([A-Za-z][A-Za-z0-9_+/-]*)\)?)?"
_REST = rf"(?:(?:[Tt]|,?\s+){_CLOCK}{_ZONE})?"
_TIME = ["h", "mi", "s", "fr", "half", "off", "z1", "z2"]


def _shapes() -> list[tuple[str, str, list[str]]]:
    """(name, pattern, its groups) in the order in which they are tried."""
    out = [("year first", rf"(\d{{4}})[{c}](\d{{1,2}})[{c}](\d{{1,2}}){_REST}", ["y", "m", "d"]) for c in "-/."]
    out += [("year last", rf"(\d{{1,2}})[{c}](\d{{1,2}})[{c}](\d{{4}}|\d{{2}}){_REST}", ["d", "m", "y"]) for c in "-/."]
    out.append(("basic", rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(){_ZONE}", ["y", "m", "d"]))
    out += [("day, month name", rf"{_WEEKDAY}(\d{{1,2}})[ -]{_NAME}[ -](\d{{4}}){_REST}", ["d", "m", "y"]), ("month name, day", rf"{_WEEKDAY}{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}}){_REST}", ["m", "d", "y"])]
    return out


def _fields() -> str:
    cases = []
    for name, pattern, ymd in _shapes():
        p, names = pattern.replace("'", "''"), ymd + _TIME
        got = f"regexp_extract(v, '^{p}$', [{', '.join(repr(n) for n in names)}])"
        cases.append(f"WHEN regexp_full_match(v, '{p}') THEN struct_pack(" + ", ".join(f"{n} := nullif(({got}).{n}, '')" for n in ["y", "m", "d", *_TIME]) + f", name := '{name}')")
    return "CASE " + " ".join(cases) + " END"


_MONTH = f"CASE WHEN regexp_full_match(f.m, '[0-9]+') THEN TRY_CAST(f.m AS INT) ELSE list_position({[m[:3] for m in _MONTHS]}, lower(left(f.m, 3))) END"

NORMALISED = f"""
WITH zones AS (SELECT lower(trim(facility, {_WS})) AS source, min(trim(tz, {_WS})) AS zone FROM facilities WHERE trim(tz, {_WS}) IN (SELECT name FROM pg_timezone_names()) GROUP BY 1),
given AS (SELECT 'epi' AS src_table, row_id, collection_date, facility FROM epi UNION ALL SELECT 'isolate_payload', row_id, collection_date, facility FROM isolate_payload),
cleaned AS (SELECT src_table, row_id, trim(collection_date, {_WS}) AS v, zone FROM given LEFT JOIN zones ON source = lower(trim(facility, {_WS}))),
split AS (SELECT *, regexp_full_match(v, '[0-9]+') AS digits, length(v) AS n, {_fields()} AS f FROM cleaned),
numbers AS (SELECT *, TRY_CAST(f.y AS INT) + CASE WHEN length(f.y) = 2 THEN 2000 ELSE 0 END AS y0, {_MONTH} AS m0, TRY_CAST(f.d AS INT) AS d0, TRY_CAST(f.h AS INT) AS h0, TRY_CAST(f.mi AS INT) AS mi0, coalesce(TRY_CAST(f.s AS INT), 0) AS s0,
  coalesce(TRY_CAST(rpad(left(f.fr, 6), 6, '0') AS INT), 0) AS us0, coalesce(f.z1, f.z2) AS zone_name FROM split),
dated AS (SELECT *, CASE WHEN digits AND n = 8 THEN TRY_CAST(v[1:4] || '-' || v[5:6] || '-' || v[7:8] AS DATE)
  WHEN f IS NOT NULL AND y0 > 0 THEN TRY_CAST(lpad(y0::VARCHAR, 4, '0') || '-' || lpad((CASE WHEN f.name = 'year last' AND m0 > 12 THEN d0 ELSE m0 END)::VARCHAR, 2, '0') || '-' || lpad((CASE WHEN f.name = 'year last' AND m0 > 12 THEN m0 ELSE d0 END)::VARCHAR, 2, '0') AS DATE) END AS day,
  CASE WHEN f.half IS NULL THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN lower(f.half) = 'p' THEN 12 ELSE 0 END END AS hour,
  upper(coalesce(f.off, CASE WHEN regexp_full_match(zone_name, '[+-][0-9]{{2}}(:?[0-9]{{2}})?') THEN zone_name END)) AS off,
  MAP {{'Z': 0, 'UTC': 0, 'GMT': 0, 'CET': 60, 'CEST': 120, 'EST': -300, 'EDT': -240}}[upper(zone_name)] AS short FROM numbers),
clocked AS (SELECT *, CASE WHEN hour <= 23 AND mi0 <= 59 AND s0 <= 59 THEN day::TIMESTAMP + to_microseconds((hour * 3600 + mi0 * 60 + s0)::BIGINT * 1000000 + us0) END AS local,
  TRY_CAST(left(regexp_replace(off, '[^0-9]', '', 'g'), 2) AS INT) AS oh, coalesce(TRY_CAST(nullif(regexp_replace(off, '[^0-9]', '', 'g')[3:4], '') AS INT), 0) AS om FROM dated),
zoned AS (SELECT *, CASE WHEN off = 'Z' THEN 0 WHEN off IS NOT NULL THEN CASE WHEN oh <= 18 AND om <= 59 THEN CASE WHEN off[1] = '-' THEN -(oh * 60 + om) ELSE oh * 60 + om END END ELSE short END AS minutes,
  CASE WHEN zone_name IS NULL THEN coalesce(zone, 'UTC') WHEN zone_name IN (SELECT name FROM pg_timezone_names()) THEN zone_name END AS region FROM clocked),
late AS (SELECT *, CASE WHEN minutes IS NULL AND off IS NULL AND region IS NOT NULL THEN timezone(region, local) END AS t2 FROM zoned),
instants AS (SELECT *, CASE WHEN digits AND n = 10 THEN make_timestamp(TRY_CAST(v AS BIGINT) * 1000000) WHEN digits AND n = 13 THEN make_timestamp(TRY_CAST(v AS BIGINT) * 1000) WHEN digits AND n = 16 THEN make_timestamp(TRY_CAST(v AS BIGINT))
  WHEN minutes IS NOT NULL THEN local - to_microseconds(minutes::BIGINT * 60000000)
  WHEN timezone(region, t2 - INTERVAL 1 HOUR) = local THEN timezone('UTC', t2 - INTERVAL 1 HOUR) WHEN timezone(region, t2 - INTERVAL 30 MINUTE) = local THEN timezone('UTC', t2 - INTERVAL 30 MINUTE) ELSE timezone('UTC', t2) END AS instant FROM late),
normal AS (SELECT src_table, row_id, CASE WHEN digits AND n IN (10, 13, 16) OR f.h IS NOT NULL THEN strftime(instant, '%Y-%m-%dT%H:%M:%S.%fZ') ELSE strftime(day, '%Y-%m-%d') END AS normalised, CASE WHEN digits THEN 'digits' ELSE f.name END AS pattern FROM instants)
"""
FOUND = NORMALISED + "SELECT src_table, row_id, normalised FROM normal WHERE normalised IS NOT NULL"
REPORT = NORMALISED + "SELECT src_table, CASE WHEN normalised IS NOT NULL THEN pattern END AS pattern, count(*) AS n_rows, count(*) FILTER (length(normalised) = 10) AS n_days FROM normal GROUP BY ALL"
