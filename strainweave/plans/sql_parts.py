"""Common table expressions that the SQL of several queries starts from."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def trim(c: str) -> str:
    return f"trim({c}, {WHITE})"


def clean(c: str) -> str:
    return f"nullif({trim(c)}, '')"


def day(c: str) -> str:
    """The reader's day formats, in their order."""
    v, a, b = trim(c), "([0-9]{4})", "([0-9]{1,2})"

    def one(pattern: str, out: str) -> str:
        return f"CASE WHEN regexp_matches({v}, '{pattern}') THEN try_cast(regexp_replace({v}, '{pattern}', '{out}') AS DATE) END"

    return "coalesce(" + ", ".join([one(f"^{a}-{b}-{b}$", r"\1-\2-\3"), one(f"^{b}/{b}/{a}$", r"\3-\2-\1"), one(f"^{b}-{b}-{a}$", r"\3-\2-\1"), one(f"^{a}/{b}/{b}$", r"\1-\2-\3"), one(f"^{b}/{b}/{a}$", r"\3-\1-\2"), one(f"^{a}-{b}-{b}[T ][0-9]{{2}}:.*$", r"\1-\2-\3")]) + ")"


def st(c: str) -> str:
    v = trim(c)
    bare = f"CASE WHEN starts_with(upper({v}), 'ST') THEN {trim(f'substr({v}, 3)')} ELSE {v} END"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN lower({v}) IN ('', 'novel', '-', '–', 'na', 'nan') OR {bare} = '' THEN 'novel' ELSE {bare} END"


EPI = f"""epi1 AS (SELECT {clean('isolate_id')} AS isolate_id, row_id, {day('collection_date')} AS collection_date, coalesce({clean('facility')}, 'unknown') AS facility, coalesce({clean('ward')}, 'unknown') AS ward FROM epi),
epi2 AS (SELECT isolate_id, max_by(collection_date, row_id) AS collection_date, max_by(facility, row_id) AS facility, max_by(ward, row_id) AS ward FROM epi1 WHERE isolate_id IS NOT NULL AND collection_date IS NOT NULL GROUP BY isolate_id)"""
MLST = f"""mlst1 AS (SELECT {clean('isolate_id')} AS isolate_id, row_id, {st('st')} AS sequence_type FROM mlst),
mlst2 AS (SELECT isolate_id, arg_max_null(sequence_type, row_id) AS sequence_type FROM mlst1 WHERE isolate_id IS NOT NULL GROUP BY isolate_id)"""
ISO = f"{EPI},\n{MLST},\nalliso AS (SELECT e.*, m.sequence_type FROM epi2 e LEFT JOIN mlst2 m USING (isolate_id))"
IDS = f"ids AS (SELECT {clean('isolate_id')} AS isolate_id FROM snp_matrix WHERE {clean('isolate_id')} IS NOT NULL UNION SELECT {clean('dst')} FROM snp_matrix WHERE {clean('dst')} IS NOT NULL)"
V = f"{ISO},\n{IDS},\niso AS (SELECT a.* FROM alliso a WHERE isolate_id IN (SELECT isolate_id FROM ids))"
DIST = f"""dist1 AS (SELECT {clean('isolate_id')} AS a, {clean('dst')} AS b, d FROM snp_matrix WHERE d IS NOT NULL),
dist AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, avg(d) AS d FROM dist1 WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY ALL)"""
EDGES = f"""{V},
{DIST},
pairs AS (SELECT src, dst, d, abs(date_diff('day', x.collection_date, y.collection_date)) AS days, coalesce(nullif(x.sequence_type, '') <> nullif(y.sequence_type, ''), false) AS mm
  FROM dist JOIN iso x ON x.isolate_id = src JOIN iso y ON y.isolate_id = dst WHERE d <= 20),
edges AS (SELECT src, dst, CAST(round_even(d, 0) AS INT) AS snp_distance, CAST(days AS INT) AS day_delta, mm AS mlst_mismatch,
  CAST(0.4 AS DOUBLE) * (d / CAST(20 AS DOUBLE)) + CAST(0.4 AS DOUBLE) * (CAST(days AS DOUBLE) / CAST(14 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * (CASE WHEN mm THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS composite_weight FROM pairs WHERE days <= 14)"""
SYM = "sym AS (SELECT src AS a, dst AS b, composite_weight AS w FROM edges UNION ALL SELECT dst, src, composite_weight FROM edges)"
REACH = """reach(id, g) USING KEY (id) AS (
  SELECT isolate_id, isolate_id FROM iso
  UNION
  SELECT s.b, min(r.g) FROM reach r JOIN sym s ON s.a = r.id JOIN recurring.reach cur ON cur.id = s.b WHERE r.g < cur.g GROUP BY s.b)"""
COMP = f"{EDGES},\n{SYM},\n{REACH}"
RANK = "ranked AS (SELECT isolate_id, collection_date, row_number() OVER (ORDER BY collection_date, isolate_id) - 1 AS place FROM iso)"
CHAINS = f"""{EDGES},
{RANK},
arcs AS (SELECT least(x.place, y.place) AS early, greatest(x.place, y.place) AS late FROM edges JOIN ranked x ON x.isolate_id = src JOIN ranked y ON y.isolate_id = dst),
walk(place, founder) AS (
  SELECT place, place FROM ranked WHERE place NOT IN (SELECT late FROM arcs)
  UNION
  SELECT a.late, w.founder FROM walk w JOIN arcs a ON a.early = w.place),
chains AS (SELECT isolate_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INT) AS cluster_id FROM (SELECT place, min(founder) AS f FROM walk GROUP BY place) JOIN ranked USING (place))"""
ARCS = f"""{EDGES},
dated AS (SELECT e.*, x.collection_date AS sd, y.collection_date AS td FROM edges e JOIN iso x ON x.isolate_id = src JOIN iso y ON y.isolate_id = dst),
oriented AS (
  SELECT src AS a, dst AS b, date_diff('day', sd, td) AS delta, composite_weight FROM dated WHERE date_diff('day', sd, td) >= -2
  UNION ALL
  SELECT dst, src, date_diff('day', td, sd), composite_weight FROM dated WHERE date_diff('day', sd, td) <= 2),
arcs AS (SELECT a AS src, b AS dst, composite_weight FROM oriented WHERE delta > 0 OR (delta = 0 AND a < b))"""


# shortest paths in the graph of arcs: down by direction, around without; floored weights
PATHS = """flo AS (SELECT src, dst, greatest(composite_weight, CAST(1e-6 AS DOUBLE)) AS w FROM arcs),
both_ways AS (SELECT src, dst, w FROM flo UNION ALL SELECT dst, src, w FROM flo),
around(s, v, d) USING KEY (s, v) AS (
  SELECT isolate_id, isolate_id, CAST(0 AS DOUBLE) FROM iso
  UNION
  SELECT a.s, e.dst, min(a.d + e.w) FROM around a JOIN both_ways e ON e.src = a.v LEFT JOIN recurring.around cur ON cur.s = a.s AND cur.v = e.dst WHERE cur.d IS NULL OR a.d + e.w < cur.d GROUP BY a.s, e.dst),
down(s, v, d) USING KEY (s, v) AS (
  SELECT isolate_id, isolate_id, CAST(0 AS DOUBLE) FROM iso
  UNION
  SELECT a.s, e.dst, min(a.d + e.w) FROM down a JOIN flo e ON e.src = a.v LEFT JOIN recurring.down cur ON cur.s = a.s AND cur.v = e.dst WHERE cur.d IS NULL OR a.d + e.w < cur.d GROUP BY a.s, e.dst),
tight AS (SELECT x.s, e.src AS u, e.dst AS v FROM down x JOIN flo e ON e.src = x.v JOIN down y ON y.s = x.s AND y.v = e.dst WHERE abs(x.d + e.w - y.d) <= 1e-10::DOUBLE * greatest(1.0::DOUBLE, y.d)),
routes(s, v) AS (SELECT isolate_id, isolate_id FROM iso UNION ALL SELECT r.s, t.v FROM routes r JOIN tight t ON t.s = r.s AND t.u = r.v),
sigma AS (SELECT s, v, count(*)::DOUBLE AS n FROM routes GROUP BY s, v),
between AS (SELECT a.v AS isolate_id, sum(na.n * nb.n / nt.n) AS b FROM down a JOIN down b ON b.s = a.v JOIN down t ON t.s = a.s AND t.v = b.v
  JOIN sigma na ON na.s = a.s AND na.v = a.v JOIN sigma nb ON nb.s = b.s AND nb.v = b.v JOIN sigma nt ON nt.s = t.s AND nt.v = t.v
  WHERE a.s <> a.v AND b.v <> a.v AND abs(a.d + b.d - t.d) <= 1e-10::DOUBLE * greatest(1.0::DOUBLE, t.d) GROUP BY a.v),
close AS (SELECT s AS isolate_id, (count(*) - 1) / sum(d) AS c FROM around GROUP BY s HAVING count(*) > 1),
paths AS (SELECT isolate_id, coalesce(b, 0) AS betweenness, coalesce(c, 0) AS closeness FROM iso LEFT JOIN between USING (isolate_id) LEFT JOIN close USING (isolate_id))"""
# an edge is in the forest if smaller edges do not link its ends
FOREST = """numbered AS (SELECT *, row_number() OVER (ORDER BY composite_weight, src, dst) AS k FROM edges),
two_ways AS (SELECT src AS a, dst AS b, k FROM numbered UNION ALL SELECT dst, src, k FROM numbered),
linked(e, node) AS (SELECT k, src FROM numbered UNION SELECT l.e, t.b FROM linked l JOIN two_ways t ON t.a = l.node AND t.k < l.e),
forest AS (SELECT n.* FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.e = n.k AND l.node = n.dst))"""


def with_(parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"
