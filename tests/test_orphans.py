from collections import Counter
from datetime import datetime as T
from datetime import timedelta

import pytest

from strainweave.operators import orphans

SNP = "row_id long, isolate_id string, dst string, loaded_at timestamp_ntz, key string, period string"
MLST = "row_id long, isolate_id string, received_at timestamp_ntz"
EPI = "row_id long, isolate_id string, received_at timestamp_ntz, withdrawn_at timestamp_ntz"


def plain(snp, mlst, epi):
    strip = lambda x: (x or "").strip(" \t") or None
    named = {strip(x) for r in snp for x in (r[1], r[2])} - {None}
    out = []
    for name, rows in (("snp_matrix", [(r[0], r[1], r[3]) for r in snp]), ("mlst", mlst)):
        for k, i, t in rows:
            ok = t and any(strip(e[1]) == strip(i) and e[2] and e[2] <= t and (e[3] is None or e[3] > t) for e in epi)
            if strip(i) and not ok:
                out.append((name, t and t.strftime("%Y-%m"), k))
    out += [("epi", e[2] and e[2].strftime("%Y-%m"), e[0]) for e in epi if strip(e[1]) and strip(e[1]) not in named]
    return sorted(out, key=str)


@pytest.mark.parametrize(("heavy_rows", "max_pieces"), [(1, 100), (2, 0), (1, 0), (10**9, 100)])
def test_orphans_as_by_hand(spark, heavy_rows, max_pieces):
    a = T(2020, 1, 31, 23, 59)
    snp = [(1, "A", "B", a, "x", "y"), (2, " A\t", "C", T(2020, 1, 1), "x", "y"), (3, None, "D", a, None, None), (4, "  ", "E", a, "x", "y"), (5, "W", "A", T(2020, 3, 5), "x", "y"), (6, "W", "A", T(2020, 5, 1), "x", "y"), (7, "W", "A", T(2020, 4, 30, 23, 59), "x", "y"), (8, "A", "B", None, "x", "y"), (1, "A", "B", a, "x", "y"), (9, "a", "B", a, "x", "y"), (10, "Q", "B", T(2021, 1, 1), "x", "y")]
    mlst = [(1, "A", a), (2, "N", a), (3, "W", T(2020, 2, 1)), (4, "W", T(2020, 2, 1)), (5, "R", T(2022, 1, 1))]
    epi = [(1, "A", T(2020, 1, 15), None), (2, "A", T(2020, 1, 20), None), (3, "W", T(2020, 2, 1), T(2020, 5, 1)), (4, "W", T(2020, 6, 1), T(2020, 5, 1)), (5, "Z", T(2020, 6, 1), None), (6, None, T(2020, 6, 1), None), (7, "E ", None, None), (8, "R", T(2021, 1, 1), T(2022, 1, 1)), (9, "R", T(2022, 1, 1), T(2022, 1, 1)), (10, "Q", T(2020, 12, 31), T(2021, 1, 2))]
    three = spark.createDataFrame(snp, SNP), spark.createDataFrame(mlst, MLST), spark.createDataFrame(epi, EPI)
    got, want = orphans.isolate_orphans(*three, heavy_rows, max_pieces), plain(snp, mlst, epi)
    assert sorted(((r.ref_table, r.period, r.row_id) for r in got.collect()), key=str) == want
    report = {(r.ref_table, r.period): r.n_orphans for r in orphans.isolate_report(*three, heavy_rows, max_pieces).collect()}
    assert {k: v for k, v in report.items() if v} == Counter((t, p) for t, p, _ in want)


def test_empty_tables(spark):
    snp, mlst, epi = (spark.createDataFrame([], s) for s in (SNP, MLST, EPI))
    found = orphans.isolate_orphans(snp, mlst, epi)
    assert found.count() == 0
    assert orphans.isolate_report(snp, mlst, epi).count() == 0
    one = spark.createDataFrame([(1, "A", T(2020, 1, 1))], MLST)
    r = orphans.isolate_report(snp, one, epi).collect()
    assert [tuple(x) for x in r] == [("mlst", "2020-01", 1, 1)]


def test_withdrawn_over_many_months(spark):
    epi = spark.createDataFrame([(1, "A", T(2019, 1, 10), T(2021, 12, 3))], EPI)
    times = [T(2019, 1, 9), T(2019, 1, 10), T(2019, 2, 1), T(2020, 2, 29), T(2021, 12, 2, 23), T(2021, 12, 3)]
    mlst = spark.createDataFrame([(i, "A", t) for i, t in enumerate(times)], MLST)
    snp = spark.createDataFrame([(1, None, "A", None, None, None)], SNP)
    assert sorted(r.row_id for r in orphans.isolate_orphans(snp, mlst, epi).collect()) == [0, 5]


def test_an_orphan_that_holds_half_of_all_rows(spark):
    day = T(2020, 1, 1)
    snp = [(i, "gone" if i % 2 else f"k{i % 50}", None, day + timedelta(i % 300), None, None) for i in range(4000)]
    epi = [(1, "gone", day, day + timedelta(100)), (2, "gone", day + timedelta(150), day + timedelta(200))] + [(9 + k, f"k{k}", day + timedelta(k), None) for k in range(50)]
    three = spark.createDataFrame(snp, SNP), spark.createDataFrame([], MLST), spark.createDataFrame(epi, EPI)
    want = plain(snp, [], epi)
    assert sum(1 for t, _, k in want if t == "snp_matrix" and k % 2) > 900
    for max_pieces in (100, 0):
        got = orphans.isolate_orphans(*three, heavy_rows=500, max_pieces=max_pieces).collect()
        assert sorted(((r.ref_table, r.period, r.row_id) for r in got), key=str) == want
