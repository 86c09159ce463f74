import random

import pytest
from plain_records import reasons

from strainweave.operators import raw_records

SCHEMA = "record_id long, file_name string, file_kind string, line_no int, sep string, line string, fields string, n_columns int"


def records(seed):
    rng, rows, k = random.Random(seed), [], 0
    bits = ['"', '""', ",", ";", "|", "\t", " ", "\n", "a", "1", ".5", "e3", "+2", "-1", "1e999", "NaN", "2020-1-1", "31/2/2020", "\r", "", "id1", "x'y"]
    for f in range(6):
        sep = rng.choice(",;|\t")
        kind = rng.choice(["kp_epi", "kp_snp_matrix"])
        head = sep.join(["x", "id1", "a", "1"]) if kind == "kp_snp_matrix" else sep.join(rng.sample(["Isolate_ID", "COLLECTION_date", "facility", "ward"], 4))
        rows.append((k := k + 1, f"f{f}", kind, 1, sep, head + rng.choice(["", "\r"]), "", 0))
        for n in range(60):
            parts = [rng.choice(["id1", "a", "1", "2020-02-29", "29/02/2021", "5", "", '"q"', '"a""b"', f'"{sep}"', '"\n"', " 3 ", "1e3"]) for _ in range(rng.choice([4, 4, 4, 3, 5]))]
            line = sep.join(parts) if rng.random() < 0.7 else "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
            rows.append((k := k + 1, f"f{f}", kind, n + 2, sep, line, "", 0))
    return rows


@pytest.mark.parametrize("heavy_rows", [10, 10**9])
def test_reasons_as_character_by_character(spark, heavy_rows):
    rows = records(7)
    names = ["record_id", "file_name", "file_kind", "line_no", "sep", "line"]
    want = reasons([dict(zip(names, r)) for r in rows])
    got = {r.record_id: r.reason for r in raw_records.reject_reasons(spark.createDataFrame(rows, SCHEMA), heavy_rows).collect()}
    lines = {r[0]: r[5] for r in rows}
    assert {k: (got.get(k), want.get(k), lines[k]) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}


def test_clean_rows_are_the_rest(spark):
    raw = spark.createDataFrame([(1, "e", "kp_epi", 1, ",", "ward,isolate_id,collection_date,facility,notes", "", 0), (2, "e", "kp_epi", 2, ",", ' "W,1" ', "", 0), (3, "e", "kp_epi", 3, ",", '"W,1",I1,1/2/2020,,n', "", 0), (4, "e", "kp_epi", 4, ",", "   ", "", 0), (5, "m", "kp_snp_matrix", 1, "\t", "id\tI1\tI2", "", 0), (6, "m", "kp_snp_matrix", 2, "\t", 'I1\t0\t"7.5"\r', "", 0), (7, "m", "kp_snp_matrix", 3, "\t", "I3\t0\t1", "", 0), (8, "none", "kp_epi", 2, ",", "a,b", "", 0), (9, "e", "kp_epi", 5, ",", None, "", 0)], SCHEMA)
    assert {r.record_id: r.reason for r in raw_records.reject_reasons(raw).collect()} == {2: "quoting", 7: "id", 8: "columns"}
    e = raw_records.clean_epi(raw).collect()
    assert [(r.record_id, r.isolate_id, str(r.collection_date), r.facility, r.ward) for r in e] == [(3, "I1", "2020-02-01", None, "W,1")]
    assert sorted((r.isolate_id, r.dst, r.d) for r in raw_records.clean_distances(raw).collect()) == [("I1", "I1", 0.0), ("I1", "I2", 7.5)]


def test_empty_and_very_wide(spark):
    assert raw_records.reject_reasons(spark.createDataFrame([], SCHEMA)).count() == 0
    ids = [f"I{i}" for i in range(6000)]
    wide = [(1, "m", "kp_snp_matrix", 1, ",", ",".join(["id", *ids]), "", 0), (2, "m", "kp_snp_matrix", 2, ",", ",".join(["I5", *["3"] * 6000]), "", 0), (3, "m", "kp_snp_matrix", 3, ",", ",".join(["I6", *["3"] * 5999, "x"]), "", 0), (4, "m", "kp_snp_matrix", 4, ",", '"' + "a" * 500_000, "", 0)]
    assert {r.record_id: r.reason for r in raw_records.reject_reasons(spark.createDataFrame(wide, SCHEMA)).collect()} == {3: "value", 4: "quoting"}
