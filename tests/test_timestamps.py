from plain_timestamps import plain

from strainweave.operators.timestamps import normalise_timestamps

ZONES = [("Berlin ", "Europe/Berlin", 1), ("NEW YORK", "America/New_York", 2), ("nowhere", "Mars/Base", 3), (None, "Asia/Tokyo", 4), ("Lord Howe", "Australia/Lord_Howe", 5)]
VALUES = [
    None, "", "  ", "\t2020-02-29 ", "2021-02-29", "2020/2/9", "31/12/2023", "12/31/2023", "13/13/2023", "1-2-2020", "01.02.21", "00/00/0000", "20200230", "20200229", "1547484204", "1547484204573", "1547484204573999", "154748420457399", "99999999999",
    "2021-10-31T02:30:00", "2021-03-28T02:30:00", "2021-11-07 01:30", "2021-03-14 02:30:15.1234567", "2021-10-31 02:30:00+01:00", "2021-10-31T02:30:00Z", "20211031T023000Z", "2021-10-31T02:30:00.123456789Z", "2021-10-31T02:30:00[America/Chicago]", "2021-10-31 02:30:00 Asia/Kolkata",
    "2021-10-31 02:30:00 CEST", "2021-10-31 02:30:00 EST", "2021-10-31 02:30:00 XYZ", "2021-10-31 02:30:00 Mars/Base", "2021-10-31T24:00:00Z", "2021-10-31T25:10:00Z", "2021-10-31T02:60:00Z", "Fri, 01 May 2020 13:19:56 +0300", "10 Aug 2019 6:02 PM", "10 Aug 2019 12:02 AM", "10 Aug 2019 13:02 AM", "10 Aug 2019",
    "31 Feb 2019", "December 1, 2021", "dec 1, 2021", "Foo 1, 2021", "2024-W17", "2020-06", "yesterday", "2021-06-1O", "1" * 40, "x" * 100_000, "2021-04-04T01:45:00", "2021-10-03T02:15:00", "2019-01-24 23:54:03+1245", "2019-01-24 23:54:03-03", "1969-12-31T23:59:59.999999Z", "0001-01-01T00:00:00Z",
]


def test_as_row_by_row(spark):
    sources = ["berlin", " New York", "NOWHERE", "elsewhere", None, "lord howe"]
    rows = [(i * 10 + j, v, s, "mine", "too") for i, v in enumerate(VALUES) for j, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "row_id long, value string, facility string, pattern string, tz string")
    zones = spark.createDataFrame(ZONES, "facility string, tz string, beds int")
    got = {r.row_id: r.normalised for r in normalise_timestamps(df, "value", "facility", zones).collect()}
    zone = {"berlin": "Europe/Berlin", "new york": "America/New_York", "lord howe": "Australia/Lord_Howe"}
    want = {k: plain(v, zone.get((s or "").strip().lower())) for k, v, s, *_ in rows}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}


def test_first_of_two_and_skipped(spark):
    zones = spark.createDataFrame(ZONES, "facility string, tz string, beds int")
    df = spark.createDataFrame([("2021-10-31T02:30:00", "Berlin"), ("2021-03-28T02:30:00", "Berlin")], "value string, facility string")
    assert [r.normalised for r in normalise_timestamps(df, "value", "facility", zones).collect()] == ["2021-10-31T00:30:00.000000Z", "2021-03-28T01:30:00.000000Z"]


def test_session_zone_and_empty_inputs(spark):
    zones = spark.createDataFrame([], "facility string, tz string")
    df = spark.createDataFrame([("2021-07-01T12:00:00", "a"), ("1547484204", None)], "value string, facility string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r.normalised for r in normalise_timestamps(df, "value", "facility", zones).collect()] == ["2021-07-01T12:00:00.000000Z", "2019-01-14T16:43:24.000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert normalise_timestamps(df.limit(0), "value", "facility", zones).count() == 0
