"""Problem 2 against the standard library's zone arithmetic and by cases."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.operators import timestamps as ts

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def one(text, zone="UTC", order="dmy"):
    us, ok = ts.instants([text], [zone], [order])
    return (EPOCH + timedelta(microseconds=int(us[0]))).isoformat() if ok[0] else None


@pytest.mark.parametrize(
    ("text", "zone", "order", "utc"),
    [
        ("2024-03-05 10:20:30", "Asia/Kolkata", "dmy", "2024-03-05T04:50:30+00:00"),
        ("2023-10-29 02:30:00", "Europe/Berlin", "dmy", "2023-10-29T00:30:00+00:00"),
        ("2023-03-26 02:30:00", "Europe/Berlin", "dmy", "2023-03-26T01:30:00+00:00"),
        ("2021-04-04 01:45:00", "Australia/Lord_Howe", "dmy", "2021-04-03T14:45:00+00:00"),
        ("2021-10-03 02:15:00", "Australia/Lord_Howe", "dmy", "2021-10-02T15:45:00+00:00"),
        ("03/04/2024 01:02:03 PM", "America/New_York", "mdy", "2024-03-04T18:02:03+00:00"),
        ("3/4/2024 13:02:03", "Europe/Berlin", "dmy", "2024-04-03T11:02:03+00:00"),
        ("2024/3/4 13:02", "UTC", "mdy", "2024-03-04T13:02:00+00:00"),
        ("12:00 AM", "UTC", "mdy", None),
        ("March 5, 2024 12:07 AM", "UTC", "mdy", "2024-03-05T00:07:00+00:00"),
        ("Tue, 05 Mar 2024 10:20:30 -0700", "UTC", "mdy", "2024-03-05T17:20:30+00:00"),
        ("05-Mar-24 10:20:30", "UTC", "mdy", "2024-03-05T10:20:30+00:00"),
        ("2024-03-05T10:20:30,5+05", "UTC", "mdy", "2024-03-05T05:20:30.500000+00:00"),
        ("2024-03-05T10:20:30.123456789Z", "UTC", "mdy", "2024-03-05T10:20:30.123456+00:00"),
        ("2024-03-05T10:20:30−05:00", "UTC", "mdy", "2024-03-05T15:20:30+00:00"),
        ("2024-03-05 10:20:30 GMT+3", "UTC", "mdy", "2024-03-05T07:20:30+00:00"),
        ("2024-03-05 10:20:30 IST", "Asia/Kolkata", "dmy", "2024-03-05T04:50:30+00:00"),
        ("2024-07-05 10:20:30 BST", "Europe/London", "dmy", "2024-07-05T09:20:30+00:00"),
        ("2024-03-05T10:20:30[Asia/Tokyo]", "UTC", "dmy", "2024-03-05T01:20:30+00:00"),
        ("2020-W53-7T00:00:00Z", "UTC", "dmy", "2021-01-03T00:00:00+00:00"),
        ("2024-366T00:00:00Z", "UTC", "dmy", "2024-12-31T00:00:00+00:00"),
        ("20240305T102030", "UTC", "dmy", "2024-03-05T10:20:30+00:00"),
        ("1700000000", "UTC", "dmy", "2023-11-14T22:13:20+00:00"),
        ("1700000000123", "UTC", "dmy", "2023-11-14T22:13:20.123000+00:00"),
        ("1700000000123456", "UTC", "dmy", "2023-11-14T22:13:20.123456+00:00"),
        ("1700000000.5", "UTC", "dmy", "2023-11-14T22:13:20.500000+00:00"),
        ("2024-13-05T08:00:00Z", "UTC", "dmy", None),
        ("2023-02-29 08:00:00", "UTC", "dmy", None),
        ("2023-366T00:00:00Z", "UTC", "dmy", None),
        ("2023-W53-1T00:00:00Z", "UTC", "dmy", None),
        ("2023-04-05T27:61:00Z", "UTC", "dmy", None),
        ("0000-00-00 00:00:00", "UTC", "dmy", None),
        ("2024-03-05X10:20:30Z", "UTC", "dmy", None),
        ("2024-03-05 10:20:30", None, "dmy", None),
        ("2024-03-05 10:20:30", "Nowhere/None", "dmy", None),
        ("13:00:00 XM", "UTC", "dmy", None),
        ("last week", "UTC", "dmy", None),
        ("", "UTC", "dmy", None),
        ("   ", "UTC", "dmy", None),
        (None, "UTC", "dmy", None),
        ("2024" * 10_000, "UTC", "dmy", None),
    ],
)
def test_cases(text, zone, order, utc):
    assert one(text, zone, order) == utc


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2037, 1, 1)), st.sampled_from(["Europe/Berlin", "America/Sao_Paulo", "Australia/Lord_Howe", "Asia/Kathmandu", "America/New_York"]))
def test_local_times_agree_with_the_standard_library(local, zone):
    local = local.replace(microsecond=0)
    before = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    assert one(local.strftime("%Y-%m-%d %H:%M:%S") if local.year > 999 else "", zone) == before.isoformat()


def test_mixed_batch_keeps_places():
    us, ok = ts.instants(["2024-01-01T00:00:00Z", "x", "1700000000", None, "2024-01-01T00:00:01Z"], ["UTC"] * 5, ["dmy"] * 5)
    assert list(ok) == [True, False, True, False, True]
    assert us[4] - us[0] == 1_000_000


def test_zone_tables_carry_a_version():
    t = ts.zone_table("Europe/Berlin")
    assert t.version and len(t.offsets) == len(t.at) + 1


def test_spark_nulls_empty_and_clashing_columns(spark):
    reg = spark.createDataFrame([("a", "Asia/Tokyo", "ymd"), (None, "UTC", "dmy")], "registry string, tz_name string, date_order string")
    rules = ts.zone_rules(reg)
    df = spark.createDataFrame([(1, "a", "2024-01-01 09:00:00", "x"), (2, None, "2024-01-01 09:00:00", "y"), (3, "a", None, "z"), (3, "a", None, "z")], "id long, registry string, t string, utc_us string")
    out = ts.normalise(df, ["t", "utc_us"], "registry", rules, "id")
    got = {(r.rec_id, r.field): r.utc_us for r in out.collect()}
    assert got[1, "t"] == 1704067200000000 and got[2, "t"] is None and got[3, "t"] is None and got[1, "utc_us"] is None
    assert out.count() == 8
    assert ts.normalise(df.limit(0), ["t"], "registry", rules, "id").count() == 0
    assert df.select(ts.utc_micros(F.col("t"), F.col("registry"), {})).where("1 = 1").collect()[0][0] is None


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        ts.zone_rules(spark.range(5).selectExpr("cast(id as string) registry", "'UTC' tz_name", "'dmy' date_order"), most=3)


def test_the_mask_tells_halves_of_the_day_from_zones_in_either_order():
    half, zone = "2024-01-01 10:00 PM", "2024-01-01 10:00 UT"
    want = {half: 22 * 3600, zone: 10 * 3600}
    base = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    for texts in ([half, zone], [zone, half]):
        ts._PARSERS.clear()
        us, ok = ts.instants(texts, ["UTC"] * 2, ["dmy"] * 2)
        assert ok.all()
        assert [int(u) // ts.US - base for u in us] == [want[t] for t in texts]
    assert ts.shape_mask("Tue, 05 May 2024 1:02 am GMT+3") != ts.shape_mask("Tue, 05 Abc 2024 1:02 am GMT+3")


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("2016-12-31T23:59:60Z", "2017-01-01T00:00:00+00:00"),
        ("2016-12-31T23:59:60.5Z", "2017-01-01T00:00:00+00:00"),
        ("2024-02-29 24:00:00", "2024-03-01T00:00:00+00:00"),
        ("2024-02-29 24:00:01", None),
        ("2024-02-29 10:20:60", None),
        ("Monkey, 05 Mar 2024 10:20:30", None),
        ("2024-03-05\x0010:20:30", None),
        ("2024-03-05 10:20:30\n", "2024-03-05T10:20:30+00:00"),
        (" " * 90 + "2024-03-05 10:20:30" + " " * 90, "2024-03-05T10:20:30+00:00"),
        ("2024-03-05 10:20:30." + "1" * 300 + "Z", "2024-03-05T10:20:30.111111+00:00"),
    ],
)
def test_edges_of_days_minutes_and_lengths(text, utc):
    assert one(text) == utc


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
@pytest.mark.parametrize("year", [1850, 1899, 2099, 2100, 2199, 2437, 2500, 2750, 9000])
def test_years_beyond_the_usual_table_keep_their_summer_time(zone, year):
    for month in (1, 4, 7, 10):
        local = datetime(year, month, 15, 12, 0, tzinfo=ZoneInfo(zone))
        assert one(local.strftime("%Y-%m-%d %H:%M:%S").rjust(19, "0"), zone) == local.astimezone(timezone.utc).isoformat()
