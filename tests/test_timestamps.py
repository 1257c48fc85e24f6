from datetime import datetime, timezone

import pandas as pd

from flowloom.operators import timestamps
from tests.conftest import rows

SITES = [("b", "Europe/Berlin", True), ("n", "America/New_York", False), ("s", "Australia/Sydney", True), ("u", "UTC", True), ("k", "Asia/Kolkata", True), ("q", "UTC", None)]
CASES = [
    ("2024-05-01T10:00:00Z", "b", "2024-05-01 10:00:00"),
    ("  \t2024-05-01 10:00:00 ", "b", "2024-05-01 08:00:00"),
    ("2024-05-01T10:00:00.250", "b", "2024-05-01 08:00:00.250"),
    ("2024-05-01 10:00:00,123", "n", "2024-05-01 14:00:00.123"),
    ("2024-05-01 10:00:00.123456+0530", None, "2024-05-01 04:30:00.123456"),
    ("2024-05-01T10:00:00-04:00[America/New_York]", "b", "2024-05-01 14:00:00"),
    ("2024-01-05 10:00:00 EST", "n", "2024-01-05 15:00:00"),
    ("2024-11-03 01:30:00 EDT", "n", "2024-11-03 05:30:00"),
    ("2024-11-03 01:30:00 EST", "n", "2024-11-03 06:30:00"),
    ("2024-11-03 01:30:00", "n", "2024-11-03 05:30:00"),  # occurs twice: the earlier
    ("2024-03-10 02:30:00", "n", None),  # never occurs
    ("2024-07-01 10:00:00 CEST", "b", "2024-07-01 08:00:00"),
    ("2024-01-15 10:00:00 AEDT", "s", "2024-01-14 23:00:00"),
    ("2024-07-15 10:00:00 AEST", "s", "2024-07-15 00:00:00"),
    ("2024-07-15 10:00:00 IST", "k", "2024-07-15 04:30:00"),
    ("2024-07-15 10:00:00 EST", None, None),
    ("03/04/2024 10:00", "u", "2024-04-03 10:00:00"),
    ("3/4/2024 12:05:09 AM", "n", "2024-03-04 05:05:09"),
    ("3/4/2024 12:05:09 PM", "n", "2024-03-04 17:05:09"),
    ("13/04/2024 10:00", "n", None),
    ("3/4/2024 13:05:09 PM", "n", None),
    ("05.04.2024 10:00:00", "n", "2024-04-05 14:00:00"),
    ("7 Sep 2024 10:00:00", "u", "2024-09-07 10:00:00"),
    ("Sat, 07 Sep 2024 10:00:00 +0200", "u", "2024-09-07 08:00:00"),
    ("20240501T100000Z", None, "2024-05-01 10:00:00"),
    ("1714557600", None, "2024-05-01 10:00:00"),
    ("1714557600123", None, "2024-05-01 10:00:00.123"),
    ("2024-02-30 10:00:00", "u", None),
    ("0000-00-00 00:00:00", "u", None),
    ("2024-05-01", "u", None),
    ("25:61", "u", None),
    ("7 Foo 2024 10:00:00", "u", None),
    ("2024-05-01 10:00:00", None, None),
    ("", "u", None),
    ("x" * 100_000, "u", None),
    (" " * 100_000 + "x", "u", None),
    (None, "u", None),
]


def us(text):
    if text is None:
        return None
    d = datetime.fromisoformat(text).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def frames(spark):
    sites = spark.createDataFrame(SITES, "site string, tz_name string, day_first boolean")
    data = spark.createDataFrame([(i, t, s, "x") for i, (t, s, _) in enumerate(CASES)], "row_id bigint, timestamp string, site string, format string")
    return data, sites


def test_every_notation(spark):
    data, sites = frames(spark)
    got = {r.row_id: r.instant_us for r in timestamps.with_instant(data, sites).collect()}
    for i, (text, site, want) in enumerate(CASES):
        assert got[i] == us(want), (text[:60] if text else text, site)


def test_normalise_agrees_and_keeps_rows(spark):
    data, sites = frames(spark)
    out = timestamps.normalise(data.unionAll(data), sites, ["site"]).collect()
    assert len(out) == 2 * len(CASES)
    for r in out:
        assert r.utc_us == us(CASES[r.row_id][2])


def test_unknown_order_is_estimated_or_marked(spark):
    sites = spark.createDataFrame(SITES, "site string, tz_name string, day_first boolean")
    clear = [("25/03/2024 10:00", "q")] * 30 + [("03/04/2024 10:00", "q")]
    out = timestamps.normalise(spark.createDataFrame(clear, "timestamp string, site string"), sites, ["site"])
    assert {r.format for r in out.collect()} == {"slash_dmy"}
    vague = spark.createDataFrame([("03/04/2024 10:00", "q")], "timestamp string, site string")
    r = timestamps.normalise(vague, sites, ["site"]).first()
    assert r.ambiguous and r.utc_us is None


def test_empty_table(spark):
    data, sites = frames(spark)
    assert timestamps.normalise(data.limit(0), sites, ["site"]).count() == 0
    assert timestamps.normalise(data, sites.limit(0), ["site"]).filter("utc_us is not null").count() > 0


def test_em_prefers_the_common_format():
    out = timestamps.em_posteriors(pd.DataFrame({"mask": [2, 6], "n": [50, 10]}))
    assert list(out["format"]) == ["slash_dmy", "slash_dmy"] and not out["ambiguous"].any()


def test_a_site_listed_twice_repeats_no_row(spark):
    data, sites = frames(spark)
    assert timestamps.with_instant(data, sites.unionAll(sites)).count() == data.count()
    assert rows(timestamps.with_instant(data.limit(0), sites)) == []


def test_a_source_without_any_usable_value(spark):
    """Every value of a source is impossible: the source has no mixture, and the others are not disturbed."""
    sites = spark.createDataFrame(SITES, "site string, tz_name string, day_first boolean")
    data = [("45/45/2024 10:00", "b")] * 3 + [("junk", "k"), ("01/05/2024 10:00", "u"), (None, "s")]
    got = timestamps.normalise(spark.createDataFrame(data, "timestamp string, site string"), sites, ["site"]).collect()
    assert [(r.timestamp, r.format, r.utc_us) for r in got if r.utc_us is not None] == [("01/05/2024 10:00", "slash_dmy", us("2024-05-01 10:00:00"))]
    only = timestamps.normalise(spark.createDataFrame(data[:3], "timestamp string, site string"), sites, ["site"]).collect()
    assert len(only) == 3 and all(r.format is None and not r.ambiguous for r in only)


def test_posteriors_decide_every_notation(spark):
    """Seconds or milliseconds by the source's years; an order against the reference is unusable; clocks are marked."""
    sites = spark.createDataFrame(SITES, "site string, tz_name string, day_first boolean")
    data = [("1714557600", None), ("13/04/2024 10:00", "n"), ("2024-11-03 01:30:00", "n"), ("2024-03-10 02:30:00", "n"), ("2024-05-01 10:00:00", None), ("2024-05-01 10:00:00", "n")]
    out = {(r.timestamp, r.site): r for r in timestamps.normalise(spark.createDataFrame(data, "timestamp string, site string"), sites, ["site"]).collect()}
    assert out[data[0]].format == "epoch_s" and out[data[0]].posterior > 0.9
    assert out[data[1]].format is None and out[data[1]].utc_us is None
    assert [out[k].clock for k in data[2:]] == ["repeated", "skipped", "no zone", None]


def test_years_tell_readings_apart():
    """Ten digits are milliseconds of 1970 or seconds of 2024; a source that writes old milliseconds keeps them."""
    mask = timestamps.I.BIT["epoch_s"] + timestamps.I.BIT["epoch_ms"]
    out = timestamps.em_posteriors(pd.DataFrame({"mask": [mask], "n": [9], "year_a": [2024], "year_b": [1970]}))
    assert list(out["format"]) == ["epoch_s"]
    ms = pd.DataFrame({"mask": [timestamps.I.BIT["epoch_ms"], mask], "n": [9000, 1], "year_a": [-1, 9000], "year_b": [1971, 1971]})
    assert list(timestamps.em_posteriors(ms)["format"]) == ["epoch_ms", "epoch_ms"]
    assert len(timestamps.em_posteriors(pd.DataFrame({"mask": [], "n": []}))) == 0
