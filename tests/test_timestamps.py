import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from skein.operators.timestamps import find_odd_times, record_times, to_utc_ms, tzdata_version, zone, zone_files

BERLIN = "Europe/Berlin"
TIMES = [
    ("2025-03-01T10:00:00.000Z", 1740823200000), ("2025-03-01T10:00:00Z", 1740823200000), ("2025-03-01T10:00:00.123456789Z", 1740823200123), ("2025-03-01T11:00:00+0100", 1740823200000), ("2025-03-01T11:00:00.5+01:00", 1740823200500),
    ("2025-03-01T15:45:00.000+05:45[Asia/Kathmandu]", 1740823200000), ("2025-03-01T15:45:00.000[Asia/Kathmandu]", 1740823200000), ("20250301T100000Z", 1740823200000), ("2025-03-01 10:00:00 UTC", 1740823200000), ("2025-03-01 11:00:00 CET", 1740823200000),
    ("2025-03-01 05:00:00 EST", 1740823200000), ("2025-03-01 11:00:00", 1740823200000), ("2025/03/01 11:00:00", 1740823200000), ("01.03.2025 11:00:00", 1740823200000), ("01 Mar 2025 05:00:00 -0500", 1740823200000), ("Sat, 01 Mar 2025 10:00:00 GMT", 1740823200000),
    ("Mar 1, 2025 11:00:00 AM", 1740823200000), ("Mar 1, 2025 12:30:00 AM", 1740785400000), ("Mar 1, 2025 12:30:00 PM", 1740828600000), ("1740823200", 1740823200000), ("1740823200123", 1740823200123), ("1740823200123999", 1740823200123), ("1740823200123999999", 1740823200123),
    ("2025-10-26 02:30:00", 1761438600000), ("2025-03-30 02:30:00", 1743298200000), ("2025-02-29T10:00:00Z", None), ("2024-02-29T10:00:00Z", 1709200800000), ("2025-13-01T10:00:00Z", None), ("2025-03-01T24:00:00Z", None), ("2025-03-01T10:60:00Z", None),
    ("0000-00-00T00:00:00Z", None), ("1969-12-31T23:59:59Z", None), ("0", None), ("-1", None), ("n/a", None), ("-", None), ("", None), ("yesterday", None), ("Foo 1, 2025 11:00:00 AM", None), ("Mar 1, 2025 13:00:00 AM", None), ("2025-03-01 10:00:00 XYZ", None), (None, None),
]


@pytest.mark.parametrize("text,want", TIMES, ids=[str(t) for t, _ in TIMES])
def test_formats_on_a_berlin_clock(text, want):
    assert to_utc_ms([text], [BERLIN], {BERLIN: zone(BERLIN)}, zone_files())[0] == [want]


def test_all_at_once_is_the_same():
    texts = [t for t, _ in TIMES] * 3
    assert to_utc_ms(texts, [BERLIN] * len(texts), {BERLIN: zone(BERLIN)}, zone_files())[0] == [w for _, w in TIMES] * 3


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Europe/Lisbon", "Pacific/Apia"])
def test_zone_tables_against_brute_force(name):
    rng, z, tz = random.Random(name), zone(name), ZoneInfo(name)
    changes = [int(s) for s in z.switch if 0 < s < 2_000_000_000] or [10**9]
    near = [c + rng.randint(-8000, 8000) for c in rng.choices(changes, k=300)] + [rng.randint(1, 2_000_000_000) for _ in range(300)]
    got = z.to_utc(np.array(near))
    for wall, utc in zip(near, got):
        naive = datetime(1970, 1, 1) + timedelta(seconds=wall)
        # fold 0 is the earlier of two instants, and the offset before the change in a gap
        want = naive.replace(tzinfo=tz, fold=0).astimezone(timezone.utc)
        assert int(want.timestamp()) == utc, (name, naive)


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Africa/Casablanca", "Asia/Tokyo"])
def test_wall_times_of_any_year(name):
    rng, z, tz = random.Random(name), zone(name), ZoneInfo(name)
    walls = [datetime(rng.randint(1860, 9998), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), 30) for _ in range(300)]
    got = z.to_utc(np.array([int((w - datetime(1970, 1, 1)).total_seconds()) for w in walls]))
    assert got.tolist() == [int(w.replace(tzinfo=tz).astimezone(timezone.utc).timestamp()) for w in walls]


def test_digits_and_the_version():
    digits = {"99999999999": 99999999999000, "12345678901234": 12345678901234, "12345678901234567": 12345678901234, "12345678": None, "1" * 20: None}
    assert to_utc_ms(list(digits), [None] * 5, {})[0] == list(digits.values())
    named = {}
    assert to_utc_ms(["2025-03-01 11:00:00[No/Zone]", "2025-03-01 11:00:00[Asia/Tokyo]"], [None] * 2, named, zone_files())[0] == [None, 1740794400000] and list(named) == ["Asia/Tokyo"]
    assert tzdata_version() != "" and zone("No/Zone") is None


def test_a_clock_without_zone(spark):
    assert to_utc_ms(["2025-03-01 11:00:00", "2025-03-01T11:00:00Z"], [None, None], {})[0] == [None, 1740826800000]
    machines = spark.createDataFrame([("m1", BERLIN), ("m2", None), (None, "UTC")], "machine string, tz_name string")
    rows = [
        ("claude", "m1/a", 1, '{"timestamp":"2025-03-01 11:00:00"}'), ("claude", "m1/a", 1, '{"timestamp":"2025-03-01 11:00:00"}'), ("claude", "m2/a", 1, '{"timestamp":"2025-03-01 11:00:00"}'), ("codex", "m1/a", 2, '{"timestamp":"2025-03-01T10:00:00.000Z"}'),
        ("dsh", "m9/a", 3, '{"time":1740823200}'), ("dsh", "m9/a", 4, '{"time":1740823200123}'), ("dsh", "m9/a", 5, '{"time":"x"}'), (None, None, None, None), ("dsh", "m9/a", 6, "{}"), ("claude", None, 7, '{"timestamp":"2025-03-01T10:00:00Z"}'),
    ]
    records = spark.createDataFrame(rows, "source string, path string, line_no bigint, raw string").selectExpr("*", "1 as utc_ms", "2 as shape")
    assert {tuple(r) for r in find_odd_times(records, machines).collect()} == {("m1/a", 1, 1740823200000), ("m9/a", 3, 1740823200000), (None, 7, 1740823200000)}
    assert record_times(records.limit(0), machines.limit(0)).count() == 0
