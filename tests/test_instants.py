from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from plantweave.operators.instants import instant_ms, is_plain, transitions, zone_version


def ms(*at: int) -> int:
    return int(datetime(*at, tzinfo=UTC).timestamp() * 1000)


CASES = [
    ("01.02.2020", "13:05", "UTC", ms(2020, 2, 1, 13, 5)),
    ("01.02.2020", "13:05", "CET", ms(2020, 2, 1, 12, 5)),
    ("01.07.2020", "13:05", " mesz", ms(2020, 7, 1, 11, 5)),
    ("01.07.2020", "13:05", "CET", ms(2020, 7, 1, 12, 5)),
    ("1.7.20", "7:05 PM", "Ortszeit", ms(2020, 7, 1, 17, 5)),
    ("03/04/2020", "12:00 AM", "+05:30", ms(2020, 4, 2, 18, 30)),
    ("2020-04-03", "0815", "GMT+02:00", ms(2020, 4, 3, 6, 15)),
    ("20200403", "08.15", "-", ms(2020, 4, 3, 6, 15)),
    ("5. Mrz. 2021", "8 Uhr", None, ms(2021, 3, 5, 7)),
    ("05-Mar-2021", "08:15:10.250", "Europe/London", ms(2021, 3, 5, 8, 15, 10) + 250),
    ("Fr, 05.03.2021", "24:00", "UTC", ms(2021, 3, 6)),
    ("2021-03-05T08:15:10.123456+0100", None, None, ms(2021, 3, 5, 7, 15, 10) + 123),
    ("2021-03-05 08:15:10Z", None, None, ms(2021, 3, 5, 8, 15, 10)),
    ("2021-03-05T08:15:10", None, "", ms(2021, 3, 5, 7, 15, 10)),
    ("05.03.2021", "08:15 MESZ", None, ms(2021, 3, 5, 6, 15)),
    ("05.03.2021", "08:15+01:00", None, ms(2021, 3, 5, 7, 15)),
    ("1614932110", None, "CET", 1614932110000),
    ("1614932110123", None, None, 1614932110123),
    ("28.03.2021", "02:30", "Europe/Berlin", None),  # skipped
    ("31.10.2021", "02:30", None, None),  # repeated
    ("31.10.2021", "02:30", "CEST", ms(2021, 10, 31, 0, 30)),
    ("29.02.2021", "02:30", "UTC", None),
    ("00.00.0000", "02:30", "UTC", None),
    ("01.02.2020", "24:15", "UTC", None),
    ("01.02.2020", "12:75", "UTC", None),
    ("01.02.2020", "13:00 PM", "UTC", None),
    ("Mo, 05.03.2021", "08:00", "UTC", None),  # a Friday
    ("01.02.2020", "08:00", "Mars/Base", None),
    ("01.02.2020", None, "UTC", None),
    (None, "08:00", "UTC", None),
    ("", "", "", None),
    ("1614932110", "08:00", None, None),
    ("9" * 5000, "08:00", None, None),
]


def test_formats(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, d string, t string, z string, want long")
    got = {r.i: r.ms for r in df.select("i", instant_ms(F.col("d"), F.col("t"), F.col("z")).alias("ms")).collect()}
    assert {i: got[i] for i in got if got[i] != CASES[i][3]} == {}


def test_empty(spark):
    df = spark.createDataFrame([], "d string, t string, z string")
    assert df.select(instant_ms(F.col("d"), F.col("t"), F.col("z"))).collect() == []


def test_plain(spark):
    df = spark.createDataFrame([("01.02.2020", "13:05", "UTC"), ("01.02.2020", "24:00", "UTC"), ("01.02.2020", "13:05", "utc"), (None, None, None)], "d string, t string, z string")
    assert [r[0] for r in df.select(is_plain(F.col("d"), F.col("t"), F.col("z"))).collect()] == [True, False, False, False]


def test_transition_table_is_exact():
    at, offsets = transitions("Europe/Berlin", zone_version())
    i = list(at).index(int(datetime(2021, 3, 28, 1, tzinfo=UTC).timestamp()))
    assert (offsets[i - 1], offsets[i]) == (3600, 7200)
    with pytest.raises(RuntimeError):
        transitions.__wrapped__("Europe/Berlin", "another version")
