from __future__ import annotations

import json

from pyspark.sql import functions as F

from plantweave.operators.volumes import daily, series, volumes
from plantweave.sources import delimited, resolvers, sinks
from plantweave.streaming import daily as stream

CALLS = "row_id long, betroffene_anlage string, gesamte_arbeit_mwh string, richtung string, beginn_datum string, beginn_uhrzeit string, zeitzone_von string, exported_at timestamp"


def calls(spark):
    rows = [(1, "A", "1,5", "erhöhen", "01.02.2020", "10:00", "CET"), (2, "A", "-2", "reduzieren", "01.02.2020", "11:00", "CET"), (3, "B", "x", "erhöhen", "01.02.2020", "10:00", "CET"), (4, "A", "1", "ERH?HEN", "31.12.2020", "23:30", "UTC")]
    return spark.createDataFrame(rows, CALLS.rpartition(",")[0]).withColumn("exported_at", F.lit("2021-01-02").cast("timestamp"))


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿NAME ;MW\nÄ;1,5\nÄ;1,5\n".encode())
    (tmp_path / "b.csv").write_text("NAME;MW;EXTRA\nÄ;1,5;x\n")
    df = delimited.read_export(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), distinct=True)
    assert df.columns == ["name", "mw", "extra"] and df.count() == 2


def test_lines_before_header(spark, tmp_path):
    junk = "".join(f"Zeile {i}\n" for i in range(9))
    (tmp_path / "k.csv").write_bytes((junk + "Datensatztyp*;EinheitMastrNummer;Anzeigename;Energietraeger;Nettonennleistung_MW;Postleitzahl;Ort\nEinzelanlage;SEE1;Kraftwerk Köln;Erdgas;1,5;50667;Köln\nAggregat;SEE2;x;y;1;2;3\n").encode("latin-1"))
    got = delimited.registry_lookup(delimited.read_after_lines(spark, str(tmp_path / "k.csv"))).collect()
    assert [(r.mastr_id, r.norm_name, r.nettonennleistung_mw, r.ort) for r in got] == [("SEE1", "kraftwerk köln", 1.5, "Köln")]


def test_absent_table_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    assert delimited.read_or_empty(spark, path, "k int, v string").count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.append_new(df, path, "k").count() == 2
    sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, "k")
    assert spark.read.parquet(path).count() == 3
    sinks.replace_table(spark.read.parquet(path).filter("k > 1"), path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_delimited(spark.createDataFrame([(["a", "b"], 1)], "l array<string>, n int"), str(tmp_path / "csv"))
    assert delimited.read_plain(spark, str(tmp_path / "csv")).first().asDict() == {"l": "a,b", "n": "1"}


def test_map_document(spark):
    days = daily(volumes(calls(spark)), "name")
    plants = series(days).withColumn("lat", F.lit(50.1234567)).withColumn("lon", F.lit(10.0)).withColumn("confidence", F.lit(None).cast("string"))
    meta = days.agg(F.min("day").alias("date_min"))
    doc = sinks.map_document(plants, spark.createDataFrame([("boerse", "2020-01-01", 1.0)], "category string, day string, mwh double"), meta)
    data = json.loads(doc[doc.index("{") : doc.rindex("}") + 1])
    assert data["plants"][0]["series"] == {"2020-02-01": [1.5, 2.0], "2021-01-01": [1.0, 0.0]}
    assert data["plants"][0]["confidence"] == "none" and data["plants"][0]["lat"] == 50.12346 and data["meta"]["date_min"] == "2020-02-01"


class Fixed:
    def resolve(self, names):
        if "boom" in names:
            raise RuntimeError
        return [(n, 50.123456, 10.0) for n in names if n != "unknown"] + [("never asked", 1.0, 1.0)]


def test_resolvers(spark):
    names = spark.createDataFrame([("a",), ("a",), (" ",), (None,), ("unknown",)], "name string")
    assert [tuple(r) for r in resolvers.locate(names, Fixed()).collect()] == [("a", 50.1235, 10.0)]
    assert resolvers.locate(spark.createDataFrame([("boom",)], "name string"), Fixed()).count() == 0
    short = spark.createDataFrame([("e", "1", 96.0), ("e", "2", 96.0), ("f", "3", 50.0)], "e string, c string, s double")
    got = {r.e: (r.c, r.confidence) for r in resolvers.choose_best(short, "e", "c", "s").collect()}
    assert got == {"e": ("1", "high"), "f": (None, "none")}


def test_stream_equals_batch(spark, tmp_path):
    rows = calls(spark)
    for i in range(3):
        rows.filter(F.col("row_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream.daily_stream(stream.read_calls(spark, str(tmp_path / "in"), CALLS, 1), late="3650 days")
    stream.upsert_days(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(str(r.day), r.name): (r.inc, r.dec) for r in stream.read_days(spark, str(tmp_path / "out")).collect()}
    want = {(str(r.day), r.name): (r.inc, r.dec) for r in daily(volumes(rows), "name").collect()}
    assert got == want


def test_repeated_reports_are_dropped(spark, tmp_path):
    rows = calls(spark)
    again = rows.filter("row_id = 1").withColumn("row_id", F.lit(99).cast("long"))
    rows.unionByName(again).coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = stream.first_reports(stream.read_calls(spark, str(tmp_path / "in"), CALLS))
    kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
