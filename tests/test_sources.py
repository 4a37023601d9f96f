import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafield.sources import delimited, documents, instruments
from stratafield.streaming import flightline


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


WALK = "Field: north 7\nProbe: 12\nSample rate: 250\nGPS: yes\nTimestamp [ms];Latitude;B1x [nT];Note;\n" + "".join(f"{i};{60 + i / 10};{'bad' if i == 3 else i * 1.5};;\n" for i in range(12))


def test_walk_file(spark, tmp_path):
    df, meta = delimited.load(spark, write(tmp_path / "walk.csv", WALK))
    assert meta == {"Field": "north 7", "Probe": "12", "Sample rate": "250", "GPS": "yes"}
    assert df.columns == ["_row_id", "Timestamp [ms]", "Latitude", "B1x [nT]"] and df.count() == 12
    numbers = df.select(F.col("`B1x [nT]`").try_cast("double").alias("v")).filter("v IS NULL").count()
    assert numbers == 1


def test_headerless_and_latin(spark, tmp_path):
    df, _ = delimited.load(spark, write(tmp_path / "n.csv", "note\n" + "1,2,3,4,5,6\n" * 3))
    assert df.count() == 3 and len(df.columns) == 7
    df, meta = delimited.load(spark, write(tmp_path / "l.csv", "Ort: Tromsø\nTimestamp;a;b;c\n1;2;é;4\n", "latin-1"))
    assert df.first()["b"] == "é"
    assert delimited.find_delimiter(["a|b|c"]) == "|" and delimited.find_delimiter(["abc"]) == ";"


def test_empty_file(spark, tmp_path):
    df, meta = delimited.load(spark, write(tmp_path / "e.csv", ""))
    assert df.count() == 0 and meta == {}


def test_text_table(spark, tmp_path):
    assert delimited.text_table(spark, write(tmp_path / "t.txt", "a\tb\n1\t2\n")).columns == ["a", "b"]
    assert delimited.profile(spark, write(tmp_path / "p.csv", "a,b\n1,x\n2,y\n")) == {"columns": 2, "names": ["a", "b"], "rows": 2, "numeric": 1, "text": 1}


def test_base_station(spark, tmp_path):
    named = instruments.base_station(spark, write(tmp_path / "a.txt", "/Gem\n/time,nT,sq\n090536.0,50000.5,99\n090537.0,x\n\nshort\n"))
    assert [tuple(r) for r in named.collect()] == [("090536.0", 50000.5, 99.0), ("090537.0", None, None)]
    plain = instruments.base_station(spark, write(tmp_path / "b.txt", "/Gem\n090536.0,1,2\n"))
    assert plain.columns == ["time", "nT", "sq"]
    with pytest.raises(ValueError):
        instruments.base_station(spark, write(tmp_path / "c.txt", "/time,x\n1,2\n"))


def test_system_log(spark, tmp_path):
    log = "[08:00:00.000] boot\n[08:00:01.000] [TF] Going to waypoint #1\n[08:00:05.500] [TF] Going to waypoint #2\n[08:00:09.000] Last waypoint reached\n[09:00:00.000] [TF] Going to waypoint #1\n[09:00:01.000] [TF] Going to waypoint #12\n"
    out = [(r["survey_no"], r["t_s"]) for r in instruments.system_log(spark, write(tmp_path / "x-system.log", log)).orderBy("line_no").collect()]
    assert out == [(1, 28801.0), (1, 28805.5), (1, 28809.0), (2, 32400.0), (2, 32401.0)]


def test_positions(spark, tmp_path):
    df = instruments.positions(spark, write(tmp_path / "p.csv", "Time,GPR:Trace,ALT:ID,OBS:ID\n1,0,4,5\n2,,4,5\n3,7,4,5\n"))
    assert df.columns == ["Time", "GPR:Trace"] and df.count() == 1


def test_segy(spark, tmp_path):
    traces = (np.arange(24).reshape(3, 8) - 3).astype(">f4")
    head = bytearray(3600)
    head[3216:3218], head[3220:3222], head[3224:3226] = struct.pack(">h", 195), struct.pack(">h", 8), struct.pack(">h", 5)
    (tmp_path / "a.sgy").write_bytes(bytes(head) + b"".join(bytes(240) + t.tobytes() for t in traces))
    rows = instruments.segy(spark, str(tmp_path / "a.sgy")).orderBy("trace_no").collect()
    assert rows[0]["dt_ns"] == pytest.approx(0.195) and [r["samples"] for r in rows] == traces.tolist()
    assert instruments.ibm_floats(np.array([0xC276A000, 0x41100000, 0], np.uint32)).tolist() == [-118.625, 1.0, 0.0]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", small=np.zeros(2), big=np.arange(12.0).reshape(4, 3))
    rows = instruments.npz_table(spark, str(tmp_path / "a.npz")).orderBy("row_no").collect()
    assert [r["values"] for r in rows] == np.arange(12.0).reshape(4, 3).tolist()
    np.savez(tmp_path / "g.npz", config=json.dumps({"v": 1}), df_Pos=np.ones((2, 2)), df_Pos_columns=np.array(["a", "b"]), distVec_array_0=np.array([0.0, 1.0]), gprProfile_array_0=np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]))
    config, places, traces = instruments.radar_project(spark, str(tmp_path / "g.npz"))
    assert config == {"v": 1, "columns": ["a", "b"]} and places.count() == 2
    assert [r["samples"] for r in traces.orderBy("trace_no").collect()] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]


def test_json_and_history(spark, tmp_path):
    df = documents.json_table(spark, write(tmp_path / "a.json", '[{"a": {"b": 1}, "c": [1, 2]}]'))
    assert df.columns == ["a.b", "c"] and documents.is_nested(df)
    assert documents.count_items({"a": 1, "b": [1, 2]}) == 2 + 1 + (2 + 2)
    assert documents.json_tree({"a": "x" * 120})[1] == ("$.a", "x" * 100 + "...", "str")
    text = '{"event_id": "1", "timestamp": "t1", "event_type": "project.created", "event_data": {"project_name": "p"}}\nbroken\n{"event_id": "2", "timestamp": "t2", "event_type": "project.loaded", "event_data": {}}\n'
    assert [r["event_id"] for r in documents.history(spark, write(tmp_path / "h.jsonl", text)).collect()] == ["2", "1"]
    documents.append_history(spark, str(tmp_path / "log"), [{"event_id": "9", "event_type": "x"}])
    assert documents.history(spark, str(tmp_path / "log")).first()["event_id"] == "9"


def test_bundle(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("metadata.json", '{"version": "1.0"}')
        z.writestr("map_state.json", '{"zoom": 40}')
    assert documents.check_bundle(str(path)) == ["missing project.json", "zoom out of range"]
    assert documents.repair_bundle(str(path), str(tmp_path / "b.zip")) == ["project.json"]
    assert documents.check_bundle(str(tmp_path / "b.zip")) == ["zoom out of range"]
    assert documents.check_bundle(str(write_bytes(tmp_path / "c"))) == ["not a zip archive"]


def write_bytes(path):
    path.write_bytes(io.BytesIO(b"x").getvalue())
    return path


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 60.0, 10.0), (1, 1, 61.0, 11.0), (2, 5, 62.0, 12.0)], "segment int, trace_no int, lat double, lon double")
    documents.write_labels(df, str(tmp_path / "labels"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "labels")).collect()) == ["1\t60.0\t10.0\t0", "1\t61.0\t11.0\t1", "2\t62.0\t12.0\t0"]
    for kind in ("csv", "tsv", "json", "parquet", "other"):
        documents.write_result(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3 and spark.read.json(str(tmp_path / "json")).count() == 3
    documents.write_segments(df.withColumn("direction", F.lit("N")), str(tmp_path / "seg"), ["N"])
    documents.write_grid(spark.createDataFrame([(0.0, 0.0, None), (1.0, 1.0, 2.0)], "x double, y double, value double"), str(tmp_path / "grid"))
    assert spark.read.csv(str(tmp_path / "grid"), header=True).count() == 1
    assert documents.result_name("a", "magnetic", "grid", "1", "csv") == "processed/magnetic/a_magnetic_grid_1.csv"
    assert documents.files(spark, str(tmp_path / "labels")).count() >= 1


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = ["line_id;ts;field"] + [f"{i % 2};2024-01-01 00:{i // 2:02d}:00;{i}" for i in range(40) if i // 2 not in (7, 8)]
    (src / "a.csv").write_text("\n".join(lines))
    schema = "line_id long, ts timestamp, field double"
    batch = flightline.flight_lines(spark.read.schema(schema).option("sep", ";").option("header", True).csv(str(src)), "90 seconds")
    want = sorted(map(tuple, batch.collect()))
    assert len(want) == 4
    stream = flightline.flight_lines(flightline.read_logger(spark, str(src), schema), "90 seconds")
    query = stream.writeStream.format("memory").queryName("lines").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = set(map(tuple, spark.table("lines").collect()))
    assert got <= set(want)
    rate = flightline.rates(spark.read.schema(schema).option("sep", ";").option("header", True).csv(str(src)), "10 minutes")
    assert sum(r["n_rows"] for r in rate.collect()) == 36
    base = spark.createDataFrame([("2024-01-01 00:00:00", 1.0)], "ts string, nT double").withColumn("ts", F.to_timestamp("ts"))
    fixed = flightline.with_base(spark.read.schema(schema).option("sep", ";").option("header", True).csv(str(src)), base)
    assert fixed.filter("residual IS NOT NULL").count() == 2
