"""Vectors for each format, with nulls, empty texts and malformed input."""

import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.functions import cron, geojson, mime
from siftwell.sources import geojson as geo_files
from siftwell.sources import jsonl
from siftwell.streaming import jsonl as stream


def over(spark, values, column, kind="string"):
    """``column`` of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "schedule, after, want",
    [
        ("15 7 * * 1-5", "2025-03-08 12:00:00", "2025-03-10 07:15:00"),
        ("*/25 * * * *", "2025-03-08 10:51:00", "2025-03-08 11:00:00"),
        ("20 30 6 * * *", "2025-03-08 06:30:05", "2025-03-09 06:30:20"),
        ("5 5 31 4 *", "2025-03-08 00:00:00", None),
        ("0 12 29 2 *", "2097-01-01 00:00:00", None),
        ("0 12 29 2 *", "2025-03-01 00:00:00", "2028-02-29 12:00:00"),
        ("40 3 2 5 *", "2025-05-02 03:40:00", "2026-05-02 03:40:00"),
        ("0 2-9/3 * * *", "2025-03-08 09:00:00", "2025-03-08 11:00:00"),
        ("0 0 20 * 6", "2025-03-10 00:00:00", "2025-03-15 00:00:00"),
        ("0 0 * * 9", "2025-03-10 00:00:00", "2025-03-11 00:00:00"),
        ("70 1 2 * * *", "2025-03-10 00:00:00", None),
    ],
)
def test_cron_next(spark, schedule, after, want):
    rows = spark.createDataFrame([(schedule, dt.datetime.fromisoformat(after))], "s string, t timestamp_ntz")
    found = rows.select(cron.cron_next_after("s", "t")).first()[0]
    assert found == (want and dt.datetime.fromisoformat(want))


def point(*numbers):
    return {"type": "Point", "coordinates": list(numbers)}


NESTED = point(1, 2)
for _ in range(6):
    NESTED = {"type": "GeometryCollection", "geometries": [NESTED]}
RING = [[0, 0], [1, 0], [1, 1], [0, 0]]
GOOD = [
    point(1, 2), point(1, 2, 3), {"type": "MultiPoint", "coordinates": [[1, 2]]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, {"type": "MultiLineString", "coordinates": [[[1, 2]]]},
    {"type": "Polygon", "coordinates": [RING]}, {"type": "MultiPolygon", "coordinates": [[RING]]}, NESTED, {"type": "Feature", "geometry": None, "properties": None},
    {"type": "FeatureCollection", "features": []}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": NESTED, "properties": {"a": 1}, "id": 7, "zz": [1]}]},
]
BAD = [
    ("not json", "Json", ""), ('{"type":"Point","coordinates":[1,2]} x', "Json", ""), ("{}", "InvalidType", ".type"), ('{"type":"Blob"}', "InvalidType", ".type"), ('{"type":"FeatureCollection"}', "InvalidType", ".features"),
    (json.dumps({"type": "FeatureCollection", "features": [point(1, 2)]}), "InvalidType", "features[0].type"), ('{"type":"Point"}', "MalformedCoordinates", ".coordinates"),
    (json.dumps(point(1)), "MalformedCoordinates", ".coordinates"), (json.dumps({"type": "LineString", "coordinates": [[1, 2], [3, "x"]]}), "MalformedCoordinates", ".coordinates[1]"),
    (json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": point(1, 2, 3, 4)}]}), "MalformedCoordinates", "features[0].geometry.coordinates"),
    (json.dumps({"type": "Polygon", "coordinates": [RING[:3]]}), "InvalidRing", ".coordinates[0]"), (json.dumps({"type": "GeometryCollection", "geometries": [point(1, 2), point(1)]}), "MalformedCoordinates", ".geometries[1].coordinates"),
]


def test_geojson_accepts_and_places_faults(spark):
    found = over(spark, [json.dumps(x) for x in GOOD] + [x for x, _, _ in BAD] + [None], geojson.geo_parse("x"))
    assert found[-1] is None
    assert [r["ok"] for r in found[: len(GOOD)]] == [True] * len(GOOD)
    assert [(r["ok"], r["error"]["kind"], r["error"]["path"]) for r in found[len(GOOD) : -1]] == [(False, k, p) for _, k, p in BAD]


def test_geojson_round_trip_at_any_depth(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(GOOD)], "i int, x string").select("i", geojson.geo_parse("x")["value"].alias("v"))
    texts = [r[1] for r in rows.select("i", geojson.geo_to_json(F.col("v"))).orderBy("i").collect()]
    assert [json.loads(t) for t in texts] == GOOD


def test_mime_extensions_and_bytes(spark):
    assert over(spark, ["JPG", "mkv", "", "nope", "mKv", None], mime.mime_by_extension("x")) == ["Jpeg", "Mkv", None, None, None, None]
    heads = [bytearray.fromhex(x) for x in ("FFD8FFE0", "1F8B08", "000001006674797068656963")]
    assert over(spark, [*heads, bytearray(), None], mime.mime_detect("x"), "binary") == ["Jpeg", "Gzip", "Heic", None, None]


def test_jsonl_lines_numbers_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\n\n{"a":2} x\r\n[1]\r\n \t\n"\xff"\n7')
    rows = {r["line"]: r["error"] and r["error"]["kind"] for r in jsonl.read_jsonl(spark, str(tmp_path)).select("line", "error").collect()}
    assert rows == {1: None, 3: "Json", 4: None, 6: "Io", 7: None}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "empty.jsonl").write_bytes(b"")
    assert jsonl.read_jsonl(spark, str(tmp_path / "b")).count() == 0


def test_jsonl_write_counts_lines_and_commits_all_or_nothing(spark, tmp_path):
    rows = spark.range(25, numPartitions=4).select("id", F.lit(None).cast("string").alias("x"))
    assert jsonl.write_jsonl(rows, str(tmp_path / "many")) == 25
    assert jsonl.write_jsonl(rows, str(tmp_path / "one"), value=F.array("id"), one_file=True) == 25
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert sorted(json.loads(r[0])[0] for r in spark.read.text(str(tmp_path / "one")).collect()) == list(range(25))
    with pytest.raises(Exception, match="stop"):
        jsonl.write_jsonl(rows.withColumn("x", F.when(F.col("id") == 24, F.raise_error(F.lit("stop"))).otherwise("y")), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("part-*"))


def test_geojson_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD[-1], indent=2))
    (tmp_path / "b.json").write_text("[1")
    (tmp_path / "c.json").write_bytes(b'{"type":"Point","coordinates":[1,2],"x":"\xff"}')
    found = {r["path"][-6:]: (r["ok"], r["error"] and r["error"]["kind"]) for r in geo_files.read_geojson(spark, str(tmp_path)).collect()}
    assert found == {"a.json": (True, None), "b.json": (False, "Json"), "c.json": (False, "Json")}


def test_features_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(json.dumps(GOOD[-1]), 1, 2)], "doc string, geo int, feature int")
    found = geojson.geo_features(rows, "doc").collect()
    assert [(r["geo"], r["feature"], r["pos"]) for r in found] == [(1, 2, 0)]


def test_equal_rejected_texts_are_looked_at_once_a_batch(monkeypatch):
    looked, examine = [], geojson._examine
    monkeypatch.setattr(geojson, "_examine", lambda *x: looked.append(x) or examine(*x))
    texts = ['{"a":1}', None, "not json", '{"a":1}', "not json", '{"type":"Blob"}', None]
    rows = pa.array([t and {"raw": t, "doubted": t == "not json"} for t in texts], pa.struct({"raw": pa.string(), "doubted": pa.bool_()}))
    found = geojson._locate.func(rows).to_pylist()
    assert len(looked) == len(set(looked)) == 3
    assert [r["kind"] for r in found] == ["InvalidType", None, "Json", "InvalidType", "Json", "InvalidType", None]
    assert found[0] == found[3] == {"kind": "InvalidType", "path": ".type", "message": "missing or non-string 'type' field", "text": None}


def test_jsonl_stream_equals_batch(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.jsonl").write_text('{"k":1}\n\nbad\n{"k":2}\n')
    rows = stream.stream_jsonl(spark, str(source)).select(F.try_variant_get("value", "$.k", "bigint").alias("k"), F.col("error.kind").alias("kind"))
    stream.write_stream(rows, str(sink), str(tmp_path / "state")).awaitTermination(120)
    written = [json.loads(x[0]) for x in spark.read.text(str(sink)).collect()]
    assert sorted(map(str, written)) == sorted(map(str, [{"k": 1, "kind": None}, {"k": None, "kind": "Json"}, {"k": 2, "kind": None}]))
