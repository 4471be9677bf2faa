"""Features cut out of files in byte ranges, against the document read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftwell.sources import geojson_split as split


def documents():
    rng = random.Random(12)
    words = ["a", '"', "\\", "\\\\", '\\"', "]", "}{", "é☕", "\n", '"features":[{', "\\\\\\"]

    def feature(i):
        geometry = rng.choice([None, {"type": "Point", "coordinates": [i, 1]}, {"type": "Point", "coordinates": [i]}, {"type": "GeometryCollection", "geometries": []}])
        return {"type": rng.choice(["Feature"] * 5 + ["Blob"]), "id": i, "geometry": geometry, "properties": {"".join(rng.choices(words, k=3)): ["".join(rng.choices(words, k=rng.randrange(9)))] for _ in range(rng.randrange(4))}}

    for _ in range(8):
        members = [("type", "FeatureCollection"), ("features", [feature(i) for i in range(rng.randrange(8))]), ("x\\", {"features": [{}]}), ("".join(rng.choices(words, k=4)), [[{}]]), ('y"features', [{}, {}])]
        rng.shuffle(members)
        yield json.dumps(dict(members), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))


OTHERS = ["", " ", "[]", "7", '[{"type":"FeatureCollection","features":[{}]}]', '{"type":"Feature","features":[{}]}', '{"type":"FeatureCollection","features":[{}]', '{"type":"FeatureCollection","features":[{}]}\n' * 2,
          '{"type":"FeatureCollection","features":[{}],"features":7}', '{"type":"FeatureCollection","features":{"a":{}}}']


@pytest.mark.parametrize("size", [7, 64, split.RANGE])
def test_ranges_of_any_size_give_what_the_whole_document_holds(spark, tmp_path, size):
    want = {}
    for i, text in enumerate(documents()):
        (tmp_path / f"d{i}").write_bytes(text.encode())
        want |= {(f"d{i}", k): f for k, f in enumerate(json.loads(text)["features"])}
    for i, text in enumerate(OTHERS):
        (tmp_path / f"o{i}").write_bytes(text.encode())
    (tmp_path / "twice").write_text('{"features":[{"a":1}],"type":"FeatureCollection","\\u0066eatures" \n : [{"b":[2]} , {"c":3}]}')
    want |= {("twice", 0): {"b": [2]}, ("twice", 1): {"c": 3}}
    rows = split.feature_texts(spark, str(tmp_path), size=size).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["pos"]): json.loads(r["text"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert open(r["path"].removeprefix("file://"), "rb").read()[r["start"] :].startswith(r["text"].encode())


def test_errors_are_those_of_the_whole_document(spark, tmp_path):
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}'
    (tmp_path / "a").write_text(f'{{"type":"FeatureCollection","features":[{point},{{"type":"Point"}},{point.replace(",2", "")}]}}')
    rows = split.read_features(spark, str(tmp_path), size=50).select("pos", "ok", "error.kind", "error.path", F.to_json("value").alias("v")).orderBy("pos").collect()
    assert [(r["pos"], r["ok"], r["kind"], r["path"]) for r in rows] == [(0, True, None, None), (1, False, "InvalidType", "features[1].type"), (2, False, "MalformedCoordinates", "features[2].geometry.coordinates")]
    assert json.loads(rows[0]["v"]) == json.loads(point)
