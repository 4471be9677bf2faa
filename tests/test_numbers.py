"""Texts of doubles against Python's shortest digits, and canonical keys."""

import json
import math
import random
import struct

from pyspark.sql import functions as F

from siftwell.functions import geojson, numbers
from siftwell.functions.strict_json import strict_json

FIXED = [(1e7, "10000000.0"), (1e-4, "0.0001"), (1e21, "1e21"), (-0.0, "-0.0"), (5e-324, "5e-324"), (0.0, "0.0"), (1e16, "1e16"), (1e15, "1000000000000000.0"), (1e-5, "0.00001"), (1e-6, "1e-6"), (-2.5e-7, "-2.5e-7"), (123.25, "123.25"), (1.7976931348623157e308, "1.7976931348623157e308"), (2.98023223876953125e-8, "2.9802322387695312e-8")]


def doubles(n, seed=7):
    rng, found = random.Random(seed), [x for x, _ in FIXED]
    while len(found) < n:
        x = rng.choice([struct.unpack("<d", rng.randbytes(8))[0], rng.uniform(-180, 180), round(rng.uniform(-1e9, 1e9), rng.randrange(9)), rng.randrange(10**17) * 10.0 ** rng.randrange(-25, 10), 2.0 ** rng.randrange(-1074, 1000)])
        if math.isfinite(x):
            found.append(x)
    return found


def test_number_texts(spark):
    xs = doubles(5000)
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", numbers.number_text("x").alias("t"))
    texts = [r["t"] for r in rows.orderBy("i").collect()]
    for x, t in zip(xs, texts, strict=True):
        assert t == numbers.number_text_of(x), x
        assert float(t) == x and math.copysign(1, float(t)) == math.copysign(1, x)
        assert len(t.strip("-").split("e")[0].replace(".", "").strip("0")) <= len(repr(abs(x)).split("e")[0].replace(".", "").strip("0")) or t in dict(FIXED).values(), (x, t)
    assert [texts[i] for i in range(len(FIXED))] == [t for _, t in FIXED]


def test_plain_numbers_leave_strings_alone(spark):
    docs = [{"a": [1e7, "1e7", 'x"1e7"', 1e-9], "b e5": -1e300, "é\\": "\\"}, [], 12, "3e4"]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, x string").select("i", numbers.plain_numbers("x").alias("t"))
    texts = [r["t"] for r in rows.orderBy("i").collect()]
    assert [json.loads(t) for t in texts] == docs and "1e-9" in texts[0] and "-1e300" in texts[0] and '"1e7"' in texts[0]


def test_canonical_keys_are_equal_where_values_are(spark):
    groups = [['{"a":1,"b":[1.50,2]}', '{ "b" : [15e-1, 2.0], "a" : 1.0 }', '{"b":[1.5,2e0],"a":10E-1}'], ['{"a":1,"b":[2,1.5]}'], ['"1.0"'], ["1", "1.0", "1e0"], ["0", "-0", "0.0"], ["12345678901234567890", "12345678901234567890"], ["12345678901234567891"], ['{"1":"1e5"}'], ['{"1":"100000.0"}'], ["[]"], ["{}"], ["null"]]
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs]
    keys = spark.createDataFrame(rows, "g int, x string").select("g", geojson.canonical_key(strict_json("x"))["hash"].alias("h")).collect()
    for a in keys:
        for b in keys:
            assert (a["g"] == b["g"]) == (a["h"] == b["h"]), (groups[a["g"]], groups[b["g"]])


def test_numbers_of_documents_at_every_depth(spark):
    xs = [(i, x) for i, x in enumerate(doubles(300, 9))]
    depths = range(5)
    text = lambda x, n: '{"type":"GeometryCollection","geometries":[' * n + f'{{"type":"Point","coordinates":[{x!r},1]}}' + "]}" * n
    rows = spark.createDataFrame([(i, n, text(x, n)) for i, x in xs for n in depths], "i int, n int, x string")
    found = {(r["i"], r["n"]): r["t"] for r in rows.select("i", "n", geojson.geo_to_json(geojson.geo_parse("x")["value"]).alias("t")).collect()}
    for i, x in xs:
        for n in depths:
            assert found[i, n] == text(x, n).replace(f"[{x!r},1]", f"[{numbers.number_text_of(x)},1.0]"), (x, n)
