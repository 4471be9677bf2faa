"""Work on small tables is dealt to all cores, and rules are evaluated once a row."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions import geojson, json_scan
from siftwell.plans import registry
from siftwell.sources import geojson_split, jsonl


@pytest.mark.parametrize("name", ["geo_geometries", "geo_number_text", "geo_deep_collections", "geo_bbox_foreign", "geo_error_paths", "geo_error_display", "json_last_key_wins", "jsonl_error_reasons"])
def test_a_small_table_is_dealt_to_all_cores(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def behind_the_udf(spark, column) -> str:
    """What is evaluated with the UDF's results at hand."""
    rows = spark.createDataFrame([("1",)], "x string").select(column.alias("r"))
    return rows._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[0]


def test_rules_of_geometries_are_evaluated_before_the_udf_alone(spark):
    assert "forall" not in behind_the_udf(spark, geojson.geo_parse("x"))


@pytest.mark.parametrize("parse", [json_scan.exact_json, jsonl.parse_line])
def test_doubts_are_looked_for_before_the_udf_alone(parse, spark):
    assert "ud[89a-f]" not in behind_the_udf(spark, parse("x"))


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}").write_text(json.dumps({"type": "FeatureCollection", "features": [{"i": i}]}))
    texts = geojson_split.feature_texts(spark, str(tmp_path), size=16)
    assert texts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["i"] for r in texts.select(F.get_json_object("text", "$.i").cast("int").alias("i")).collect()) == list(range(60))


def test_lines_of_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "a").write_text('{"a":1}\n \t　\n\n7\n')
    rows = jsonl.read_jsonl(spark, str(tmp_path / "a"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["line"] for r in rows.orderBy("line").collect()] == [1, 4]
