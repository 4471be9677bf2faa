"""GeoJSON files: one document a file, read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.geojson import geo_parse


def read_geojson(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, ok, root_kind, value VARIANT, error) of every file under ``path``.

    A file that is not UTF-8, or holds no JSON document, gives a row with an error of kind ``Json``, never an exception.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    read = files.select(F.col("_metadata.file_path").alias("path"), F.when(F.is_valid_utf8("value"), F.col("value")).otherwise("").alias("text"))
    return read.select("path", geo_parse("text").alias("g")).select("path", "g.*")
