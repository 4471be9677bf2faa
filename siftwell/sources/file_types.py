"""Types of files by their first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions.mime import HEAD_BYTES, mime_detect, mime_string
from siftwell.sources.file_heads import read_heads


def detect_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, kind, mime, error) of every file under ``path``; extensions are not looked at, and no more than ``HEAD_BYTES`` bytes are read."""
    return read_heads(spark, path, glob, HEAD_BYTES).select("path", "length", mime_detect("head").alias("kind"), "error").select("path", "length", "kind", mime_string("kind").alias("mime"), "error")
