"""JSON Lines as a stream.

``stream_jsonl`` is row-local: no state, and a line is told by file and block.
``follow_jsonl`` numbers lines as the batch reader does.  A file arrives whole in
one micro-batch, so the lines before a block are counted within the batch, one row
a block, and no file has to pass through one task.

Sinks write each micro-batch to a folder of its own, named by the batch's id.  A
batch that is run again after a failure replaces its folder, so no line is
written twice; how many lines it has is written beside it and survives restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwell.sources.jsonl import number_lines, parse_line, parsed_lines, to_line


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(path, block, text) of every line in files that arrive under ``path``."""
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def stream_jsonl(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(path, block, value VARIANT, error) of every line that is not blank in files that arrive under ``path``."""
    lines = stream_lines(spark, path, max_files).select("path", "block", parse_line("text").alias("p"))
    return lines.where(F.col("p").isNotNull()).select("path", "block", F.col("p.value").alias("value"), F.col("p.error").alias("error"))


def write_batch(df: DataFrame, path: str, batch: int) -> int:
    """Write the rows of micro-batch ``batch`` as lines of JSON, in place of what it wrote before.  Returns how many there are."""
    seen = Observation()
    lines = df.select(to_line(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(f"{path}/batch={batch}")
    # after the lines: a batch without a number has to be run again
    df.sparkSession.createDataFrame([(seen.get["n"],)], "n long").coalesce(1).write.mode("overwrite").json(f"{path}/_written/batch={batch}")
    return seen.get["n"]


def written(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n): how many lines each micro-batch has under ``path``."""
    return spark.read.schema("n long, batch long").json(f"{path}/_written").select("batch", "n")


def _start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each row of a stream once, as one line of JSON under ``path``."""
    return _start(df, lambda rows, batch: write_batch(rows, path, batch), checkpoint, available_now)


def follow_jsonl(spark: SparkSession, source: str, sink: str, checkpoint: str, select: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Write (path, line, value, error) of every line that is not blank, or what ``select`` makes of these, once each under ``sink``.

    Line numbers are those of ``read_jsonl``, whichever micro-batch reads the file and however often it is run again.
    """

    def each(lines: DataFrame, batch: int) -> None:
        rows = parsed_lines(number_lines(lines.withColumn("row", F.monotonically_increasing_id()), few=False))
        write_batch(select(rows) if select else rows, sink, batch)

    return _start(stream_lines(spark, source, max_files), each, checkpoint, available_now)
