"""JSON Lines: read with physical line numbers and error rows, write one value a line.

Lines end at LF alone.  Blank lines (all Unicode white space) are skipped but
counted.  A bad line becomes a row with an error; reading goes on behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.columns import WHITE_SPACE, as_column, let, trim_space
from siftwell.functions.json_scan import exact_json, fault_text

#: So many rows may be sent to all tasks.
MOST_SENT = 100_000


def parse_line(line: Column | str) -> Column:
    """Struct (value, error struct(kind, message, column)) of one line; null for a blank or null line.

    The last of equal keys wins.  A message gives the reason of the first fault and its place: the column counts bytes of the
    line without the white space around it, from 1.
    """
    c = as_column(line)
    found = exact_json(let(let(c, lambda t: F.when(F.is_valid_utf8(t), trim_space(t))), lambda t: F.when(t != "", t)))

    def parsed(x: Column) -> Column:
        fault = x["found"]["error"]
        kind = F.when(~x["text"], "Io").when(fault.isNotNull(), "Json")
        message = F.when(kind == "Io", "I/O error: stream did not contain valid UTF-8").when(kind == "Json", F.concat(F.lit("JSON error: "), fault_text(fault)))
        error = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), message.alias("message"), fault["column"].alias("column")))
        # a line that is not blank has a value or a fault
        return F.when(~x["text"] | fault.isNotNull() | x["found"]["value"].isNotNull(), F.struct(x["found"]["value"].alias("value"), error.alias("error")))

    return let(F.struct(F.is_valid_utf8(c).alias("text"), found.alias("found")), parsed)


def number_lines(raw: DataFrame, few: bool) -> DataFrame:
    """(path, line, text) of rows (path, block, row, text), where ``row`` grows along each block.

    A line's number is its place in the block plus the lines of the file's earlier blocks.  Only one row a
    block is shuffled; ``few`` tells whether these can be sent to all tasks.
    """
    splits = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return raw.join(F.broadcast(offsets) if few else offsets, ["path", "block"]).select("path", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, text) with the 1-based physical line number in each file.

    Splits are read in parallel.  Up to ``MOST_SENT`` numbers of lines are sent to all tasks, more are joined by a shuffle.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text")
    )
    # a task reads one split of a large file or several whole files
    return number_lines(raw, len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= MOST_SENT)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(path, line, value VARIANT, error struct(line, kind, message, column)) of lines (path, line, text) that are not blank."""
    # blank lines are known by their text: a condition on what is parsed would go below the join of ``number_lines``, to be parsed twice
    rows = lines.where(~F.is_valid_utf8("text") | F.col("text").rlike(f"[^{WHITE_SPACE}]")).withColumn("p", parse_line("text"))
    error = F.when(F.col("p.error").isNotNull(), F.struct(F.col("line"), F.col("p.error.kind").alias("kind"), F.col("p.error.message").alias("message"), F.col("p.error.column").alias("column")))
    return rows.select("path", "line", F.col("p.value").alias("value"), error.alias("error"))


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, value VARIANT, error struct(line, kind, message, column)) of every line that is not blank."""
    return parsed_lines(numbered_lines(spark, path))


def error_text(error: Column) -> Column:
    return F.concat(F.lit("jsonl error on line "), error["line"].cast("string"), F.lit(": "), error["message"])


def to_line(value: Column | str) -> Column:
    """Compact JSON of a struct, map, array or VARIANT column; null fields are kept."""
    return F.to_json(as_column(value), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, value: Column | str | None = None, one_file: bool = False, mode: str = "errorifexists") -> int:
    """Write one value a line: ``value``, or the whole row as an object.  Returns how many lines were written.

    Where a task fails for good, the write fails and commits no file.  ``one_file`` is for small results: one task writes them all.
    """
    line, seen = to_line(F.struct(*[F.col(f"`{c}`") for c in df.columns]) if value is None else value).alias("value"), Observation()
    lines = df.select(line).observe(seen, F.count(F.lit(1)).alias("n"))
    (lines.coalesce(1) if one_file else lines).write.mode(mode).option("lineSep", "\n").text(path)
    return seen.get["n"]
