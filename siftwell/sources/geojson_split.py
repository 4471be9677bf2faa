"""Features of GeoJSON files of any size, without a task that reads a whole file.

A file is cut into byte ranges.  What a range means depends on what stands before
it: whether it begins inside a string, and how deep.  So each range is read for
both cases, which gives a parity of quotes and two net depths; running sums over
the ranges of a file then tell where each begins.  A second reading finds the
root's members, and how many features begin in each range; a third cuts out the
features that begin in a range, reading on behind its end for the last one.  Only
a few numbers a range, and the root's own members, move between tasks.

Defined cases: the last of several ``features`` members counts; a file whose root
is no FeatureCollection object, or no JSON, gives no rows, as does one that cannot
be read; a faulty feature gives a row with the error that the whole document would
have, and others are not touched by it.  What stands between two features is not
checked, and numbers, strings or nulls in the list are passed over.  The store must be one that Arrow's file systems open.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.geojson import geo_parse
from siftwell.functions.json_scan import exact_json

from .file_heads import read_heads

#: Bytes of a range, and the most tasks that ranges are dealt to.
RANGE, TASKS = 8 << 20, 20_000
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")[ \t\n\r]*:[ \t\n\r]*$')


class Bytes:
    """Reads places of files; the last one opened stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, begin: int, end: int) -> bytes:
        from pyarrow import fs

        if path != self.path:
            self.close()
            store, inner = fs.FileSystem.from_uri(path) if not path.startswith("file://") else (fs.LocalFileSystem(), path.removeprefix("file://"))
            self.path, self.file = path, store.open_input_file(inner)
        return self.file.read_at(max(0, end - begin), begin)

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.path = self.file = None

    def before(self, path: str, at: int, size: int) -> bytes:
        return self.read(path, max(0, at - size), at)


def _escaped(files: Bytes, path: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before the byte ``at``."""
    size = 64
    while True:
        tail = files.before(path, at, size)
        count = len(tail) - len(tail.rstrip(b"\\"))
        if count < len(tail) or len(tail) == at:
            return count % 2 == 1
        size *= 2


def quotes_and_steps(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """(parity of unescaped quotes up to and with each byte, places of brackets)."""
    data = np.frombuffer(raw, np.uint8)
    quote = data == 0x22
    if escaped or b"\\" in raw:
        # the last place before each quote that is no backslash; those before the range count as one or none
        last = np.maximum.accumulate(np.where(data != 0x5C, np.arange(len(data), dtype=np.int32), np.int32(-1)))
        at = np.flatnonzero(quote)
        plain = np.where(at > 0, last[at - 1], -1)
        run = at - 1 - plain + ((plain < 0) & escaped)
        quote[at[run % 2 == 1]] = False
    return np.bitwise_xor.accumulate(quote.view(np.uint8)), np.flatnonzero(_STEP[data])


def _brackets(raw: bytes, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of brackets outside strings, depth behind each)."""
    parity, at = quotes_and_steps(raw, escaped)
    at = at[parity[at] == inside]
    return at, depth + np.cumsum(_STEP[np.frombuffer(raw, np.uint8)[at]])


def _ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(files, row, begin, bytes, whether its first byte is escaped) of every range that can be read."""
    files = Bytes()
    try:
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["idx"] * size
                try:
                    raw = files.read(row["path"], begin, min(begin + size, row["length"]))
                    escaped = _escaped(files, row["path"], begin)
                except OSError:
                    continue
                yield files, row, begin, raw, escaped
    finally:
        files.close()


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _summaries(chunks: DataFrame, size: int) -> DataFrame:
    """(path, length, idx, quotes, even, odd): parity of quotes, and net depth where the range begins outside or inside a string."""

    def run(batches):
        for _, row, _, raw, escaped in _ranges(batches, size):
            parity, at = quotes_and_steps(raw, escaped)
            step = _STEP[np.frombuffer(raw, np.uint8)[at]]
            odd = parity[at] == 1
            values = (row["path"], row["length"], row["idx"], int(parity[-1]) if len(parity) else 0, int(step[~odd].sum()), int(step[odd].sum()))
            yield _batch([values], ["path", "length", "idx", "quotes", "even", "odd"], [pa.string(), *[pa.int64()] * 5])

    return chunks.mapInArrow(run, "path string, length long, idx long, quotes long, even long, odd long")


def _is_features(files: Bytes, path: str, at: int) -> bool:
    """Whether the member that opens at ``at`` has the key ``features``."""
    size = 64
    while True:
        tail = files.before(path, at, size)
        found = _KEY.search(tail)
        # a quote after a backslash, or one cut off from what stands before it, need not begin the key
        if found and tail[: found.start()][-1:] in (b"{", b",", b" ", b"\t", b"\n", b"\r"):
            break
        if len(tail) == at:
            return False
        size *= 2
    try:
        return json.loads(found[1]) == "features"
    except ValueError:
        return False


def _members(placed: DataFrame, size: int) -> DataFrame:
    """(path, idx, kind, at, n, root): opening and closing places of root members, stretches of elements, and the root's own text."""
    names, types = ["path", "idx", "kind", "at", "n", "root"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for files, row, begin, raw, escaped in _ranges(batches, size):
            path, out = row["path"], []
            at, deep = _brackets(raw, escaped, row["inside"] == 1, row["depth"])
            opens = _STEP[np.frombuffer(raw, np.uint8)[at]] == 1
            add = lambda kind, place, n=None, root=None: out.append((path, row["idx"], kind, begin + int(place), n, root))  # noqa: E731,B023
            edges = at[(deep == 2) & opens | (deep == 1) & ~opens]
            for place in at[(deep == 2) & opens].tolist():
                if raw[place] == 0x5B and _is_features(files, path, begin + place):
                    add("features", place)
            for place in at[(deep == 1) & ~opens].tolist():
                add("close", place)
            elements = at[(deep == 3) & opens]
            stretch = np.searchsorted(edges, elements)
            _, first, count = np.unique(stretch, return_index=True, return_counts=True)
            for place, n in zip(elements[first].tolist(), count.tolist(), strict=True):
                add("elements", place, n)
            # the root with its members' insides left out
            shallow = np.flatnonzero(np.append(row["depth"], deep) <= 1)
            cuts = np.append(np.append(0, at + 1), len(raw))
            closes = np.append(False, (deep == 1) & ~opens)
            text = b"".join(raw[cuts[i] - closes[i] : cuts[i + 1]] for i in shallow.tolist())
            ends = at[(deep == 0) & ~opens]
            if len(ends):
                add("end", ends[0], len(ends))
            if text:
                add("root", 0, None, text)
            yield _batch(out, names, types)

    return placed.mapInArrow(run, "path string, idx long, kind string, at long, n long, root binary")


def _cut_out(wanted: DataFrame, size: int) -> DataFrame:
    """(path, pos, start, text) of the features that begin in each range."""

    def run(batches):
        for files, row, begin, raw, escaped in _ranges(batches, size):
            path, end = row["path"], min(begin + size, row["length"])
            at, deep = _brackets(raw, escaped, row["inside"] == 1, row["depth"])
            opens = _STEP[np.frombuffer(raw, np.uint8)[at]] == 1
            starts = at[(deep == 3) & opens]
            stops = at[(deep == 2) & ~opens]
            starts = starts[(starts + begin > row["open"]) & (starts + begin < row["close"])]
            if len(starts) and not (stops > starts[-1]).any():
                # the last feature ends behind the range: read on from its own first byte
                head, more = int(starts[-1]), size
                while True:
                    tail = files.read(path, begin + head, min(end + more, row["length"]))
                    places, depths = _brackets(tail, False, False, 2)
                    ended = places[(depths == 2)]
                    if len(ended) or end + more >= row["length"]:
                        raw = raw[:head] + tail
                        stops = np.append(stops, head + (int(ended[0]) if len(ended) else len(tail) - 1))
                        break
                    more *= 2
            ends = stops[np.searchsorted(stops, starts)] + 1
            rows = [(path, row["base"] + i, begin + a, raw[a:b].decode("utf-8", "replace")) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
            yield _batch(rows, ["path", "pos", "start", "text"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    return wanted.mapInArrow(run, "path string, pos long, start long, text string")


def feature_texts(spark: SparkSession, path: str, glob: str = "*", size: int = RANGE) -> DataFrame:
    """(path, pos, start, text) of every feature of the files under ``path``: its place in the list and its first byte."""
    heads = read_heads(spark, path, glob).where("error IS NULL AND length > 0")
    files = heads.where(F.decode("head", "ISO-8859-1").rlike(r"^[ \t\r\n]*(\{|$)")).select("path", "length")
    last = F.floor((F.col("length") - 1) / size).cast("long")
    # ranges of one file go to many tasks; a stated number, as rows of a few bytes would be gathered in one.  It follows the bytes,
    # not the ranges: small files or ranges would each be a task of their own
    ranges, eights = files.agg(F.sum(last + 1), F.sum(F.col("length")) / RANGE).first()
    parts = max(1, min(ranges or 0, max(4 * spark.sparkContext.defaultParallelism, int(eights or 0) + 1), TASKS))
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("idx")).repartition(parts, "path", "idx")
    before = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    sides = _summaries(chunks, size).withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    net = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    placed = sides.withColumn("depth", F.coalesce(F.sum(net).over(before), F.lit(0))).select("path", "length", "idx", "inside", "depth")
    # a few rows a range, asked for several times: kept, as each asking would read the files again
    placed = placed.persist()
    members = _members(placed.repartition(parts, "path", "idx"), size).persist()

    # a file of many documents, such as JSON Lines, has no root whose text could be gathered
    single = members.where("kind = 'end'").groupBy("path").agg(F.sum("n").alias("n")).where("n = 1")
    texts = members.where("kind = 'root'").join(single, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "root"))).alias("parts"))
    root = texts.select("path", exact_json(F.array_join(F.transform("parts", lambda p: F.decode(p["root"], "utf-8")), "")).alias("r"))
    listed = F.try_variant_get("r.value", "$.features", "array<variant>").isNotNull()
    roots = root.where((F.try_variant_get("r.value", "$.type", "string") == "FeatureCollection") & listed).select("path")
    opened = members.where("kind = 'features'").groupBy("path").agg(F.max("at").alias("open")).join(roots, "path", "left_semi")
    closed = members.where("kind = 'close'").join(opened, "path").where("at > open").groupBy("path", "open").agg(F.min("at").alias("close"))
    counts = members.where("kind = 'elements'").join(closed, "path").where("at > open AND at < close")
    based = counts.select("path", "idx", "open", "close", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return _cut_out(placed.join(based, ["path", "idx"]).repartition(parts, "path", "idx"), size)


def read_features(spark: SparkSession, path: str, glob: str = "*", size: int = RANGE) -> DataFrame:
    """(path, pos, start, text, ok, value VARIANT, error) of every feature of the files under ``path``."""
    rows = feature_texts(spark, path, glob, size)
    whole = geo_parse(F.concat(F.lit('{"type":"FeatureCollection","features":['), "text", F.lit("]}")))
    g = rows.select("path", "pos", "start", "text", whole.alias("g"))
    at = F.concat(F.lit("features["), F.col("pos").cast("string"), F.lit("]"))
    error = F.when(~F.col("g.ok"), F.col("g.error").withField("path", F.regexp_replace("g.error.path", F.lit(r"^features\[0\]"), at)))
    return g.select("path", "pos", "start", "text", "g.ok", F.variant_get("g.value", "$.features[0]", "variant").alias("value"), error.alias("error"))
