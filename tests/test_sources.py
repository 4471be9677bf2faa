"""File heads, and streams of JSON Lines: numbers, restarts and replayed batches."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.sources import file_heads, file_types, jsonl
from siftwell.streaming import jsonl as stream


def test_heads_of_files_of_any_size(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x").write_bytes(b"BM")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "a.png").write_bytes(bytes.fromhex("FFD8FFE0"))
    (tmp_path / "deep" / "er" / "b").write_bytes(b"\0" * 257 + b"ustar" + b"\0" * 2000)
    with open(tmp_path / "deep" / "huge", "wb") as f:  # a hole of 3 GB
        f.write(bytes.fromhex("1F8B08"))
        f.truncate(3 << 30)
    found = {r["path"].removeprefix(f"file://{tmp_path}/"): (r["length"], r["kind"], r["mime"], r["error"]) for r in file_types.detect_files(spark, str(tmp_path)).collect()}
    assert found == {
        "empty": (0, None, None, None), "a.png": (4, "Jpeg", "image/jpeg", None), "deep/er/b": (2262, "Tar", "application/x-tar", None), "deep/huge": (3 << 30, "Gzip", "application/gzip", None),
    }
    assert [r["length"] for r in file_types.detect_files(spark, f"file://{tmp_path}", "*.png").collect()] == [4]
    assert [len(r["head"]) for r in file_heads.read_heads(spark, f"file:{tmp_path}/deep/huge", size=100).collect()] == [100]
    with pytest.raises(Exception, match="FileNotFound|No such|not found"):
        file_types.detect_files(spark, str(tmp_path / "none")).collect()


def test_planning_looks_at_one_level(tmp_path, monkeypatch):
    monkeypatch.setattr(file_heads, "GROUP", 3)
    for k in range(7):
        (tmp_path / f"f{k}").write_bytes(b"x" * k)
        (tmp_path / f"d{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 2}" / f"g{k}").write_bytes(b"y")
    reader = file_heads.HeadReader({"path": str(tmp_path)})
    splits = reader.partitions()
    assert sorted(len(s.files) for s in splits) == [0, 0, 1, 3, 3] and sum(s.folder is not None for s in splits) == 2
    paths = [p for s in splits for batch in reader.read(s) for p in batch.column("path").to_pylist()]
    assert len(paths) == len(set(paths)) == 14


def test_an_unreadable_file_gives_an_error_row(tmp_path):
    reader = file_heads.HeadReader({"path": str(tmp_path)})
    batch = next(iter(reader.read(file_heads.Split([(str(tmp_path / "gone"), 5)]))))
    assert batch.column("head").to_pylist() == [None] and batch.column("error").to_pylist()[0].startswith("I/O error: ")


def write_lines(folder, name, first, n):
    text = "".join("\n" if k % 5 == 4 else f'{{"k":{k}}} junk\n' if k % 7 == 6 else f'{{"k":{k}}}\n' for k in range(first, first + n))
    (folder / name).write_text(text)


def read_back(spark, sink):
    return sorted((r["path"].rsplit("/", 1)[1], r["line"], r["k"] if r["k"] is not None else -1, r["place"] or 0) for r in spark.read.schema("path string, line long, k long, place int").json(str(sink)).collect())


def test_followed_lines_have_the_batch_readers_numbers_after_restarts(spark, tmp_path):
    source, sink, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    chosen = lambda rows: rows.select("path", "line", F.try_variant_get("value", "$.k", "bigint").alias("k"), F.col("error.column").alias("place"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several blocks a file
    try:
        for turn in range(3):
            for k in range(2):
                write_lines(source, f"f{turn}{k}", 1000 * turn + 100 * k, 400)
            stream.follow_jsonl(spark, str(source), str(sink), str(state), chosen, max_files=1).awaitTermination(120)
        want = sorted((r["path"].rsplit("/", 1)[1], r["line"], r["k"] if r["k"] is not None else -1, r["place"] or 0) for r in chosen(jsonl.read_jsonl(spark, str(source))).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(want) == 6 * 320 and read_back(spark, sink) == want
    counts = {r["batch"]: r["n"] for r in stream.written(spark, str(sink)).collect()}
    assert sorted(counts) == list(range(6)) and set(counts.values()) == {320}


def test_a_replayed_batch_adds_no_line_and_counts_survive(spark, tmp_path):
    source, sink, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    write_lines(source, "a", 0, 50)
    rows = lambda: stream.stream_jsonl(spark, str(source)).select(F.try_variant_get("value", "$.k", "bigint").alias("k"))
    stream.write_stream(rows(), str(sink), str(state)).awaitTermination(120)
    once = sorted(r["value"] for r in spark.read.text(str(sink)).collect())
    # the batch was written, but its commit is lost: it runs again
    (state / "commits" / "0").unlink()
    (state / "commits" / ".0.crc").unlink(missing_ok=True)
    stream.write_stream(rows(), str(sink), str(state)).awaitTermination(120)
    assert sorted(r["value"] for r in spark.read.text(str(sink)).collect()) == once and len(once) == 40
    write_lines(source, "b", 100, 10)
    stream.write_stream(rows(), str(sink), str(state)).awaitTermination(120)
    assert {r["batch"]: r["n"] for r in stream.written(spark, str(sink)).collect()} == {0: 40, 1: 8}
    assert len(spark.read.text(str(sink)).collect()) == 48
    assert all(set(json.loads(x)) == {"k"} for x in once)
