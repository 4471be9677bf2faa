"""Repeated passages by a sparse suffix array.

Of all word suffixes only those at minimiser positions are kept: of any
``min_words`` consecutive words, the place of the smallest hashed ``k``-gram is
kept, so equal passages keep equal places.  Suffixes whose ``k``-gram occurs in
no other document are dropped.

The kept suffixes, each with the words to its left, are sorted over all
partitions.  Neighbours are compared word by word for the length of their common
prefix; a run of neighbours that share enough words to the right is extended to
the left, and those that also agree there hold the same ``min_words`` words.  A
run that reaches the edge of a partition, or of a block of ``BLOCK`` suffixes, is
left open, and its windows are joined with those of the other side by their
hashes; so a suffix array of any size or skew is read in blocks of one size.
Each run has one owner, the smallest id that holds the window.  Overlapping
windows of a document with the same owner are merged to a span; spans of
different owners stay apart.

Copies cost little: equal contexts are folded into one row that stands for all
its places, and only that one is sorted.

A passage is found whole and wherever it stands.  Words are compared by 64-bit
keys, which clash with a chance of about 2**-64; U+0000 in a word counts as U+0001.

Defined cases: a null text is empty; texts under ``min_words`` words have no
span; rows equal in key and text are one document, and rows that share a key with
other texts are documents of their own; a very long text is read in one task; ties for an owner go to the smallest hash; an empty table gives an empty
result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name
from .words import U, mix, text_buffers, windows, word_keys

#: A gram is hot where it holds more than one in so many of the places.
HOT = 1000
#: Sorted suffixes that a task compares at once, and contexts that it cuts from a text at once.
BLOCK, AT_ONCE = 1 << 16, 1 << 12
STEP = U(0xD6E8FEB86659FD93)
LONG, INT = T.LongType(), T.IntegerType()


def anchors(words, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, place of its minimiser, k-gram there) of every window of ``min_words`` words."""
    wide = min_words - k + 1
    at, key = windows(words, k)
    if not len(at):
        return at, at, key
    # k-grams are laid out by place so that a window is a slice; the low bits carry the place
    grams = np.full(len(words.key), np.iinfo(U).max, U)
    grams[at] = key
    low = U((1 << 20) - 1)
    packed = (grams & ~low) | (np.arange(len(grams), dtype=U) & low)
    least, span = packed, 1
    while span * 2 <= wide:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    first = np.arange(max(0, len(words.key) - min_words + 1))
    first = first[words.row[first] == words.row[first + min_words - 1]]
    place = first + ((least[first] - first.astype(U)) & low).astype(np.int64)
    return first, place, grams[place]


def _anchor_rows(base: DataFrame, k: int, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for words in word_keys(batch.column("text"), lower=False):
                _, place, gram = anchors(words, k, min_words)
                place, one = np.unique(place, return_index=True)
                gram = gram[one]
                row = words.row[place]
                pos = place - words.bounds()[row - words.first]
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(gram.view(np.int64)), pa.array(pos, pa.int32())], names=["uid", "gram", "pos"])

    return base.select("uid", "text").mapInArrow(run, "uid long, gram long, pos int")


def _fields(**types) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a ``uid`` that the task has not had before; equal documents come to one task."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, uid in enumerate(batch.column("uid").to_pylist()):
            if uid not in seen:
                seen.add(uid)
                new.append(i)
        yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))


def _occurrences(listed: DataFrame, k: int, min_words: int) -> DataFrame:
    """(uid, id, start, n_left, n, cid) of every kept place: it has ``n`` windows, from word ``start`` on, and stands ``n_left`` words later."""
    schema = _fields(uid=LONG, id=listed.schema["id"].dataType, start=INT, n_left=INT, n=INT, cid=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_rows(batches):
            uid, ids, places = batch.column("uid").to_numpy(), batch.column("id"), batch.column("places")
            owner, offsets = places.flatten().to_numpy(), places.offsets.to_numpy()
            for words in word_keys(batch.column("text"), lower=False):
                first, place, _ = anchors(words, k, min_words)
                if not len(first):
                    continue
                cuts = words.bounds()
                held = np.zeros(len(words.key), bool)
                counts = np.diff(offsets[words.first : words.last + 1])
                held[owner[offsets[words.first] : offsets[words.last]] + np.repeat(cuts[:-1], counts)] = True
                at, key = windows(words, min_words)  # the same windows as ``first``
                keep = held[place]
                at, key, place = at[keep], key[keep], place[keep]
                if not len(at):
                    continue
                begin = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(at) != 1)])
                size = np.diff(np.append(begin, len(at)))
                with np.errstate(over="ignore"):
                    step = (np.arange(len(at)) - np.repeat(begin, size)).astype(U)
                    cid = mix(np.add.reduceat(mix(key + step * STEP), begin))
                row = words.row[at[begin]]
                columns = [pa.array(uid[row]), ids.take(pa.array(row)), pa.array(at[begin] - cuts[row - words.first], pa.int32())]
                columns += [pa.array(place[begin] - at[begin], pa.int32()), pa.array(size, pa.int32()), pa.array(cid.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return listed.select("uid", "id", "text", "places").mapInArrow(run, schema)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of ``data`` as strings."""
    size = np.maximum(end - begin, 0)
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at])])


def _contexts(listed: DataFrame, min_words: int) -> DataFrame:
    """(suffix, left, ...) of every context in the list ``held``: its words from the place on and those before it, parted by U+0000."""
    held = listed.schema["held"].dataType.elementType
    schema = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("left", T.StringType()), *held.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_rows(batches):
            lists = batch.column("held")
            items, offsets = pa.RecordBatch.from_struct_array(lists.flatten()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            start, n_left, n = (items.column(c).to_numpy() for c in ("start", "n_left", "n"))
            for words in word_keys(batch.column("text"), lower=False):
                lo, hi = offsets[words.first], offsets[words.last]
                size = words.end - words.start + 1
                ends = np.append(0, np.cumsum(size))
                # the words, each with one sign after it, so that the order of texts is that of their words
                data = np.zeros(ends[-1], np.uint8)
                inside = np.ones(ends[-1], bool)
                inside[ends[1:] - 1] = False
                source = np.repeat(words.start - ends[:-1], size) + np.arange(ends[-1])
                data[inside] = np.maximum(words.data[source[inside]], 1)
                row = np.repeat(np.arange(words.last - words.first), np.diff(offsets[words.first : words.last + 1]))
                at = words.bounds()[row] + start[lo:hi]
                for i in range(0, hi - lo, AT_ONCE):
                    part = slice(i, i + AT_ONCE)
                    both = slice(lo + i, min(lo + i + AT_ONCE, hi))
                    place = at[part] + n_left[both]
                    columns = [_strings(data, ends[place], ends[at[part] + n[both] + min_words - 1] - 1), _strings(data, ends[at[part]], ends[place] - 1)]
                    yield pa.RecordBatch.from_arrays([*columns, *items.slice(both.start, both.stop - both.start).columns], names=schema.names)

    return listed.select("uid", "text", "held").mapInArrow(run, schema)


def _matrix(texts: pa.Array, width: int, backward: bool) -> np.ndarray:
    """Keys of the words of each row, from the first on or from the last back; 0 where there is none."""
    offsets, data = text_buffers(texts)
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(np.where(data == 0, np.uint8(0x20), data))])
    keys = np.zeros((len(texts), width), U)
    for words in word_keys(spaced, lower=False):
        cuts, row = words.bounds(), words.row - words.first
        place = np.arange(len(words.row))
        place = cuts[row + 1] - 1 - place if backward else place - cuts[row]
        kept = place < width
        keys[words.row[kept], place[kept]] = words.key[kept]
    return keys


def _prefix_hashes(keys: np.ndarray) -> np.ndarray:
    """Column ``i``: hash of the first ``i`` words of each row."""
    out = np.zeros((len(keys), keys.shape[1] + 1), U)
    with np.errstate(over="ignore"):
        for i in range(keys.shape[1]):
            out[:, i + 1] = mix(out[:, i] * STEP + keys[:, i] + U(1))
    return out


def common_prefix(keys: np.ndarray) -> np.ndarray:
    """Number of first words that each row shares with the row before it; -1 for the first row."""
    differ = keys[1:] != keys[:-1]
    return np.append(-1, np.where(differ.any(1), differ.argmax(1), keys.shape[1])).astype(np.int64)[: len(keys)]


def compare_block(rows: pa.Table, suffix: np.ndarray, shared: np.ndarray, k: int, min_words: int, open_start: bool, open_end: bool) -> pa.RecordBatch:
    """Pieces of contexts that other documents hold, and the windows of the runs that reach an open edge.

    ``suffix`` are the word keys of the sorted suffixes, ``shared`` their common prefixes with the row before.
    """
    low, high, n_left, n = (rows.column(c).to_numpy() for c in ("low", "high", "n_left", "n"))
    wide = min_words - k + 1
    left, right = _prefix_hashes(_matrix(rows.column("left"), wide - 1, True)), _prefix_hashes(suffix)
    ids, uid = rows.column("owner_id"), rows.column("owner_uid").to_numpy()
    # equal owners have one rank, so that their windows make one piece
    number = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    order = np.lexsort((uid, number))
    other = np.append(True, (np.diff(number[order].astype(np.int64)) != 0) | (np.diff(uid[order]) != 0))
    rank, by_rank = np.empty(len(order), np.int64), order[other]
    rank[order] = np.cumsum(other) - 1
    owners = np.full((len(rank), wide + 1), -1, np.int64)
    after = np.append(shared[1:], -1)
    open_row, open_j, open_hash = [], [], []
    for a in range(wide):
        # windows with ``a`` words to the left of the place and the others to its right
        need = min_words - a
        run = np.cumsum(shared < need) - 1
        edge = (run == 0) & open_start | (run == run[-1]) & open_end
        has = (a <= n_left) & (a > n_left - n)
        row = np.flatnonzero(has & edge)
        open_row.append(row)
        open_j.append(n_left[row] - a)
        with np.errstate(over="ignore"):
            open_hash.append(mix(left[row, a] * STEP + right[row, need]))
        row = np.flatnonzero(has & ~edge & ((shared >= need) | (after >= need) | (low < high)))
        if not len(row):
            continue
        row = row[np.lexsort((left[row, a], run[row]))]
        begin = np.flatnonzero(np.r_[True, (np.diff(run[row]) != 0) | (left[row[1:], a] != left[row[:-1], a])])
        many = np.minimum.reduceat(low[row], begin) < np.maximum.reduceat(high[row], begin)
        first = np.where(many, np.minimum.reduceat(rank[row], begin), -1)
        owners[row, n_left[row] - a] = np.repeat(first, np.diff(np.append(begin, len(row))))
    # windows in a row with the same owner are one piece
    flat = owners.ravel()
    change = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    stop = np.append(change[1:], len(flat))
    closed = flat[change] >= 0
    begin, stop, first = change[closed], stop[closed], by_rank[flat[change[closed]]]
    row, j, hashes = (np.concatenate(x) for x in (open_row, open_j, open_hash))
    cid = rows.column("cid").to_numpy()
    piece_row, from_j, to_j = begin // (wide + 1), begin % (wide + 1), (stop - 1) % (wide + 1)
    owner_row = np.append(first, row)
    none, no = np.zeros(len(begin), np.int64), np.append(np.ones(len(begin), bool), np.zeros(len(row), bool))
    columns = [
        pa.array(np.append(cid[piece_row], cid[row])),
        pa.array(np.append(from_j, j), pa.int32()),
        pa.array(np.append(to_j, j) + min_words, pa.int32()),
        ids.combine_chunks().take(pa.array(owner_row)),
        pa.array(uid[owner_row]),
        pa.array(np.append(none, hashes.view(np.int64)), mask=no),
        pa.array(np.append(none, low[row]), mask=no),
        pa.array(np.append(none, high[row]), mask=no),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cid", "a", "b", "id", "uid", "hash", "low", "high"])


def _neighbours(contexts: DataFrame, k: int, min_words: int, block: int) -> DataFrame:
    """(cid, a, b, id, uid, hash, low, high): owned pieces of contexts; those with a hash are windows of open runs."""
    schema = _fields(cid=LONG, a=INT, b=INT, id=contexts.schema["owner_id"].dataType, uid=LONG, hash=LONG, low=LONG, high=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_start = [], True

        def compare(last: bool) -> pa.RecordBatch:
            nonlocal held, open_start
            rows = pa.Table.from_batches(held)
            suffix = _matrix(rows.column("suffix"), min_words, False)
            shared = common_prefix(suffix)
            # the last place where a new k-gram begins: no run goes over it
            fresh = 0 if last else int(np.flatnonzero(shared < k)[-1])
            size = fresh or len(shared)
            found = compare_block(rows.slice(0, size), suffix[:size], shared[:size], k, min_words, open_start, not fresh)
            held, open_start = rows.slice(size).to_batches(), not fresh
            return found

        for batch in batches:
            for i in range(0, batch.num_rows, block):
                held.append(batch.slice(i, block))
                if sum(b.num_rows for b in held) >= block:
                    yield compare(False)
        if sum(b.num_rows for b in held):
            yield compare(True)

    ordered = contexts.repartitionByRange("suffix", "left").sortWithinPartitions("suffix", "left")
    return ordered.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, min_words: int = 50, k: int = 12, key: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, start, end, n_words, first_id, row_key, first_row): merged spans of words that another document holds too.

    ``first_id`` is the smallest id of all documents that hold the windows of the span.  Rows that share an id are told
    apart by ``row_key``, a hash of id and text; ``first_row`` is that of the owner, whose copy stays.
    """
    base = docs.select(F.col(key).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    places = cut(_anchor_rows(base, k, min_words))
    # one aggregation serves both sides: it is already dealt by gram where the cold places meet it
    busy = places.groupBy("gram").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.count("*").alias("n")).where("low < high")
    rows = places.count()
    # at most HOT grams can hold more than one in HOT of the rows: these are sent to the places, not the places to one task
    hot = F.broadcast(busy.where(F.col("n") * HOT > rows).select("gram"))
    cold = places.join(hot, "gram", "left_anti").join(busy.where(F.col("n") * HOT <= rows).select("gram"), "gram", "left_semi")
    kept = places.join(hot, "gram", "left_semi").unionByName(cold)
    # texts meet short lists of places, which are hashed: no text is sorted
    listed = cut(kept.groupBy("uid").agg(F.collect_set("pos").alias("places")))
    occurrences = cut(_occurrences(base.join(listed.hint("shuffle_hash"), "uid"), k, min_words))

    # equal contexts are one row, which stands where the smallest uid holds it
    folded = occurrences.groupBy("cid").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.min(F.struct("id", "uid")).alias("owner"), F.min(F.struct("uid", "start", "n_left", "n")).alias("at"))
    context = F.struct("cid", "at.start", "at.n_left", "at.n", "low", "high", F.col("owner.id").alias("owner_id"), F.col("owner.uid").alias("owner_uid"))
    holders = cut(folded.groupBy(F.col("at.uid").alias("uid")).agg(F.collect_list(context).alias("held")))
    contexts = cut(_contexts(base.join(holders.hint("shuffle_hash"), "uid"), min_words))
    found = cut(_neighbours(contexts, k, min_words, block)).withColumn("owner", F.struct("id", "uid"))

    edges = found.where("hash IS NOT NULL")
    runs = edges.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("owner").alias("owner")).where("low < high").select("hash", "owner")
    owned = edges.select("cid", "a", "hash").join(runs, "hash").groupBy("cid", "owner").agg(F.array_sort(F.collect_set("a")).alias("js"))
    # windows in a row with the same owner are one piece
    starts = F.filter("js", lambda j: ~F.array_contains("js", j - 1))
    ends = F.filter("js", lambda j: ~F.array_contains("js", j + 1))
    joined = owned.select("cid", "owner", F.inline(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b + min_words).alias("b")))))
    pieces = found.where("hash IS NULL").select("cid", "owner", "a", "b").unionByName(joined)

    spans = occurrences.select("uid", "id", "start", "cid").join(pieces, "cid")
    span = F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    per_doc = spans.groupBy("uid", "id", "owner").agg(F.array_sort(F.collect_set(span)).alias("spans"))

    def merge(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (s["a"] <= F.try_element_at(acc, F.lit(-1))["b"]), grown).otherwise(F.concat(acc, F.array(s)))

    merged = per_doc.select("uid", "id", "owner", F.explode(F.aggregate("spans", F.array().cast("array<struct<a:int,b:int>>"), merge)).alias("s"))
    return merged.select(
        F.col("id").alias(key),
        F.col("s.a").alias("start"),
        F.col("s.b").alias("end"),
        (F.col("s.b") - F.col("s.a")).alias("n_words"),
        F.col("owner.id").alias("first_id"),
        F.col("uid").alias("row_key"),
        F.col("owner.uid").alias("first_row"),
    )


def cut_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of ``spans`` in every document but the span's first; white space around them is joined by one space."""
    cuts, row = free_name(docs, "cuts"), free_name(docs, "row_key")
    drop = spans.where("row_key <> first_row").groupBy(F.col("row_key").alias(row)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    ws = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    kept = F.filter(ws, lambda w, i: ~F.exists(cuts, lambda c: (i >= c["start"]) & (i < c["end"])))
    joined = docs.withColumn(row, F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).join(drop, row, "left")
    return joined.select(*[F.when(F.col(cuts).isNull(), F.col(f"`{c}`")).otherwise(F.array_join(kept, " ")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
