"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct word shingles.  Its signature is
``chunks * chunk_size`` MinHash values of 16 bits.  Two signatures that differ
in at most ``chunks * (errors + 1) - 1`` values differ in at most ``errors``
values of some chunk (pigeonhole), so each chunk is indexed under every way of
leaving ``errors`` of its values out: all pairs under that distance meet under
some key.  Links are then confirmed on the full sets.

Equal sets are first folded into one class with a number of its own, so a group
of exact copies counts as one row and rows that share an id never share a class by it.  Under a key, members are first linked to one
centre, a different one in a second round; only keys of three or more members
that are still in several components are then compared pairwise, in blocks of
bounded size: by a longer signature of ``LONG`` values, of which a pair at the
threshold differs in more than ``long_distance`` with a chance of about 1e-9, then by their sets folded to 16 bits, which can only raise a similarity.
The pairs that are left go on to be confirmed, once each.  So a large
group of near copies costs a row or two per member, and no link between
different components is lost to a cap.  Components come from repeated hooking to the smallest label with
shortcuts; every round is written to the shared folder.

Defined cases: a null text, or one without words, has an empty set and is linked
with nothing; a document with fewer words than a shingle has its whole sequence
as its one shingle; rows that share an id are each judged by their own text; a
null id is never linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name
from .words import U, mix, windows, word_keys

CHUNKS, CHUNK_SIZE = 8, 4
#: Every pair that differs in at most this many values of the signature is found, with one error a chunk.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Values of the longer signature.
LONG = 256
_MULTIPLIERS = mix(np.arange(1, LONG + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def long_distance(percent: int) -> int:
    """How many values of the longer signature a pair of that similarity differs in at most: the mean and six standard deviations."""
    differ = (1 - percent / 100) * (1 - 1 / 256)
    return int(LONG * differ + 6 * (LONG * differ * (1 - differ)) ** 0.5) + 1


def shingle_sets(texts, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle keys) of every row."""
    for words in word_keys(texts):
        at, key = windows(words, n)
        bounds = words.bounds()
        cuts = np.searchsorted(at, bounds)
        for k in range(words.last - words.first):
            if bounds[k] == bounds[k + 1]:
                yield words.first + k, np.zeros(0, U)
            elif bounds[k + 1] - bounds[k] < n:
                with np.errstate(over="ignore"):
                    whole = reduce(lambda a, b: mix(a * U(0xD6E8FEB86659FD93) + b), words.key[bounds[k] : bounds[k + 1]], np.full(1, bounds[k + 1] - bounds[k], U))
                yield words.first + k, whole
            else:
                yield words.first + k, np.unique(key[cuts[k] : cuts[k + 1]])


def min_hashes(shingles: np.ndarray, n: int, block: int = 1 << 14) -> np.ndarray:
    least = np.full(n, np.iinfo(U).max, U)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), block):
            least = np.minimum(least, (shingles[a : a + block, None] * _MULTIPLIERS[:n]).min(axis=0))
    return mix(least)


def signature(shingles: np.ndarray) -> np.ndarray:
    return (min_hashes(shingles, CHUNKS * CHUNK_SIZE) >> U(48)).astype("<u2")


def long_signature(shingles: np.ndarray) -> np.ndarray:
    return (min_hashes(shingles, LONG) >> U(56)).astype(np.uint8)


SKETCH = "doc long, body long, n_shingles long, set_a long, set_b long, signature binary"


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """(doc, body, n_shingles, set_a, set_b, signature) of every row of ``docs`` (doc, body, text); (set_a, set_b) is a 128-bit key of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, s in shingle_sets(batch.column("text"), n):
                with np.errstate(over="ignore"):
                    a, b = int(s.sum().astype(np.int64)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum().astype(np.int64))
                out.append((len(s), a, b, signature(s).tobytes() if len(s) else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [batch.column("doc"), batch.column("body"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "body", "n_shingles", "set_a", "set_b", "signature"])

    return docs.mapInArrow(run, SKETCH)


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, slot, id): each chunk with each of its values left out in turn; ``slot`` numbers the ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(n, CHUNKS, CHUNK_SIZE).astype(U)
            keys = np.empty((n, CHUNKS, CHUNK_SIZE), U)
            for c in range(CHUNKS):
                for skip in range(CHUNK_SIZE):
                    code = np.full(n, c * CHUNK_SIZE + skip, U)
                    for k in range(CHUNK_SIZE):
                        if k != skip:
                            code = mix((code << U(16)) ^ sigs[:, c, k] ^ (code >> U(48)))
                    keys[:, c, skip] = code
            ids = np.repeat(batch.column("id").to_numpy(), CHUNKS * CHUNK_SIZE)
            slots = np.tile(np.arange(CHUNKS * CHUNK_SIZE, dtype=np.int8), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(slots), pa.array(ids, pa.int64())], names=["key", "slot", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, slot byte, id long")


def member_sets(docs: DataFrame, n: int, flush: int = 8 << 20) -> DataFrame:
    """(id, members, long, folded): the set of every row of ``docs`` (id, text) as packed sorted keys, its longer signature, and 16 bits of each key."""

    def packed(batch: pa.RecordBatch, rows: list, out: list) -> pa.RecordBatch:
        columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *columns], names=["id", "members", "long", "folded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, size = [], [], 0
            for row, s in shingle_sets(batch.column("text"), n):
                rows.append(row)
                out.append((s.tobytes(), long_signature(s).tobytes(), (s >> U(48)).astype("<u2").tobytes()))
                size += s.nbytes
                if size > flush:
                    yield packed(batch, rows, out)
                    rows, out, size = [], [], 0
            if rows:
                yield packed(batch, rows, out)

    return docs.mapInArrow(run, "id long, members binary, long binary, folded binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) with 100 * intersection >= ``percent`` * union on full sets (``sets``: id, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                common = 0
                if 100 * len(small) >= percent * len(large):
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("right")), "b")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that can be reached."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    # first labels need no shuffle beyond the links': the smallest neighbour or the id itself
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(F.col("a").alias("id"), "component"))
    edges = cut(both)
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("hook"))
        above = labels.select(F.col("id").alias("hook"), F.col("component").alias("short"))
        moved = cut(hooked.join(above, "hook", "left").select("id", F.least("hook", "short").alias("component"), F.col("component").alias("old")))
        labels = moved.select("id", "component")
        if moved.where(F.col("component") < F.col("old")).isEmpty():
            return labels


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each key's members with one centre of the key, which differs by ``turn``."""
    order = F.struct(F.when(F.lit(turn) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(turn), "id")), F.col("id"))
    centres = members.groupBy("key").agg(F.min(order)["id"].alias("centre"))
    met = members.join(centres, "key").where(F.col("id") != F.col("centre"))
    return met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def block_pairs(members: DataFrame, percent: int, block: int = 1024, task_rows: int = 20_000) -> DataFrame:
    """Pairs of each key's members in different components that longer signatures and folded sets let pass.

    ``members``: key, slot, id, component, signature, long, folded.  A key's members are
    parted into classes of set size so wide that similar sets lie in the same or in
    neighbouring ones, and a class is dealt into blocks by hash; each two blocks of
    one class or of neighbouring ones are a group of bounded size, and groups are
    gathered into tasks of about ``task_rows`` rows.  A pair that meets under several
    keys is given under the first alone.
    """
    width = F.log(F.lit(100 / percent))
    classed = members.withColumn("class", F.floor(F.log(F.greatest(F.octet_length("folded") / 2, F.lit(1))) / width - F.lit(1e-9)))
    sizes = classed.groupBy("key", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    below, above = (sizes.select("key", (F.col("class") + step).alias("class"), F.col("blocks").alias(name)) for step, name in ((1, "below"), (-1, "above")))
    around = sizes.join(below, ["key", "class"], "left").join(above, ["key", "class"], "left")
    own = classed.join(around, ["key", "class"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda low, across, i, j, left, right: F.struct(low.alias("class"), F.lit(across).alias("across"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    at, yes, no = F.col("own"), F.lit(True), F.lit(False)
    places = F.concat(
        F.transform(numbers("blocks"), lambda x: group(F.col("class"), False, F.least(at, x), F.greatest(at, x), at <= x, at >= x)),
        F.transform(numbers("above"), lambda x: group(F.col("class"), True, at, x, yes, no)),
        F.transform(numbers("below"), lambda x: group(F.col("class") - 1, True, x, at, no, yes)),
    )
    marks = ["key", "class", "across", "i", "j"]
    grid = own.select("key", "slot", "id", "component", "signature", "long", "folded", F.explode(places).alias("g"))
    grid = cut(grid.select("key", "g.*", "slot", "id", "component", "signature", "long", "folded"))
    tasks, most = max(1, -(-grid.count() // task_rows)), long_distance(percent)

    def first_slot(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        equal = (many == one).reshape(len(many), CHUNKS, CHUNK_SIZE)
        lone = equal.sum(axis=2)[:, :, None] - equal  # equal values besides the one left out
        return (lone >= CHUNK_SIZE - 1).reshape(len(many), CHUNKS * CHUNK_SIZE).argmax(axis=1)

    def pairs(group: pd.DataFrame, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = group if same else group[group["left"]]
        right = group if same else group[group["right"]]
        slot, ids, comps = group["slot"].iloc[0], right["id"].to_numpy(), right["component"].to_numpy()
        unpack = lambda side, c, kind: np.frombuffer(b"".join(side[c]), kind).reshape(len(side), -1)
        folded, table = [np.frombuffer(x, "<u2") for x in right["folded"]], np.zeros(1 << 16, bool)
        short, long = unpack(right, "signature", "<u2"), unpack(right, "long", np.uint8)
        for k, (x, c, s, w, f) in enumerate(zip(left["id"], left["component"], unpack(left, "signature", "<u2"), unpack(left, "long", np.uint8), left["folded"], strict=True)):
            near = np.flatnonzero(comps != c)
            near = near[near > k] if same else near
            near = near[(long[near] != w).sum(axis=1) <= most]
            near = near[first_slot(s, short[near]) == slot]
            if len(near):
                f = np.frombuffer(f, "<u2")
                table[f] = True
                common = np.array([int(table[folded[y]].sum()) for y in near])
                table[f] = False
                near = near[100 * common >= percent * (len(f) + np.array([len(folded[y]) for y in near]) - common)]
            yield np.full(len(near), x), ids[near]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(marks, ignore_index=True)
        of = rows[marks].to_numpy(dtype=np.int64)
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        found = [p for a, b in zip(cuts, cuts[1:], strict=False) for p in pairs(rows.iloc[a:b], not of[a][2] and of[a][3] == of[a][4])]
        a, b = (np.concatenate([p[k] for p in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return grid.groupBy(F.pmod(F.xxhash64(*marks), F.lit(tasks))).applyInPandas(run, "a long, b long").distinct()


def _bodies(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(doc, body, text): with the id, ``body`` tells a row's text, so rows that share an id are told apart."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))


def judged(docs: DataFrame, shingle: int, percent: int, key: str, text_col: str) -> DataFrame:
    """(doc, body, n_shingles, first) of every row: ``first`` (doc, body) is the smallest of all rows that can be reached."""
    if percent < 70 or not isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType)):
        raise ValueError("near duplicates need a similarity of 70 percent or more and keys that are whole numbers")
    bodies = _bodies(docs, key, text_col)
    rows = cut(sketch(bodies, shingle))
    full = rows.where((F.col("n_shingles") > 0) & F.col("doc").isNotNull())
    folded = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc", "body")).alias("first"), F.min("signature").alias("signature"))
    classes = cut(folded.withColumn("id", F.monotonically_increasing_id()))
    keys = chunk_keys(classes)
    busy = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(keys.join(busy, "key"))
    signatures = classes.select("id", "signature")
    wanted = members.select("id").distinct().join(classes.select("id", "first.*"), "id")
    sets = cut(member_sets(bodies.join(wanted, ["doc", "body"]).select("id", "text"), shingle))

    tried = cut(star_pairs(members, 0))
    links = cut(confirm(tried, sets, percent))
    labels = components(links)
    for turn in (1, 2):
        placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # a key's two members have met their centre already
        torn = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("key")
        rest = cut(placed.join(torn, "key", "left_semi").select("key", "slot", "id", "component"))
        if rest.isEmpty():
            break
        fresh = star_pairs(rest, turn) if turn == 1 else block_pairs(rest.join(signatures, "id").join(sets.select("id", "long", "folded"), "id"), percent)
        fresh = cut(fresh.join(tried, ["a", "b"], "left_anti"))
        more = cut(confirm(fresh, sets, percent))
        if not more.isEmpty():
            links, tried = links.union(more), tried.union(fresh)
            labels = components(links)
        else:
            tried = tried.union(fresh)

    # a component is known by the smallest row of its classes; only linked classes are looked at
    linked = labels.join(classes.select("id", "first"), "id")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("id", "least")
    label = classes.join(named, "id", "left").select("set_a", "set_b", F.coalesce("least", "first").alias("least"))
    found = rows.join(label, ["set_a", "set_b"], "left")
    first = F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("least"))
    return found.select("doc", "body", "n_shingles", F.coalesce(first, F.struct("doc", "body")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``; keys are whole numbers.

    A pair at similarity s meets under no key with a chance of (1 - 4 s^3 + 3 s^4) ** CHUNKS: about 1e-6 at 0.8 and
    1e-4 at 0.7, the least that is taken.
    """
    found, kind = judged(docs, shingle, percent, key, text_col), docs.schema[key].dataType
    kept = F.coalesce(F.col("doc") == F.col("first.doc"), F.lit(True)).alias("kept")
    return found.select(F.col("doc").cast(kind).alias(key), "n_shingles", F.col("first.doc").cast(kind).alias("component_id"), kept)


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id, and of these of one text.

    Rows that share an id stay or go by their own texts; of rows equal in id and text one stays; rows with a null id all stay.
    """
    found = judged(docs, shingle, percent, key, text_col)
    kept = found.where((F.col("doc") == F.col("first.doc")) & (F.col("body") == F.col("first.body"))).select("doc", "body").distinct()
    doc, body = free_name(docs, "near_doc"), free_name(docs, "near_body")
    marked = docs.withColumn(doc, F.col(f"`{key}`").cast("long")).withColumn(body, F.xxhash64(F.col(f"`{text_col}`")))
    survivors = marked.join(kept.select(F.col("doc").alias(doc), F.col("body").alias(body)), [doc, body], "left_semi")
    return survivors.dropDuplicates([doc, body]).drop(doc, body).unionByName(docs.where(F.col(f"`{key}`").isNull()))
