"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Pieces are dealt by hash into blocks of about ``block_items``; each block is
one bin-packing problem, solved by a grouping genetic algorithm whose
individuals are whole assignments.  A crossover injects well-filled bins of one
parent into another, drops the bins that hold the same pieces, and places the
displaced pieces by best fit.  The islands of a block evolve in separate tasks
and pass their elite to the next island between epochs; an island whose first
individual, by best fit, is already at the lower bound has nothing to evolve.  The emptiest bin of
every block is opened again and packed at the next level with those of the
other blocks, until one block is left, so no block wastes a bin of its own.

Only piece lengths move between tasks; a block's size is fixed by a parameter,
so tasks stay equal whatever the corpus or its hot keys.

Defined cases: a null text counts as empty, and an empty document is the end
token alone; repeated rows are separate documents; an empty table packs into no
sequence; of the input only the key column and the text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .words import word_keys

#: Words kept between calls, and words given to the tokenizer at once: both bound a task's memory.
_CACHE, _AT_ONCE = 1 << 19, 1 << 14


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``begin`` to ``begin + length`` of every span, one span after the other."""
    total = np.cumsum(length)
    return np.repeat(begin - (total - length), length) + np.arange(total[-1] if len(total) else 0)


class WordTokenizer:
    """Token ids of whole texts, each distinct white-space word being encoded once.

    Right for tokenizers that drop white space and never merge across it.  Words
    met before are kept as sorted keys beside one flat array of ids.
    """

    def __init__(self, spec: str):
        # Spark runs one task a core already: more threads in a task only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(spec)
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words, keys: np.ndarray, first: np.ndarray) -> None:
        """Encode the words at ``first``, whose keys are new."""
        lengths, ids = [], []
        for a in range(0, len(first), _AT_ONCE):
            at = first[a : a + _AT_ONCE]
            size = words.end[at] - words.start[at]
            # the words, one a line: no word holds a line break
            raw = np.append(words.data, np.uint8(10))[spans(words.start[at], size + 1)]
            raw[np.cumsum(size + 1) - 1] = 10
            coded = self.encoder.encode_batch_fast(raw[:-1].tobytes().decode().split("\n"), add_special_tokens=False)
            lists = [c.ids for c in coded]
            lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths[-1].sum())))
        length = np.concatenate(lengths)
        begin = np.cumsum(length) - length + len(self.flat)
        self.flat = np.concatenate([self.flat, *ids])
        order = np.argsort(keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.begin, self.length = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.length, length])[order]

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key among the words met before; -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def encode(self, texts) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids as uint32) of every row."""
        for words in word_keys(texts):
            if len(self.keys) > _CACHE:
                self.forget()
            keys, first, inverse = np.unique(words.key, return_index=True, return_inverse=True)
            new = np.flatnonzero(self.known(keys) < 0)
            if len(new):
                self.learn(words, keys[new], first[new])
            place = self.known(keys)
            length = self.length[place][inverse]
            ids = self.flat[spans(self.begin[place][inverse], length)]
            cuts = np.concatenate([[0], np.cumsum(length)])[words.bounds()]
            for k in range(words.last - words.first):
                yield words.first + k, ids[cuts[k] : cuts[k + 1]]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (key, piece, start, length, ids_crc32, uid[, ids]) of every document.

    ``uid`` tells repeated rows apart.  The tokenizer file is read once on the
    driver and sent to the tasks; its size does not depend on the data.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("uid", T.LongType())]
    fields += [("ids", T.ArrayType(T.LongType()))] * with_ids
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, part = WordTokenizer(spec.value), 0, TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, out, ids_out = [], [], []
            for row, ids in tokenizer.encode(batch.column(text_col)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, a in enumerate(range(0, len(ids), capacity)):
                    piece = ids[a : a + capacity]
                    rows.append(row)
                    out.append((p, a, len(piece), zlib.crc32(piece.tobytes()), part + seen))
                    seen += 1
                    if with_ids:
                        ids_out.append(piece.astype(np.int64))
            p, a, n, crc, uid = np.array(out, np.int64).reshape(-1, 5).T
            columns = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(p, pa.int32()), pa.array(a), pa.array(n), pa.array(crc), pa.array(uid)]
            columns += [pa.array(ids_out, pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text_col).mapInArrow(run, schema)


class Bins:
    """Open bins by free space; the fullest bin with room is found through a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.slots, self.count = capacity, 0, [[] for _ in range(capacity + 1)], 0

    def add(self, bin_id: int, free: int) -> None:
        self.slots[free].append(bin_id)
        self.mask |= 1 << free

    def best_fit(self, size: int) -> int:
        room = self.mask >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            bin_id = self.slots[free].pop()
            if not self.slots[free]:
                self.mask ^= 1 << free
        else:
            bin_id, free = self.count, self.capacity
            self.count += 1
        self.add(bin_id, free - size)
        return bin_id


def best_fit(order: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    bins, placed = Bins(capacity), np.empty(len(sizes), np.int32)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        placed[i] = bins.best_fit(size)
    return placed


def crossover(giver: np.ndarray, taker: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.15) -> np.ndarray:
    """``taker`` with some whole well-filled bins of ``giver``; displaced pieces are placed by best fit."""
    fill = np.bincount(giver, sizes)
    ranked = np.argsort(-fill * (1 + 0.01 * rng.random(len(fill))))
    inject = np.zeros(len(fill), bool)
    inject[ranked[: max(1, int(share * len(fill)))]] = True
    moved = inject[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[moved]] = True
    displaced = np.flatnonzero(hit[taker] & ~moved)
    kept = ~hit[taker] & ~moved
    child = np.empty_like(taker)
    _, child[kept] = np.unique(taker[kept], return_inverse=True)
    whole = int(child[kept].max()) + 1 if kept.any() else 0
    _, own = np.unique(giver[moved], return_inverse=True)
    child[moved] = own + whole
    filled = np.bincount(child[kept | moved], sizes[kept | moved]).astype(np.int64)
    bins = Bins(capacity)
    bins.count = len(filled)
    for b, free in enumerate((capacity - filled).tolist()):
        if free:
            bins.add(b, free)
    for i in displaced[np.argsort(-sizes[displaced], kind="stable")].tolist():
        child[i] = bins.best_fit(int(sizes[i]))
    return child


def fitness(placed: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones, which leave room to close another bin."""
    fill = np.bincount(placed, sizes)
    return -len(fill), float(np.square(fill / capacity).sum())


def evolve(sizes: np.ndarray, capacity: int, seed: int, elite: list[np.ndarray], population: int, generations: int) -> np.ndarray:
    """The best assignment of one island after some generations; stops at the lower bound.

    Each child takes the place of the worst individual, or of its own equal in fitness, so the island keeps its variety.
    """
    rng, least = np.random.default_rng(seed), -int(-(-sizes.sum() // capacity))
    score = lambda x: fitness(x, sizes, capacity)
    group = [*elite] or [best_fit(np.argsort(-sizes, kind="stable"), sizes, capacity)]
    while len(group) < population and max(map(score, group))[0] < least:
        group.append(best_fit(np.argsort(-sizes * (1 + 0.2 * rng.random(len(sizes)))), sizes, capacity))
    for _ in range(generations):
        group.sort(key=score, reverse=True)
        if score(group[0])[0] >= least or len(group) < 2:
            break
        # parents by tournament: the list is sorted, so the smaller place is the fitter
        a, b = (int(rng.integers(len(group), size=2).min()) for _ in range(2))
        if a == b:
            b = (a + 1) % len(group)
        child = crossover(group[a], group[b], sizes, capacity, rng)
        same = [i for i, x in enumerate(group) if score(x) == score(child)]
        group[same[0] if same else -1] = child
    return max(group, key=score)


def pack_blocks(pieces: DataFrame, capacity: int, blocks: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """``pieces`` (uid, length, ...) with block, bin, offset and ``worst`` (in the block's emptiest bin) more."""
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("uid")), F.lit(blocks)).cast("int"))
    state_schema = "block int, island int, best binary, done boolean"

    def step(epoch: int):
        def run(key, items: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            block, island = key
            sizes = items.sort_values("uid")["length"].to_numpy(np.int64)
            elite = [np.frombuffer(x, np.int32) for x in states["best"]]
            best = evolve(sizes, capacity, hash((seed, int(block), int(island), epoch)) % 2**32, elite, population, generations)
            done = len(np.unique(best)) <= -(-int(sizes.sum()) // capacity)
            return pd.DataFrame({"block": [block], "island": [island], "best": [best.astype(np.int32).tobytes()], "done": [done]})

        return run

    copies = dealt.select("block", "uid", "length").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    states, finished = pieces.sparkSession.createDataFrame([], state_schema), []
    for epoch in range(epochs):
        # each island keeps its elite and gets that of the island before it
        arrived = states.unionByName(states.withColumn("island", (F.col("island") + 1) % islands)) if epoch else states
        evolved = cut(copies.groupBy("block", "island").cogroup(arrived.groupBy("block", "island")).applyInPandas(step(epoch), state_schema))
        # blocks at the lower bound have nothing left to evolve
        open_blocks = evolved.groupBy("block").agg(F.max("done").alias("any")).where(~F.col("any")).select("block")
        states = evolved.join(open_blocks, "block", "left_semi")
        finished.append(evolved.join(open_blocks, "block", "left_anti") if epoch < epochs - 1 else evolved)
        if open_blocks.isEmpty():
            break
        copies = copies.join(open_blocks, "block", "left_semi")
    states = reduce(DataFrame.unionByName, finished)
    names = [*pieces.columns, "block", "bin", "offset", "worst"]
    schema = T.StructType([*dealt.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("worst", T.BooleanType())])

    def place(key, items: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("uid")
        sizes = items["length"].to_numpy(np.int64)
        best = max((np.frombuffer(x, np.int32) for x in found["best"]), key=lambda x: fitness(x, sizes, capacity))
        items["bin"] = best.astype(np.int64)
        items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
        fill = np.bincount(best, sizes)
        items["worst"] = best == int(np.argmin(fill))
        return items[names]

    return dealt.groupBy("block").cogroup(states.groupBy("block")).applyInPandas(place, schema)


def pack(pieces: DataFrame, capacity: int = 4096, block_items: int = 8192, islands: int = 4, epochs: int = 3, population: int = 8, generations: int = 24, seed: int = 17) -> DataFrame:
    """``pieces`` (uid long, length long, any others) with ``sequence_id`` and ``offset`` more."""
    level, rest, done = 0, cut(pieces), []
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    while True:
        blocks = max(1, -(-rest.count() // block_items))
        placed = cut(pack_blocks(rest, capacity, blocks, islands, epochs, population, generations, seed + level))
        number = (F.lit(level).cast("long") * 2**56 + F.col("block").cast("long") * 2**24 + F.col("bin")).alias("sequence_id")
        last = blocks == 1
        done.append(placed.where(F.lit(last) | ~F.col("worst")).select(*columns, number, "offset"))
        if last:
            return reduce(DataFrame.unionByName, done)
        level, rest = level + 1, placed.where("worst").select(*columns)
