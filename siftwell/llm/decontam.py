"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A window of a document as long as a benchmark item (in words) leaks the item if
their word edit distance is at most ``max_edit_share`` of the item's length.
The CGK random walk embeds a word sequence so that edit distance becomes
Hamming distance: at each step it emits the current word and moves on or stays
by a coin keyed by step and word.  Each of ``tables`` walks, with
``samples`` sampled output places, is one LSH table; a window and an item that
agree in all sampled places of a table are a candidate pair.  Every candidate is
verified by exact edit distance, the ends of the window being free to move.

Windows that share too few words' n-grams with all items of their length to be
within the edit bound (q-gram count lemma, so none is lost) are not embedded.

Items are taken in blocks of ``item_block``, each a bounded table sent to all
tasks; documents are read in one narrow pass a block and never shuffled, so no
key, item or group can be hot.  A worker process builds the index of a block once.
Two sampled places a table and 48 tables found all of 250 random items (8 to 120
words, not of any benchmark) under random edits at the bound; three places found
0.96 of them in 24 tables and all in 64.

Defined cases: a null or wordless text or item matches nothing; an item listed
twice is found twice; a document may leak several items; empty tables give empty
results; input columns are kept and may clash with no working name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name
from .words import U, mix, windows, word_keys

_BITS = 22


@dataclass(frozen=True)
class Settings:
    max_edit_share: float = 0.2
    tables: int = 48
    samples: int = 2
    seed: int = 20


def cgk_codes(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, s: Settings) -> np.ndarray:
    """LSH keys (tables, windows) of the windows ``keys[start : start + length]``.

    All walks go on side by side, over the first two thirds of the embedding's
    ``3 * length`` places, which hold the sampled ones; past its end a window
    emits 0.
    """
    # places and coins are hashes of (seed, table, number), so longer windows walk as shorter ones do
    table, number = np.arange(s.tables, dtype=U)[:, None] << U(32), np.arange(max(s.samples, 2 * int(lengths.max(initial=1))), dtype=U)
    with np.errstate(over="ignore"):
        marks = mix(table + number + U(s.seed) * U(0x9E3779B97F4A7C15))
    shares = (mix(marks[:, : s.samples]) >> U(11)) / 2.0**53
    coins = marks[:, : 2 * int(lengths.max(initial=1))] | U(1)
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    places = (shares[:, :, None] * (2 * size)).astype(np.int64)
    at = np.zeros((s.tables, len(size)), np.int64)
    code = mix(np.arange(s.tables, dtype=U)[:, None] * U(1 << 20) + size.astype(U))
    walking = np.searchsorted(-2 * size, -np.arange(coins.shape[1]), "left")  # windows with more steps to go
    for step, m in enumerate(walking.tolist()):
        here = at[:, :m]
        inside = here < size[:m]
        word = np.where(inside, keys[np.minimum(begin[:m] + here, len(keys) - 1)], U(0))
        for k in range(s.samples):
            t, w = np.nonzero(places[:, k, :m] == step)
            code[t, w] = mix(code[t, w] ^ word[t, w])
        # one hash bit of (step, word) decides whether the walk moves on
        with np.errstate(over="ignore"):
            here += ((word * coins[:, step : step + 1]) >> U(63)).astype(np.int64) & inside
    found = np.empty_like(code)
    found[:, order] = code
    return found


def fit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the part of ``region`` nearest to ``item``; of equal ones the leftmost end."""
    m = len(region)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, word in enumerate(item, 1):
        diagonal, up = cost[:-1] + (region != word), cost[1:] + 1
        new, came = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], came[0] = i, 0
        new[1:] = np.minimum(diagonal, up)
        came[1:] = np.where(diagonal <= up, origin[:-1], origin[1:])
        # moves along the region: running minimum of cost minus place
        slack = new - np.arange(m + 1)
        best = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == best, np.arange(m + 1), 0))
        cost, origin = best + np.arange(m + 1), came[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


class ItemIndex:
    """One block of benchmark items, with what a task needs to find them."""

    def __init__(self, ids: list, texts: list, s: Settings):
        self.s, self.ids, self.items = s, [], []
        for words in word_keys(pa.array(texts, pa.large_string())):
            cuts = words.bounds()
            for k in range(words.last - words.first):
                if cuts[k] < cuts[k + 1]:
                    self.ids.append(ids[words.first + k])
                    self.items.append(words.key[cuts[k] : cuts[k + 1]])
        self.edits = [int(s.max_edit_share * len(x)) for x in self.items]
        #: length -> (q, least number of shared q-grams, the q-grams of its items as a sorted array)
        self.lengths: dict[int, tuple[int, int, np.ndarray]] = {}
        sizes = np.array([len(x) for x in self.items], np.int64)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            edits = int(s.max_edit_share * n)
            q = next((q for q in (3, 2) if n - q + 1 - q * edits >= 2), 1)
            grams = np.unique(np.concatenate([_grams(self.items[i], q) for i in own]))
            self.lengths[n] = (q, max(1, n - q + 1 - q * edits), grams)
        #: q -> (bit map of low bits, sorted q-grams, fewest hits that matter, longest reach) over all lengths
        self.grams = {}
        for q in {v[0] for v in self.lengths.values()}:
            own = {n: v for n, v in self.lengths.items() if v[0] == q}
            union, flag = np.unique(np.concatenate([v[2] for v in own.values()])), np.zeros(1 << _BITS, bool)
            flag[union & U((1 << _BITS) - 1)] = True
            self.grams[q] = flag, union, min(v[1] for v in own.values()), int(max(own) * (1 + s.max_edit_share))
        self.tables = []
        if self.items:
            codes = cgk_codes(np.concatenate(self.items), np.cumsum(sizes) - sizes, sizes, s)
            order = np.argsort(codes, axis=1)
            self.tables = [(c[o], o) for c, o in zip(codes, order, strict=True)]

    def _hits(self, words, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, q-gram) of the words' q-grams that some item holds and that stand close enough to others to matter."""
        flag, union, least, reach = self.grams[q]
        at, key = windows(words, q)
        some = np.flatnonzero(flag[key & U((1 << _BITS) - 1)])
        some = some[union[np.minimum(np.searchsorted(union, key[some]), len(union) - 1)] == key[some]]
        at, key = at[some], key[some]
        if len(at) < least:
            return at[:0], key[:0]
        near = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= reach)
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, near, 1)
        np.add.at(mark, near + least, -1)
        keep = np.cumsum(mark[:-1]) > 0
        return at[keep], key[keep]

    def find(self, words) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end word, distance) of every leak, best place of each item in a row."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        hits = {q: self._hits(words, q) for q in self.grams}
        starts, lengths = [], []
        for n, (q, least, grams) in self.lengths.items():
            at, key = hits[q]
            if len(at) < least:
                continue
            own = at[np.isin(key, grams)]
            if len(own) < least:
                continue
            # starts whose window of n words, widened by the edits allowed, holds at least ``least`` of the q-grams
            edits = int(self.s.max_edit_share * n)
            first, last = own[: len(own) - least + 1], own[least - 1 :]
            dense = np.flatnonzero(last + q - first <= n + edits)
            if len(dense):
                some = np.unique(np.concatenate([np.arange(max(0, last[d] + q - n - edits), first[d] + edits + 1) for d in dense]))
                some = some[some < len(words.key)]
                starts.append(some)
                lengths.append(np.full(len(some), n, np.int64))
        if starts:
            starts, lengths = np.concatenate(starts), np.concatenate(lengths)
            cuts, pairs = words.bounds(), set()
            for a in range(0, len(starts), 8192):
                begin = starts[a : a + 8192]
                row = words.row[begin]
                for (codes, items), code in zip(self.tables, cgk_codes(words.key, begin, lengths[a : a + 8192], self.s), strict=True):
                    low, high = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
                    for j in np.flatnonzero(high > low).tolist():
                        pairs.update((int(row[j]), int(i), int(begin[j])) for i in items[low[j] : high[j]])
            self._verify(pairs, words, cuts, found)
        return [(r, i, a, b, d) for (r, i), (d, a, b) in sorted(found.items())]

    def _verify(self, pairs: set, words, cuts: np.ndarray, found: dict) -> None:
        done: dict[tuple[int, int], int] = {}
        for row, i, start in sorted(pairs):
            item, edits = self.items[i], self.edits[i]
            low, high = cuts[row - words.first], cuts[row - words.first + 1]
            if start < done.get((row, i), -1) or found.get((row, i), (edits + 1,))[0] == 0:
                continue
            a, b = max(low, start - 2 * edits), min(high, start + 2 * len(item) + 2 * edits)
            done[(row, i)] = start + len(item) // 2
            d, s, e = fit_distance(item, words.key[a:b])
            if d <= edits and d < found.get((row, i), (edits + 1,))[0]:
                found[(row, i)] = (d, int(a + s - low), int(a + e - low))


def _grams(item: np.ndarray, q: int) -> np.ndarray:
    from .words import Words

    row = np.zeros(len(item), np.int64)
    return windows(Words(0, 1, row, item, row, row, row), q)[1]


_PLACE = [T.StructField(c, T.IntegerType()) for c in ("start", "end", "distance")]
#: The index that this worker process built last, and what it is of: tasks of one block share it.
_LAST: list = [None, None]


def _index(block, settings: Settings) -> ItemIndex:
    if _LAST[0] != (mark := (block.value[0], settings)):
        _LAST[:] = mark, ItemIndex(*block.value[1:], settings)
    return _LAST[1]


def item_blocks(benchmark: DataFrame, item_block: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at most about ``item_block`` items at a time, dealt by hash."""
    blocks = max(1, -(-benchmark.count() // item_block))
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        yield [r[0] for r in part], [r[1] for r in part]


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), item_block: int = 20_000, text_col: str = "text") -> DataFrame:
    """``docs`` with an array column ``leaks`` more: item_id, start and end (word numbers), distance."""
    out = free_name(docs, "leaks")
    found, leak = docs, T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), *_PLACE]))
    schema, kind = T.StructType([*docs.schema.fields, T.StructField(out, leak)]), to_arrow_type(leak)
    for ids, texts in item_blocks(benchmark, item_block):
        block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids, texts))
        first = found is docs

        def run(batches: Iterator[pa.RecordBatch], block=block, first=first) -> Iterator[pa.RecordBatch]:
            index = _index(block, settings)
            for batch in batches:
                lists: list[list] = [[] for _ in range(len(batch))] if first else batch.column(out).to_pylist()
                for words in word_keys(batch.column(text_col)):
                    for row, i, a, b, d in index.find(words):
                        lists[row].append({"item_id": index.ids[i], "start": a, "end": b, "distance": d})
                columns = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, kind)], names=schema.names)

        found = found.mapInArrow(run, schema)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a leak, with the columns of ``docs``."""
    found = find_leaks(docs, benchmark, **options)
    return found.where(F.size(F.col(f"`{found.columns[-1]}`")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
