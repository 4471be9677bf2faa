"""Phrase collocations by generalised suffix automata, one for each shard of the corpus.

A shard is a run of documents of about ``shard_words`` words inside one task.
Its generalised suffix automaton, bounded to phrases of ``depth`` words, is
built for all positions together: the states of a suffix automaton and their
suffix links are the compact trie of the contexts read backwards, so one sort of
the positions by their last words yields every state, with the lengths of its
phrases, its endpos count and its suffix link.  (Transitions are not stored:
enumeration needs none.)  Enumerating the states gives each distinct phrase of
the shard once, with its count, so however common a phrase is, a shard sends one
row for it; counts are then summed over all shards by key.

Three passes, each a narrow read of the texts and one sum by key:

1. words and word pairs; those below ``min_count`` go;
2. phrases of two to ``depth`` words: a phrase can reach ``min_count`` only where all
   its pairs do, so the automata are built over the runs of frequent pairs.  The
   frequent pairs travel as a Bloom filter of at most ``filter_bits`` bits, however large the corpus
   is; what it lets through by chance only adds rows to the sum, never to the result;
3. the documents that hold the first copy of a candidate give its words and the
   keys of its parts.

A phrase is subsumed where a longer candidate keeps 80 % of its count.  Counts
fall along extensions, so only candidates one word longer matter: each candidate
hands its count to its suffix link (the phrase without its first word) and to
its prefix (without its last), and the largest count that arrives decides.

Phrases are known by 64-bit keys; two of them share one with a chance of about
2**-64.

Defined cases: a null text is empty; a null language is ``und``; rows that are
repeated count as often as they stand; ties are resolved as ``collocations``
states; a very long text is one document of a shard like others; a language
without a candidate has no rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .words import U, mix, text_buffers, word_keys

#: What ends a piece: ``.,;:!?`` and U+000A to U+000D.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[_ENDS] = 0x20
_STEP = U(0xD6E8FEB86659FD93)


class Automaton(NamedTuple):
    """States of a suffix automaton: the phrases of ``low`` to ``high`` words that end at ``end``, how often they occur, and the state of the suffix link (-1: the root)."""

    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    link: np.ndarray

    def phrases(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, number of words, count) of every distinct phrase of ``least`` words or more, in the order of the text."""
        low = np.maximum(self.low, least)
        many = np.maximum(self.high - low + 1, 0)
        state = np.repeat(np.arange(len(many)), many)
        words = low[state] + np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(self.end[state], kind="stable")
        state = state[order]
        return self.end[state], words[order], self.count[state]


def suffix_automaton(word: np.ndarray, piece: np.ndarray, depth: int) -> Automaton:
    """The generalised suffix automaton of all pieces (runs of equal ``piece``), for phrases of up to ``depth`` words."""
    n = len(word)
    none = np.zeros(0, np.int64)
    if not n:
        return Automaton(none, none, none, none, none)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        """``x`` as it stands ``k`` words before, 0 where the piece begins later."""
        out = np.zeros_like(x)
        out[k:] = np.where(piece[k:] == piece[:-k], x[:-k], 0) if k else x
        return out

    rank = np.unique(word, return_inverse=True)[1].astype(U) + U(1)
    before = [back(rank, k) for k in range(depth)]
    code, span = rank, 1
    while span < depth:
        code = code << U(32) | back(code, span)
        span *= 2
        if span < depth:
            code = np.unique(code, return_inverse=True)[1].astype(U) + U(1)
    order = np.argsort(code)

    starts, sizes, ends, real = [], [], [], []
    new = np.zeros(n, bool)
    new[0] = True
    for k in range(depth):
        at = before[k][order]
        new[1:] |= at[1:] != at[:-1]
        first = np.flatnonzero(new)
        starts.append(first)
        sizes.append(np.diff(np.append(first, n)))
        ends.append(order[first])
        real.append(at[first] != 0)
    # a group of one length and the group one word longer are one state where they occur equally often
    state: list[np.ndarray] = [none] * depth
    made, total = [], 0
    for k in reversed(range(depth)):
        own = real[k].copy()
        state[k] = np.full(len(starts[k]), -1)
        if k + 1 < depth:
            child = np.searchsorted(starts[k + 1], starts[k])
            same = own & real[k + 1][child] & (sizes[k + 1][child] == sizes[k])
            state[k][same] = state[k + 1][child[same]]
            own &= ~same
        state[k][own] = total + np.arange(own.sum())
        made.append((ends[k][own], np.full(own.sum(), k + 1), sizes[k][own]))
        total += int(own.sum())
    end, high, count = (np.concatenate(x).astype(np.int64) for x in zip(*made, strict=True))
    low, link = np.zeros(total, np.int64), np.full(total, -1)
    for k in reversed(range(depth)):
        low[state[k][real[k]]] = k + 1  # the shortest length comes last
    for k in range(1, depth):
        mine = real[k] & (low[state[k]] == k + 1)
        parent = np.searchsorted(starts[k - 1], starts[k][mine], "right") - 1
        link[state[k][mine]] = state[k - 1][parent]
    return Automaton(end, low, high, count, link)


class Shard(NamedTuple):
    """Words in their order: key (with the language in it), piece, and the document's number ``uid``; ``roots`` are (language key, words)."""

    word: np.ndarray
    piece: np.ndarray
    uid: np.ndarray
    roots: tuple[np.ndarray, np.ndarray]


class Tokens(NamedTuple):
    row: np.ndarray
    word: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    first: int
    last: int


def _language_keys(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    names = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    keys = []
    for name in names.dictionary.to_pylist():
        value = 0
        for byte in name.encode():
            value = (value * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
        keys.append(value)
    return mix(np.array(keys, U))[names.indices.to_numpy()] if keys else np.zeros(0, U)


def tokens(batch: pa.RecordBatch, piece: int = 0) -> Iterator[Tokens]:
    """The words of a batch (text, lang), some rows at a time; pieces are numbered from ``piece`` on."""
    offsets, data = text_buffers(batch.column("text"))
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = data[low:high]
    offsets = np.ascontiguousarray(offsets - low)
    blanked = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(_BLANKED[data]))
    languages = _language_keys(batch.column("lang"))
    for words in word_keys(blanked):
        a, b = int(offsets[words.first]), int(offsets[words.last])
        part = data[a:b]
        ended = np.cumsum(_ENDS[part], dtype=np.int32)
        number = piece + words.row + (ended[words.start] if len(words.start) else 0)
        # rows add one each, ends one each: the numbers of different pieces differ, and grow
        piece += words.last - words.first + (int(ended[-1]) if len(ended) else 0)
        key = mix(words.key ^ languages[words.row]) if len(words.key) else words.key
        yield Tokens(words.row, key, number.astype(np.int64), words.start, words.end, part, words.first, words.last)


def shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[Shard]:
    parts, held, piece = [], 0, 0

    def close() -> Shard:
        word, number, uid = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
        language, many = (np.concatenate(x) for x in list(zip(*parts, strict=True))[3:])
        root, at = np.unique(language, return_inverse=True)
        return Shard(word, number, uid, (root, np.bincount(at, many, len(root)).astype(np.int64)))

    for batch in batches:
        ids = batch.column("uid").to_numpy() if "uid" in batch.schema.names else np.zeros(len(batch), np.int64)
        languages = _language_keys(batch.column("lang"))
        for t in tokens(batch, piece):
            if not len(t.word):
                continue
            piece = int(t.piece[-1]) + 1
            many = np.bincount(t.row - t.first, minlength=t.last - t.first)
            parts.append((t.word, t.piece, ids[t.row], languages[t.first : t.last], many))
            held += len(t.word)
            if held >= shard_words:
                yield close()
                parts, held = [], 0
    if parts:
        yield close()


def phrase_hashes(word: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each number of words, the hash of the phrase that ends at each place (meaningless where its piece begins later)."""
    found = [word]
    with np.errstate(over="ignore"):
        for _ in range(depth - 1):
            longer = np.zeros_like(word)
            longer[1:] = found[-1][:-1] * _STEP
            found.append(longer + word)
    return found


def phrase_key(hashes: list[np.ndarray], end: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = np.zeros(len(end), U)
    for k, h in enumerate(hashes):
        at = words == k + 1
        key[at] = mix(h[end[at]] + U(k + 1))
    return key.view(np.int64)


def _root_key(language: np.ndarray) -> np.ndarray:
    return mix(language ^ _STEP).view(np.int64)


def count_short(docs: DataFrame, shard_words: int) -> DataFrame:
    """(key, n): words, word pairs and, for each language, all words together, once for each shard that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            end, words, count = suffix_automaton(shard.word, shard.piece, 2).phrases()
            key = phrase_key(phrase_hashes(shard.word, 2), end, words)
            language, many = shard.roots
            yield from _rows({"key": np.append(_root_key(language), key), "n": np.append(many, count)})

    return docs.select("lang", "text").mapInArrow(run, "key long, n long")


def _rows(columns: dict[str, np.ndarray], block: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(next(iter(columns.values()))), block):
        yield pa.RecordBatch.from_pydict({name: pa.array(x[a : a + block]) for name, x in columns.items()})


class Filter(NamedTuple):
    """A Bloom filter of 64-bit keys with two places a key."""

    bits: int
    words: np.ndarray

    def holds(self, key: np.ndarray) -> np.ndarray:
        key = key.view(U)
        found = np.ones(len(key), bool)
        for place in (key & U(self.bits - 1), (key >> U(32)) & U(self.bits - 1)):
            found &= (self.words[place >> U(6)] >> (place & U(63))) & U(1) == 1
        return found


def bloom_filter(keys: DataFrame, most_bits: int) -> Filter:
    """A filter of the column ``key``: 16 bits a key, ``most_bits`` (a power of two, at most 2**32) together at most, so its size has a bound."""
    bits = 1 << 12
    need = 16 * keys.count()
    while bits < min(need, most_bits):
        bits *= 2
    places = F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))
    set_bits = keys.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    found = set_bits.toArrow()
    words = np.zeros(bits // 64, U)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U)
    return Filter(bits, words)


def count_phrases(docs: DataFrame, known, depth: int, shard_words: int) -> DataFrame:
    """(key, n, uid): phrases of 2 to ``depth`` words all of whose pairs pass the filter (``known``: broadcast), once for each shard, with a document that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            word, piece = shard.word, shard.piece
            pair = phrase_key(phrase_hashes(word, 2), np.arange(len(word)), np.full(len(word), 2))
            joined = np.zeros(len(word) + 1, bool)
            joined[1:-1] = piece[1:] == piece[:-1]
            joined[:-1] &= known.value.holds(pair)
            keep = joined[:-1] | joined[1:]
            word, uid, run_of = word[keep], shard.uid[keep], np.cumsum(~joined[:-1])[keep]
            end, words, count = suffix_automaton(word, run_of, depth).phrases(2)
            yield from _rows({"key": phrase_key(phrase_hashes(word, depth), end, words), "n": count, "uid": uid[end]})

    return docs.select("lang", "text", "uid").mapInArrow(run, "key long, n long, uid long")


def candidate_phrases(docs: DataFrame, depth: int) -> DataFrame:
    """(key, lang, phrase, words, root, parts): the wanted phrases (column ``wanted``: keys) of each document; ``parts`` are the keys (left, right) of each cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.unique(batch.column("wanted").flatten().to_numpy())
            langs = pc.fill_null(batch.column("lang").cast(pa.string()), "und")
            languages = _language_keys(batch.column("lang"))
            for t in tokens(batch):
                hashes, n = phrase_hashes(t.word, depth), len(t.word)
                lower = t.data.copy()
                lower[(lower >= 65) & (lower <= 90)] += 32
                for m in range(2, depth + 1):
                    end = np.arange(m - 1, n)
                    end = end[t.piece[end] == t.piece[end - m + 1]]
                    key = phrase_key(hashes, end, np.full(len(end), m))
                    key, first = np.unique(key, return_index=True)
                    hit = np.isin(key, wanted, assume_unique=True)
                    key, end = key[hit], end[first[hit]]
                    if not len(key):
                        continue
                    names = [b" ".join(lower[t.start[j] : t.end[j]].tobytes() for j in range(e - m + 1, e + 1)) for e in end]
                    cuts = [np.full(len(end), k) for k in range(1, m)]
                    left = [phrase_key(hashes, end - m + k[0], k) for k in cuts]
                    right = [phrase_key(hashes, end, m - k) for k in cuts]
                    flat = pa.StructArray.from_arrays([pa.array(np.stack(x, 1).ravel()) for x in (left, right)], names=["left", "right"])
                    row = t.row[end]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key),
                            langs.take(pa.array(row)),
                            pa.array(names, pa.binary()).cast(pa.string(), safe=False) if _all_text(names) else pa.array([x.decode(errors="replace") for x in names]),
                            pa.array(np.full(len(end), m, np.int32)),
                            pa.array(_root_key(languages[row])),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(end) + 1, dtype=np.int32) * (m - 1)), flat),
                        ],
                        names=["key", "lang", "phrase", "words", "root", "parts"],
                    )

    return docs.select("lang", "text", "wanted").mapInArrow(run, "key long, lang string, phrase string, words int, root long, parts array<struct<left:long,right:long>>")


def _all_text(names: list[bytes]) -> bool:
    try:
        b"".join(names).decode()
    except UnicodeDecodeError:
        return False
    return True


def collocations(
    docs: DataFrame,
    min_count: int = 30,
    top: int = 2000,
    depth: int = 4,
    subsumed: int = 80,
    key: str | None = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    shard_words: int = 1 << 19,
    filter_bits: int = 1 << 28,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score is 2,000,000 * a / (l + r), rounded down, of the cut where it is lowest (the earliest of these).  A phrase
    contained in a longer candidate with ``subsumed`` percent of its count is dropped.  Ranks go by score, then a,
    descending, then by the phrase's UTF-8 bytes.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in (key, lang_col, text_col) if c]
    base = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(*own).alias("uid"))
    # dealt by key before they are summed: rows of a shard are distinct, so a sum before that finds little to add up
    short = cut(count_short(base, shard_words).repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    known = spark.sparkContext.broadcast(bloom_filter(short, filter_bits))
    frequent = cut(count_phrases(base, known, depth, shard_words).repartition("key").groupBy("key").agg(F.sum("n").alias("a"), F.min("uid").alias("uid")).where(F.col("a") >= min_count))
    known.unpersist()

    wanted = frequent.groupBy("uid").agg(F.collect_list("key").alias("wanted"))
    named = candidate_phrases(base.join(wanted, "uid"), depth).dropDuplicates(["key"])
    candidates = cut(named.join(frequent.select("key", "a"), "key"))

    counts = short.unionByName(candidates.where("words > 2").select("key", F.col("a").alias("n")))
    cuts = candidates.select("key", "a", F.posexplode("parts").alias("k", "p")).select("key", "a", "k", "p.left", "p.right")
    met = cuts.join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(18,0)) + cast(r as decimal(18,0)))").cast("long")
    lowest = met.groupBy("key").agg(F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("best"))

    # the suffix link of a candidate is what its first word leaves, its prefix what its last word leaves
    longer = candidates.where("words > 2").select("a", F.explode(F.array(F.col("parts")[0]["right"], F.element_at("parts", -1)["left"])).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("above"))
    alive = candidates.join(longer, "key", "left").where(F.col("above").isNull() | (F.col("above").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * subsumed))
    scored = alive.join(lowest, "key").select("lang", "root", "phrase", "a", "best.*")

    # the first of each part of a language, then the first of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, candidates.count() // 100_000)
    within = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = short.join(candidates.select(F.col("root").alias("key")).distinct(), "key").select(F.col("key").alias("root"), "n")
    return ranked.join(totals, "root").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
