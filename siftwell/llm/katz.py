"""Katz back-off language model with Good-Turing discounts, counted and evaluated on Spark.

Tokens are lower-cased words and one end token a document.  Unigrams of all
training tokens are counted exactly and Good-Turing discounted; what the
discount frees is the chance of the one unseen slot.  Bigrams and, with ``order``
3, trigrams are counted over all words, however rare, by 64-bit keys.  Back-off
weights are the exact ones: for each context of one or two words the freed mass
over the lower-order mass of the words not seen after it, so the model sums to one
after every context.  One start stands before a document, so its first word has a
bigram alone.

Texts are read twice: first their words meet by hash in buckets, are numbered there
without gaps and counted; then each group of documents gets the numbers of its words
and is written as numbers.  All later steps read these, and small numbers travel and
lie in a fraction of the bytes of hashes.

Counts live in tables partitioned by hash (``order``, ``bucket``).  A bigram lies
with its second word, whose unigram chance is thus at hand; words frequent enough
to fill half a bucket are spread over several by a hash of the context, and the
list of these (at most two a bucket) is all of the counts that every task gets.
Each bucket sends its share of a context's sums, whole numbers, to the context's
own bucket, where counts and back-off weight of each word lie.

A trigram lies with its last two words, so one exchange of trigrams counts the
bigrams too, and the chance of its last word after the one before is at hand.
Each bucket sends its share of the sums of a context of two words to where that
bigram lies; groups of documents get them by its place there.

Documents are handled in groups of some megabytes.  A group sends its distinct
n-grams once, as sorted, delta-coded keys; the bucket adds up the training counts
and gives the sums back to the groups.  To score, the groups' words are sent to
their buckets for their counts and weights, and the tokens of a group meet what is
known of its words and n-grams.  So every text is scored whole.  A bucket holds
near ``bucket_tokens`` n-grams whatever words are frequent; only the words before
one very frequent bigram lie together, however many they are.

What is shuffled at once is held down by working through the buckets, and then
through the contexts of two words and the groups, in shares.

Defined cases: a null or wordless text is the end token alone; a null key counts
as training; repeated rows are separate documents; an empty training set leaves
every token to the unseen slot; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, setting
from .words import U, by_eights, mix, word_keys

#: Key of the end token; no word hash is made this way.
END = U(0xE0E0E0E0E0E0E0E1)
#: Numbers of the place before a document and of the end token; those of words are larger.
START, LAST = U(0), U(1)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted uint64 values as compressed differences.  Others are kept as well, in more bytes."""
    return zstandard.compress(np.diff(values, prepend=U(0)).astype("<u8").tobytes(), 1)


def expand(blob: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.frombuffer(zstandard.decompress(blob), "<u8"), dtype=U)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's Good-Turing ratios d_0..d_k from ``n`` = counts of counts n_1..n_(k+1); d_r is 1 where the data give none in (0, 1]."""
    k = len(n) - 1
    d = np.ones(k + 1)
    if n[0] > 0:
        common = (k + 1) * n[k] / n[0]
        for r in range(1, k + 1):
            if n[r - 1] > 0 and common < 1:
                ratio = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                d[r] = ratio if 0 < ratio <= 1 else 1.0
    return d


@dataclass
class Lexicon:
    """What every task needs of the unigrams."""

    hot: np.ndarray  # sorted numbers of the words that fill half a bucket or more
    counts: np.ndarray
    splits: np.ndarray  # over how many buckets each of them is spread
    discount: np.ndarray
    scale: float
    total: int  # N: training tokens
    distinct: int  # V
    unseen: float  # chance of the unseen slot
    buckets: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Chance of words with these training counts."""
        d = self.discount[np.where(counts < len(self.discount), counts, 0)]
        return np.where(counts > 0, self.scale * d * counts / max(self.total, 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def bucket(self, words: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where bigrams lie, given as places in ``words``."""
        splits, bucket = _lookup(self.hot, self.splits, words), home(mix(words), self.buckets)[word]
        spread = np.flatnonzero((splits > 1)[word])
        part = mix(words[context[spread]]) % splits[word[spread]].astype(U)
        bucket[spread] = home(mix(words[word[spread]] + part * U(0xD6E8FEB86659FD93)), self.buckets)
        return bucket


def home(word: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of keys or numbers of words."""
    return (word % U(buckets)).astype(np.int64)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * U(0xD6E8FEB86659FD93) + mix(word))


def slices(bucket: np.ndarray, buckets: int, *then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in it) of each bucket that occurs, places sorted by ``then``."""
    # small whole numbers are sorted by their digits
    small = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket
    order = np.lexsort((*then, small)) if then else np.argsort(small, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield b, order[ends[b] : ends[b + 1]]


def with_ends(words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the tokens of ``words``: each row's words, then the end token."""
    cuts = words.bounds()[1:]
    rows = np.arange(words.first, words.last)
    return np.insert(words.row, cuts, rows), np.insert(keys, cuts, END)


def planes(ids: np.ndarray) -> bytes:
    """Compressed small numbers: all low bytes, then all next ones, and so on."""
    ids = ids.astype(np.uint32)
    return zstandard.compress(b"".join((ids >> np.uint32(8 * i)).astype(np.uint8).tobytes() for i in range(4)), 3)


def unplanes(blob: bytes) -> np.ndarray:
    low, *others = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    ids = low.astype(np.int64)
    for i, plane in enumerate(others, 1):
        if plane.any():
            ids |= plane.astype(np.int64) << 8 * i
    return ids


def coded(values: np.ndarray) -> bytes:
    """Eight-byte values of which many are equal: the different ones, and the place of each among them."""
    distinct, at = np.unique(values, return_inverse=True)
    return _pack(zstandard.compress(distinct.tobytes(), 3), planes(at))


def decoded(blob: bytes, kind: str) -> np.ndarray:
    distinct, at = _unpack(blob)
    return np.frombuffer(zstandard.decompress(distinct), kind)[unplanes(at)]


def starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a place differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def contexts(row: np.ndarray, ids: np.ndarray, start) -> np.ndarray:
    """What stands before each token; ``start`` before the first of a row."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[starts(row)] = start
    return context


def factors(times: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 factors of the words seen and not seen after contexts that occur ``times``: ``kept`` of that is left by the
    discounts, and ``lower`` is the lower-order mass of the words seen.
    """
    c = np.maximum(times, 1)
    rest = np.maximum(1.0 - lower, 0.0)  # lower-order mass of the words not seen after the context
    free = 1.0 - kept / c
    tight = (free < 1e-12) & (rest > 1e-12)  # nothing was discounted: free one part in count + 1
    full = rest <= 1e-12  # every word was seen: nothing to free
    scale = np.where(full, c / np.maximum(kept, 1e-300), np.where(tight, c / (c + 1) / np.maximum(kept / c, 1e-300), 1.0))
    free = 1.0 - scale * kept / c
    weight = np.where(full, 0.0, free / np.where(full, 1.0, rest))
    known = times > 0
    with np.errstate(divide="ignore"):
        return np.where(known, np.log10(scale / c), 0.0), np.log10(np.where(known, weight, 1.0))


def few_and_rest(context: np.ndarray, contexts: int, sums: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By context: how many n-grams occur 1..k times and how many of their lower n-grams do (``few``), and how often the others of these occur."""
    count = lambda keep: np.bincount(context[keep], minlength=contexts).astype("<u4")
    few = np.array([count(sums == r) for r in range(1, k + 1)] + [count(n == r) for r in range(1, k + 1)])
    # whole numbers below 2**53 add up exactly
    return few, np.bincount(context, np.where(n > k, n, 0).astype(float), contexts).astype("<u8")


def sums_blob(few: np.ndarray, rest: np.ndarray) -> bytes:
    return zstandard.compress(few.tobytes() + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def weighted(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``weights @ rows``, one row at a time."""
    return reduce(lambda done, x: done + x[0] * x[1], zip(weights, rows, strict=True), np.zeros(rows.shape[1]))


def add_sums(keys: np.ndarray, parts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``few`` and ``rest`` of the sorted ``keys``, added up from (keys, blob) parts."""
    few, rest = np.zeros((2 * k, len(keys)), np.uint32), np.zeros(len(keys), np.int64)
    for own, blob in parts:
        at, raw = np.searchsorted(keys, own), zstandard.decompress(blob)
        few[:, at] += np.frombuffer(raw, "<u4", 2 * k * len(at)).reshape(2 * k, -1)
        rest[at] += np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8 * k * len(at)).reshape(8, -1).T).view("<i8").ravel()
    return few, rest


def number_words(base: DataFrame, buckets: int, k: int, bucket_tokens: int) -> DataFrame:
    """The words of all documents, counted and numbered by bucket.

    A row with a ``chunk`` holds for one group, in the order of its words' keys, their numbers and training counts.  The row without holds the
    counts of the bucket's words in the order of their numbers, without the end token; in ``n`` how many words have count 1..k+1, how many have any,
    and how many tokens that makes; and in ``hot`` and ``times`` numbers and counts of those that fill half a bucket or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch, words, row, own, ids in _texts(batches):
            train = ~batch.column("held_out").slice(words.first, words.last - words.first).to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(ids, train[row], len(own))
            b, blobs = zip(*[(b, _pack(squeeze(own[o]), planes(n[o]))) for b, o in slices(home(own, buckets), buckets)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        bucket, parts = int(group["bucket"].iloc[0]), [list(_unpack(blob)) for blob in group["blob"]]
        keys = [expand(x[0]) for x in parts]
        own = np.unique(np.concatenate(keys))
        n, places = np.zeros(len(own), np.int64), [np.searchsorted(own, x) for x in keys]
        for at, x in zip(places, parts, strict=True):
            n[at] += unplanes(x[1])
        numbers = (np.arange(len(own), dtype=U) + U(2)) * U(buckets) + U(bucket)
        numbers[own == END] = LAST
        out = [(bucket, chunk, squeeze(numbers[at]), coded(n[at]), [], [], []) for chunk, at in zip(group["chunk"], places, strict=True)]
        hot, few = 2 * n > bucket_tokens, [int((n == r).sum()) for r in range(1, k + 2)]
        words = zstandard.compress(np.where(own == END, 0, n).astype("<i8").tobytes(), 3)
        out.append((bucket, None, None, words, [*few, int((n > 0).sum()), int(n.sum())], numbers[hot].astype(np.int64).tolist(), n[hot].tolist()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "numbers", "counts", "n", "hot", "times"]).astype({"chunk": "Int64"})

    schema = "bucket int, chunk long, numbers binary, counts binary, n array<long>, hot array<long>, times array<long>"
    return base.mapInArrow(run, "bucket int, chunk long, blob binary").groupBy("bucket").applyInPandas(add, schema)


def sums_of(table: DataFrame, places: int) -> list[int]:
    """Sums of the first ``places`` entries of the lists ``n``."""
    return [int(x or 0) for x in table.select(*[F.sum(F.get("n", F.lit(r))).alias(f"n{r}") for r in range(places)]).first()]


def build_lexicon(numbered: DataFrame, k: int, bucket_tokens: int, buckets: int) -> Lexicon:
    *by_count, distinct, total = sums_of(numbered, k + 3)
    hot = numbered.select(F.explode(F.arrays_zip("hot", "times")).alias("x")).select("x.hot", "x.times").toPandas()
    words, counts = hot["hot"].to_numpy(np.int64).astype(U), hot["times"].to_numpy(np.int64)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    d = discounts(by_count)
    used = 1.0 - sum((1 - d[r]) * r * by_count[r - 1] for r in range(1, k + 1)) / max(total, 1)
    scale = 1.0 if 1 - used > 1e-12 else total / (total + 1)  # leave something to the unseen slot
    unseen = 1.0 - scale * used if total else 1.0
    return Lexicon(words, counts, -(-2 * counts // bucket_tokens), d, scale, total, distinct, unseen, buckets)


TABLE = "order int, bucket int, chunk long, keys binary, counts binary, n array<long>"


def _pack(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Values of ``columns``, row by row, one copied at a time: they are large."""
    for batch in batches:
        for values in zip(*map(batch.column, columns), strict=True):
            yield tuple(x.as_py() for x in values)


def _unpack(blob: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        yield blob[at + 8 : at + 8 + size]
        at += 8 + size


def _distinct(own: np.ndarray, ids: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(before, context, word, which n-gram each token is) of the distinct n-grams of tokens ``own[ids]``, by word, context and what is before.

    ``before``, ``context`` and ``word`` are places in ``own``.  For bigrams ``before`` is the start.
    """
    size, start = len(own), np.searchsorted(own, START)
    context = contexts(row, ids, start)
    before = contexts(row, context, start) if order > 2 else start
    two, pair = ids * size + context, None
    if size**3 >= 1 << 63:  # one very long text
        two, pair = np.unique(two, return_inverse=True)
        three, inverse = np.unique(pair * size + before, return_inverse=True)
        two, before = two[three // size], three % size
    else:
        three, inverse = np.unique(two * size + before, return_inverse=True)
        two, before = three // size, three % size
    return before, two % size, two // size, inverse


def _places(lex: Lexicon, own: np.ndarray, context: np.ndarray, word: np.ndarray, shares: int = 1, share: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its n-grams) of one of the shares of buckets: the order in which a group's n-grams travel and come back."""
    bucket = lex.bucket(own, context, word)
    mine = np.flatnonzero(bucket % shares == share)
    for b, o in slices(bucket[mine], lex.buckets):
        yield b, mine[o]


def _texts(batches: Iterator[pa.RecordBatch]):
    """(chunk, batch, words, row, own, ids) of each group of documents: its number, and its tokens as places in its sorted keys ``own``.

    The number comes from the input's partition and the place there, so it is the same each time the input is read.
    """
    seen = 0
    for batch in batches:
        for words in word_keys(batch.column("text"), hashed=by_eights):
            row, keys = with_ends(words, words.key)
            own, ids = np.unique(keys, return_inverse=True)
            yield (batch.column("part")[0].as_py() << 32) + seen, batch, words, row - words.first, own, ids
            seen += 1


def token_table(base: DataFrame, numbered: DataFrame, buckets: int) -> DataFrame:
    """(chunk, blob): by group of documents their keys and lengths, the sorted numbers of its words and the start, their counts, and its tokens as places among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch, words, row, own, ids in _texts(batches):
            rows = words.last - words.first
            known = pa.RecordBatch.from_arrays(
                [batch.column("key").slice(words.first, rows), batch.column("held_out").slice(words.first, rows), pa.array(np.bincount(row, minlength=rows))],
                names=["key", "held_out", "n_tokens"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, known.schema) as writer:
                writer.write_batch(known)
            place = np.empty(len(own), np.int64)  # where the buckets' answers give a word
            place[np.concatenate([o for _, o in slices(home(own, buckets), buckets)])] = np.arange(len(own))
            columns = [pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary()), pa.array([planes(place[ids])], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "numbers", "counts"])

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        (docs, *numbers), (ids, *counts) = group.column("numbers").to_pylist(), group.column("counts").to_pylist()
        ids, numbers, n = unplanes(ids), [START.reshape(1), *map(expand, numbers)], [np.zeros(1, "<i8"), *(decoded(x, "<i8") for x in counts)]
        own, n = np.concatenate(numbers), np.concatenate(n)
        if group.column("bucket")[0].as_py() != -1 or ids.max() + 2 != len(own):
            raise ValueError("the documents came in other groups the second time: they are no stable input")
        order = np.argsort(own)
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        blob = _pack(docs, squeeze(own[order]), coded(n[order]), planes(place[1:][ids]))
        return pa.Table.from_arrays([group.column("chunk").slice(0, 1), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    answers = numbered.where(F.col("chunk").isNotNull()).select("chunk", "bucket", "numbers", "counts")
    return base.mapInArrow(run, answers.schema).unionByName(answers).groupBy("chunk").applyInArrow(meet, "chunk long, blob binary")


@dataclass
class Group:
    """A row of the table of tokens."""

    docs: pa.Table
    row: np.ndarray  # of each token
    own: np.ndarray
    n: np.ndarray  # training counts of ``own``
    ids: np.ndarray

    @classmethod
    def of(cls, blob: bytes) -> Group:
        docs, own, n, ids = _unpack(blob)
        docs = pa.ipc.open_stream(zstandard.decompress(docs)).read_all().combine_chunks()
        return cls(docs, np.repeat(np.arange(len(docs)), docs.column("n_tokens").to_numpy()), expand(own), decoded(n, "<i8"), unplanes(ids))


def count_ngrams(tokens: DataFrame, lexicon, k: int, order: int, shares: int, share: int) -> DataFrame:
    """One share of the partitioned table of n-grams.

    Rows of order 2 hold a bucket's bigrams, the words before them and training counts (``n``: how many bigrams, then how many
    trigrams, have count 1..k+1).  Rows of order 0 hold for one group, in its order, the places among those of its bigrams that training has
    (``keys``) and the counts of its n-grams and bigrams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        for chunk, blob in _rows(batches, "chunk", "blob"):
            x = Group.of(blob)
            own, (before, context, word, inverse) = x.own, _distinct(x.own, x.ids, x.row, order)
            n, out = np.bincount(inverse, ~x.docs.column("held_out").to_numpy()[x.row], len(word)).astype("<u4"), []
            for b, o in _places(lex, own, context, word, shares, share):
                known, at = np.unique(np.concatenate([context[o], before[o]]), return_inverse=True)
                out.append((b, _pack(squeeze(own[word[o]]), squeeze(own[known]), planes(at[: len(o)]), planes(at[len(o) :]), planes(n[o]))))
            if out:
                b, blobs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        bucket, parts = int(group["bucket"].iloc[0]), [list(_unpack(blob)) for blob in group["blob"]]
        small = lambda places: np.concatenate([x.astype(np.int32) for x in places])
        words, keys = [expand(x[0]) for x in parts], [expand(x[1]) for x in parts]
        cuts = np.cumsum([len(x) for x in words])[:-1]
        own, known = np.unique(np.concatenate([x[starts(x)] for x in words])), np.unique(np.concatenate(keys))
        word, keys = small(np.searchsorted(own, x) for x in words), [np.searchsorted(known, x) for x in keys]
        del words
        context, before = (small(at[unplanes(x[i])] for at, x in zip(keys, parts, strict=True)) for i in (2, 3))
        counts = small(unplanes(x[4]) for x in parts)
        del keys, parts
        # bigrams in the order of word and context, as each group has them
        two, pair = np.unique(word.astype(np.int64) * len(known) + context, return_inverse=True)
        del word, context
        three, triple = np.unique(pair * len(known) + before, return_inverse=True)
        del before
        twos, threes = np.bincount(pair, counts).astype(np.int64), np.bincount(triple, counts).astype(np.int64)
        place, out = np.cumsum(twos > 0) - 1, []
        for chunk, p, t in zip(group["chunk"], np.split(pair, cuts), np.split(triple, cuts), strict=True):
            new = p[starts(p)]
            out.append((0, bucket, chunk, squeeze(place[new[twos[new] > 0]].astype(U)), _pack(planes(threes[t]), planes(twos[new])), []))
        three, threes = three[threes > 0], threes[threes > 0]
        spread = np.bincount(three // len(known), minlength=len(two))[twos > 0]
        two, twos = two[twos > 0], twos[twos > 0]
        word, context = two // len(known), two % len(known)
        keys = _pack(squeeze(own), squeeze(known), planes(np.bincount(word, minlength=len(own))), planes(context), planes(spread), planes(three % len(known)))
        whole = np.repeat(known[context] != START, spread)  # a first word has a bigram alone
        few = [int((x == r).sum()) for x in (twos, threes[whole]) for r in range(1, k + 2)]
        out.append((2, bucket, None, keys, _pack(planes(twos), planes(threes)), few))
        return pd.DataFrame(out, columns=["order", "bucket", "chunk", "keys", "counts", "n"]).astype({"chunk": "Int64"})

    return tokens.select("chunk", "blob").mapInArrow(run, "bucket int, chunk long, blob binary").groupBy("bucket").applyInPandas(add, TABLE)


@dataclass
class Bucket:
    """The bigrams of a row of order 2, in order of word and context, and the trigrams that end in each."""

    words: np.ndarray
    known: np.ndarray
    word: np.ndarray  # place in words
    context: np.ndarray  # place in known
    count: np.ndarray
    pair: np.ndarray  # which bigram a trigram ends in
    before: np.ndarray  # place in known
    threes: np.ndarray

    @classmethod
    def of(cls, keys: bytes, counts: bytes) -> Bucket:
        own, known, of_word, context, of_pair, before = _unpack(keys)
        own, of_word, of_pair = expand(own), unplanes(of_word), unplanes(of_pair)
        twos, threes = map(unplanes, _unpack(counts))
        return cls(own, expand(known), np.repeat(np.arange(len(own)), of_word), unplanes(context), twos, np.repeat(np.arange(len(of_pair)), of_pair), unplanes(before), threes)


def context_sums(pairs: DataFrame, lexicon, k: int, order: int, shares: int = 1, share: int = 0) -> DataFrame:
    """(bucket, keys, counts): by context of ``order`` - 1 words, where that context lies, how many n-grams of one bucket follow it 1..k times,
    how many of the lower n-grams of all that follow occur 1..k times themselves, and how often the others of these occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        for keys, counts in _rows(batches, "keys", "counts"):
            x = Bucket.of(keys, counts)
            if order == 2:
                # all bigrams of a word are here, but for those of split words
                hot = _lookup(lex.hot, lex.counts, x.words)
                n = np.where(hot > 0, hot, np.bincount(x.word, x.count, len(x.words)).astype(np.int64))[x.word]
                key, context = np.unique(x.known[x.context], return_inverse=True)
                bucket, sums = home(key, lex.buckets), x.count
            else:
                mine = (lex.bucket(x.known, x.before, x.context[x.pair]) % shares == share) & (x.known[x.context] != START)[x.pair]
                pair, sums = x.pair[mine], x.threes[mine]
                n = x.count[pair]
                at, context = np.unique(x.before[mine] * len(x.known) + x.context[pair], return_inverse=True)
                first, second = at // len(x.known), at % len(x.known)
                bucket, key = lex.bucket(x.known, first, second), pair_keys(x.known[first], x.known[second])
            few, rest = few_and_rest(context, len(key), sums, n, k)
            out = [(b, squeeze(key[o]), sums_blob(few[:, o], rest[o])) for b, o in slices(bucket, lex.buckets, key)]
            if out:
                b, keys, blobs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["bucket", "keys", "counts"])

    return pairs.select("keys", "counts").mapInArrow(run, "bucket int, keys binary, counts binary")


def context_answers(table: DataFrame, sums: DataFrame, d2: np.ndarray, d3: np.ndarray, k: int) -> DataFrame:
    """Rows of kind 3: for each group and bucket, in the group's order, what the discounts take of each bigram that training has as a context, and
    the sum of the discounted counts of the bigrams that end the trigrams seen after it.
    """

    def answer(group, parts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows["counts"].notna()
        x = Bucket.of(*rows.loc[whole, ["keys", "counts"]].iloc[0])
        keys = pair_keys(x.known[x.context], x.words[x.word])
        order = np.argsort(keys)
        few, rest = add_sums(keys[order], ((expand(own), blob) for own, blob in zip(parts["keys"], parts["counts"], strict=True)), k)
        r = np.arange(1, k + 1)
        taken, lower = np.zeros(max(len(keys), 1)), np.zeros(max(len(keys), 1))
        taken[order], lower[order] = weighted((1 - d3[1:]) * r, few[:k]), weighted(d2[1:] * r, few[k:]) + rest
        out = []
        for chunk, places in zip(rows.loc[~whole, "chunk"], rows.loc[~whole, "keys"], strict=True):
            at = expand(places).astype(np.int64)
            out.append((chunk, group[0], 3, _pack(coded(taken[at]), coded(lower[at]))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "blob"])

    rows = table.select("bucket", "chunk", "keys", F.when(F.col("order") == 2, F.col("counts")).alias("counts"))
    return sums.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(answer, _PART)


def word_table(numbered: DataFrame, sums: DataFrame, lexicon, d: np.ndarray, documents: int, k: int) -> DataFrame:
    """By bucket, each word's log10 factors, as a context, of the words seen and not seen after it."""

    def finish(group, words: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        lex: Lexicon = lexicon.value
        counts = np.frombuffer(zstandard.decompress(words["counts"].iloc[0]), "<i8") if len(words) else np.zeros(0, np.int64)
        own, blobs = (np.arange(len(counts), dtype=U) + U(2)) * U(lex.buckets) + U(group[0]), [expand(x) for x in parts["keys"]]
        keys = np.unique(np.concatenate([own, *blobs]))
        n = np.zeros(len(keys), np.int64)
        n[np.searchsorted(keys, own)] = counts
        few, rest = add_sums(keys, zip(blobs, parts["counts"], strict=True), k)
        r = np.arange(1, k + 1)
        lower = weighted(lex.unigram(r), few[k:]) + lex.scale / max(lex.total, 1) * rest
        times = np.where(keys == START, documents, n)
        seen, back = factors(times, times - weighted((1 - d[1:]) * r, few[:k]), lower)
        return pd.DataFrame([(group[0], squeeze(keys), zstandard.compress(seen.tobytes() + back.tobytes(), 3))], columns=["bucket", "keys", "counts"])

    words = numbered.where(F.col("chunk").isNull()).select("bucket", "counts")
    return words.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInPandas(finish, "bucket int, keys binary, counts binary")


#: What meets in a group of documents: kind 0 its tokens, kind 1 what is known of the words of one bucket, kind 2 the counts of its n-grams of one bucket,
#: kind 3 what is known of its bigrams of one bucket as contexts.
_PART = "chunk long, bucket int, kind int, blob binary"


def _requests(tokens: DataFrame, lexicon) -> DataFrame:
    """(bucket, chunk, keys): the words of each group of documents, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        for chunk, blob in _rows(batches, "chunk", "blob"):
            own = expand(list(_unpack(blob))[1])
            b, keys = zip(*[(b, squeeze(own[o])) for b, o in slices(home(own, lex.buckets), lex.buckets)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int64()), pa.array(keys, pa.binary())], names=["bucket", "chunk", "keys"])

    return tokens.select("chunk", "blob").mapInArrow(run, "bucket int, chunk long, keys binary")


def _lookup(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def score(docs: DataFrame, held_out, key: str = "doc_id", text_col: str = "text", k: int = 5, bucket_tokens: int = 1 << 20, same_each_time: bool = False, order: int = 2, shares: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from rows where ``held_out`` is not true.  ``base_score``
    is the add-0.1 unigram score; ``score`` the log10 probability by the model of ``order`` 2 or 3.
    ``docs`` is read several times: where it does not give the same rows in the
    same order each time, as a table does (``same_each_time``), it is written first.
    The buckets are filled in ``shares``, all else is done in twice as many, so that less is shuffled at once.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    # splits of files must not follow the number of executors at hand
    with setting(spark, "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)):
        base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
        return _score(base if same_each_time else cut(base), k, bucket_tokens, order, shares).withColumnRenamed("key", key)


def _score(base: DataFrame, k: int, bucket_tokens: int, order: int, shares: int) -> DataFrame:
    size = base.agg(F.count("*").alias("docs"), F.count_if(~F.col("held_out")).alias("train"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # about six bytes a token: only the number of buckets depends on this
    buckets = max(1, -(-((size["bytes"] or 0) // 6 + size["docs"]) // bucket_tokens))
    base = base.withColumn("part", F.spark_partition_id())
    numbered = cut(number_words(base, buckets, k, bucket_tokens))
    lexicon = base.sparkSession.sparkContext.broadcast(build_lexicon(numbered, k, bucket_tokens, buckets))
    tokens = cut(token_table(base, numbered, buckets))
    each = lambda shares, step: reduce(DataFrame.unionByName, [cut(step(share)) for share in range(shares)])
    table = each(shares, lambda share: count_ngrams(tokens, lexicon, k, order, shares, share))
    shares *= 2  # the table lies on the disk by now
    pairs, counted = table.where(F.col("order") == 2), table.where(F.col("order") == 0)
    n = sums_of(pairs, 2 * k + 2)
    d, d3 = discounts(n[: k + 1]), discounts(n[k + 1 :])
    words = cut(word_table(numbered, context_sums(pairs, lexicon, k, 2), lexicon, d, size["train"], k))
    known = counted.select("chunk", "bucket", F.lit(2).alias("kind"), F.col("counts").alias("blob"))
    if order > 2:
        known = known.unionByName(each(shares, lambda share: context_answers(table.where(F.col("bucket") % shares == share), context_sums(pairs, lexicon, k, 3, shares, share), d, d3, k)))

    def answer(group, requests: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known, raw = (expand(rows["keys"].iloc[0]), zstandard.decompress(rows["counts"].iloc[0])) if len(rows) else (np.zeros(0, U), b"")
        columns = [np.frombuffer(raw, kind, len(known), 8 * i * len(known)) for i, kind in enumerate(("<f8", "<f8"))]
        out = []
        for chunk, blob in zip(requests["chunk"], requests["keys"], strict=True):
            keys = expand(blob)
            out.append((chunk, group[0], 1, _pack(blob, *[coded(_lookup(known, x, keys)) for x in columns])))
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "blob"])

    schema = T.StructType([base.schema["key"], *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def total(group: pa.Table) -> pa.Table:
        lex: Lexicon = lexicon.value
        parts = {}
        for b, kind, blob in zip(*(group.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
            parts.setdefault(kind, {})[b] = blob
        if not parts.keys() >= {0, 1, *range(2, order + 1)}:
            raise ValueError("a group of documents lacks a part")
        x = Group.of(parts[0][0])
        known, row, own, n, ids, rows = x.docs, x.row, x.own, x.n, x.ids, len(x.docs)
        words, seen, back = map(np.concatenate, zip(*((expand(keys), decoded(seen, "<f8"), decoded(back, "<f8")) for keys, seen, back in map(_unpack, parts[1].values())), strict=True))
        at = np.argsort(words)
        seen, back = seen[at], back[at]
        _, context, word, inverse = _distinct(own, ids, row, order)
        c, pair, two, taken, lower, pairs = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), [], [], [], 0
        for b, at in _places(lex, own, context, word):
            threes, twos = map(unplanes, _unpack(parts[2][b]))
            c[at], pair[at] = threes, pairs + np.cumsum(starts(context[at], word[at])) - 1
            pairs += len(twos)
            two.append(twos)
            if order > 2:
                of = _unpack(parts[3][b])
                for found, blob in zip((taken, lower), of, strict=True):
                    found.append(np.zeros(len(twos)))
                    found[-1][twos > 0] = decoded(blob, "<f8")
        two = np.concatenate(two)
        left = lambda d, c: np.log10(np.maximum(d[np.where(c < len(d), c, 0)] * c, 1e-300))
        p = np.where(two[pair] > 0, seen[context] + left(d, two[pair]), back[context] + np.log10(lex.unigram(n))[word])
        if order > 2:
            # the context of a token is the bigram of the token before it
            before = np.zeros(len(word), np.int64)
            before[inverse[1:]] = pair[inverse[:-1]]
            times = two[before]
            seen3, back3 = factors(times, times - np.concatenate(taken)[before], 10.0 ** seen[context] * np.concatenate(lower)[before])
            longer = np.where(c > 0, seen3 + left(d3, c), back3 + p)
            p = np.where((own[context] != START) & (times > 0), longer, p)
        add = lambda x: np.bincount(row, x, rows)
        columns = [*known.columns, pa.array(add(n[ids] > 0).astype(np.int64)), pa.array(np.full(rows, lex.total)), pa.array(add(lex.base(n)[ids])), pa.array(add(p[inverse]))]
        return pa.Table.from_arrays(columns, names=schema.names)

    def scored(share: int) -> DataFrame:
        docs = tokens.where(F.shiftright("chunk", 32) % shares == share)
        answers = _requests(docs, lexicon).groupBy("bucket").cogroup(words.select("bucket", "keys", "counts").groupBy("bucket")).applyInPandas(answer, _PART)
        parts = docs.select("chunk", F.lit(0).alias("bucket"), F.lit(0).alias("kind"), "blob").unionByName(answers).unionByName(known.where(F.shiftright("chunk", 32) % shares == share))
        return parts.groupBy("chunk").applyInArrow(total, schema)

    return each(shares, scored)
