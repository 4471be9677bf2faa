"""Fill-in-the-middle transformation as one NumPy kernel over Arrow's UTF-8 buffers.

A text is read as units: a run of white space with the word after it, or the
white space at its end.  Bytes are classed by a lookup table; a mask over
adjacent classes marks where units begin; cumulative sums of that mask, less
their value at each document's start, number the units of all documents at once;
``searchsorted`` then finds the cuts of all rows together.  Prefix, middle and
suffix lie one after another in the buffer, so they are one Arrow array over the
old bytes, and the outputs are put together by element-wise joins.

The numbers that decide come from a seeded hash of the key, so a row's result
does not depend on where or when it is computed.  Rows are taken some at a time,
so that temporaries stay near a fixed multiple of ``chunk_bytes``; one text is
never split.  Nothing is shuffled, and no key can be hot.

Defined cases: a null or empty text is ``plain`` with no units and an empty
output; so is, with its text as output, one that holds a marker already; a null
key is hashed as no digits; rows that share a key share its numbers, and
repeated rows have one result; an empty table gives an empty result; bytes that
are no UTF-8 count as what they would begin; input columns are kept and may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .words import text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
_LEADS = (np.arange(256) & 0xC0) != 0x80

FIM = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def unit_cuts(offsets: np.ndarray, data: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut) of every row: cuts are byte places in ``data``, drawn by ``h1`` and ``h2``."""
    blank = _SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = blank[1:] & ~blank[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    counted = np.concatenate([[0], np.cumsum(begins)])
    base = counted[offsets[:-1]]
    units = counted[offsets[1:]] - base
    draws = np.stack([h1 % (units + 1), h2 % (units + 1)])
    # a cut after k units is where unit k begins, or the end of the text
    cuts = [np.minimum(np.searchsorted(counted, base + k + 1) - 1, offsets[1:]) for k in (draws.min(axis=0), draws.max(axis=0))]
    return units, *cuts


def transform(texts: pa.Array, h: np.ndarray, rate: int, spm: int) -> pa.StructArray:
    """The struct ``FIM`` of every text; ``h`` holds four unsigned numbers a row."""
    offsets, data = text_buffers(texts)
    low = offsets[0]
    data, offsets = data[low : offsets[-1]], np.ascontiguousarray(offsets - low)
    rows = len(texts)
    units, first, second = unit_cuts(offsets, data, h[0], h[1])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    marked = reduce(pc.or_, [pc.match_substring(whole, m) for m in (PREFIX, SUFFIX, MIDDLE)]).to_numpy(zero_copy_only=False)
    plain = (np.diff(offsets) == 0) | marked | (h[2] % 100 >= rate)
    suffix_first = h[3] % 100 < spm

    bounds = np.append(np.stack([offsets[:-1], first, second], 1).ravel(), offsets[-1])
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 3 * rows, [None, pa.py_buffer(bounds), whole.buffers()[2]])
    joined = {}
    for name, rows_of, shape in (("psm", ~plain & ~suffix_first, ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1))), ("spm", ~plain & suffix_first, ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)))):
        at = np.flatnonzero(rows_of)
        pieces = [x for mark, k in shape for x in (pa.scalar(mark.encode(), pa.large_binary()), parts.take(pa.array(3 * at + k)))]
        joined[name] = (at, pc.binary_join_element_wise(*pieces, pa.scalar(b"", pa.large_binary())))
    at = np.flatnonzero(plain)
    joined["plain"] = (at, whole.take(pa.array(at)))
    place, form = np.empty(rows, np.int64), np.empty(rows, object)
    place[np.concatenate([a for a, _ in joined.values()])] = np.arange(rows)
    output = pa.concat_arrays([x for _, x in joined.values()]).take(pa.array(place))
    for name, (a, _) in joined.items():
        form[a] = name

    points = np.concatenate([[0], np.cumsum(_LEADS[data])])
    between = lambda a, b: pa.array(points[b] - points[a], pa.int64(), mask=plain)
    values = [pa.array(units, pa.int64()), pa.array(form, pa.string()), between(offsets[:-1], first), between(first, second), _as_text(output)]
    return pa.StructArray.from_arrays(values, names=FIM.names)


def _as_text(raw: pa.Array) -> pa.Array:
    """The same bytes as a string column; unlike a cast, bytes that are no UTF-8 pass as they came."""
    validity, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets.astype(np.int32)), data if data is not None else pa.py_buffer(b""))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, key: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with a struct column ``fim`` more: n (units), form, prefix_chars, middle_chars, output.

    ``rate`` percent of the texts are cut; of these ``spm`` percent give the suffix first.
    """
    out, hashes = free_name(docs, "fim"), free_name(docs, "fim_hash")
    names = docs.columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = docs.withColumn(hashes, F.unhex(F.substring(digest, 1, 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            texts, codes = batch.column(names.index(text_col)), batch.column(len(names))
            h = np.frombuffer(b"".join(codes.to_pylist()), ">u4").reshape(-1, 4).T.astype(np.int64)
            offsets, _ = text_buffers(texts)
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk_bytes, "right")) - 1)
                done = transform(texts.slice(a, b - a), h[:, a:b], rate, spm)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[: len(names)]], done], names=[*names, out])
                a = b

    return drawn.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, FIM)]))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = lambda after, before: F.substring_index(F.substring_index(output, after, -1), before, 1)  # noqa: E731  bytes alone: what is no UTF-8 stays
    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))).when(form == "spm", F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))).otherwise(output)
