"""Two-pass external shuffle into shards.

First pass: a seeded rendezvous hash of the key gives each record its shard,
so the key and the number of shards alone decide, and one more shard takes
records only into itself; a second seeded hash of key and text scatters each
shard's records into memory-sized buckets.  Second pass: each bucket is put in
the order of that hash, Fisher-Yates shuffled in memory by a generator seeded
from the bucket's number, and its records get consecutive slots after those of
the shard's earlier buckets.  So the seed alone fixes every slot, however the
input is partitioned and whichever task runs again.

The records cross the network once.  Bucket sizes come from a counting pass;
their offsets travel to the buckets by co-grouping, so nothing that grows with
the data is broadcast or collected.  ``write_shards`` writes the buckets where
they were shuffled, in one folder a shard, so no task holds a shard.

Rows equal in key and text share a bucket.  Where one key and text fills more
than a bucket, its rows are spread by their place in the input, so that every
bucket stays bounded; only which slots these equal rows get depends on that.

Defined cases: a null text has no bytes; a null key is a key like any other;
rows that share a key share its shard and are spread over the shard's buckets by
their text; an empty table gives an empty result; input columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name

#: So many numbers of hot rows may be sent to all tasks; beyond, they are joined by a shuffle.
MOST_SENT = 100_000
SHARDING = T.StructType([T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType())])


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash for ``key``."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s")))
    return F.array_max(marks)["s"]


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = 8 << 20, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``sharding`` more: size, shard, slot, grown_shard."""
    out = free_name(docs, "sharding")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    shard = rendezvous(F.col(key), shards, seed)
    volume = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-volume // (shards * bucket_bytes)))
    b, c, h = free_name(docs, "bucket"), free_name(docs, "spread"), free_name(docs, "hot")
    spread = F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text_col))
    # rows equal in key and text that fill more than a bucket: there are fewer of these than buckets
    hot = cut(docs.select(spread.alias(h), size.alias("size")).groupBy(h).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bucket_bytes).select(h))
    dealt = docs.withColumn(c, spread)
    if n_hot := hot.count():
        sent = F.broadcast(hot) if n_hot <= MOST_SENT else hot
        one_of_many = F.xxhash64(c, F.monotonically_increasing_id())
        # written once: both passes must see the same numbers, whatever is run again
        split = cut(dealt.join(sent, F.col(c) == F.col(h), "left_semi").withColumn(h, one_of_many))
        dealt = dealt.join(sent, F.col(c) == F.col(h), "left_anti").withColumn(h, F.col(c)).unionByName(split)
    else:
        dealt = dealt.withColumn(h, F.col(c))
    place = shard.cast("long") * per_shard + F.pmod(F.col(h), F.lit(per_shard))
    dealt = dealt.withColumn(out, F.struct(size.alias("size"), shard.alias("shard"), F.lit(None).cast("long").alias("slot"), rendezvous(F.col(key), shards + 1, seed).alias("grown_shard"))).withColumn(b, place).drop(h)
    counts = dealt.groupBy(b).agg(F.count("*").alias("n"))
    before = W.partitionBy((F.col(b) / per_shard).cast("long")).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(b).alias("of_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first_slot"))
    names = docs.columns
    fields = [*docs.schema.fields, T.StructField(out, SHARDING)]

    def shuffle_bucket(group, records: pa.Table, offset: pa.Table) -> pa.Table:
        rng = np.random.default_rng([seed, group[0].as_py()])
        order = np.argsort(records.column(c).to_numpy(), kind="stable")
        rng.shuffle(order)  # Fisher-Yates
        records = records.take(pa.array(order)).combine_chunks()
        first = offset.column("first_slot")[0].as_py()
        s = records.column(out)
        s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
        values = [s.field("size"), s.field("shard"), pa.array(np.arange(first, first + len(records)), pa.int64()), s.field("grown_shard")]
        column = pa.StructArray.from_arrays(values, names=["size", "shard", "slot", "grown_shard"])
        return pa.Table.from_arrays([*[records.column(c) for c in names], column], names=[*names, out])

    return dealt.groupBy(b).cogroup(offsets.groupBy("of_bucket")).applyInArrow(shuffle_bucket, T.StructType(fields))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write shuffled records as one folder a shard, ``shard=0`` and so on, each file in slot order.

    Every task writes the buckets it has shuffled, so a shard is spread over many files.
    """
    s = shuffled.columns[-1]
    slot, shard = free_name(shuffled, "slot"), free_name(shuffled, "shard")
    rest = [F.col(f"{s}.{x}").alias(free_name(shuffled, x)) for x in ("size", "grown_shard")]
    flat = shuffled.select(*[F.col(f"`{c}`") for c in shuffled.columns[:-1]], *rest, F.col(f"{s}.slot").alias(slot), F.col(f"{s}.shard").alias(shard))
    flat.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
