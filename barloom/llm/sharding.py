"""Sharding by jump consistent hashing: the key and the number of shards decide, without a ring table.

Appending one shard moves only the rows that land in it, about one in n + 1. Rows with a null key share one
shard. Rows that are equal in every returned column are interchangeable; each still gets a slot of its own.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import column, free_name
from barloom.llm.mixing import place_of
from barloom.llm.resampling import in_order
from barloom.session import cut_lineage

# Fixed values of the published algorithm: the generator's multiplier, and the range its high bits are taken from.
MULTIPLIER, RANGE = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. All keys jump together until every one is past the last shard."""
    state, shard = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    at = np.zeros(len(keys), np.int64)
    while len(live):
        shard[live] = at
        state = state * MULTIPLIER + np.uint64(1)
        at = ((at + 1) * (RANGE / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        still = at < shards
        live, state, at = live[still], state[still], at[still]
    return shard


def with_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """`df` with the shard of each row in column `out`; no shuffle."""
    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return df.withColumn(out, place(F.xxhash64(column(key).cast("string"))))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of each row.

    Slots are gapless from 0 in each shard. They are numbered in parallel: rows fall into buckets of about
    `bucket_rows` by hash, bucket totals give each bucket its first slot, and only rows of one bucket meet in a task.
    Equal rows are counted first and unfolded at the end, so a key with very many copies stays one row until then.
    A null text has size 1 and the checksum of an empty text.
    """
    body = F.coalesce(column(text), F.lit(""))
    rows = docs.select(column(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    same = cut_lineage(with_shard(with_shard(same, "doc_id", shards), "doc_id", shards + 1, "grown_shard"))
    buckets = max(1, -(-same.count() // (bucket_rows * shards)))
    same = same.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (same.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
             .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = same.join(first, ["shard", "bucket"]).withColumn("start", F.col("first") + F.sum("copies").over(inside) - F.col("copies"))
    return placed.select(F.col("doc_id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.explode(F.sequence("start", F.col("start") + F.col("copies") - 1)).alias("slot"), "grown_shard")


def training_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """`docs`, texts included, with the shard and slot of each row: what a training job reads in the order of the slots.

    Equal rows are the passes that mixing takes of a document, so they are numbered (epoch, from 0), and within a shard
    the slots run through one epoch after the other, each in the order of mixing's permutation: `place_of` with the same
    seed. Sources are mixed within an epoch and a document's passes lie in epochs of their own (one may end where the next begins). Only narrow rows are sorted; the
    texts move once. Added columns: epoch, shard, slot, grown_shard (with one shard more), size and text_crc32, with
    underscores appended where `docs` has such a name. Nulls count as in `shard_documents`.
    """
    body = F.coalesce(column(text), F.lit(""))
    stored = cut_lineage(docs.select(F.struct(*[column(c) for c in docs.columns]).alias("doc"), column(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                                     F.crc32(F.encode(body, "utf-8")).alias("text_crc32"), F.xxhash64(*[column(c) for c in docs.columns]).alias("same"), F.monotonically_increasing_id().alias("row")))
    narrow = stored.drop("doc")
    listed = in_order(narrow, F.col("key").asc(), F.col("same").asc(), F.col("row").asc())
    first = listed.groupBy("key", "same").agg(F.min("rank").alias("first")).select(F.col("key").alias("k"), F.col("same").alias("s"), "first")
    counted = listed.join(first.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (F.col("same") == F.col("s"))).withColumn("epoch", F.col("rank") - F.col("first")).drop("rank", "first", "k", "s")
    dealt = with_shard(with_shard(counted, "key", shards), "key", shards + 1, "grown_shard").withColumn("place", place_of(seed, F.col("epoch"), F.col("key")))
    ranked = in_order(dealt.withColumnRenamed("place", "at"), *[F.col(c).asc() for c in ("shard", "epoch", "at", "key", "row")])
    starts = ranked.groupBy("shard").agg(F.min("rank").alias("start"))   # a row for each shard
    slots = ranked.join(F.broadcast(starts), "shard").select("row", "epoch", "shard", (F.col("rank") - F.col("start")).alias("slot"), "grown_shard")
    named = [F.col(c).alias(free_name(docs, c)) for c in ("epoch", "shard", "slot", "grown_shard", "size", "text_crc32")]
    return stored.select("doc", "size", "text_crc32", "row").join(slots, "row").select(*[F.col("doc")[c].alias(c) for c in docs.columns], *named)
