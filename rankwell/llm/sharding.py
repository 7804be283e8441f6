"""Weighted rendezvous hashing of record keys over shards, with a gapless slot in each shard.

Each key draws a uniform number for every shard, -ln of which over the shard's weight is its distance to that shard;
the nearest shard holds the key. Another shard draws numbers of its own and can only take keys, never move them
between the others.

Defined results: a null text has no bytes (size 1) and checksum 0; a null key is hashed as the text "null"; repeated
rows are rows of their own, in the same shard; slots follow a bucket of key, checksum and size, so that a key repeated very
often is spread, then the key, checksum and size; a very long text has its whole size and checksum; an empty table gives
an empty one; only the key and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.llm.common import cut

#: Rows of one shard's bucket, on average; slots are numbered within buckets.
BUCKET_ROWS = 100_000


def _distance(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of the MD5 of key and shard."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the nearest, the lower-numbered of equally near ones."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    near = F.least(*(F.struct(_distance(text, s, w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights)))
    return near["s"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard); `grown` are the weights with one more shard."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    grown = [*weights, 1.0] if grown is None else grown
    d = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"), rendezvous(F.col(id_col), grown).alias("grown_shard"),
    ))
    buckets = max(1, math.ceil(d.count() / (BUCKET_ROWS * max(1, len(weights)))))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = d.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size"))
    out = d.withColumn("rn", within).join(first, ["shard", "bucket"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rn") - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
