"""Two-pass external shuffle into shards (operator 10), in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import offsets, unclashed

#: Bytes of a bucket on average; a task holds one.
BUCKET_BYTES = 32 << 20
#: Buckets above this many times the average hold repeats of one row, which are dealt out by their number.
HOT = 4


def shuffle_into_shards(df: DataFrame, path: str, shards: int, size: Column, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes all rows of df, with their columns, in a random order under `path` and returns that table.

    Pass 1 scatters the rows into buckets by a seeded hash of all their columns, so rows of one key spread; the number of
    buckets follows the sum of `size`, so that one bucket fits in memory, and each bucket is one task. Pass 2 puts each
    bucket into a fixed order, shuffles it by Fisher-Yates (`shuffle` with a seed) and writes it. A bucket's first place
    is the count of rows in the buckets before it, so all rows are numbered in their new order without a global sort, and
    shard s gets the s-th of `shards` equal runs: row counts differ by one at most. Added columns: shard, slot (0, 1, ...
    in each shard), named with trailing underscores where df has such names.

    Equal rows are kept as often as they occur; where repeats of a row make a bucket hot, they are numbered and
    scattered by their number too. Null keys are values like others. An empty table gives none. Columns must be orderable
    (no maps). The order is the same for the same rows, seed and number of buckets.
    """
    spark = df.sparkSession
    shard, slot = unclashed(df, "shard"), unclashed(df, "slot")
    total = df.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    n, buckets = total["n"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    dealt = lambda h: F.pmod(h, F.lit(buckets)).cast("int").alias("bucket")
    items = df.select(F.xxhash64(F.lit(seed), *df.columns).alias("h"), F.struct(*df.columns).alias("row"), size.alias("size"))
    rows = items.select(dealt("h"), "h", "row", "size")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    hot = [r["bucket"] for r in sizes.filter(F.col("bytes") > HOT * bucket_bytes).select("bucket").collect()] if buckets > HOT else []
    if hot:
        numbered = rows.filter(F.col("bucket").isin(hot)).withColumn("h", F.xxhash64("h", F.row_number().over(W.partitionBy("h").orderBy("h"))))
        rows = rows.filter(~F.col("bucket").isin(hot)).union(numbered.select(dealt("h"), "h", "row", "size"))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("count"))
    starts = offsets(sizes, "bucket", "count").select("bucket", "start")
    scattered = rows.select("bucket", F.struct("h", "row").alias("item"), F.lit(None).cast("long").alias("start"))
    scattered = scattered.union(starts.select("bucket", F.lit(None).cast(scattered.schema["item"].dataType), "start")).repartitionById(buckets, "bucket")
    held = scattered.groupBy("bucket").agg(F.collect_list("item").alias("items"), F.max("start").alias("start"))  # null items don't count
    moved = held.select("start", F.posexplode(F.shuffle(F.sort_array("items"), F.lit(seed))).alias("pos", "item")).select((F.col("start") + F.col("pos")).alias("g"), "item.row")
    low, more = divmod(n, shards)
    edge = more * (low + 1)
    at = F.when(F.col("g") < edge, F.floor(F.col("g") / (low + 1))).otherwise(more + F.floor((F.col("g") - edge) / max(low, 1)))
    out = moved.withColumn("s", at.cast("int")).select("row.*", F.col("s").alias(shard), (F.col("g") - F.col("s") * low - F.least(F.col("s"), F.lit(more))).cast("long").alias(slot))
    out.write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)
