"""Optimal length buckets and token-budget batches (operator 5)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import offsets, unclashed, written

#: Rows of a group that one task orders, on average.
GROUP_ROWS = 20_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` runs of the sorted distinct lengths, so that padding each row to its bound
    wastes the fewest tokens.

    Dynamic programming: cost(i, j) = length[j] * rows(i..j) - tokens(i..j), and the best split moves right with j, so
    each layer is solved by divide and conquer in n log n steps. Ties take the smaller split.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    best, splits = lengths * rows[1:], []  # one bucket; tokens are a constant
    for _ in range(min(buckets, n) - 1):
        new, split = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j, last) + 1)  # the last bucket is i..j
            cost = np.where(i > 0, best[i - 1], 0.0) + lengths[j] * (rows[j + 1] - rows[i])
            k = int(cost.argmin())
            new[j], split[j] = cost[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        best, splits = new, [*splits, split]
    bounds, j = [], n - 1
    for split in reversed(splits):
        bounds.append(int(lengths[j]))
        j = int(split[j]) - 1
        if j < 0:
            return bounds[::-1]
    return [*bounds, int(lengths[j])][::-1]


def pack(docs: DataFrame, length: Column, budget: int = 16_384, buckets: int = 16, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Length buckets and batches of padded rows that hold at most `budget` tokens.

    The exact global histogram of lengths goes to the driver, where dynamic programming chooses the bounds. n distinct
    lengths need n * n / 2 tokens at least, so 10 ** 13 tokens have 4.5 million of them at most (16 bytes each). Inside
    a bucket rows are ordered by groups of a seeded hash of the row; a group's first place is the number
    of rows in the groups before it, so no task orders a whole bucket, and batches run on from group to group. Each batch
    has budget // bound rows, at least one: a longer document is a batch of its own, marked `over_budget`.

    Returns the columns `keep` (the id by default) with n_tokens, bucket (0 is the shortest), padded_tokens (the bound),
    batch (inside the bucket), slot (inside the batch), over_budget; clashing names get underscores. Null lengths count
    as 0. Equal rows are placed one after the other; an empty table gives none.
    """
    keep = [id_col] if keep is None else keep
    names = [unclashed(docs.select(*keep), n) for n in ("n_tokens", "bucket", "padded_tokens", "batch", "slot", "over_budget")]
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), F.xxhash64(F.lit(5), *hashed).alias("h"))
    rows = written(rows, "lengths")
    histogram = rows.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").toArrow()
    lengths, counts = histogram.column("n").to_numpy(), histogram.column("c").to_numpy()
    bounds = best_bounds(lengths, counts, buckets) or [0]
    groups = max(1, math.ceil(int(counts.sum()) / GROUP_ROWS))
    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(bound, lambda b: b < F.col("n"))).cast("long")).withColumn("padded", F.element_at(bound, (F.col("bucket") + 1).cast("int")))
    rows = rows.withColumn("g", F.pmod("h", F.lit(groups)))
    sizes = rows.groupBy("bucket", "g").agg(F.count("*").alias("c"))
    starts = offsets(sizes, "g", "c", within="bucket").select("bucket", "g", "start")
    placed = rows.withColumn("r", F.row_number().over(W.partitionBy("bucket", "g").orderBy("h", "n", "row")) - 1).join(starts, ["bucket", "g"])
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded", F.lit(1)))).cast("long")
    place = F.col("start") + F.col("r")
    out = [F.col("n"), F.col("bucket").cast("int"), F.col("padded"), F.floor(place / size).cast("long"), (place % size).cast("long"), F.col("padded") > budget]
    return placed.select("row.*", *[c.alias(n) for c, n in zip(out, names, strict=True)])
