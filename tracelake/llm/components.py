"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that one task thins out, about.
THINNED = 1_000_000


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v) without those that others of the same task make needless: a task keeps a link only if its ends weren't
    joined by what it has kept, so a dense class leaves at most one link for each node and task."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for b in batches:
            kept = []
            for i, (u, v) in enumerate(zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)):
                x, y = find(u), find(v)
                if x != y:
                    parent[x] = y
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64()))

    return links.select("u", "v").mapInArrow(thin, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that it reaches. Nodes are longs.

    Links are thinned out to forests in tasks of about THINNED first. Then alternating large-star and small-star steps, about log(longest path) rounds; each round is written to the shared
    folder. Links are counted and compared by a checksum; nothing but that goes to the driver. Loops (a = a) keep a node.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    loops = edges.filter("u = v").select(F.col("u").alias("node"))
    edges = written(edges.filter("u <> v"), "edges")
    edges = written(forest(edges.coalesce(1 + edges.count() // THINNED)), "forest")
    before = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums["n"] == 0 or sums == before:
            break
        before = sums
        both = edges.union(edges.select("v", "u"))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lows, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(near.union(lows.select("u", F.col("m").alias("v"))).distinct(), "edges")
    joined = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).union(loops).distinct().withColumn("root", F.col("node"))
    return joined.union(roots).groupBy("node").agg(F.min("root").alias("root"))
