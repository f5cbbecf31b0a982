"""Connected components of a distributed edge table.

Each partition first contracts its edges with a union-find of bounded size to stars, then
large-star and small-star rounds (joins and minima, aggregated before they are shuffled)
run until the edges stay the same.  Every round is written to the shared folder, so a lost
executor costs one round at most.  Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import discard, keep


def _contracted(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > limit:
                yield stars()
                up.clear()
        yield stars()

    return run


def connected_components(edges: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(``node``, ``root``) for each node that an edge (columns ``u``, ``v``, longs) touches; root is the smallest node reachable.

    Nulls and loops are ignored; no edges give no rows.  ``limit`` bounds the nodes that a
    task holds while it contracts.
    """
    spark = edges.sparkSession
    edges = edges.select("u", "v").where("u <> v").mapInArrow(_contracted(limit), "u long, v long").distinct()
    now, path = keep(edges, "edges")
    mark = None
    while True:
        # u > v always: v is the smaller end
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = keep(small.union(down.select("u", "m")).distinct(), "edges")
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = new, new_path
        if got[0] == 0 or tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
