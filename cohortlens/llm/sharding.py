"""Minimax contiguous sharding, with DataFrame operations only.

Groups (rows with equal texts) are atomic and ordered by a 64-bit hash.  The smallest
feasible shard capacity over the ordered group sizes is found by binary search, each
capacity checked greedily, and the sequence is cut under it, each shard as near to the mean
of what is left as whole groups and the capacity allow.

The sizes never come to the driver as a whole.  It reads sums over cells of hash prefixes
(4,096 at most for each cell that is refined) and refines only cells in which a cut may
fall: between a lower bound on the capacity (cells can be cut anywhere) and an upper one
(cells are whole), until both are equal.  Slots are numbered by counts of bounded buckets
plus the rank inside a bucket; a hot group is salted over many buckets.

Law ``bytes``: sizes near equal; a group larger than the mean is a shard of its own size.
Edge cases: a null text has size 1 and the CRC of no bytes (0); empty texts likewise; ties
of the id keep the slots gapless; repeated rows each get a slot; an empty table gives no
rows; columns besides those named are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm.common import keep

STEP = 12  # bits by which a cell is refined: 4,096 cells


@dataclass(frozen=True)
class Cell:
    """Groups whose hashes share the leading bits of ``low``; ``whole`` if there is one group."""

    low: int
    bits: int
    size: int
    whole: bool


def _cells(sizes: DataFrame, parents: list[Cell] | None) -> list[Cell]:
    """Sums by the next STEP bits of the hash, all over or inside the parents."""
    bits = min(64, STEP + (parents[0].bits if parents else 0))
    if parents:
        sizes = sizes.where(F.shiftright("key", 64 - parents[0].bits).isin([c.low >> (64 - c.bits) for c in parents]))
    rows = sizes.groupBy(F.shiftright("key", 64 - bits).alias("p")).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("whole")).collect()
    return sorted((Cell(r["p"] << (64 - bits), bits, r["size"], r["whole"]) for r in rows), key=lambda c: c.low)


def _greedy(ends: list[int], cells: list[Cell], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Where each shard ends (bytes from the start) when filled greedily; with ``fluid``, cells of many groups can be cut anywhere."""
    out, at = [], 0
    for _ in range(shards):
        to = min(at + capacity, ends[-1])
        i = bisect_right(ends, to)
        if i < len(cells) and not (fluid and not cells[i].whole):
            to = max(at, ends[i] - cells[i].size)
        at = to
        out.append(at)
    return out


def _smallest(ends: list[int], cells: list[Cell], shards: int, fluid: bool) -> int:
    lo, hi = max(1, -(-ends[-1] // shards)), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(ends, cells, mid, shards, fluid)[-1] >= ends[-1]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def plan(sizes: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first hash of shards 1 to ``shards - 1``) for rows of (``key``, ``size``)."""
    cells = _cells(sizes, None)
    if not cells:
        return 0, []

    def refine(which: list[Cell]) -> None:
        nonlocal cells
        level = min(c.bits for c in which)
        old = {c.low for c in which if c.bits == level}
        finer = _cells(sizes, [c for c in which if c.bits == level])
        cells = sorted([c for c in cells if c.bits != level or c.low not in old] + finer, key=lambda c: c.low)

    while True:
        ends = list(accumulate(c.size for c in cells))
        low, high = (_smallest(ends, cells, shards, fluid) for fluid in (True, False))
        if stuck := [c for c in cells if c.size > low and not c.whole]:
            refine(stuck)
            continue
        if low == high:
            capacity = low
            # the latest cut i can be made and still leave no more than fits: greedy from the end
            back, at = [], ends[-1]
            for _ in range(shards - 1):
                at = next(iter(ends[bisect_left(ends, at - capacity) : bisect_left(ends, at - capacity) + 1])) if at > capacity else 0
                back.append(at)
            back.reverse()
            cuts, open_cells, at = [], [], 0
            for j in range(shards - 1):
                goal = at + (ends[-1] - at) / (shards - j)
                i = min(bisect_left(ends, goal), len(cells) - 1)
                if not cells[i].whole and ends[i] > goal > ends[i] - cells[i].size:
                    open_cells.append(cells[i])
                below, above = max(at, ends[i] - cells[i].size), ends[i]
                near = above if above - goal < goal - below else below
                most = max([e for e in ends[max(0, bisect_right(ends, at + capacity) - 1) : bisect_right(ends, at + capacity)] if e >= at], default=at)
                at = min(max(near, back[j]), most)
                cuts.append(at)
            if not open_cells:
                first = [c.low for c in cells]
                return capacity, [first[i] if (i := bisect_right(ends, cut)) < len(cells) else None for cut in cuts]
            refine(open_cells)
            continue
        ranges = list(zip(_greedy(ends, cells, low, shards, False), _greedy(ends, cells, high, shards, True), strict=True))
        refine([c for c, e in zip(cells, ends, strict=True) if not c.whole and any(a < e and e - c.size < b for a, b in ranges)])


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, _ = keep(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key")), "sizes")
    _, first = plan(rows, shards)
    cuts = [c for c in first if c is not None]
    shard = sum([(F.col("key") >= c).cast("int") for c in cuts], F.lit(0))
    # hash prefixes so short that there are at most 65,536; a prefix with many rows is salted
    n = rows.count()
    bits = min(16, max(0, (n // 128).bit_length()))
    fill = max(128, n >> 16)
    prefix = F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("shard", shard).withColumn("prefix", prefix)
    salts = rows.groupBy("prefix").agg(F.ceil(F.count("*") / fill).alias("salts"))
    rows = rows.join(F.broadcast(salts), "prefix").withColumn("salt", F.pmod(F.xxhash64("id"), "salts"))
    bucket = ["shard", "prefix", "salt"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("prefix", "salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most 65,536 prefixes and as many salts again: bounded
    offsets = counts.select(*bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("key", "id"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(offsets), bucket)
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
