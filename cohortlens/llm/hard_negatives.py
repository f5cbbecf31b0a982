"""Hard-negative mining by dual-tree search.

Vectors become whole numbers (``floor(scale * x)``), so inner products are exact.  All rows are dealt
into blocks: an upper tree fitted on a bounded sample (``sample`` rows) and the label say where to, and
a block of more than ``block`` rows is dealt out by hash.  A block holds a tree of its own, down to leaves
of ``leaf`` rows, with the centre, radius and range of labels of each node.  The anchors are the stated
queries: groups of at most ``group_bytes`` are broadcast with a tree over them, one group after the other,
and every task walks pairs of nodes of both trees.  The inner products of a pair of nodes lie within
``a.c -+ (r_a |c| + r_c |a| + r_a r_c)``; a pair that can't hold a result for any of its anchors is dropped
with all of them, and pairs of leaves are scored exactly.

A first search over one block of each bucket of labels gives each anchor the score that its results
have at least; the second, over all blocks, starts from there.  The search runs twice: for the
``positives`` best rows of an anchor's label, then for the ``negatives`` best rows of other labels between
``low`` and ``high`` per cent of each positive's score.  Equal scores are told apart by id (then by
row), so results depend neither on trees nor on blocks.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; shorter vectors count as if zeros followed; an empty vector is all zeros; repeated rows stay apart
as rows, so an anchor's copy may be its positive; an anchor without positives, or whose positives have
no row in their range, returns nothing; empty tables give no rows.  Vectors whose scores could reach
2**53 are an error, as they would not be exact.  Only the named columns are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import keep


class Tree(NamedTuple):
    """Rows in the order of their leaves, and arrays of nodes; the first node is the root and a leaf has no child (-1)."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray  # nodes by two
    centre: np.ndarray
    radius: np.ndarray
    labels: np.ndarray  # nodes by least and largest label


def _direction(x: np.ndarray) -> np.ndarray:
    """From one to the other of two rows that are far apart."""
    far = x[np.argmax(((x - x[0]) ** 2).sum(1))]
    return x[np.argmax(((x - far) ** 2).sum(1))] - far


def build_tree(x: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int) -> Tree:
    """Halves of halves by the projection on the line between two far rows; rows of a leaf are in the order of ids."""
    order = np.arange(len(x))
    first, last, child, todo = [0], [len(x)], [[-1, -1]], [0]
    while todo:
        node = todo.pop()
        a, b = first[node], last[node]
        if b - a <= leaf:
            own = order[a:b]
            order[a:b] = own[np.argsort(ids[own], kind="stable")]
            continue
        own = order[a:b]
        half = (b - a) // 2
        order[a:b] = own[np.argpartition(x[own] @ _direction(x[own]), half)]
        child[node] = [len(first), len(first) + 1]
        todo += child[node]
        first += [a, a + half]
        last += [a + half, b]
        child += [[-1, -1], [-1, -1]]
    spans = list(zip(first, last, strict=True))
    centre = np.stack([x[order[a:b]].mean(0) for a, b in spans])
    radius = np.array([math.sqrt(((x[order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centre, strict=True)])
    ranges = np.array([[labels[order[a:b]].min(), labels[order[a:b]].max()] for a, b in spans], np.int64)
    return Tree(order, np.array(first), np.array(last), np.array(child), centre, radius, ranges)


def fit_upper(x: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each level, the directions (node by component) and thresholds of the upper tree."""
    out, node = [], np.zeros(len(x), np.int64)
    for level in range(levels):
        lines, cuts = np.zeros((1 << level, x.shape[1])), np.zeros(1 << level)
        for n in np.unique(node).tolist():
            own = x[node == n]
            lines[n] = _direction(own)
            cuts[n] = np.median(own @ lines[n])
        out.append((lines, cuts))
        node = node * 2 + ((x * lines[node]).sum(1) > cuts[node])
    return out


def upper_leaf(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for lines, cuts in levels:
        node = node * 2 + ((x * lines[node]).sum(1) > cuts[node])
    return node


def _over(tree: Tree, values: np.ndarray, of) -> np.ndarray:
    """``of`` (minimum or maximum) of the values of each node's rows, which are in the tree's order."""
    out = np.empty(len(tree.first))
    for n in range(len(tree.first) - 1, -1, -1):
        a, b = tree.child[n]
        out[n] = of.reduce(values[tree.first[n] : tree.last[n]]) if a < 0 else of(out[a], out[b])
    return out


def leaf_pairs(a: Tree, c: Tree, least: np.ndarray, most: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of both trees whose inner products can be from ``least`` to ``most`` of an anchor node, and the upper ends of their intervals, largest first."""
    norm_a, norm_c = np.sqrt((a.centre**2).sum(1)), np.sqrt((c.centre**2).sum(1))
    dots = a.centre @ c.centre.T
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(i):
        reach = a.radius[i] * norm_c[j] + c.radius[j] * norm_a[i] + a.radius[i] * c.radius[j]
        reach += 1e-9 * (norm_a[i] + a.radius[i]) * (norm_c[j] + c.radius[j]) + 1e-6  # for rounding in centres and radii
        low, high = dots[i, j] - reach, dots[i, j] + reach
        meet = (a.labels[i, 0] <= c.labels[j, 1]) & (c.labels[j, 0] <= a.labels[i, 1])
        one = (a.labels[i, 0] == a.labels[i, 1]) & (c.labels[j, 0] == c.labels[j, 1]) & (a.labels[i, 0] == c.labels[j, 0])
        ok = (high >= least[i]) & (low <= most[i]) & (meet if same else ~one)
        i, j, high = i[ok], j[ok], high[ok]
        end_a, end_c = a.child[i, 0] < 0, c.child[j, 0] < 0
        done.append((i[end_a & end_c], j[end_a & end_c], high[end_a & end_c]))
        split_a = ~end_a & (end_c | (a.radius[i] >= c.radius[j]))
        split_c = ~end_c & ~split_a
        i, j = (np.concatenate([a.child[i[split_a]].ravel(), i[split_c].repeat(2)]), np.concatenate([j[split_a].repeat(2), c.child[j[split_c]].ravel()]))
    i, j, high = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(-high, kind="stable")
    return i[by], j[by], high[by]


class Anchors(NamedTuple):
    """A group of anchors in the order of its tree; slots are what results are kept for."""

    tree: Tree
    rows: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray  # anchors by slots: least and largest score that counts, and the least that can still be a result
    high: np.ndarray
    floor: np.ndarray
    same: bool  # rows of the anchor's label are looked for, or of the others


class Best:
    """The best k rows of each slot so far, as arrays (slot, id, row, score); ``floor`` is the score that a new one has at least."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.ravel().copy(), k
        self.found, self.new, self.size = np.empty((4, 0), np.int64), [], 0

    def add(self, slot: np.ndarray, ids: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        self.new.append(np.stack([slot, ids, rows, score.astype(np.int64)]))
        self.size += len(slot)
        if self.size > 100_000:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        found = np.concatenate([self.found, *self.new], axis=1)
        found = found[:, np.lexsort((found[2], found[1], -found[3], found[0]))]
        rank = np.arange(found.shape[1]) - np.searchsorted(found[0], found[0])
        last = rank == self.k - 1
        self.floor[found[0, last]] = np.maximum(self.floor[found[0, last]], found[3, last])
        self.found, self.new, self.size = found[:, rank < self.k], [], 0


def scan(block: dict, anchors: Anchors, best: Best, dim: int) -> None:
    """Adds the rows of a block to the results."""
    load = lambda c, kind: np.frombuffer(block[c], kind)
    ids, rows, labels, x = load("ids", np.int64), load("rows", np.int64), load("labels", np.int64), load("vectors", np.float64).reshape(-1, dim)
    nodes = load("nodes", np.int64).reshape(-1, 6)
    tree = Tree(np.arange(len(ids)), nodes[:, 0], nodes[:, 1], nodes[:, 2:4], load("centres", np.float64).reshape(-1, dim), load("radii", np.float64), nodes[:, 4:])
    slots = anchors.low.shape[1]
    floor = best.floor.reshape(-1, slots)  # a view: merges are seen
    least = lambda: np.maximum(anchors.low, floor).min(1)
    most = anchors.high.max(1)
    for i, j, high in zip(*leaf_pairs(anchors.tree, tree, _over(anchors.tree, least(), np.minimum), _over(anchors.tree, most, np.maximum), anchors.same), strict=True):
        own = slice(anchors.tree.first[i], anchors.tree.last[i])
        if high < least()[own].min():  # results have come meanwhile
            continue
        to = slice(tree.first[j], tree.last[j])
        score = anchors.x[own] @ x[to].T  # whole numbers below 2**53: exact in any order
        equal = anchors.labels[own][:, None] == labels[to][None, :]
        fits = equal & (anchors.rows[own][:, None] != rows[to][None, :]) if anchors.same else ~equal
        for s in range(slots):
            cut = np.maximum(anchors.low[own, s], floor[own, s])
            left = np.where(fits & (score >= cut[:, None]) & (score <= anchors.high[own, s][:, None]), score, -np.inf)
            live = np.flatnonzero((left > -np.inf).any(1))
            left = left[live]
            for _ in range(best.k):
                if not len(live):
                    break
                place = left.argmax(1)  # the first of equal ones, which has the smallest id
                value = left[np.arange(len(live)), place]
                some = value > -np.inf
                live, left, place, value = live[some], left[some], place[some], value[some]
                best.add((own.start + live) * slots + s, ids[to][place], rows[to][place], value)
                left[np.arange(len(live)), place] = -np.inf
    best.merge()


_BLOCK = "ids binary, rows binary, labels binary, vectors binary, nodes binary, centres binary, radii binary"


def _searched(blocks: DataFrame, anchors: Anchors, k: int, dim: int) -> DataFrame:
    """(``slot``, ``id``, ``row``, ``score``, ``rank``) of the best k rows of each slot."""
    shared = blocks.sparkSession.sparkContext.broadcast((tuple(anchors.tree), anchors[1:]))  # plain arrays, of a group of anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rest = shared.value
        asked = Anchors(Tree(*tree), *rest)
        best = Best(asked.floor, k)
        for b in batches:
            for i in range(b.num_rows):
                scan({c: b.column(c)[i].as_buffer() for c in b.schema.names}, asked, best, dim)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found], names=["slot", "id", "row", "score"])

    found = blocks.select(*(c.split()[0] for c in _BLOCK.split(", "))).mapInArrow(run, "slot long, id long, row long, score long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= k)


def _floors(seeds: DataFrame, anchors: Anchors, k: int, dim: int) -> np.ndarray:
    """The score of the k-th result among the seed blocks, for slots that have so many there."""
    floor = anchors.floor.ravel().copy()
    for r in _searched(seeds, anchors, k, dim).where(F.col("rank") == k).select("slot", "score").collect():  # a row a slot at most
        floor[r["slot"]] = r["score"]
    return floor.reshape(anchors.floor.shape)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, block: int = 2048, leaf: int = 128, sample: int = 4096, buckets: int = 16, group_bytes: int = 32_000_000) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``); ids are whole numbers.

    ``is_anchor`` is an expression over the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = isinstance(vectors.schema[label_col].dataType, T.IntegralType)
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.when(good, vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and vector is not null").withColumn("row", F.monotonically_increasing_id())
    rows, _ = keep(rows, "rows")  # the numbers of rows stay what they are
    total, dim, anchors_n = rows.agg(F.count("*"), F.max(F.size("vector")), F.count_if("anchor")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors_n:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)

    def whole_numbers(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), dim))
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())
        size = np.diff(ends, prepend=0)
        at = np.repeat(np.arange(len(size)), size)
        out[at, np.arange(len(flat)) - np.repeat(ends - size, size)] = np.floor(flat * float(scale))
        return out

    few = max(64, min(sample, 8_000_000 // dim))
    # a bounded sample; those out of question go before the order, which brings `few` rows from every task
    draw = F.pmod(F.xxhash64("row"), F.lit(total))
    drawn = rows.where(draw < 2 * few).select("vector", draw.alias("draw")).orderBy("draw").limit(few).select("vector").toArrow()
    largest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    if (largest * scale + 1) ** 2 * dim >= 2**53:
        raise ValueError("scores of these vectors can reach 2**53, beyond which they are not exact")
    points = whole_numbers(drawn.column(0).combine_chunks())
    levels = min(int(math.log2(max(1, total / (2 * block)))), int(math.log2(max(1, len(points) // 32))))
    upper = spark.sparkContext.broadcast(fit_upper(points, levels))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole_numbers(b.column("vector"))
            columns = [b.column("row"), b.column("id"), b.column("label"), b.column("anchor"), pa.array(upper_leaf(x, upper.value).astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "anchor", "leaf", "vector"])

    placed, _ = keep(rows.mapInArrow(place, "row long, id long, label long, anchor boolean, leaf int, vector binary"), "placed")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("leaf", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), ["leaf", "bucket"]).withColumn("own", F.pmod(F.xxhash64("row"), "parts").cast("int"))  # as many sizes as leaves (at most sample / 32) times buckets

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        return *(t.column(c).to_numpy() for c in ("row", "id", "label")), x

    def packed(t: pa.Table) -> pa.Table:
        row, ids, labels, x = arrays(t.sort_by([("row", "ascending")]))
        tree = build_tree(x, labels, ids, leaf)
        o = tree.order
        nodes = np.concatenate([tree.first[:, None], tree.last[:, None], tree.child, tree.labels], axis=1).astype(np.int64)
        own = {"ids": ids[o], "rows": row[o], "labels": labels[o], "vectors": x[o], "nodes": nodes, "centres": tree.centre, "radii": tree.radius}
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "leaf": t.column("leaf").slice(0, 1), "own": t.column("own").slice(0, 1)} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in own.items()})

    blocks = dealt.select("bucket", "leaf", "own", "row", "id", "label", "vector").groupBy("bucket", "leaf", "own").applyInArrow(packed, f"bucket int, leaf int, own int, {_BLOCK}")
    blocks, _ = keep(blocks, "blocks")
    first = blocks.groupBy("bucket").agg(F.min(F.struct("leaf", "own")).alias("s")).select("bucket", "s.leaf", "s.own")
    seeds = blocks.join(F.broadcast(first), ["bucket", "leaf", "own"], "left_semi")  # one row a bucket

    groups = max(1, math.ceil(anchors_n * 8 * dim / group_bytes))
    out = []
    for g in range(groups):
        asked = placed.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).select("row", "id", "label", "vector").orderBy("row").toArrow()  # about `group_bytes`
        if not asked.num_rows:
            continue
        row, ids, labels, x = arrays(asked)
        tree = build_tree(x, labels, ids, leaf)
        row, ids, labels, x = row[tree.order], ids[tree.order], labels[tree.order], x[tree.order]
        none = np.full((len(row), 1), -np.inf)
        wanted = Anchors(tree, row, labels, x, none, -none, none, True)
        wanted = wanted._replace(floor=_floors(seeds, wanted, positives, dim))
        near, _ = keep(_searched(blocks, wanted, positives, dim).select(F.col("slot").alias("anchor"), "rank", "id", "score"), "positives")
        # of each anchor and positive the range of scores; no room where there is no positive or its score is below 0
        least, most = np.full((len(row), positives), np.inf), np.full((len(row), positives), -np.inf)
        for r in near.where("score >= 0").collect():  # `positives` rows an anchor of the group
            least[r["anchor"], r["rank"] - 1], most[r["anchor"], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
        wanted = Anchors(tree, row, labels, x, least, most, np.full(least.shape, -np.inf), False)
        wanted = wanted._replace(floor=_floors(seeds, wanted, negatives, dim))
        far = _searched(blocks, wanted, negatives, dim)
        names = spark.createDataFrame(pa.table({"anchor": np.arange(len(ids)), "anchor_id": ids}))
        far = far.select(F.floor(F.col("slot") / positives).cast("long").alias("anchor"), (F.col("slot") % positives + 1).cast("int").alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        near = near.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out.append(far.join(near, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return reduce(DataFrame.unionByName, out)

