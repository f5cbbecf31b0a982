"""Ranked lexical search over a clustered index whose documents recursive graph bisection puts in order.

Each text is read once for its length and the terms that are asked for (a semi-join with the items'
terms, which are broadcast; see ``cells``).  The documents are ordered by recursive graph bisection of
the graph of documents and terms: the upper levels are fitted on a bounded sample (``sample``
documents) and kept as a weight of each term and a threshold for each node, by which every document is
routed; the lower levels bisect the documents of a part themselves, in one task of at most about
``part`` documents, down to clusters of ``cluster``.  A leaf of the upper levels with more documents, equal
texts for example, is dealt into several parts.

The index holds for each cluster its postings and the largest impact of each term.  A search computes
the bound of every cluster, visits clusters by descending bound and stops at the first below the
score of the k-th document so far.  A first round visits the best clusters of each part and gives every
item a score that its k-th document has at least; the second starts from there.  Clusters that reach
the score exactly are visited too, and equal scores are told apart by id, so results don't depend on
the order, the sample or the sizes.  Scores are integers; products are summed in double precision
only where all sums are below 2**53.

Items are searched in groups of at most about ``cells`` items times terms, each over the whole index of
its terms, so what is broadcast is bounded whatever the number of items.

Edge cases: a null or empty text has no term and is in no result; an item without terms returns
nothing; each row of the items is an item, repeated ids included; documents with one id stay apart as
rows; a null id comes last among equal scores; empty tables give no rows.  Only the named columns are
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import keep
from cohortlens.llm.decontam import words_of

#: A null id in arrays of ids: it sorts last.
_NO_ID = np.iinfo(np.int64).max


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of the gaps of a term that ``degree`` of ``size`` documents hold."""
    return degree * np.log2(size / (degree + 1.0))


def improve(doc: np.ndarray, term: np.ndarray, seg: np.ndarray, side: np.ndarray, terms: int, rounds: int) -> np.ndarray:
    """Better sides of documents: in every segment, pairs change sides while that makes the gaps of its terms cheaper.

    ``doc`` and ``term`` are the postings; ``seg`` and ``side`` are of documents.
    """
    segs, side = int(seg.max()) + 1, side.copy()
    at, place = np.unique(seg[doc].astype(np.int64) * terms + term, return_inverse=True)
    owner = at // terms
    for _ in range(rounds):
        right = np.bincount(place, side[doc], len(at))
        left = np.bincount(place, minlength=len(at)) - right
        n_right = np.maximum(1, np.bincount(seg, side, segs))[owner]
        n_left = np.maximum(1, np.bincount(seg, 1 - side, segs))[owner]
        now = _cost(left, n_left) + _cost(right, n_right)
        to_right = now - _cost(np.maximum(0, left - 1), n_left) - _cost(right + 1, n_right)
        to_left = now - _cost(left + 1, n_left) - _cost(np.maximum(0, right - 1), n_right)
        gain = np.bincount(doc, np.where(side[doc] == 0, to_right[place], to_left[place]), len(seg))
        # the i-th best of the left changes with the i-th best of the right
        order = np.lexsort((-gain, side, seg))
        group = seg[order] * 2 + side[order]
        first = np.searchsorted(group, np.arange(2 * segs))
        rank = np.arange(len(order)) - first[group]
        width = int(rank.max()) + 1 if len(rank) else 0
        best = np.full((2 * segs, width), -np.inf)
        best[group, rank] = gain[order]
        change = (best[0::2] + best[1::2] > 1e-9).repeat(2, axis=0)
        swapped = order[change[group, rank]]
        if not len(swapped):
            break
        side[swapped] = 1 - side[swapped]
    return side


def bisection(doc: np.ndarray, term: np.ndarray, n: int, leaf: int, rounds: int = 6) -> np.ndarray:
    """The cluster of each of n documents: halves of halves, of at most ``leaf`` documents, in the order of the bisection."""
    seg = np.zeros(n, np.int64)
    local, term = np.unique(term, return_inverse=True)
    while n and np.bincount(seg).max() > leaf:
        order = np.argsort(seg, kind="stable")
        size, first = np.bincount(seg), np.searchsorted(seg[order], np.arange(seg.max() + 1))
        side = np.empty(n, np.int64)
        side[order] = np.arange(n) - first[seg[order]] >= (size[seg[order]] + 1) // 2
        seg = seg * 2 + improve(doc, term, seg, side, max(1, len(local)), rounds)
        seg = np.unique(seg, return_inverse=True)[1]
    return seg


def rules(doc: np.ndarray, term: np.ndarray, n: int, terms: int, levels: int, rounds: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each upper level, the weights (node by term) and thresholds by which a document goes to the left or right."""
    out, seg = [], np.zeros(n, np.int64)
    for level in range(levels):
        nodes = 1 << level
        order = np.argsort(seg, kind="stable")
        size, first = np.bincount(seg, minlength=nodes), np.searchsorted(seg[order], np.arange(nodes))
        side = np.empty(n, np.int64)
        side[order] = np.arange(n) - first[seg[order]] >= (size[seg[order]] + 1) // 2
        side = improve(doc, term, seg, side, terms, rounds)
        held = np.bincount((seg[doc] * 2 + side[doc]) * terms + term, minlength=2 * nodes * terms).reshape(nodes, 2, terms)
        count = np.bincount(seg * 2 + side, minlength=2 * nodes).reshape(nodes, 2)
        share = np.log2((held + 1.0) / (count[:, :, None] + 2.0))
        weights = (share[:, 0] - share[:, 1]).astype(np.float32)
        value = np.bincount(doc, weights[seg[doc], term], n)
        thresholds = np.array([np.median(value[seg == s]) if (seg == s).any() else 0.0 for s in range(nodes)])
        out.append((weights, thresholds))
        seg = seg * 2 + (value < thresholds[seg])
    return out


def route(doc: np.ndarray, term: np.ndarray, n: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each of n documents."""
    seg = np.zeros(n, np.int64)
    for weights, thresholds in levels:
        seg = seg * 2 + (np.bincount(doc, weights[seg[doc], term], n) < thresholds[seg])
    return seg


def _postings(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document places and terms of rows whose terms are int32 bytes."""
    parts = [np.frombuffer(t, np.int32) for t in terms]
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([*parts, np.empty(0, np.int32)]).astype(np.int64)


class Found:
    """The best ``k`` documents of each item so far, as arrays (item, id, score), and the score that each item's k-th has at least."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.rows = np.empty((3, 0), np.int64)

    def add(self, rows: list[np.ndarray]) -> None:
        rows = np.concatenate([self.rows, *rows], axis=1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        last = rank == self.k - 1
        self.floor[rows[0, last]] = np.maximum(self.floor[rows[0, last]], rows[2, last])
        self.rows = rows[:, (rank < self.k) & (rows[2] >= self.floor[rows[0]])]


def visit(part: dict, weights: np.ndarray, found: Found, limit: int | None = None) -> None:
    """Adds a part's documents to ``found``: clusters by descending bound until none can reach an item's floor, or ``limit`` of them."""
    ids, sizes = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["sizes"], np.int64)
    doc, term, impact = (np.frombuffer(part[c], np.int32) for c in ("docs", "terms", "impacts"))
    if not len(term):
        return
    local, term = np.unique(term, return_inverse=True)
    own = weights[:, local].astype(np.float64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.searchsorted(doc, first)  # postings are in the order of documents
    largest = np.zeros((len(sizes), len(local)))
    np.maximum.at(largest, (np.searchsorted(first, doc, "right") - 1, term), impact)
    exact = float((own.sum(1) * largest.max()).max()) < 2**53
    kind = np.float64 if exact else np.int64
    bound = own.astype(kind) @ largest.T.astype(kind)
    order = np.argsort(-bound, axis=1, kind="stable")
    live, at, step = np.arange(len(bound)), 0, 1
    while len(live) and at < (limit or len(sizes)):
        chosen = order[live, at : at + step]
        item, place = np.repeat(live, chosen.shape[1]), chosen.ravel()
        worth = (bound[item, place] >= found.floor[item]) & (bound[item, place] > 0)
        item, place = item[worth], place[worth]
        rows = []
        for c in np.unique(place):
            asked = item[place == c]
            span = slice(cut[c], cut[c + 1])
            here, column = np.unique(term[span], return_inverse=True)
            table = np.zeros((sizes[c], len(here)), kind)
            table[doc[span] - first[c], column] = impact[span]
            score = own[np.ix_(asked, here)].astype(kind) @ table.T
            i, j = np.nonzero((score >= found.floor[asked][:, None]) & (score > 0))
            rows.append(np.stack([asked[i], ids[first[c] + j], score[i, j].astype(np.int64)]))
        if rows:
            found.add(rows)
        at, step = at + step, step * 2
        if at < len(sizes):
            live = live[(bound[live, order[live, at]] >= found.floor[live]) & (bound[live, order[live, at]] > 0)]


def _group(source: DataFrame, asked: list[list[str]], k: int, cluster: int, part: int, sample: int, rules_cells: int) -> DataFrame | None:
    """(``item``, ``id``, ``score``) of the best documents of the items whose terms are given; item is a place in the list."""
    spark = source.sparkSession
    names = sorted({t for terms in asked for t in terms})
    shared = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            sizes, terms, times = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                known = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                held, n = np.unique(known[known >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(held.astype(np.int32).tobytes())
                times.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["id", "n", "terms", "times"])

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            total += np.bincount(_postings(b.column(0).to_pylist())[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    held, _ = keep(source.mapInArrow(count, "id long, n long, terms binary, times binary").where("n > 0"), "terms")
    number, length = held.agg(F.count("*"), F.sum("n")).first()
    if not number:
        return None
    df = np.zeros(len(names), np.int64)
    for r in held.select("terms").mapInArrow(frequency, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    matrix = np.zeros((len(asked), len(names)), np.int64)
    place = {t: i for i, t in enumerate(names)}
    for i, terms in enumerate(asked):
        at = [place[t] for t in terms]
        matrix[i, at] = weight[at]

    # documents with a term; the others score nothing
    useful = held.where(F.octet_length("terms") > 0)
    total = useful.count()
    # a bounded sample; those out of question go before the order, which brings `sample` rows from every task
    some = useful.select("terms", F.pmod(F.xxhash64("id", "terms"), F.lit(max(1, total))).alias("draw")).where(F.col("draw") < 2 * sample)
    drawn = some.orderBy("draw").limit(sample).select("terms").collect()
    levels = min(int(math.log2(max(1, math.ceil(total / part)))) if total > part else 0, int(math.log2(max(1, len(drawn) // cluster))), int(math.log2(max(1, rules_cells // len(names)))))
    doc, term = _postings([bytes(r["terms"]) for r in drawn])
    upper = spark.sparkContext.broadcast(rules(doc, term, len(drawn), len(names), levels))
    tables = spark.sparkContext.broadcast(matrix)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, terms = _postings(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route(docs, terms, b.num_rows, upper.value).astype(np.int32))], names=["id", "n", "terms", "times", "leaf"])

    routed, _ = keep(useful.mapInArrow(leaf, "id long, n long, terms binary, times binary, leaf int"), "routed")
    sizes = routed.groupBy("leaf").agg(F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum(F.octet_length("terms")) / 8_000_000)).cast("int").alias("parts"))
    dealt = routed.join(F.broadcast(sizes), "leaf").withColumn("own", F.pmod(F.xxhash64("id", "n", "terms"), "parts"))  # as many sizes as leaves, at most `sample`

    def index(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("n", "ascending")])
        n = rows.num_rows
        doc, term = _postings(rows.column("terms").to_pylist())
        times = _postings(rows.column("times").to_pylist())[1]
        seg = bisection(doc, term, n, cluster)
        order = np.argsort(seg, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.arange(n)
        size = rows.column("n").to_numpy()
        m = np.array([50 + 50 * int(x) * number // length for x in size], np.int64)
        impact = 1_000_000_000 * times // (1000 * times + 20 * m[doc])
        by = np.lexsort((term, new[doc]))
        ids = rows.column("id").fill_null(_NO_ID).to_numpy()[order]
        out = {"ids": ids, "sizes": np.bincount(seg), "docs": new[doc][by].astype(np.int32), "terms": term[by].astype(np.int32), "impacts": impact[by].astype(np.int32)}
        return pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in out.items()})

    indexed, _ = keep(dealt.select("leaf", "own", "id", "n", "terms", "times").groupBy("leaf", "own").applyInArrow(index, "ids binary, sizes binary, docs binary, terms binary, impacts binary"), "index")

    def searched(floor: np.ndarray, limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Found(floor, k)
            for b in batches:
                for row in b.to_pylist():
                    visit(row, tables.value, found, limit)
            if limit:
                some = np.flatnonzero(found.floor)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found.floor[some])], names=["item", "score"])
            else:
                ids = pa.array(found.rows[1], mask=found.rows[1] == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(found.rows[0]), ids, pa.array(found.rows[2])], names=["item", "id", "score"])

        return run

    floor = np.zeros(len(asked), np.int64)
    first = indexed.mapInArrow(searched(floor, 3), "item long, score long").groupBy("item").agg(F.max("score").alias("score"))
    for r in first.collect():  # one row an item
        floor[r["item"]] = r["score"]
    return indexed.mapInArrow(searched(floor, None), "item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           cluster: int = 64, part: int = 4096, sample: int = 4096, cells: int = 8_000_000, rules_cells: int = 16_000_000) -> DataFrame:
    """(``item_col``, ``rank``, ``id_col``, ``score``) of the ``k`` best documents of each item with a score above 0.

    ``id_col`` has to be a whole number.  ``rules_cells`` bounds the broadcast weights of the upper
    levels (nodes times terms).
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted({w.decode("utf-8", "surrogatepass") for w in words_of(t.as_py())}) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.string()))], names=["item", "name", "terms"])

    kind = items.schema[item_col].dataType
    named = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), F.col(item_text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("name", kind), T.StructField("terms", T.ArrayType(T.StringType()))])
    asked, _ = keep(named.mapInArrow(distinct, schema).where(F.size("terms") > 0), "asked")
    number, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
    groups = max(1, math.ceil(math.sqrt(number * terms / cells)), math.ceil(terms / 1_000_000))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = []
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).select("item", "terms").collect()  # about `cells` items times terms
        found = _group(source, [r["terms"] for r in rows], k, cluster, part, sample, rules_cells) if rows else None
        if found is not None:
            places = docs.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "place long, item long")
            out.append(_best(found, k).withColumnRenamed("item", "place").join(F.broadcast(places), "place").drop("place"))
    if not out:
        empty = T.StructType([T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], empty)
    found = reduce(DataFrame.unionByName, out)
    return found.join(asked.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)

