"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of one label are one class beforehand.  The classes of a label are dealt into
tiles, and each pair of tiles of a label is compared once: groups of tiles of at most about
``group_bytes`` are broadcast, one after the other, and every tile meets those of the group that come
at or after it.  So vectors are moved once for each group, not once for each tile.  A pair of
tiles whose centres are too far apart for their radii is left out whole.

A unit vector ``u`` is coded as ``s * q`` with int8 ``q``; its error ``|u - s q|`` is kept, and
``u . v`` differs from ``s t (q . r)`` by at most ``e_u (1 + e_v) + e_v``.  Only pairs that can reach
the threshold under that bound are computed in double precision, so nothing is missed and nothing
below it is linked.  A pair of tiles gives link counts and a spanning forest of its links, never
the pairs.

Comparisons are within a label and a length of vectors.  Vectors that are null, empty, zero
or hold null or non-finite components, and vectors without a label, link with nothing.
Rows with a null id have no component but count as links of others.  Repeated ids stay
apart as rows.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import keep, new_path, shuffle_partitions
from cohortlens.llm.components import connected_components


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exact, with the largest component from 0.5 to 1: squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error bounds of the rows of ``x`` brought to unit length."""
    x = _scaled(x)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - scale[:, None] * code
    return code, scale, np.sqrt((rest * rest).sum(1)) + 1e-12


def possible_pairs(a, b, threshold: float) -> np.ndarray:
    """Places (i, j) where the cosine can reach the threshold, from two results of :func:`quantise`."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    # sums of products of up to 1,000 int8 pairs are exact in single precision
    kind = np.float32 if qa.shape[1] <= 1000 else np.float64
    dots = qa.astype(kind) @ qb.astype(kind).T
    near = dots * (sa[:, None] * sb[None, :]) + (ea[:, None] * (1 + eb[None, :]) + eb[None, :])
    return np.argwhere(near >= threshold - 1e-9)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of n places by links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(a: dict, b: dict | None, threshold: float, strip: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links) sums and forest edges as (kind, u, v) columns; kind 0: u has v links, kind 1: u and v are connected."""
    load = lambda t: (np.frombuffer(t["ids"], np.int64), np.frombuffer(t["counts"], np.int64), np.frombuffer(t["vectors"], t["kind"]).reshape(-1, t["dim"]).astype(np.float64))
    ia, ca, va = load(a)
    ib, cb, vb = (ia, ca, va) if b is None else load(b)
    qa, qb = quantise(va), quantise(vb)
    at, to = [], []
    for s in range(0, len(ia), strip):
        pairs = possible_pairs(tuple(x[s : s + strip] for x in qa), qb, threshold)
        i, j = pairs[:, 0] + s, pairs[:, 1]
        if b is None:
            i, j = i[i < j], j[i < j]
        hit = np.concatenate([cosines(va[i[k : k + 65536]], vb[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        at.append(i[hit])
        to.append(j[hit])
    i, j = np.concatenate(at), np.concatenate(to)
    shift = 0 if b is None else len(ia)
    ids, counts = (ia, ca) if b is None else (np.concatenate([ia, ib]), np.concatenate([ca, cb]))
    j = j + shift
    links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
    root = _stars(len(ids), i, j)
    some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    return (np.repeat([0, 1], [len(some), len(moved)]), np.concatenate([ids[some], ids[moved]]), np.concatenate([links[some].astype(np.int64), ids[root[moved]]]))


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of the rows' directions and their largest distance from it."""
    x = _scaled(x)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    centre = unit.mean(0)
    return centre, float(np.sqrt(((unit - centre) ** 2).sum(1).max()))


def can_meet(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float], threshold: float) -> bool:
    """Whether rows of two balls can have a cosine of the threshold."""
    reach = a[1] * np.sqrt((b[0] ** 2).sum()) + b[1] * np.sqrt((a[0] ** 2).sum()) + a[1] * b[1]
    return float(a[0] @ b[0]) + reach >= threshold - 1e-6


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = 2048, group_bytes: int = 32_000_000) -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``) of each row."""
    spark = vectors.sparkSession
    # single precision stays so until it is computed with; all other numbers are doubles
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    good = F.size(vector) > 0
    good &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(F.coalesce(good, F.lit(False)) & F.col(label_col).isNotNull(), vector).alias("vector"))
    # equal vectors of one label are told apart from others by 128 bits, so that rows are joined without their vectors
    rows = rows.select("id", "label", "vector", F.xxhash64(F.lit(1), "label", "vector").alias("a"), F.xxhash64(F.lit(2), "vector", "label").alias("b"))
    classes = rows.where("vector is not null").groupBy("a", "b").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("n"))
    # written, so that the numbers stay the same however often a part is read again
    classes, _ = keep(classes.select(F.monotonically_increasing_id().alias("class"), "a", "b", "label", "vector", "least", "n"), "vectors")

    sizes = classes.groupBy("label", F.size("vector").alias("dim")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.drop("a", "b", "least").withColumn("dim", F.size("vector")).join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("class"), "tiles").cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[[0]][["label", "dim", "own"]].copy()
        head["ids"], head["counts"] = [pdf["class"].to_numpy(np.int64).tobytes()], [pdf["n"].to_numpy(np.int64).tobytes()]
        head["kind"] = "<f4" if single else "<f8"
        held = np.stack(pdf["vector"].to_numpy()).astype(head["kind"].iloc[0])
        centre, head["radius"] = ball(held.astype(np.float64))
        head["vectors"], head["centre"] = [held.tobytes()], [centre.tobytes()]
        return head

    kind = classes.schema["label"].dataType.simpleString()
    fields = "ids binary, counts binary, kind string, radius double, vectors binary, centre binary"
    packed = dealt.groupBy("label", "dim", "own").applyInPandas(pack, f"label {kind}, dim int, own int, {fields}")
    # tiles are told apart by a hash of their label, length and number, and those of one label and length by another
    packed = packed.withColumn("of", F.xxhash64("label", "dim")).drop("label").withColumn("key", F.xxhash64("of", "own"))
    packed, _ = keep(packed, "tiles")
    size, tiles = packed.agg(F.coalesce(F.sum(F.octet_length("vectors").cast("long")), F.lit(0)), F.count("*")).first()
    groups = max(1, min(tiles, math.ceil(size / group_bytes)))
    tasks = shuffle_partitions(spark)
    out = new_path(spark, "links")
    for g in range(groups):
        group = packed.where(F.pmod("key", F.lit(groups)) == g).toArrow().to_pylist()  # about `group_bytes`
        shared = spark.sparkContext.broadcast(group)

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    one = b.slice(i, 1).to_pylist()[0]
                    own = np.frombuffer(one["centre"]), one["radius"]
                    for other in shared.value:
                        if one["of"] == other["of"] and one["dim"] == other["dim"] and one["own"] <= other["own"]:
                            same = one["own"] == other["own"]
                            if same or can_meet(own, (np.frombuffer(other["centre"]), other["radius"]), threshold):
                                found = tile_links(one, None if same else other, threshold)
                                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(found, (np.int32, np.int64, np.int64), strict=True)], names=["kind", "u", "v"])

        labels = packed.where(F.col("of").isin(sorted({t["of"] for t in group}))) if groups > 1 else packed
        labels.repartition(tasks, "key").mapInArrow(meet, "kind int, u long, v long").write.mode("append").parquet(out)
        shared.unpersist()
    found = spark.read.schema("kind int, u long, v long").parquet(out)
    links = found.where("kind = 0").groupBy(F.col("u").alias("class")).agg(F.sum("v").alias("links"))
    roots = connected_components(found.where("kind = 1").select("u", "v")).withColumnRenamed("node", "class")
    placed = classes.select("class", "least", "n").join(roots, "class", "left").join(links, "class", "left")
    placed, _ = keep(placed.select("class", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")), "placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    looked_up = classes.select("class", "a", "b").join(placed, "class").join(named, "root").select("a", "b", "n_links", "component_id")
    linked = rows.where("vector is not null").select("id", "a", "b").join(looked_up, ["a", "b"]).select("id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
