"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within the radius
differ by at most one bit in one of them at least (``segments = radius // 2 + 1``).  Each
segment is indexed once per bit with that bit taken out (a one-wildcard variant): two
segments differ by at most one bit exactly if they share a variant.  Equal fingerprints are
one class beforehand, so copies cost nothing.  Fingerprints that meet in a variant are
verified, and a variant's members give a spanning forest, never all pairs.

A variant with more than ``bucket_limit`` fingerprints is cut into blocks, and pairs of
blocks are compared in tasks of bounded size: exact as well, and no member is dropped.

Edge cases: a text without words (or null) has fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle; texts of any length are read
whole; rows with a null id keep their class but don't give it its id; repeated rows stay;
an empty table gives no rows.  Columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import keep, scratch, shuffle_partitions, with_id
from cohortlens.llm.components import connected_components
from cohortlens.llm.shingles import class_of, histogram, may_reach, mix, sets_of, shingle_set, similar

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, piece: int = 200_000) -> bytes:
    """The big-endian bytes of the SimHash: a bit is set if over half of the shingles' XXH64 have it set."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return bytes(8)
    counts, total = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for first in range(0, total, piece):  # bounded memory for very long texts
        part = words[first : first + piece + shingle - 1]
        joined, at, starts, ends = b" ".join(part), 0, [], []
        for w in part:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        n = min(piece, total - first)
        last = ends[shingle - 1 :] or [at - 1]
        hashes = b"".join([xxh64_digest(joined[s:e], seed) for s, e in zip(starts[:n], last[:n], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(``id``, ``fp`` as a signed long) of each row; no shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b"".join(fingerprint(t.as_py(), shingle, seed) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["id", "fp"])

    return source.mapInArrow(run, with_id(source, "fp long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(radius: int) -> list[tuple[int, int]]:
    n = radius // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def variant_masks(radius: int) -> list[tuple[int, int]]:
    """(bit taken out, mask of what is left of its segment) of each variant, as signed longs."""
    return [(bit, _signed(((1 << hi) - (1 << lo)) & ~(1 << bit))) for lo, hi in _segments(radius) for bit in range(lo, hi)]


def halves(radius: int) -> list[tuple[int, int, list[int]]]:
    """(mask of a half of a segment, mask of the segment, bits of its other half) of each half, masks as signed longs.

    All variants without a bit of one half have the other half whole, so they can be dealt
    out by that half in one row and be spread out where they arrive.
    """
    out = []
    for lo, hi in _segments(radius):
        mid, bits = (lo + hi) // 2, lambda a, b: (1 << b) - (1 << a)
        out += [(_signed(bits(mid, hi)), _signed(bits(lo, hi)), list(range(lo, mid))), (_signed(bits(lo, mid)), _signed(bits(lo, hi)), list(range(mid, hi)))]
    return out


def _of(values: list, kind: str, at) -> Column:
    """The value at a place of a fixed list."""
    return F.element_at(F.lit(values).cast(kind), at + 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers NumPy counts the bits of the absolute value


def _forest(fps: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components among ``fps`` (and ``other``) under links within the radius.

    With ``other``, only links between the two sides count.
    """
    a = np.unique(fps)
    if other is not None:
        a = np.concatenate([a, np.unique(other)])
    side = None if other is None else np.arange(len(a)) >= len(np.unique(fps))
    left, us, vs = np.ones(len(a), bool), [], []
    for seed in range(len(a)):
        if not left[seed]:
            continue
        left[seed] = False
        front = np.array([seed])
        while len(front):
            reached = np.zeros(len(a), bool)
            for x in front:
                hit = left & (_distance(a, a[x]) <= radius)
                if side is not None:
                    hit &= side != side[x]
                reached |= hit
                left &= ~hit
            front = np.flatnonzero(reached)
            us.append(a[front])
            vs.append(np.full(len(front), a[seed]))
    return (np.concatenate(us), np.concatenate(vs)) if us else (a[:0], a[:0])


def _variant_edges(masks: list[tuple[int, int]], radius: int, limit: int):
    """Reads (bit, fp) sorted by variant; yields edges (u, v, null) and, of variants over the limit, their entries (fp, null, bit)."""
    mask_of = np.zeros(BITS, np.int64)
    for bit, mask in masks:
        mask_of[bit] = mask

    def rows(u, v=None, bit=None) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()) if v is not None else pa.nulls(n, pa.int64()), pa.array(bit, pa.int64()) if bit is not None else pa.nulls(n, pa.int64())], names=["u", "v", "bit"]
        )

    def solve(bit: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = fp & mask_of[bit]
        first = np.flatnonzero(np.concatenate([[True], (bit[1:] != bit[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(first, append=len(fp))
        us, vs = [], []
        small = np.repeat(np.where(size <= 16, size, 0), size)
        run = np.repeat(np.arange(len(first)), size)
        for d in range(1, 16):
            i = np.flatnonzero((run[d:] == run[:-d]) & (small[d:] > 0)) if len(run) > d else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[_distance(fp[i], fp[i + d]) <= radius]
            us.append(fp[i])
            vs.append(fp[i + d])
        for s, n in zip(first[size > 16], size[size > 16], strict=True):
            u, v = _forest(fp[s : s + n], radius)
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        yield rows(u[u != v], v[u != v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, fp, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            bit = np.concatenate([bit, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False)])
            key = fp & mask_of[bit]
            if hot is not None:  # the variant is over the limit: pass its entries on as they come
                n = int(np.argmin(np.append((bit == hot[0]) & (key == hot[1]), False)))
                yield rows(fp[:n], bit=bit[:n])
                bit, fp, key = bit[n:], fp[n:], key[n:]
                if not len(fp):
                    continue
                hot = None
            same = (bit == bit[-1]) & (key == key[-1]) if len(fp) else np.empty(0, bool)
            last = len(fp) - int(np.argmin(np.append(same[::-1], False)))  # the last run may go on
            if last:
                yield from split(bit[:last], fp[:last])
            bit, fp, key = bit[last:], fp[last:], key[last:]
            if len(fp) > limit:
                hot = (bit[0], key[0])
                yield rows(fp, bit=bit)
                bit, fp = bit[:0], fp[:0]
        if len(fp):
            yield from split(bit, fp)

    def split(bit: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = fp & mask_of[bit]
        first = np.flatnonzero(np.concatenate([[True], (bit[1:] != bit[:-1]) | (key[1:] != key[:-1])]))
        over = np.repeat(np.diff(first, append=len(fp)) > limit, np.diff(first, append=len(fp)))
        if over.any():
            yield rows(fp[over], bit=bit[over])
            bit, fp = bit[~over], fp[~over]
        if len(fp):
            yield from solve(bit, fp)

    return run


def _block_edges(entries: DataFrame, masks: list[tuple[int, int]], radius: int, limit: int) -> DataFrame:
    """Edges of the variants over the limit, from entries (fp, bit): blocks of a variant meet in pairs."""
    literal = F.create_map(*[F.lit(x).cast("long") for bit_mask in masks for x in bit_mask])
    entries = entries.withColumn("key", F.col("fp").bitwiseAND(literal[F.col("bit")]))
    sizes = entries.groupBy("bit", "key").agg(F.ceil(F.count("*") / (limit / 2)).cast("int").alias("n"))
    placed = entries.join(sizes, ["bit", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("fp", "own", "bit", "key", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy(), pdf["own"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        u, v = _forest(fp, radius) if i == j else _forest(fp[own == i], radius, fp[own == j])
        return pd.DataFrame({"u": u, "v": v})

    return pairs.groupBy("bit", "key", "i", "j").applyInPandas(meet, "u long, v long")


def similar_pairs(fps: DataFrame, radius: int, bucket_limit: int = 8192) -> DataFrame:
    """Edges (``u``, ``v``) whose components are those of all links within the radius, from distinct ``fp``."""
    masks, parts = variant_masks(radius), halves(radius)
    half = F.explode(F.lit(list(range(len(parts)))).cast("array<byte>")).alias("half")
    whole = F.col("fp").bitwiseAND(_of([p[0] for p in parts], "array<long>", F.col("half")))
    dealt = fps.select(half, "fp").repartition(shuffle_partitions(fps.sparkSession), "half", whole)
    key = F.col("fp").bitwiseAND(_of([m for _, m in sorted(masks)], "array<long>", F.col("bit")))
    spread = dealt.select(F.explode(_of([p[2] for p in parts], "array<array<byte>>", F.col("half"))).alias("bit"), "fp").sortWithinPartitions("bit", key)
    found, _ = keep(spread.mapInArrow(_variant_edges(masks, radius, bucket_limit), "u long, v long, bit long"), "variants")
    edges = found.where("v is not null").select("u", "v")
    entries = found.where("v is null").select(F.col("u").alias("fp"), "bit")
    if entries.isEmpty():
        return edges
    return edges.union(_block_edges(entries, masks, radius, bucket_limit))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, bucket_limit: int = 8192) -> DataFrame:
    """(``id_col``, ``fingerprint`` in hex, ``component_id``) of each row; the component's id is the smallest id reachable by links."""
    prints, _ = keep(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(similar_pairs(classes.select("fp"), radius, bucket_limit))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed, _ = keep(placed, "classes")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # only classes that links have joined need the second look-up
    classes = placed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_prints(found: np.ndarray, prints: int, piece: int = 60_000) -> np.ndarray:
    """So many independent SimHashes of a set of 64-bit hashes; zeros of an empty one."""
    counts = np.zeros(prints * BITS, np.int64)
    for s in range(0, len(found), piece):
        part = found[s : s + piece]
        hashes = np.stack([mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(prints)], 1)
        counts += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(len(part), -1), axis=1), axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(found)).view(np.int64)


#: Members of a key that are compared with each other at once.
_KEY = 4096


def _met(small: int, bits: int):
    """Reads (key, cls, look, part) sorted by key and class; yields pairs (u, v, null) with looks within so many bits.

    Where a key has more such pairs than classes, one of its classes is tried against the others;
    those that are in further pairs are yielded as (cls, null, part) for a second look.
    """

    def rows(u, v=None, part=None) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()), pa.nulls(n, pa.int32()) if part is None else pa.array(part, pa.int32())], names=["u", "v", "part"])

    def hub_of(x) -> tuple[np.int64, np.int64, np.int64]:
        """The key, and its class that is nearest to what most of them have: copies of one text are nearer to it than to each other."""
        key, cls, look, _ = x
        center = np.packbits(np.unpackbits(look.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) * 2 > len(look)).view(np.int64)[0]
        near = int(_distance(look, center).argmin())
        return key[0], cls[near], look[near]

    def star(hub, x, whole: bool = False) -> Iterator[pa.RecordBatch]:
        _, cls, look, part = x
        hit = (_distance(look, hub[2]) <= bits) & (cls != hub[1])
        yield rows(np.full(int(hit.sum()), hub[1]), cls[hit])
        other = cls != hub[1]
        if whole and len(cls) <= _KEY:  # those without a near class besides the hub are done
            for s in range(0, len(cls), 256):
                near = _distance(look[s : s + 256, None], look[None, :]) <= bits
                near[np.arange(len(near)), np.arange(s, s + len(near))] = False
                near[:, cls == hub[1]] = False
                other[s : s + 256] &= near.any(1)
        again.append((cls[other], part[other]))

    def members() -> Iterator[pa.RecordBatch]:
        if again:
            some = np.unique(np.stack([np.concatenate([a[0] for a in again]), np.concatenate([a[1] for a in again]).astype(np.int64)], 1), axis=0)
            again.clear()
            yield rows(some[:, 0], part=some[:, 1])

    def solve(x) -> Iterator[pa.RecordBatch]:
        key, cls, look, part = x
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(first, append=len(key))
        run, few = np.repeat(np.arange(len(first)), length), np.repeat(length <= small, length)
        at, to = [first[:0]], [first[:0]]
        for d in range(1, small):
            i = np.flatnonzero((run[d:] == run[:-d]) & few[d:]) if len(run) > d else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[_distance(look[i], look[i + d]) <= bits]
            at.append(i)
            to.append(i + d)
        i, j = np.concatenate(at), np.concatenate(to)
        degree = np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
        dense = (np.bincount(run[i], minlength=len(first)) > length)[run[i]]
        best = np.lexsort((np.arange(len(key)), -degree, run))[first]  # of each key the class with most pairs
        hub = best[run[i]]
        done = ~dense | (i == hub) | (j == hub)
        more = np.concatenate([i[~done], j[~done]])
        if len(more):
            again.append((cls[more], part[more]))
        u, v = cls[i[done]], cls[j[done]]
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0) if len(u) else np.empty((0, 2), np.int64)
        yield rows(both[:, 0], both[:, 1])
        for s, n in zip(first[length > small], length[length > small], strict=True):
            own = [c[s : s + n] for c in x]
            yield from star(hub_of(own), own, whole=True)

    again: list[tuple[np.ndarray, np.ndarray]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = None, None
        again.clear()
        for b in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                x = [np.concatenate([h, c]) for h, c in zip(held, x, strict=True)]
                held = None
            if hub is not None:  # the key goes on: pass its entries on as they come
                n = int(np.argmin(np.append(x[0] == hub[0], False)))
                if n:
                    yield from star(hub, [c[:n] for c in x])
                x = [c[n:] for c in x]
            if not len(x[0]):
                continue
            hub, start = None, int(np.argmax(x[0] == x[0][-1]))  # the last key may go on
            if start:
                yield from solve([c[:start] for c in x])
            held = [c[start:] for c in x]
            if len(held[0]) > 50_000:
                hub = hub_of(held)
                yield from star(hub, held)
                held = None
            if sum(len(a[0]) for a in again) > 500_000:
                yield from members()
        if held is not None:
            yield from solve(held)
        yield from members()

    return run


def _unconnected(entries: DataFrame, bits: int, block: int = 2048) -> DataFrame:
    """Pairs of classes that share a variant, within so many bits, which no link connects yet: blocks of a key meet in pairs.

    Entries are (key, cls, root, look, segment, bins): all variants of a half of a segment are
    one key, and segments that differ by at most one bit share one of them.  Histograms
    (``bins``) rule out most pairs that are less similar, so a task returns little more than links.
    """
    sizes = entries.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key", "n")
    dealt = entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cls"), "n").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", "cls", "look", "root", "segment", "bins", "own", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own, i, j = pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        cls, root, look, segment = (pdf[c].to_numpy(np.int64) for c in ("cls", "root", "look", "segment"))
        counts = np.frombuffer(b"".join(pdf["bins"]), "<u4").reshape(len(pdf), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        us, vs = [cls[:0]], [cls[:0]]
        for x in left:
            hit = right[(_distance(segment[right], segment[x]) <= 1) & (root[right] != root[x])]
            hit = hit[_distance(look[hit], look[x]) <= bits]
            hit = hit[cls[hit] > cls[x]] if i == j else hit
            hit = hit[may_reach(counts[x], counts[hit])]
            us.append(np.full(len(hit), cls[x]))
            vs.append(cls[hit])
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return dealt.groupBy("key", "i", "j").applyInPandas(meet, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, prints: int = 5, radius: int = 4, look_bits: int = 20, sketch_bits: int = 80, small: int = 16) -> DataFrame:
    """(``id_col``, ``cls``, ``component_id``) of each row: groups of texts whose shingle sets have a Jaccard similarity of 4/5 or more.

    Candidates share a deletion variant of one of several independent 64-bit SimHashes of
    their sets, the first of these differs by at most ``look_bits`` bits, all of them together by
    at most ``sketch_bits``, and neither set is smaller than 4/5 of the other.  Each of them
    is checked on the whole sets, so nothing below 4/5 is linked.  A pair at a similarity of
    just 4/5 differs in 15 % of the bits (in 10 of 64, and 48 of 320 with a deviation of 6) and is found
    with a probability of 0.90 with five prints in segments of 21 bits, one at 0.85 with 0.97, one at 0.9 with 0.997 (a group's members are found
    through any of the others).  Equal sets are one class (``cls``) beforehand.  Keys with more
    such pairs than classes first try them against one class, the nearest to what most have; only
    classes in further pairs that are not connected by that meet in blocks, all of them.

    Texts without words are one class and link with nothing else; rows with a null id keep their
    group but don't give it its id; repeated rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    names = [f"p{k}" for k in range(prints)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(s, 1000) for x in batches for s in range(0, x.num_rows, 1000)):  # a thousand sets at a time
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            found = np.stack([set_prints(x, prints) for x in sets]) if sets else np.empty((0, prints), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([class_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()),
                                              pa.array([histogram(x) for x in sets], pa.binary()), *[pa.array(found[:, k]) for k in range(prints)]], names=["id", "key", "cls", "size", "bins", *names])

    rows, _ = keep(source.mapInArrow(describe, with_id(source, "key long, cls long, size int, bins binary, " + ", ".join(f"{n} long" for n in names))), "prints")
    with scratch(spark) as stay:
        links = _near_links(rows, source, names, shingle, radius, look_bits, sketch_bits, small)
        roots = connected_components(links)
        ids = rows.groupBy("cls").agg(F.min("id").alias("least"))
        placed, path = keep(ids.join(roots, ids["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root")), "classes")
        stay.append(path)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "cls").join(placed.join(named, "root").select("cls", "component_id"), "cls").select(F.col("id").alias(id_col), "cls", "component_id")


def _near_links(rows: DataFrame, source: DataFrame, names: list[str], shingle: int, radius: int, look_bits: int, sketch_bits: int, small: int) -> DataFrame:
    """Checked links (``u``, ``v``) between classes that share a deletion variant of one of the prints ``names``."""
    spark = rows.sparkSession
    sketches, _ = keep(rows.where("size > 0").groupBy("cls").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("bins").alias("bins"), *[F.first(n).alias(n) for n in names]), "sketches")
    classes = sketches.select("cls", F.posexplode(F.array(*names)).alias("print", "fp"), F.col(names[0]).alias("look"))

    parts = halves(radius)
    half = F.explode(F.lit(list(range(len(parts)))).cast("array<byte>")).alias("half")
    whole = F.col("fp").bitwiseAND(_of([p[0] for p in parts], "array<long>", F.col("half")))
    segment = F.col("fp").bitwiseAND(_of([p[1] for p in parts], "array<long>", F.col("half")))
    placed = lambda d: d.select("*", segment.alias("segment"), whole.alias("whole"))
    dealt = placed(classes.select("print", half, "cls", "look", "fp")).drop("fp")
    dealt = dealt.repartition(shuffle_partitions(spark), "print", "half", "whole")
    variant = F.explode(_of([[_signed(p[1] & ~(1 << b) & (2**64 - 1)) for b in p[2]] for p in parts], "array<array<long>>", F.col("half"))).alias("mask")
    part = (F.col("print") * len(parts) + F.col("half")).cast("int").alias("part")
    spread = dealt.select("print", variant, "cls", "look", "segment", part).select(F.xxhash64("print", "mask", F.col("segment").bitwiseAND(F.col("mask"))).alias("key"), "cls", "look", "part")
    met, _ = keep(spread.sortWithinPartitions("key", "cls").mapInArrow(_met(small, look_bits), "u long, v long, part int"), "met")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        a, b = (sketches.select(F.col("cls").alias(side), F.struct("key", "size", *names).alias(f"{side}_")) for side in ("u", "v"))
        apart = sum((F.bit_count(F.col(f"u_.{n}").bitwiseXOR(F.col(f"v_.{n}"))) for n in names), F.lit(0))
        near = (apart <= sketch_bits) & (5 * F.least("u_.size", "v_.size") >= 4 * F.greatest("u_.size", "v_.size"))
        pairs, _ = keep(pairs.join(a, "u").join(b, "v").where(near).select("u", "v", F.col("u_.key").alias("u_key"), F.col("v_.key").alias("v_key")), "pairs")
        sets, _ = keep(sets_of(source, pairs.select(F.col("u_key").alias("key")).union(pairs.select("v_key")), shingle), "sets")
        return keep(similar(pairs.select("u", "v"), sets), "links")[0]

    links = checked(met.where("v is not null").select("u", "v"))
    rest = met.where("v is null").select(F.col("u").alias("cls"), F.floor(F.col("part") / len(parts)).cast("int").alias("print"), (F.col("part") % len(parts)).cast("byte").alias("half")).distinct()
    if not rest.isEmpty():
        roots = connected_components(links).withColumnRenamed("node", "cls")
        known = sketches.select("cls", "bins", F.col(names[0]).alias("look"), F.array(*names).alias("fps")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        entries = placed(rest.join(known, "cls").withColumn("fp", F.element_at("fps", F.col("print") + 1))).select(F.xxhash64("print", "half", "whole").alias("key"), "cls", "root", "look", "segment", "bins")
        links = links.union(checked(_unconnected(keep(entries, "entries")[0], look_bits)))
    return links
