"""Best-fit packing of tokenised documents by bin completion.

Each text becomes its token ids and a closing id 0.  A document of more than ``capacity`` ids is cut
into pieces of ``capacity``, of which the first may be shorter; shorter ones are one piece.  Pieces of
one length are interchangeable, so what is searched is the table of lengths and their counts: at
most ``capacity`` rows at any size of the corpus, and all that comes to the driver.

The search is a branch and bound.  A node takes the largest length that is left, lists undominated
fillings of the room beside it, least waste first, and uses one as often as the counts allow.  A
branch ends as soon as its waste leaves no way to beat the incumbent, which is the best-fit packing
at first; all ends when the incumbent meets the lower bound.  ``nodes`` bounds the search, never the
rows: any incumbent packs everything.

The chosen fillings go back to the pieces as ranges: the n-th piece of a length falls into one
range, which tells its sequence and its offset.  Pieces are numbered by (length, task) and the
counts of earlier tasks, so no task sees all pieces of a length.

Edge cases: a null or empty text is one piece that holds the closing id alone; repeated rows and
ids are packed apart; a null id stays null; an empty table gives no rows.  A text that holds the
vocabulary's end mark gets its id, as the library does by default.  Only the two named columns are
looked at, so others may have any names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import keep, with_id

#: The end mark of the vocabulary and its id (fixed values).
END_MARK, END_ID = "<|endoftext|>", 50256
#: How a text is cut into words before merging (fixed value of the vocabulary).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks_path: str):
    """The byte-level vocabulary of ``ranks_path``: its ids equal those of the JSON form of the same vocabulary."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={END_MARK: END_ID})


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first have the whole capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, ranks_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``task``, ``nth``); ``nth`` counts a task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = encoder(ranks_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = tokens.encode_to_numpy(text.as_py() or "", allowed_special="all")
                ids = np.append(ids, 0).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    nth.append(seen[n])
                    seen[n] += 1
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, with_id(source, "piece int, start long, length long, ids_crc32 long, task int, nth long"))


Filling = tuple[tuple[int, int], ...]  # (length, how often) of one sequence, largest first


def lower_bound(counts: np.ndarray) -> int:
    """The fewest sequences that any packing can have, by Martello and Toth's second bound; ``counts[n]`` pieces have length n."""
    capacity = len(counts) - 1
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(half + 1)
    # longer than capacity - k: alone; above the half: one each; from k to the half: fill up what those leave
    large = number[capacity - k + 1] - number[half + 1]
    left = large * capacity - (total[capacity - k + 1] - total[half + 1])
    more = -((left - (total[half + 1] - total[k])) // capacity)
    return int((number[-1] - number[capacity - k + 1] + large + np.maximum(0, more)).max())


def best_fit(counts: np.ndarray) -> dict[Filling, int]:
    """Largest pieces first, each into the fullest sequence that has room; sequences that look alike are kept as one entry."""
    capacity = len(counts) - 1
    by_room: dict[int, dict[Filling, int]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(filling: Filling, room: int, n: int) -> None:
        held = by_room.setdefault(room, {})
        held[filling] = held.get(filling, 0) + n
        rooms[room] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fit = length + int(np.argmax(rooms[length:])) if rooms[length:].any() else 0
            if not fit:
                each = min(left, capacity // length)  # a new sequence, filled with the same length as far as it goes
                n = left // each
                put(((length, each),), capacity - each * length, n)
                left -= each * n
                continue
            filling, n = by_room[fit].popitem()
            each = min(fit // length, left)
            use = min(n, left // each)
            if use < n:
                by_room[fit][filling] = n - use
            if not by_room[fit]:
                rooms[fit] = False
            put((*filling, (length, each)), fit - each * length, use)
            left -= each * use
    out: dict[Filling, int] = {}
    for held in by_room.values():
        for filling, n in held.items():
            out[filling] = out.get(filling, 0) + n
    return out


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be put into places of the sizes of ``a``: then ``a`` is never the worse filling."""
    if not b:
        return True
    tried = set()
    for i, room in enumerate(a):
        if room >= b[0] and room not in tried:
            tried.add(room)
            if _dominates(tuple(sorted((*a[:i], *a[i + 1 :], room - b[0]), reverse=True)), b[1:]):
                return True
    return False


def fillings(counts: np.ndarray, room: int, allowed: int, width: int, steps: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of at most ``width`` undominated fillings of ``room``, least waste first, none above ``allowed`` waste.

    One, two and three pieces are looked up by their sum; where those leave waste, a walk of at
    most ``steps`` steps in descending order finds larger sets.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [(room, ())] if room <= allowed else []
    out: list[tuple[int, tuple[int, ...]]] = []

    def add(waste: int, chosen: tuple[int, ...]) -> None:
        if not any(_dominates(other, chosen) for _, other in out):
            out.append((waste, chosen))

    def pairs(target: int, most: int, spare: int = 0) -> list[tuple[int, int]]:
        """Two lengths of a sum, the first at most ``most``; ``spare`` is one that is already used once."""
        first = have[(have <= min(most, target - 1)) & (2 * have >= target)][::-1]
        second = target - first
        same = second == first
        ok = (counts[second] >= 1 + (second == spare) + same) & (counts[first] >= 1 + (first == spare) + same)
        return [(int(x), int(target - x)) for x in first[ok][:width]]

    # sums of one, two and three lengths as bits, whatever the counts: where to look
    lengths, mask = have.tolist(), (1 << (room + 1)) - 1
    one = sum(1 << x for x in lengths)
    two = three = 0
    for x in lengths:
        two |= one << x
    two &= mask
    for x in lengths:
        three |= two << x
    sums = (one | two | three) & mask & ~((1 << max(0, room - allowed)) - 1)
    looked = 0
    while sums and looked < 4 * width and len(out) < width and not (out and out[0][0] == 0):
        target = sums.bit_length() - 1
        sums ^= 1 << target
        waste = room - target
        looked += bool(out)
        if counts[target]:
            add(waste, (target,))
        if two >> target & 1:
            for x in pairs(target, target):
                add(waste, x)
        if three >> target & 1 and len(out) < width:
            for x in have[(have < target) & (3 * have >= target) & np.array([two >> (target - y) & 1 if y < target else 0 for y in lengths], bool)][::-1][:16].tolist():
                for rest in pairs(target - x, x, x):
                    if counts[x] >= 1 + rest.count(x):
                        add(waste, (x, *rest))
    least, used, took = (out[0][0] if out else allowed + 1), 0, []

    def walk(at: int, left: int, chosen: tuple[tuple[int, int], ...]) -> None:
        nonlocal least, used
        used += 1
        if left < least:
            least = left
            took.append((left, tuple(x for x, n in chosen for _ in range(n))))
        for i in range(min(at, int(np.searchsorted(have, left, "right")) - 1), -1, -1):
            x = int(have[i])
            for n in range(min(left // x, int(counts[x])), 0, -1):
                if used > steps or not least:
                    return
                walk(i - 1, left - n * x, (*chosen, (x, n)))

    walk(len(have) - 1, room, ())
    for waste, chosen in sorted(took)[:width]:
        if chosen:
            add(waste, chosen)
    return sorted(out, key=lambda x: (x[0], tuple(-y for y in x[1])))[:width]


def complete(counts: np.ndarray, nodes: int = 5_000, width: int = 3) -> tuple[dict[Filling, int], int]:
    """The fillings of the best packing found, with how often each is used, and the lower bound."""
    capacity, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    least = lower_bound(counts)
    best, fewest = best_fit(counts), 0
    fewest = sum(best.values())
    # a branch: counts that are left, waste and sequences so far, and the way to it as a linked list
    stack: list[tuple[np.ndarray, int, int, tuple | None]] = [(counts.astype(np.int64), 0, 0, None)]
    while stack and fewest > least and nodes > 0:
        left, waste, made, way = stack.pop()
        allowed = (fewest - 1) * capacity - total - waste
        if allowed < 0:
            continue
        lengths = np.flatnonzero(left)
        if not len(lengths):
            if made < fewest:
                best, fewest = {}, made
                while way:
                    best[way[0]] = best.get(way[0], 0) + way[1]
                    way = way[2]
            continue
        if made + lower_bound(left) >= fewest:
            continue
        nodes -= 1
        largest = int(lengths[-1])
        left[largest] -= 1
        found = fillings(left, capacity - largest, allowed, width)
        left[largest] += 1
        for lost, others in reversed(found):  # the least waste is looked into first
            kinds = {x: (largest, *others).count(x) for x in (largest, *others)}
            times = min(int(left[x]) // n for x, n in kinds.items())
            if lost:
                times = min(times, allowed // lost)
            if times:
                rest = left.copy()
                for x, n in kinds.items():
                    rest[x] -= n * times
                stack.append((rest, waste + lost * times, made + times, (tuple(sorted(kinds.items(), reverse=True)), times, way)))
    return best, least


def ranges(packed: dict[Filling, int]) -> np.ndarray:
    """Rows (length, first number, how often in a sequence, first sequence, offset), sorted: which pieces of a length go where."""
    rows, used, sequence = [], {}, 0
    for filling, times in sorted(packed.items(), reverse=True):
        offset = 0
        for length, each in filling:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * times
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, ranks_path: str, capacity: int = 2048, nodes: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``) of every piece."""
    spark = docs.sparkSession
    held, _ = keep(pieces(docs, ranks_path, capacity, id_col, text_col), "pieces")
    by_task, _ = keep(held.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(ranges(complete(counts, nodes)[0]))  # of the lengths and fillings alone, whatever the rows

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = held.join(before, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        starts = {int(x): (table[a:b, 1], a) for x, a, b in zip(*_runs(table[:, 0]), strict=True)}
        for b in batches:
            length, number = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            row = np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                first, at = starts[x]
                row[own] = at + np.searchsorted(first, number[own], "right") - 1
            _, first, each, sequence, offset = table[row].T if len(row) else np.empty((5, 0), np.int64)
            nth = number - first
            columns = [*b.columns[:5], pa.array(sequence + nth // each, pa.int64()), pa.array(offset + length * (nth % each), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = numbered.mapInArrow(place, with_id(numbered, "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    return placed.withColumnRenamed("id", id_col)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, first and last + 1 place of each run of equal values."""
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)) if len(values) else np.empty(0, np.int64)
    return values[first], first, np.append(first[1:], len(values))
