"""Distinct sampled segmentations of texts by Gumbel top-k without replacement.

The lattice of a text has an edge for each vocabulary piece that fits, and one of byte
pieces for a character without a piece.  A piece's weight is ``-log(rank + 100)`` in the
vocabulary's own order, times ``alpha``; a segmentation's probability is proportional to the
product of its pieces.  No piece goes on from a letter into a space, so the lattice is a
chain of independent units (spaces and the characters up to the next space), and backward
sums over each distinct unit give all conditional probabilities exactly.

Perturbed A-star: the search tree's nodes are sets of segmentations (a prefix of units held,
the next unit barred from some segmentations), their keys the maxima of their members'
Gumbel-perturbed log probabilities, drawn top-down: a node's best member takes its key, and
each branch off it gets a Gumbel of its own mass, truncated at that key.  Popping the
largest key k times gives k distinct segmentations, exactly as if all had been perturbed.
The next key is the threshold of the inclusion scores ``1 - exp(-exp(log p - threshold))``.
Draws are hashes of the row key, sample, unit and step, so they don't depend on the partitioning.

Edge cases: a null or empty text has one segmentation, the empty one, with probability 1;
a text with fewer segmentations than asked for gives all of them, with inclusion 1; a
character U+2581 of the text itself is written in byte pieces, so decoding is exact; units
of any length are taken whole; a null key counts as the text ``null``; repeated rows give
equal samples; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import with_id

SPACE = "▁"
_LITERAL = "\udfff"  # stands for U+2581 of the text while it is cut; no valid text holds it
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_SHORT = 48  # characters of a unit whose backward sums are products of plain numbers; longer ones go by logarithms
_CHUNK = 1_500_000  # characters of text worked on at once
_SHIFT = 8
U = np.uint64
_BASE, _SPREAD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def load_pieces(model_file: str) -> dict:
    """Pieces of a SentencePiece model as plain lists, small and of fixed size, so they can be broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    normal, byte, text = {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            text.append(b"")
        else:
            normal[piece] = i
            text.append(piece.replace(SPACE, " ").encode())
    return {"normal": normal, "byte": byte, "text": text}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(key: np.ndarray, turn: int, place: np.ndarray | int, step: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the arguments."""
    at = np.asarray(place).astype(U) * U(0xD1342543DE82EF95) + np.asarray(step).astype(U) * U(0xAF251AF3B0F025B5)
    x = _mix(key + U((turn + 1) * 0xDA942042E4DD58B5 % (1 << 64)) + at)
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattice:
    """Edges and conditional probabilities of units."""

    def __init__(self, pieces: dict, alpha: float) -> None:
        self.normal, self.byte = pieces["normal"], pieces["byte"]
        self.longest = max(map(len, self.normal), default=1)
        first = min(self.normal.values(), default=0)
        # rounded so that the weights in tables and their logarithms agree
        rounded = lambda w: math.log(float(np.float32(math.exp(w))))
        self.weight = {i: rounded(-alpha * math.log(i - first + 100)) for i in self.normal.values()}
        self.of_byte = rounded(-alpha * math.log(max(self.normal.values(), default=0) - first + 200))
        self.log_weight = np.full(len(pieces["text"]), self.of_byte)
        for i, w in self.weight.items():
            self.log_weight[i] = w
        # by piece plus _SHIFT, so that minus the number of bytes has an entry as well
        self.logs = np.concatenate([self.of_byte * np.arange(_SHIFT, 0, -1), self.log_weight])
        self.plain = np.exp(self.logs).astype(np.float32)
        self.logs[_SHIFT:] = self.log_weight
        if self.longest > 63:
            raise ValueError("pieces of more than 63 characters")
        # pieces and their proper beginnings by hash; a beginning that is no piece has -2
        self.strings = strings = {p[:k]: -2 for p in self.normal for k in range(1, len(p))} | self.normal
        size = 1 << (len(strings) * 4).bit_length()
        self.keys, self.ids, self.shift, self.rounds = np.zeros(size, U), np.full(size, -1, np.int32), U(65 - size.bit_length()), 1
        for piece, i in strings.items():
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
            at, n = (h * int(_SPREAD) & (2**64 - 1)) >> int(self.shift), 1
            while self.ids[at] != -1:
                at, n = (at + 1) % size, n + 1
            self.keys[at], self.ids[at], self.rounds = h, i, max(self.rounds, n)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Of each hash of a string its piece, -2 for a mere beginning of pieces, or -1."""
        at = ((h * _SPREAD) >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        open_ = np.flatnonzero((out == -1) & (self.ids[at] != -1))
        for n in range(1, self.rounds):
            if not len(open_):
                break
            to = (at[open_] + n) % len(self.ids)
            hit = self.keys[to] == h[open_]
            out[open_[hit]] = self.ids[to[hit]]
            open_ = open_[~hit & (self.ids[to] != -1)]
        return out

    def spelt(self, c: str) -> int:
        """What stands for a character without a piece: its byte piece, or minus the number of its bytes."""
        data = self.bytes_of(c)
        return self.byte[data[0]] if len(data) == 1 else -len(data)

    def log_of(self, piece: int) -> float:
        return float(self.log_weight[piece]) if piece >= 0 else -piece * self.of_byte

    def bytes_of(self, c: str) -> bytes:
        return SPACE.encode() if c == _LITERAL else c.encode("utf-8", "surrogatepass")

    def edges(self, unit: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
        """Of each place of one unit the edges (length, piece or minus its bytes, weight), and the backward log sums."""
        n = len(unit)
        beta, out, strings, weight = [0.0] * (n + 1), [[] for _ in range(n)], self.strings, self.weight
        for i in range(n - 1, -1, -1):
            found = []
            for k in range(1, n - i + 1):
                p = strings.get(unit[i : i + k])
                if p is None:
                    break
                if p >= 0:
                    found.append((k, p, weight[p]))
            if not found or found[0][0] > 1:
                found.insert(0, (1, self.spelt(unit[i]), self.log_of(self.spelt(unit[i]))))
            if len(found) == 1:
                beta[i] = found[0][2] + beta[i + found[0][0]]
            else:
                terms = [w + beta[i + k] for k, _, w in found]
                top = max(terms)
                beta[i] = top + math.log(sum([math.exp(t - top) for t in terms]))
            out[i] = found
        return out, beta

    def draw(self, unit: str, uniforms: Iterator[float], barred: list[tuple[tuple[int, int], ...]]) -> tuple[tuple[tuple[int, int], ...], float, float] | None:
        """A segmentation (lengths and pieces) other than the barred ones, its log probability in the unit's own distribution, and the mass of it and the barred."""
        edges, beta = self.edges(unit)
        chance = []
        for segments in barred:
            at, total = 0, -beta[0]
            for k, p in segments:
                total += next(w for a, b, w in edges[at] if (a, b) == (k, p))
                at += k
            chance.append(math.exp(total))
        at, done, log_p = 0, [], 0.0
        live = list(range(len(barred)))
        while at < len(unit):
            options = []
            for k, p, w in edges[at]:
                left = math.exp(log_p + w + beta[at + k] - beta[at])
                took = [b for b in live if len(barred[b]) > len(done) and barred[b][len(done)] == (k, p)]
                options.append((max(0.0, left - sum(chance[b] for b in took)) if took else left, k, p, w, took))
            total = sum(o[0] for o in options)
            if total <= 1e-15:
                return None
            u = next(uniforms) * total
            for mass, k, p, w, took in options:
                u -= mass
                if u < 0:
                    break
            else:
                mass, k, p, w, took = next(o for o in reversed(options) if o[0] > 0)
            log_p += w + beta[at + k] - beta[at]
            done.append((k, p))
            at += k
            live = took
        return None if tuple(done) in barred else (tuple(done), log_p, sum(chance) + math.exp(log_p))


class Units:
    """Tables over the characters of distinct units: cumulative chances, pieces and lengths of the edges from each.

    A row is found by its distance from the unit's end and the unit's rank (longest first), so
    that all characters at one distance, which the backward sums take at once, lie together.
    """

    def __init__(self, lattice: Lattice, units: list[str]) -> None:
        self.lattice, self.units = lattice, units
        self.length = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-self.length, kind="stable")
        self.rank = np.empty(len(units), np.int64)
        self.rank[order] = np.arange(len(units))
        # units that are at least so long; the rows of distance d begin at base[d], those of distance 0 are the ends
        reach = np.searchsorted(-self.length[order], -np.arange(int(self.length.max(initial=0)) + 1), "right")
        self.base = np.concatenate([[0], np.cumsum(reach)])[:-1]
        cp = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        start = np.cumsum(self.length) - self.length
        left = np.repeat(start + self.length, self.length) - np.arange(n)  # characters up to the end
        row_of = self.base[left] + np.repeat(self.rank, self.length)
        total = int(reach.sum())

        # each character's strings, one character longer a turn, as long as they begin a piece
        h = cp.astype(U) + U(1)
        code, found, count = h, lattice.lookup(h), np.ones(n, np.int8)
        on = np.flatnonzero((found != -1) & (left > 1))
        bare = np.flatnonzero(found < 0)
        found[bare] = [lattice.spelt(chr(c)) for c in cp[bare].tolist()]
        edges: list[tuple[np.ndarray, int, np.ndarray, np.ndarray | int]] = [(slice(None), 1, found, 0)]
        at, h = on, h[on]
        for k in range(1, min(lattice.longest, len(reach) - 1)):
            h = h * _BASE + code[at + k]
            found = lattice.lookup(h)
            hit = np.flatnonzero(found >= 0)
            some = at[hit]
            column = count[some]
            edges.append((some, k + 1, found[hit], column))
            count[some] = column + 1
            on = np.flatnonzero((found != -1) & (left[at] > k + 1))
            at, h = at[on], h[on]
        # a column for each edge, in order of length; in eights, so that eight comparisons are one number
        columns = -(-int(count.max(initial=1)) // 8) * 8
        # pieces (shifted) and widths in one number
        self.code = np.zeros((total, columns), np.int32)
        weight = np.zeros((total, columns), np.float32)
        row_of *= columns
        for rows, k, piece, column in edges:
            place, piece = row_of[rows] + column, piece + _SHIFT
            self.code.ravel()[place] = piece * 64 + k
            weight.ravel()[place] = lattice.plain[piece]

        self.cumulative = np.ones((total, columns), np.float32)
        log_total = np.zeros(len(units))
        long = int(np.searchsorted(-self.length[order], -_SHORT, "left"))  # ranks below are longer
        for r in range(long):
            log_total[r] = self._by_logs(units[order[r]], r)
        beta = np.zeros(total)
        beta[long : len(units)] = 1.0
        for back in range(1, min(len(reach) - 1, _SHORT) + 1):
            lo, hi = self.base[back] + long, self.base[back] + reach[back]
            sums = beta[self.base[back - (self.code[lo:hi] & 63)] + np.arange(long, reach[back])[:, None]]
            sums *= weight[lo:hi]
            for c in range(1, columns):
                sums[:, c] += sums[:, c - 1]
            beta[lo:hi] = sums[:, -1]
            np.divide(sums, sums[:, -1:], out=self.cumulative[lo:hi], casting="same_kind")
        if len(units) > long:
            log_total[long:] = np.log(beta[self.base[self.length[order[long:]]] + np.arange(long, len(units))])
        self.log_total, self.beta = log_total[self.rank], beta

    def draw(self, unit: int, uniforms: Iterator[float], barred: list[tuple[tuple[int, int], ...]]) -> tuple[tuple[tuple[int, int], ...], float, float] | None:
        """:meth:`Lattice.draw` of a unit of the tables."""
        size, rank = int(self.length[unit]), int(self.rank[unit])
        if size > _SHORT:
            return self.lattice.draw(self.units[unit], uniforms, barred)
        log_of, base, beta = self.lattice.log_of, self.base, self.beta
        whole = -float(self.log_total[unit])
        chance = [math.exp(whole + sum([log_of(p) for _, p in b])) for b in barred]
        left, done, mass, live = size, [], 1.0, range(len(barred))
        while left:
            row = base[left] + rank
            here, options, total = float(beta[row]), [], 0.0
            for x in self.code[row].tolist():
                k, p = x & 63, (x >> 6) - _SHIFT
                if not k:
                    break
                weight = float(self.lattice.plain[p + _SHIFT])
                rest = mass * weight * float(beta[base[left - k] + rank]) / here
                took = [b for b in live if len(barred[b]) > len(done) and barred[b][len(done)] == (k, p)]
                own = max(0.0, rest - sum([chance[b] for b in took])) if took else rest
                options.append((own, rest, k, p, took))
                total += own
            if total <= 1e-15:
                return None
            u = next(uniforms) * total
            for own, rest, k, p, took in options:
                u -= own
                if u < 0:
                    break
            else:
                own, rest, k, p, took = next(o for o in reversed(options) if o[0] > 0)
            mass, live = rest, took
            done.append((k, p))
            left -= k
        if tuple(done) in barred:
            return None
        log_p = whole + sum([log_of(p) for _, p in done])
        return tuple(done), log_p, sum(chance) + math.exp(log_p)

    def _by_logs(self, unit: str, rank: int) -> float:
        edges, beta = self.lattice.edges(unit)
        for i, found in enumerate(edges):
            chance = np.cumsum([math.exp(w + beta[i + k] - beta[i]) for k, _, w in found])
            self.cumulative[self.base[len(unit) - i] + rank, : len(found)] = chance / chance[-1]
        return beta[0]

    def sample(self, unit: np.ndarray, key: np.ndarray, place: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence of a unit: pieces in order (flat), edge lengths, how many, and the log probability."""
        lattice = self.lattice
        n_out, log_p = np.zeros(len(unit), np.int64), -self.log_total[unit]
        got: list[tuple[np.ndarray, np.ndarray]] = []
        occ, rank, left = np.arange(len(unit)), self.rank[unit], self.length[unit]
        base = key + place.astype(U) * U(0xD1342543DE82EF95)
        step = 0
        while len(occ):
            u = (_mix(base + U((turn * 0xDA942042E4DD58B5 + (step + 1) * 0xAF251AF3B0F025B5) % (1 << 64))) >> U(40)).astype(np.float32) * np.float32(2.0**-24)
            row = self.base.take(left)
            row += rank
            passed = (self.cumulative.take(row, 0) <= u[:, None]).view(U)
            column = ((passed * U(0x0101010101010101)) >> U(56)).sum(1, dtype=np.int64) if passed.shape[1] > 1 else ((passed[:, 0] * U(0x0101010101010101)) >> U(56)).astype(np.int64)
            row *= self.code.shape[1]
            column += row
            code = self.code.ravel().take(column)
            got.append((occ, code))
            gain = lattice.logs.take(code >> 6)
            if step:
                log_p[occ] += gain
                n_out[occ] += 1
            else:
                log_p += gain
                n_out += 1
            left = left - (code & 63)
            on = np.flatnonzero(left)
            occ, rank, left, base, step = occ.take(on), rank.take(on), left.take(on), base.take(on), step + 1
        start = np.concatenate([[0], np.cumsum(n_out)])
        flat = np.empty(start[-1], np.int32)
        for step, (occ, code) in enumerate(got):
            flat[start[occ] + step] = code
        return (flat >> 6) - _SHIFT, flat & 63, n_out, log_p


def _stream(key: int, turn: int, place: int) -> Iterator[float]:
    """Numbers in [0, 1) from hashes of the arguments and a step, one at a time."""
    word = (1 << 64) - 1
    at = key + (turn + 1) * 0xDA942042E4DD58B5 + place * 0xD1342543DE82EF95
    while True:
        at = (at + 0x9E3779B97F4A7C15) & word
        x = ((at ^ (at >> 30)) * 0xBF58476D1CE4E5B9) & word
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & word
        yield ((x ^ (x >> 31)) >> 11) * 2.0**-53


def _gumbel(u: np.ndarray, log_mass: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Gumbels of the masses, truncated at ``below``."""
    with np.errstate(all="ignore"):
        return -np.logaddexp(-below, np.log(-np.log(u)) - log_mass)


def segment(keys: list[str], texts: list[str | None], pieces: dict, samples: int, alpha: float, seed: int = 0, lattice: Lattice | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text up to ``samples`` segmentations (pieces, log probability, perturbed log probability, inclusion), best first."""
    from xxhash import xxh64_intdigest

    lattice = lattice or Lattice(pieces, alpha)
    place: dict[str, int] = defaultdict(count().__next__)  # a new unit, without its first space, takes the next number
    flat: list[int] = []
    starts = [0]
    for t in texts:
        if t:
            if SPACE in t:
                t = t.replace(SPACE, _LITERAL)
            if "  " in t or t[0] == " " or t[-1] == " ":
                cut = [u[1:] for u in _UNIT.findall(SPACE + t.replace(" ", SPACE))]
            else:  # every unit is one space and a word
                cut = t.split(" ")
            flat.extend(map(place.__getitem__, cut))
        starts.append(len(flat))
    names = [SPACE + u for u in place]
    units, unit, begin = Units(lattice, names), np.array(flat, np.int64), np.array(starts, np.int64)
    n_docs = len(texts)
    key = np.array([xxh64_intdigest(k.encode("utf-8", "surrogatepass"), seed) for k in keys], U)
    doc = np.repeat(np.arange(n_docs), np.diff(begin))
    inner = np.arange(len(unit)) - begin[doc]
    root = -np.log(-np.log(_uniform(key, 0, 0, 0)))

    # a path: its pieces by unit, and where its units from ``since`` on are kept; what is before is its parent's
    paths: list[list[tuple]] = [[] for _ in range(n_docs)]  # (round, first unit of its own, offset in the round, parent, key, log probability)
    rounds: list[tuple] = []
    heads: list[list[list]] = [[] for _ in range(n_docs)]  # open branches of each text: [key, path, unit, barred or None]

    def run_round(turn: int, docs: np.ndarray, since: np.ndarray, bound: np.ndarray, before: np.ndarray) -> None:
        """Sample the units from ``since`` on of each of ``docs`` and open the branches off them; ``before`` is the log mass of what is held."""
        size = begin[docs + 1] - begin[docs] - since
        which = np.repeat(np.arange(len(docs)), size)
        offset = np.concatenate([[0], np.cumsum(size)])
        occ = begin[docs][which] + since[which] + np.arange(offset[-1]) - offset[which]
        pieces_, widths, n_out, log_p = units.sample(unit[occ], key[doc[occ]], inner[occ], turn)
        total = np.concatenate([[0.0], np.cumsum(log_p)])
        held = total[:-1] - total[offset[which]]
        # exp(-Gumbel) of each branch, but for the mass that is held before: the smallest is the best branch
        with np.errstate(all="ignore"):
            branch = -np.log(_uniform(key[doc[occ]], 1000 + turn, inner[occ], 0)) / (np.exp(held) * np.abs(np.expm1(np.minimum(log_p, 0.0))))
        held += before[which]
        rounds.append((pieces_, np.concatenate([[0], np.cumsum(n_out)]), widths, branch, log_p, held, offset, bound, before))

    def best_branches(turn: int, r: int, count: int) -> list[tuple[float, int]]:
        """Keys and units of the best branches off a path: Gumbels truncated at the path's own key."""
        lo, hi = rounds[turn][6][r], rounds[turn][6][r + 1]
        values = rounds[turn][3][lo:hi]
        some = np.argpartition(values, count - 1)[:count] if hi - lo > count else np.arange(hi - lo)
        bound, before = float(rounds[turn][7][r]), float(rounds[turn][8][r])
        out = []
        for i, v in zip(some.tolist(), values[some].tolist(), strict=True):
            if 0 < v < math.inf:
                away = math.log(v) - before + bound
                out.append((bound - (away + math.log1p(math.exp(-away)) if away > 0 else math.log1p(math.exp(away))), i))
        return out

    docs = np.arange(n_docs)
    run_round(0, docs, np.zeros(n_docs, np.int64), root, np.zeros(n_docs))
    own_log_p = lambda turn, r: float(rounds[turn][4][rounds[turn][6][r] : rounds[turn][6][r + 1]].sum())
    for d in range(n_docs):
        paths[d].append((0, d, 0, None, float(root[d]), own_log_p(0, d), None))
        heads[d] += [[g, 0, i, []] for g, i in best_branches(0, d, samples)]

    def pieces_at(d: int, p: int, i: int) -> tuple[tuple[int, int], ...]:
        """Edges of unit i on path p of text d."""
        turn, r, since, parent, _, _, first = paths[d][p]
        while i < since - (first is not None):
            p = parent
            turn, r, since, parent, _, _, first = paths[d][p]
        if first is not None and i == since - 1:
            return first
        at = rounds[turn][6][r] + i - since
        lo, hi = rounds[turn][1][at], rounds[turn][1][at + 1]
        return tuple(zip(rounds[turn][2][lo:hi].tolist(), rounds[turn][0][lo:hi].tolist(), strict=True))

    for turn in range(1, samples):
        chosen, since, bound, before = [], [], [], []
        for d in range(n_docs):
            while heads[d]:
                head = max(heads[d], key=lambda h: h[0])
                g, p, i, barred = head
                heads[d].remove(head)
                barred = [*barred, pieces_at(d, p, i)] if not barred else barred
                drawn = units.draw(unit[begin[d] + i], _stream(int(key[d]), 2000 + turn, i), barred)
                if drawn is None:
                    continue
                segments, log_p, used = drawn
                held = _held(paths, rounds, d, p, i)
                paths[d].append((turn, len(chosen), i + 1, p, g, None, segments))
                if used < 1 - 1e-12:  # neither of these segmentations
                    u = _uniform(key[d : d + 1], 3000 + turn, i, 0)
                    value = _gumbel(u, np.array([held + math.log(1 - used)]), np.array([g]))[0]
                    heads[d].append([float(value), p, i, [*barred, segments]])
                chosen.append(d)
                since.append(i + 1)
                bound.append(g)
                before.append(held + log_p)
                break
        run_round(turn, np.array(chosen, np.int64), np.array(since, np.int64), np.array(bound), np.array(before))
        for r, d in enumerate(chosen):
            p = len(paths[d]) - 1
            t, _, s, parent, g, _, first = paths[d][p]
            paths[d][p] = (t, r, s, parent, g, before[r] + own_log_p(turn, r), first)
            heads[d] += [[g2, p, s + i, []] for g2, i in best_branches(turn, r, samples)]

    out = []
    for d in range(n_docs):
        n = int(begin[d + 1] - begin[d])
        next_key = max((h[0] for h in heads[d]), default=-math.inf)
        rows, whole = [], {}
        for p, (turn, r, since, parent, g, log_p, first) in enumerate(paths[d]):
            lo = rounds[turn][6][r]
            own = rounds[turn][0][rounds[turn][1][lo] : rounds[turn][1][lo + n - since]]
            widths = rounds[turn][2][rounds[turn][1][lo] : rounds[turn][1][lo + n - since]]
            if first is not None:
                ids, wide, cut = whole[parent]
                keep = cut[since - 1]
                after = rounds[turn][1][lo : lo + n - since + 1] - rounds[turn][1][lo]
                own = np.concatenate([ids[:keep], np.array([x for _, x in first], np.int32), own])
                widths = np.concatenate([wide[:keep], np.array([k for k, _ in first], np.int32), widths])
                cut = np.concatenate([cut[:since], keep + len(first) + after])
            else:
                cut = rounds[turn][1][lo : lo + n + 1] - rounds[turn][1][lo]
            whole[p] = (own, widths, cut)
            ids = own
            if len(spelt := np.flatnonzero(own < 0)):
                text = SPACE + texts[d].replace(SPACE, _LITERAL).replace(" ", SPACE)
                at = np.cumsum(widths) - widths
                parts, done = [], 0
                for x in spelt.tolist():
                    parts += [own[done:x], [lattice.byte[b] for b in lattice.bytes_of(text[at[x]])]]
                    done = x + 1
                ids = np.concatenate([*parts, own[done:]]).astype(np.int64)
            inclusion = 1.0 if next_key == -math.inf else -math.expm1(-math.exp(min(700.0, log_p - next_key)))
            rows.append((ids, log_p, g, inclusion))
        out.append(rows)
    return out


def _held(paths, rounds, d: int, p: int, i: int) -> float:
    """The log mass of path p of text d up to its unit i."""
    turn, r, since, parent, _, _, first = paths[d][p]
    if i < since:
        return _held(paths, rounds, d, parent, i)
    return float(rounds[turn][5][rounds[turn][6][r] + i - since])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int32, copy=False)))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", samples: int = 3, alpha: float = 0.5, seed: int = 0, decoded: bool = False) -> DataFrame:
    """(``id_col``, ``sample`` from 1, ``ids array<int>``, ``log_prob``, ``perturbed``, ``inclusion``): up to ``samples`` rows for each row; no shuffle.

    With ``decoded`` also ``text``, spelt by the pieces, from the same worker.
    """
    if samples < 1:
        raise ValueError("samples must be positive")
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key"), F.col(text_col).cast("string").alias("text"))
    fields = ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, speller = Lattice(pieces.value, alpha), Speller(pieces.value["text"])
        for b in batches:
            keys, texts, first = b.column(1).to_pylist(), b.column(2).to_pylist(), 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last] or "") < _CHUNK):
                    size += len(texts[last] or "")
                    last += 1
                found = segment(keys[first:last], texts[first:last], pieces.value, samples, alpha, seed, lattice)
                owner = [first + i for i, rows in enumerate(found) for _ in rows]
                rows = [(n, *x) for of_text in found for n, x in enumerate(of_text, 1)]
                columns = [pa.array([r[i] for r in rows], kind) if i != 1 else _lists([r[1] for r in rows]) for i, (_, kind) in enumerate(fields)]
                names = ["id", *[n for n, _ in fields]]
                if decoded:
                    columns.append(speller.spell(columns[1]))
                    names.append("text")
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *columns], names=names)
                first = last

    return source.mapInArrow(run, with_id(source, "sample int, ids array<int>, log_prob double, perturbed double, inclusion double" + ", text string" * decoded)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``, the exact text that the pieces spell; null ids spell nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_file)["text"])

    @F.arrow_udf("string")
    def spell(ids):
        return Speller(shared.value).spell(ids)

    return encoded.withColumn("text", spell(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


class Speller:
    """Texts of lists of pieces."""

    def __init__(self, text: list[bytes]) -> None:
        self.size = np.array([len(t) for t in text], np.int64)
        self.begin, self.letters = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(text), np.uint8)

    def spell(self, ids: pa.ListArray, block: int = 100_000) -> pa.Array:
        """The text of each list; so many pieces at a time as fit in a processor's cache."""
        offsets = ids.offsets.to_numpy()
        pieces = ids.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        parts, ends, done = [], [np.zeros(1, np.int64)], 0
        for lo in range(0, len(pieces), block):
            piece = pieces[lo : lo + block]
            size = self.size.take(piece)
            end = np.cumsum(size)
            from_ = np.repeat((self.begin.take(piece) - end + size).astype(np.int32), size)
            from_ += np.arange(len(from_), dtype=np.int32)
            parts.append(self.letters.take(from_))
            ends.append(end + done)
            done += len(from_)
        data = np.concatenate([*parts, np.empty(0, np.uint8)])
        cut = np.concatenate(ends).take(offsets)
        # the space that encoding put first
        first = cut[:-1][cut[1:] > cut[:-1]]
        first = first[data[first] == 32]
        cut = cut - np.searchsorted(first, cut)
        data = np.delete(data, first).tobytes()
        out = pa.StringArray.from_buffers(len(ids), pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # pieces that no text has
            out = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)], pa.string())
        return out
