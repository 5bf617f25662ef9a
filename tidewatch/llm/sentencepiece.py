"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

Sampling: a text's segmentations form a lattice of pieces; a piece's log-probability follows its rank in the vocabulary
by Zipf's law. Gumbel top-k is run as an A* search: regions of the lattice wait in a queue under the largest perturbed
log-probability within them, which is exact because the backward sums of the lattice give each region's mass. The best
region is taken apart: one path in it, drawn piece by piece, holds its maximum, and at each of the path's nodes the
other edges are a new region, whose maximum is a Gumbel variable truncated at the path's. Paths come out distinct, in
descending order; with the best region left over as threshold each has its inclusion probability.

No piece holds the word mark after another character, so a lattice is a chain of independent units (a word with its
mark); lattices of units are built once for many texts, and random numbers are hashes of the row's key and the place.
"""

from __future__ import annotations

import heapq
import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Units beyond this many characters are worked on one by one, on log-probabilities.
LONG = 256
#: Log-probability that scaling adds to a character.
SCALE = 2.6
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 19
#: Between these letters and these signs units are cut where no piece of the vocabulary holds both side by side.
LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
SIGNS = ",.!?;:\n"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass(frozen=True)
class PieceConfig:
    #: A SentencePiece model; by default the public one where it is installed.
    model: str | None = None
    samples: int = 2
    seed: int = 0
    #: Added to ranks in Zipf's law.
    shift: float = 2.7
    #: Nodes of cached lattices at which the cache starts anew.
    cache_nodes: int = 2_500_000
    #: Characters that are worked on at a time.
    block_chars: int = 1_000_000


class Vocabulary:
    """Pieces, their probabilities, and single bytes for characters that have no piece."""

    def __init__(self, cfg: PieceConfig):
        import sentencepiece

        path = cfg.model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.processor
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [i for i in range(sp.get_piece_size()) if sp.is_byte(i)]
        ranks = np.argsort(np.argsort([-sp.get_score(i) for i in ids], kind="stable"))
        total = math.log(sum(1 / (r + cfg.shift) for r in range(len(ids) + len(byte_ids))))
        self.log = {sp.id_to_piece(i): -math.log(r + cfg.shift) - total for i, r in zip(ids, ranks.tolist(), strict=True)}
        self.id = {sp.id_to_piece(i): i for i in ids}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds the word mark after another character")
        self.byte_log = -math.log(len(ids) + len(byte_ids) + cfg.shift) - total
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in byte_ids}
        #: Every beginning of a piece: its id, or -1 where it is no piece.
        self.begin: dict[str, int] = {p[:k]: -1 for p in self.id for k in range(1, len(p))} | self.id
        self.longest = max(map(len, self.id))
        letter = re.compile(f"[{LETTERS}]")
        crossed = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if letter.match(a)} | {a for p in self.id for a, b in zip(p, p[1:], strict=False) if letter.match(b)}
        signs = re.escape("".join(c for c in SIGNS if c not in crossed)) if "\n" not in "".join(self.id) else ""
        whole = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        #: A word before a sign or by itself; signs before a word; else all up to the next mark.
        self.units = re.compile(f"{MARK}*[{LETTERS}]+(?=[{signs}{MARK}]|$)|[{signs}]+(?=[{LETTERS}{MARK}]|$)|{whole}" if signs else whole)
        self.scaled = np.zeros(sp.get_piece_size())
        for p, i in self.id.items():
            self.scaled[i] = math.exp(self.log[p] + SCALE * len(p))
        self._index()
        self.text = [b""] * sp.get_piece_size()
        for p, i in self.id.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        #: The same bytes in one array: where an id's begin, how many they are.
        self.flat, self.flat_len = np.frombuffer(b"".join(self.text), np.uint8), np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.flat_from = np.cumsum(self.flat_len) - self.flat_len

    def _index(self) -> None:
        """A hash table of the beginnings' polynomial hashes, with linear probing."""
        self.slots = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.values = np.full(1 << _SLOT_BITS, -1, np.int64)
        base, mask = int(_BASE), (1 << 64) - 1
        for p, i in self.begin.items():
            h = 0
            for c in p:
                h = (h * base + ord(c)) & mask
            at = ((h * int(_SPREAD)) & mask) >> (64 - _SLOT_BITS)
            while self.slots[at]:
                if int(self.slots[at]) == h:
                    raise ValueError("two beginnings of pieces share a hash")
                at = (at + 1) % len(self.slots)
            self.slots[at], self.values[at] = h, i

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a beginning's, and its id (-1: no piece)."""
        at = ((hashes * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        held = self.slots[at]
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << _SLOT_BITS) - 1)
            held[open_] = self.slots[at[open_]]
            open_ = open_[(held[open_] != hashes[open_]) & (held[open_] != 0)]
        return held == hashes, self.values[at]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids; the space that encoding adds in front goes."""
        return b"".join(map(self.text.__getitem__, ids)).removeprefix(b" ")

    def decoded_crc(self, ids: np.ndarray, step: int = 1 << 18) -> int:
        """The crc32 of decode_bytes, step ids at a time."""
        crc = 0
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            sizes = self.flat_len[part]
            stops = np.cumsum(sizes)
            raw = self.flat[np.repeat(self.flat_from[part] - stops + sizes, sizes) + np.arange(stops[-1])]
            crc = zlib.crc32(raw[1:] if at == 0 and len(raw) and raw[0] == 32 else raw, crc)
        return crc

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


class _Growing:
    """An array with room to grow; memory that is not written yet is not taken."""

    def __init__(self, kind: type, room: int):
        self.data, self.size = np.empty(room, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            data = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : need] = values
        self.size = need

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class Lattices:
    """Lattices of units in flat arrays: edges of a node in descending order of probability."""

    def __init__(self, vocab: Vocabulary, cfg: PieceConfig):
        self.vocab, self.cfg = vocab, cfg
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.fallback: list[list[int]] = []
        self.raw: dict[str, int] = {}
        #: By unit: first node, where its encoding is. By node: first edge (-1: the unit's end), number of edges. By edge:
        #: target, id (negative: several bytes), log-probability at its node, running probability. And all encodings.
        room = self.cfg.cache_nodes + self.cfg.block_chars
        self.store = {name: _Growing(kind, room * 4 if name in ("to", "piece", "log", "run") else room) for name, kind in (("root", np.int32), ("enc_from", np.int32), ("enc_len", np.int32), ("first", np.int32), ("degree", np.int32), ("to", np.int32), ("piece", np.int32), ("log", np.float32), ("run", np.float32), ("encoded", np.int32))}
        self._views()

    def _views(self) -> None:
        for name, array in self.store.items():
            setattr(self, name, array.view())

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers; new ones are added in the order they come."""
        before = len(self.known)
        out = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if len(self.known) > before:
            self._add(list(islice(self.known, before, None)))
        return out

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' units, one text after another, and how many each text has.

        Units end where a mark begins, so each word is cut once, however often the texts hold it.
        """
        plain = [t.replace(MARK, " ") for t in texts]
        # Marks beside marks belong to the word behind them.
        plain = [" ".join([x[1:] for x in _MARKED.findall(MARK + t.replace(" ", MARK))]) if "  " in t or t[:1] == " " else t for t in plain]
        parts = pc.split_pattern(pa.array([t for t, own in zip(plain, texts, strict=True) if own], pa.string()), " ")
        words = parts.values.dictionary_encode()
        cut, units, each = self.vocab.units.findall, [], []
        for w in words.dictionary.to_numpy(zero_copy_only=False).tolist():
            own = cut(MARK + w)
            units += own
            each.append(len(own))
        sizes, numbers = np.array(each, np.int64), self.numbers(units)
        at = words.indices.to_numpy()
        counts = sizes[at]
        stops = np.concatenate(([0], np.cumsum(counts)))
        out = numbers[np.repeat((np.cumsum(sizes) - sizes)[at] - stops[:-1], counts) + np.arange(stops[-1])]
        held = np.zeros(len(texts), np.int64)
        held[[bool(t) for t in texts]] = np.diff(stops[parts.offsets.to_numpy()])
        return out, held

    def _encode(self, units: list[str]) -> list[list[int]]:
        """The library's encoding of each unit. It adds a mark in front, which a unit has, or which a line feed takes."""
        v, feed = self.vocab, self.vocab.bytes.get(10)
        plain = [u[1:].replace(MARK, " ") if u[0] == MARK else "\n" + u for u in units]
        out = v.processor.encode(plain, num_threads=1)
        for i, u in enumerate(units):
            if u[0] != MARK:
                out[i] = out[i][out[i].index(feed) + 1 :]
            elif not out[i]:  # a lone mark
                out[i] = [v.id[MARK]]
        return out

    def _add(self, units: list[str]) -> None:
        short = [i for i, u in enumerate(units) if len(u) <= LONG]
        parts = [self._short([units[i] for i in short])] if short else []
        order = short
        if len(short) < len(units):
            order = short + [i for i, u in enumerate(units) if len(u) > LONG]
            parts += [self._long(units[i]) for i in order[len(short) :]]
        base = len(self.first)
        bases = np.cumsum([base, *[len(p[0]) for p in parts[:-1]]])
        deg = np.concatenate([p[0] for p in parts])
        to = np.concatenate([p[1] + b for p, b in zip(parts, bases, strict=True)])
        piece, probs = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        lengths = np.fromiter((len(units[i]) for i in order), np.int64, len(order)) + 1
        roots = np.empty(len(units), np.int64)
        roots[order] = base + np.cumsum(lengths) - lengths
        with np.errstate(divide="ignore"):
            logs = np.minimum(np.log(probs), 0.0)
        starts = np.cumsum(deg) - deg
        sums = np.cumsum(probs)
        has = deg > 0
        run = sums - np.repeat((sums - probs)[np.minimum(starts, len(probs) - 1)], deg)
        run[(starts + deg - 1)[has]] = 2.0  # the last edge takes what rounding leaves
        enc = self._encode(units)
        sizes = np.fromiter(map(len, enc), np.int64, len(enc))
        new = {"root": roots, "enc_from": np.cumsum(sizes) - sizes + len(self.encoded), "enc_len": sizes, "first": np.where(has, starts + len(self.to), -1), "degree": deg, "to": to, "piece": piece, "log": logs, "run": run, "encoded": np.fromiter(chain.from_iterable(enc), np.int32, int(sizes.sum()))}
        for name, values in new.items():
            self.store[name].extend(values)
        self._views()

    def _code(self, char: str) -> int:
        """The byte of a character without a piece, or a negative number for several."""
        raw = [self.vocab.bytes[b] for b in char.encode()]
        if len(raw) == 1:
            return raw[0]
        if char not in self.raw:
            self.fallback.append(raw)
            self.raw[char] = -len(self.fallback)
        return self.raw[char]

    def _short(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Degrees by node, and by edge its target, id and probability, for many units at once.

        Pieces of one length are looked up together, those places dropping out that begin no longer piece. Backward
        sums go by distance from the end, on probabilities scaled by character, which short units keep in range.
        """
        v = self.vocab
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes + 1) - 1
        n = len(chars)
        chars[ends] = np.uint64(0xFFFFFFFF)
        dist = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(np.uint16)
        # Places by distance from the end, the way the sums run; all that is picked from them keeps the order.
        inner = np.argsort(dist, kind="stable")[len(units) :].astype(np.int32)
        layers: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        at, far, h = inner, dist[inner], np.zeros(len(inner), np.uint64)
        bare = np.ones(n, bool)
        bare[ends] = False
        for k in range(1, v.longest + 1):
            h = h * _BASE + chars[at + (k - 1)]
            found, ids = v.look_up(h)
            whole = found & (ids >= 0)
            got = ids[whole]
            layers.append((k, at[whole], got, v.scaled[got]))
            if k == 1:
                bare[at[whole]] = False
            found &= far > k
            at, far, h = at[found], far[found], h[found]
            if not len(at):
                break
        alone = inner[bare[inner]]
        if len(alone):
            letters = [chr(int(c)) for c in chars[alone]]
            codes = np.array([self._code(c) for c in letters], np.int64)
            layers.insert(0, (1, alone, codes, np.exp(np.array([v.byte_log * len(c.encode()) for c in letters]) + SCALE)))
        back = np.zeros(n)
        back[ends] = 1.0
        steps = int(sizes.max())
        cuts = [np.searchsorted(dist[at], np.arange(steps + 2)).tolist() for _, at, _, _ in layers]
        for d in range(1, steps + 1):
            for (k, at, _, p), cut in zip(layers, cuts, strict=True):
                if k <= d and cut[d] < cut[d + 1]:
                    x = slice(cut[d], cut[d + 1])
                    own = at[x]
                    back[own] += p[x] * back[own + k]
        degree = np.zeros(n, np.int64)
        for _, at, _, _ in layers:
            degree[at] += 1
        free = np.cumsum(degree) - degree
        total = int(degree.sum())
        to, piece, prob = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        for k, at, ids, p in reversed(layers):  # long pieces, mostly the likelier, first
            slot = free[at]
            to[slot], piece[slot], prob[slot] = at + k, ids, p * back[at + k] / back[at]
            free[at] += 1
        return degree, to, piece, prob

    def _long(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As _short, for one unit of any length, on log-probabilities."""
        v, n = self.vocab, len(unit)
        back = [0.0] * (n + 1)
        found: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            own = found[i]
            for j in range(i + 1, min(n, i + v.longest) + 1):
                x = v.begin.get(unit[i:j])
                if x is None:
                    break
                if x >= 0:
                    own.append((v.log[unit[i:j]] + back[j], x, j))
            if unit[i] not in v.id:
                own.append((v.byte_log * len(unit[i].encode()) + back[i + 1], self._code(unit[i]), i + 1))
            own.sort(reverse=True)
            back[i] = own[0][0] + math.log(sum(math.exp(x[0] - own[0][0]) for x in own))
        edges = [(j, code, math.exp(x - back[i])) for i in range(n) for x, code, j in found[i]]
        to, piece, prob = zip(*edges, strict=True)
        return np.array([*map(len, found), 0], np.int64), np.array(to, np.int64), np.array(piece, np.int64), np.array(prob)

    def draw(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each node to its unit's end: edges, one path after another, and their numbers."""
        lanes = np.arange(len(nodes), dtype=np.int32)
        counts = np.zeros(len(nodes), np.int32)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        edge = self.first[nodes]
        step = 0
        while True:
            live = np.flatnonzero(edge >= 0)
            if not len(live):
                break
            lanes, edge = lanes[live], edge[live]
            u = uniform(seeds[lanes] + np.uint64(step))
            late = np.flatnonzero(u > self.run[edge])
            while len(late):
                at_late = edge[late] + np.int32(1)
                edge[late] = at_late
                late = late[u[late] > self.run[at_late]]
            steps.append((lanes, edge))
            counts[lanes] += 1
            edge = self.first[self.to[edge]]
            step += 1
        out = np.empty(int(counts.sum()), np.int32)
        start = np.cumsum(counts) - counts
        for i, (who, edge) in enumerate(steps):
            out[start[who] + i] = edge
        return out, counts

    def walk(self, node: int, seed: int) -> np.ndarray:
        """As draw, for one node."""
        out = []
        if self.degree[node]:
            rng = random.Random(seed)
            while True:
                u, edge = rng.random(), int(self.first[node])
                while u > self.run[edge]:
                    edge += 1
                out.append(edge)
                node = int(self.to[edge])
                if not self.degree[node]:
                    break
        return np.array(out, np.int32)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The ids of a path."""
        ids = self.piece[edges]
        if len(ids) and ids.min() < 0:
            return np.array([y for x in ids.tolist() for y in ([x] if x >= 0 else self.fallback[-1 - x])], np.int64)
        return ids


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 by hashing 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def uniform_of(x: int) -> float:
    """As uniform, of one integer."""
    mask = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


def _gumbel_below(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """The largest of Gumbel variables of a log-mass, given that it is below the bound."""
    return mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) - np.log(u))


@dataclass
class Sample:
    """A segmentation: edges, log-probability, perturbed log-probability, probability of being among the k."""

    edges: np.ndarray
    log: float
    perturbed: float
    inclusion: float = 1.0


def sample_paths(lat: Lattices, paths: list[tuple[np.ndarray, np.ndarray]], roots: np.ndarray, seed: int) -> list[Sample]:
    """Distinct paths through a chain of units by A* over regions; paths: for each sample drawn edges and their number
    by unit, which a sample uses from the unit after its branch on.
    """
    k = len(paths)
    first = float(-np.log(-np.log(uniform_of(seed))))
    #: Regions: -maximum, tie breaker, sample whose path it leaves, place on it, edges taken there.
    queue: list[tuple[float, int, int, int, tuple[int, ...]]] = [(-first, 0, -1, 0, ())]
    out: list[Sample] = []
    made = 0
    for j in range(k):
        if not queue:
            break
        negative, _, parent, place, taken = heapq.heappop(queue)
        top = -negative
        fresh, counts = paths[j]
        if parent < 0:
            edges, branch = fresh, 0
        else:
            old = out[parent].edges
            unit = int(np.count_nonzero(lat.degree[lat.to[old[:place]]] == 0))
            back = int(lat.to[old[place - 1]]) if place else -1
            node = back if place and lat.degree[back] else int(roots[unit])
            node_edges = [e for e in range(int(lat.first[node]), int(lat.first[node] + lat.degree[node])) if e not in taken]
            mix = uniform_of(seed + 7919 * (j + 1))
            weights = np.exp(lat.log[node_edges])
            pick = node_edges[min(int(np.searchsorted(np.cumsum(weights), mix * weights.sum())), len(node_edges) - 1)]
            # The rest of the unit after the branch, then the drawn paths of the units that follow.
            inner = lat.walk(int(lat.to[pick]), seed + 104_729 * (j + 1))
            skip = int(counts[: unit + 1].sum())
            edges, branch = np.concatenate((old[:place], np.array([pick], np.int32), inner, fresh[skip:])), place + 1
            # What the region still holds at this node.
            rest = [e for e in node_edges if e != pick]
            if rest:
                mass = float(lat.log[old[:place]].sum() + np.log(np.exp(lat.log[rest]).sum()))
                made += 1
                g = _gumbel_below(np.array([mass]), top, np.array([uniform_of(seed + 15_485_863 * made)]))[0]
                heapq.heappush(queue, (-float(g), made, parent, place, (*taken, pick)))
        logs = lat.log[edges]
        out.append(Sample(edges, float(logs.sum(dtype=np.float64)), top))
        # New regions: at each node from the branch on, the edges not taken. A prefix below e^-60 leaves less mass to
        # what follows than doubles resolve beside the whole.
        stop = branch + 1024
        sums = np.cumsum(logs[:stop], dtype=np.float64)
        while stop < len(edges) and sums[-1] > -60:
            stop *= 2
            sums = np.cumsum(logs[:stop], dtype=np.float64)
        own = branch + np.flatnonzero(logs[branch:stop] < 0)
        if len(own):
            mass = sums[own] - logs[own] + np.log(-np.expm1(logs[own].astype(np.float64)))
            g = _gumbel_below(mass, top, uniform(np.uint64(seed) + np.uint64(2_750_159 * (j + 1)) + own.astype(np.uint64)))
            # No more regions than samples to come, and one for the threshold, can matter.
            n = k - j + 1
            best = np.argpartition(-g, n)[:n] if len(g) > n else np.arange(len(g))
            for x in best.tolist():
                made += 1
                place = int(own[x])
                heapq.heappush(queue, (-float(g[x]), made, j, place, (int(edges[place]),)))
    if queue:
        threshold = -queue[0][0]
        for s in out:
            s.inclusion = -math.expm1(-math.exp(min(s.log - threshold, 700.0)))
    return out


_WORKERS: dict[PieceConfig, Lattices] = {}
_DIGEST = "n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, samples array<struct<n_pieces:bigint,ids_crc32:bigint,log_prob:double,perturbed:double,inclusion:double>>"
_DIGEST_TYPE = pa.list_(pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _run(cfg: PieceConfig, with_ids: bool) -> Callable:
    def block(lat: Lattices, keys: list, texts: list[str]) -> list[tuple]:
        if len(lat.first) > cfg.cache_nodes:
            lat.reset()
        numbers, sizes = lat.cut(texts)
        seeds = np.fromiter((xxhash.xxh64_intdigest(str(k).encode(), cfg.seed) for k in keys), np.uint64, len(keys))
        stops = np.cumsum(sizes)
        within = np.arange(len(numbers)) - np.repeat(stops - sizes, sizes)
        draws = []
        for j in range(cfg.samples):
            base = np.repeat(seeds, sizes) + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((j + 1) * 0xD1B54A32D192ED03 % 2**64)
            edges, counts = lat.draw(lat.root[numbers], base)
            draws.append((edges, counts, np.concatenate(([0], np.cumsum(counts)))))
        enc_len = lat.enc_len[numbers]
        enc_to = np.concatenate(([0], np.cumsum(enc_len)))
        encoded = lat.encoded[np.repeat(lat.enc_from[numbers] - enc_to[:-1], enc_len) + np.arange(enc_to[-1])]
        out = []
        for i, text in enumerate(texts):
            a, b = int(stops[i] - sizes[i]), int(stops[i])
            ids = encoded[enc_to[a] : enc_to[b]]
            found = sample_paths(lat, [(e[s[a] : s[b]], c[a:b]) for e, c, s in draws], lat.root[numbers[a:b]], int(seeds[i]) >> 1) if b > a else []
            samples = [(lat.ids(s.edges), s) for s in found]
            out.append((ids, lat.vocab.decoded_crc(ids), samples))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cfg not in _WORKERS:
            _WORKERS[cfg] = Lattices(Vocabulary(cfg), cfg)
        lat = _WORKERS[cfg]
        for batch in batches:
            texts, keys = [t or "" for t in batch["text"].to_pylist()], batch["doc_id"].to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= cfg.block_chars):
                    chars += len(texts[stop])
                    stop += 1
                rows = block(lat, keys[start:stop], texts[start:stop])
                digests = [[{"n_pieces": len(ids), "ids_crc32": _crc(ids), "log_prob": s.log, "perturbed": s.perturbed, "inclusion": s.inclusion} for ids, s in r[2]] for r in rows]
                arrays = [batch["doc_id"].slice(start, stop - start), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([_crc(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(digests, _DIGEST_TYPE)]
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "samples"]
                if with_ids:
                    arrays += [pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())), pa.array([[ids.tolist() for ids, _ in r[2]] for r in rows], pa.list_(pa.list_(pa.int32())))]
                    names += ["ids", "sampled_ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                start = stop

    return run


def encode_documents(docs: DataFrame, cfg: PieceConfig = PieceConfig(), with_ids: bool = False) -> DataFrame:
    """Per row: the model's own encoding (number of ids, crc32 over little-endian 32-bit ids), the crc32 of its decoding,
    and up to cfg.samples distinct sampled segmentations; with_ids adds the ids of all of them.

    Null and empty texts have no ids and no samples; a text with fewer segmentations than samples gives all of them.
    Rows are worked on one by one, seeded by doc_id; only doc_id and text are read, and nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_DIGEST}" + ", ids array<int>, sampled_ids array<array<int>>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_run(cfg, with_ids), schema)


def decode_ids(rows: DataFrame, column: str = "ids", name: str = "text", cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """rows with the texts that a column of ids stands for; null ids give null, ids out of range fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(cfg)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x) for x in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs)
