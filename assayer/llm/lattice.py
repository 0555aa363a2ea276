"""SentencePiece encoding and decoding, and segmentations sampled without replacement.

``encode`` and ``decode`` use the library. ``sample`` draws the k most likely
segmentations under Gumbel noise, which is a sample without replacement from
the segmentations' distribution (W. Kool et al., *Stochastic beams and where to
find them*), by perturbed A* search over the piece lattice.

Lattice: nodes are the places between characters, an arc is a vocabulary piece
(or the byte pieces of a character that no piece covers) with log-weight
``-theta * log(rank + 1)``, rank being the piece's order in the vocabulary. The
exact logarithmic sum of all completions of a node (backward pass) is the
search's heuristic, so an arc's probability is known locally.

Search: a queue entry is a set of segmentations: a prefix, then any arc but
some excluded ones. Its key is its Gumbel maximum. The best entry is split at
the segmentation that attains it, drawn top down from arc probabilities, and
into one entry for each place where others leave it; their maxima are Gumbel
variates cut off at the entry's key. Only the k + 1 best entries can matter, so
only those are kept. The (k+1)-th key is the threshold kappa of the inclusion
score 1 - exp(-exp(log p - kappa)).

No piece reaches over two neighbouring characters that stand in no piece side
by side, so the lattice falls into units there, and only there: a run that
nothing cuts is one unit, however long. New units of a batch are built together,
and one search round runs for all texts of a batch at once in numpy. Uniform numbers are a hash of (row key, seed, sample, place), and log
probabilities are whole numbers (2^-30), so results depend neither on batches
nor on partitions.

Defined results: a null or empty text has one segmentation, of no pieces, with
log probability 0; a text with fewer than k segmentations gives them all, and
then every inclusion score is 1; rows with equal keys and texts give equal
samples, and repeated rows give repeated samples; a null key counts as 0; very
long texts are whole lattices (a task holds one text's arcs); an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import table

SAMPLES = 3
SEED = 17
THETA = 1.0
_FIX = float(1 << 30)
BATCH_CHARS = 1 << 18
#: Lattices of this many units with this many arcs are kept between batches.
UNITS = 1 << 17
ARCS = 1 << 22


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Vocabulary:
    """The pieces as a trie whose steps are a sorted array, so that many texts walk it at once."""

    def __init__(self, path: str, theta: float = THETA) -> None:
        sp = model(path)
        self.theta = theta
        self.byte = [0] * 256
        self.text: list[str] = []
        steps: dict[int, int] = {}
        pieces: dict[int, int] = {}
        self.longest = 1
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            self.text.append(text)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                node = 0
                for c in text:
                    node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
                pieces[node] = i
                self.longest = max(self.longest, len(text))
        self.slots, self.step_keys, self.child = self._hashed(steps)
        self.root = np.zeros(0x110000, np.int64)
        for k, to in steps.items():
            if k < 0x110000:
                self.root[k] = to
        whole = [self.text[i] for i in pieces.values()]
        seen = sorted({c for t in whole if len(t) > 1 for c in t})
        self.kind = np.zeros(0x110000, np.uint16)  # 0: in no piece of several characters
        self.kind[[ord(c) for c in seen]] = np.arange(1, len(seen) + 1)
        self.joined = np.zeros((len(seen) + 1, len(seen) + 1), bool)
        for t in whole:
            at = self.kind[[ord(c) for c in t]]
            self.joined[at[:-1], at[1:]] = len(t) > 1
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(pieces)] = list(pieces.values())
        # what an id adds to a decoded text; a byte beyond ASCII needs its neighbours
        self.shown = [t.replace("▁", " ") for t in self.text]
        for b in range(128):
            self.shown[self.byte[b]] = chr(b)
        self.shown_array = np.array(self.shown, object)
        self.shown_strings = pa.array(self.shown, pa.string())
        self.high = self.byte[128]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _hashed(self, steps: dict[int, int]) -> tuple[int, np.ndarray, np.ndarray]:
        """The trie's steps in an open hash table at most an eighth full, so that a lookup rarely takes a second look."""
        bits = (8 * len(steps)).bit_length()
        keys, child = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32)
        waiting, to = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        place = self._slot(waiting, bits)
        while len(waiting):  # the first of those that want a free slot takes it
            free = keys[place] < 0
            _, first = np.unique(place, return_index=True)
            first = first[free[first]]
            keys[place[first]], child[place[first]] = waiting[first], to[first]
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, to, place = waiting[rest], to[rest], place[rest] + 1
        return bits, keys, child

    def follow(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are steps, and the nodes that these lead to."""
        place = self._slot(key, self.slots)
        found = self.step_keys[place]
        hit = found == key
        look = np.flatnonzero(~hit & (found >= 0))
        while len(look):
            place[look] += 1
            found = self.step_keys[place[look]]
            hit[look] = found == key[look]
            look = look[~hit[look] & (found >= 0)]
        return hit, self.child[place[hit]].astype(np.int64)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of all texts, which of them stands at each place in order, and how many places each text has."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = self.kind[points]
        begins = np.append(True, ~self.joined[kinds[:-1], kinds[1:]])
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        first = np.cumsum(sizes) - sizes
        begins[first[sizes > 0]] = True
        at = np.append(np.flatnonzero(begins), len(whole))
        counts = np.diff(np.append(np.searchsorted(at, first), len(at) - 1))
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)  # bytes of each character
        offsets = np.append(0, np.cumsum(width))[at].astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())]
        coded = pa.Array.from_buffers(pa.large_string(), len(at) - 1, buffers).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts

    def arcs(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """For all units: nodes of each, then by node its first arc and number of arcs, then by arc its end, id (or -1 - character) and log probability."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(chars)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        at, node = np.arange(n), np.zeros(n, np.int64)
        found: list[tuple] = []
        for length in range(1, self.longest + 1):
            open_ = left[at] >= length
            at, node = at[open_], node[open_]
            key = node << 21 | chars[at + length - 1]
            if length == 1:
                hit = self.root[key] > 0
                at, node = at[hit], self.root[key[hit]]
            else:
                hit, node = self.follow(key)
                at = at[hit]
            ids = self.piece[node]
            own = ids >= 0
            if length == 1:
                bare = np.ones(n, bool)
                bare[at[own]] = False
                bare = np.flatnonzero(bare)
                kinds, which = np.unique(chars[bare], return_inverse=True)
                cost = np.array([sum(-self.theta * math.log(self.byte[b] + 1) for b in chr(c).encode()) for c in kinds.tolist()])
                found.append((bare, np.ones(len(bare), np.int64), -1 - chars[bare], cost[which] if len(bare) else np.zeros(0)))
            found.append((at[own], np.full(own.sum(), length), ids[own], -self.theta * np.log(ids[own] + 1.0)))
            if not len(at):
                break
        many = np.zeros(n, np.int64)
        for at, *_ in found:
            many[at] += 1
        first = np.cumsum(many) - many
        start, free = np.repeat(np.arange(n), many), first.copy()
        length, ids, weight = np.empty(len(start), np.int64), np.empty(len(start), np.int64), np.empty(len(start))
        for at, *values in found:  # by start, then by length
            place = free[at]
            length[place], ids[place], weight[place] = values
            free[at] += 1
        beta = np.zeros(n + 1)
        total = np.empty(len(start))
        far = left[start]
        by_left = np.argsort(far.astype(np.uint8 if far.max(initial=0) < 256 else np.int32), kind="stable")  # bytes sort faster
        cuts = np.append(0, np.cumsum(np.bincount(far)[1:]))
        for k in range(len(cuts) - 1):  # from the ends of all units to their beginnings
            some = by_left[cuts[k] : cuts[k + 1]]
            if not len(some):
                continue
            source, size = start[some], length[some]
            w = weight[some] + np.where(size == left[source], 0.0, beta[source + size])
            heads = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            top = np.maximum.reduceat(w, heads)
            counts = np.diff(np.r_[heads, len(w)])
            sums = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, counts)), heads))
            beta[source[heads]] = sums
            total[some] = w - np.repeat(sums, counts)
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return sizes, first, many, start + length - base[start], ids, total


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stir(key: np.ndarray, part) -> np.ndarray:
    """The key of one part of what ``key`` stands for."""
    with np.errstate(over="ignore"):
        return _mix(key + np.asarray(part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def _unit_interval(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from a row's key and what they are for."""
    for part in parts:
        key = _stir(key, part)
    return _unit_interval(key)


def _below(mean: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates with the given locations, cut off at ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        return mean - np.log(np.exp(np.minimum(mean - top, 700.0)) - np.log(u))


class _Numbers(dict):
    """Numbers of units in order of appearance; ``fresh`` holds those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.fresh.append(unit)
        self[unit] = at = len(self)
        return at


class Units:
    """Lattices of the units met so far, in arrays that double as they fill.

    A unit's lattice depends on nothing else, so keeping it or building it
    again makes no difference; beyond ``UNITS`` units or ``ARCS`` arcs all are
    forgotten before the next batch, which bounds the memory.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.bytes = np.array(vocabulary.byte, np.int64)
        small = {"many": np.uint8} | dict.fromkeys(("id", "node", "end"), np.int32) | dict.fromkeys(("prob", "rest"), np.float64)
        self.kinds = dict.fromkeys(("nodes", "node0", "first", "log"), np.int64) | small
        self.release()

    def release(self) -> None:
        """Forget all, memory included: a worker may idle beside other stages for long."""
        for name, kind in self.kinds.items():
            setattr(self, name, np.empty(0, kind))
        self.clear()

    def clear(self) -> None:
        self.of = _Numbers()
        self.used = dict.fromkeys(self.kinds, 0)

    def _add(self, **arrays: np.ndarray) -> None:
        for name, values in arrays.items():
            used, held = self.used[name], getattr(self, name)
            if used + len(values) > len(held):
                held, old = np.empty(2 * (used + len(values)), held.dtype), held
                held[:used] = old[:used]
                setattr(self, name, held)
            held[used : used + len(values)] = values
            self.used[name] = used + len(values)

    def learn(self) -> None:
        """Build the lattices of the fresh units."""
        if not self.of.fresh:
            return
        nodes, first, many, end, ids, log = self.vocabulary.arcs(self.of.fresh)
        self.of.fresh = []
        log = np.round(log * _FIX).astype(np.int64)
        node = np.repeat(np.arange(len(many)), many)
        top = np.flatnonzero(log == np.maximum.reduceat(log, first)[node])[::-1]
        likely = first.copy()
        likely[node[top]] = top  # the likeliest arc of a node changes places with its first: most draws end there
        for values in (end, ids, log):
            values[first], values[likely] = values[likely], values[first]
        plain = (ids < 0) & (ids >= -128)  # one byte is one piece
        ids[plain] = self.bytes[-1 - ids[plain]]
        prob = np.exp(log / _FIX)
        main = prob > 0.5  # of such an arc the others are summed: one minus it would cancel
        with np.errstate(divide="ignore"):  # -inf: no other arc leaves the node
            rest = np.where(main, np.log(np.add.reduceat(np.where(main, 0.0, prob), first)[node]), np.log1p(-np.where(main, 0.0, prob)))
        self._add(
            node0=np.cumsum(nodes) - nodes + self.used["many"], nodes=nodes, node=node + self.used["many"],
            first=first + self.used["id"], many=many, end=end, id=ids, log=log, prob=prob, rest=rest,
        )


class Batch:
    """The lattices of some texts, and the search over all of them at once."""

    def __init__(self, units: Units, texts: list[str], keys: np.ndarray, seed: int) -> None:
        if len(units.of) > UNITS or units.used["id"] > ARCS:
            units.clear()
        found, places, self.count = units.vocabulary.cut(texts)
        self.unit = np.fromiter(map(units.of.__getitem__, found), np.int64, len(found))[places]
        units.learn()
        self.units = units
        self.begin = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.key = _mix(keys.astype(np.uint64) + np.uint64(seed))
        self.nodes, self.node0 = units.nodes[self.unit], units.node0[self.unit]
        place = np.append(0, np.cumsum(self.nodes))
        self.place0 = place[:-1] - np.repeat(place[self.begin], self.count)  # places count from the start of each text

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One arc of each node by its probability."""
        units = self.units
        arc = units.first[node]
        last = arc + units.many[node] - np.int64(1)
        on = np.flatnonzero((u >= units.prob[arc]) & (arc < last))
        at, rest, last = arc[on], u[on], last[on]
        while len(on):
            rest = rest - units.prob[at]
            at = at + 1
            arc[on] = at
            more = (rest >= units.prob[at]) & (at < last)
            on, at, rest, last = on[more], at[more], rest[more], last[more]
        return arc

    def draw_other(self, node: int, u: float, barred: tuple[int, ...]) -> int:
        """One arc of a node by its probability, without those barred."""
        first = int(self.units.first[node])
        allowed = [a for a in range(first, first + int(self.units.many[node])) if a not in barred]
        probs = self.units.prob[allowed].tolist()
        at = u * sum(probs)
        for a, p in zip(allowed, probs, strict=True):
            at -= p
            if at < 0:
                break
        return a

    def walk(self, slot: np.ndarray, local: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From node ``local`` of each unit in ``slot`` to its end: (slot, arc) in order, and where each unit's arcs begin."""
        stirred = _stir(self.key, 2 * sample)[self.doc[slot]]
        nodes, node0, place0 = self.nodes[slot], self.node0[slot], self.place0[slot]
        length, now, found = np.zeros(len(slot), np.int64), local, []
        order = np.flatnonzero(now < nodes)
        now = now[order]
        while len(order):
            arc = self.draw(node0[order] + now, _unit_interval(_stir(stirred[order], place0[order] + now)))
            found.append((order, arc))
            length[order] += 1
            now = self.units.end[arc].astype(np.int64)
            inside = now < nodes[order]
            order, now = order[inside], now[inside]
        begin = np.append(0, np.cumsum(length))
        arcs = np.empty(begin[-1], np.int64)
        for k, (order, arc) in enumerate(found):
            arcs[begin[order] + k] = arc
        return np.repeat(slot, length), arcs, begin

    def fork(self, work: list[int], entries: list[tuple], sample: int) -> tuple:
        """Draw a path of each entry (an earlier path, the step where it is left, the arcs barred there).

        Returns all paths in a row (slot, arc, offset of each), the steps that
        each shares with its earlier one, the log of what leaves it at each
        step, and the arcs that are now barred at its fork.
        """
        units = self.units
        came = np.array([step for _, step, _ in entries], np.int64)
        first_u = _uniform(self.key[work], np.full(len(work), 2 * sample + 1), came).tolist()
        chosen, left, slots, locals_ = [], [], [], []
        for d, ((slot, arc), step, bar), u in zip(work, entries, first_u, strict=True):
            node = int(units.node[arc[step]])
            chosen.append(self.draw_other(node, u, bar))
            first = int(units.first[node])
            left.append(sum(units.prob[a] for a in range(first, first + int(units.many[node])) if a != chosen[-1] and a not in bar))
            slots.append(np.arange(slot[step], self.begin[d] + self.count[d]))
            locals_.append(np.zeros(len(slots[-1]), np.int64))
            locals_[-1][0] = units.end[chosen[-1]]
        slot, arc, begin = self.walk(np.concatenate(slots), np.concatenate(locals_), sample)
        cut = begin[np.append(0, np.cumsum([len(s) for s in slots]))]
        offset = np.append(0, np.cumsum(came + 1 + np.diff(cut)))
        all_slot, all_arc = np.empty(offset[-1], np.int64), np.empty(offset[-1], np.int64)
        for j, ((old_slot, old_arc), step, _) in enumerate(entries):
            at, fork = offset[j], offset[j] + step
            all_slot[at : fork + 1] = old_slot[: step + 1]
            all_arc[at:fork] = old_arc[:step]
            all_slot[fork + 1 : offset[j + 1]] = slot[cut[j] : cut[j + 1]]
            all_arc[fork + 1 : offset[j + 1]] = arc[cut[j] : cut[j + 1]]
        all_arc[offset[:-1] + came] = chosen
        rest = units.rest[all_arc]
        with np.errstate(divide="ignore"):
            rest[offset[:-1] + came] = np.log(left)
        return all_slot, all_arc, offset, came, rest, [(*bar, c) for (_, _, bar), c in zip(entries, chosen, strict=True)]

    def search(self, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """For each text up to k of (log p, key, inclusion, arcs), best first."""
        units, n = self.units, len(self.count)
        first_key = -np.log(-np.log(_uniform(self.key, np.full(n, 1), np.zeros(n))))
        queue: list[list[tuple]] = [[(float(first_key[d]), None)] for d in range(n)]
        done: list[list[tuple]] = [[] for _ in range(n)]
        for sample in range(k):
            work = [d for d in range(n) if queue[d]]
            if not work:
                break
            tops = [queue[d].pop(0) for d in work]
            if sample:
                slot, arc, offset, came, rest, bars = self.fork(work, [t[1] for t in tops], sample)
            else:
                every = np.arange(len(self.unit))
                slot, arc, begin = self.walk(every, np.zeros(len(every), np.int64), 0)
                offset = begin[np.append(self.begin, len(self.unit))]
                came, rest, bars = np.zeros(n, np.int64), units.rest[arc], [()] * n
            # all paths in a row: their log probabilities, and the sets that leave them
            long = np.diff(offset)
            through = np.append(0, np.cumsum(units.log[arc]))
            owner = np.repeat(np.arange(len(work)), long)
            step = np.arange(len(arc)) - offset[owner]
            open_ = np.flatnonzero((step >= came[owner]) & (rest > -np.inf))
            step, of = step[open_], owner[open_]
            mean = (through[open_] - through[offset[of]]) / _FIX + rest[open_]
            top = np.array([t[0] for t in tops])
            u = _unit_interval(_stir(_stir(self.key[work], 2 * sample + 1)[of], step + (1 << 40)))
            keys = _below(mean, top[of], u)
            bounds = np.searchsorted(of, np.arange(len(work) + 1)).tolist()
            total = ((through[offset[1:]] - through[offset[:-1]]) / _FIX).tolist()
            ends = offset.tolist()
            last = sample + 1 == k  # no more searching: only the best key of the rest is asked for
            if last:
                best_key = np.full(len(work), -np.inf)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    best_key[some] = np.maximum.reduceat(keys, np.array(bounds[:-1])[some])
                best_keys = best_key.tolist()
            for j, d in enumerate(work):
                path = (slot[ends[j] : ends[j + 1]], arc[ends[j] : ends[j + 1]])
                done[d].append((total[j], tops[j][0], path[1]))
                if last:
                    if best_keys[j] > -math.inf:
                        queue[d].append((best_keys[j], None))
                else:
                    a, b = bounds[j], bounds[j + 1]
                    for at in (a + np.argpartition(-keys[a:b], k)[: k + 1]).tolist() if b - a > k + 1 else range(a, b):
                        s = int(step[at])
                        bar = bars[j] if bars[j] and s == came[j] else (int(path[1][s]),)
                        queue[d].append((float(keys[at]), (path, s, bar)))
                queue[d].sort(key=lambda q: -q[0])
                del queue[d][k + 1 :]
        out = []
        for d in range(n):
            kappa = queue[d][0][0] if queue[d] else -math.inf
            out.append([(p, g, -math.expm1(-math.exp(min(p - kappa, 700.0))), arcs) for p, g, arcs in done[d]])
        return out

    def pieces(self, arcs: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Piece ids of a path; a character without a piece gives its bytes."""
        ids = self.units.id[arcs]
        if ids.min(initial=0) >= 0:
            return ids
        return np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [vocabulary.byte[b] for b in chr(-1 - i).encode()])], np.int64)


    def all_pieces(self, paths: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Where each path's piece ids end (from 0), and the ids of all paths in a row."""
        ends = np.append(0, np.cumsum([len(p) for p in paths]))
        ids = self.units.id[np.concatenate(paths)] if ends[-1] else np.zeros(0, np.int32)
        if ids.min(initial=0) < 0:
            each = [self.pieces(p, vocabulary) for p in paths]
            return np.append(0, np.cumsum([len(p) for p in each])), np.concatenate(each)
        return ends, ids


def decode_all(vocabulary: Vocabulary, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The texts of many rows of piece ids; only rows with bytes beyond ASCII are put together one by one."""
    shown = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), vocabulary.shown_strings.take(pa.array(ids)))
    texts = pc.utf8_slice_codeunits(pc.binary_join(shown, ""), 1)
    high = np.flatnonzero((ids >= vocabulary.high) & (ids < vocabulary.high + 128))
    if not len(high):
        return texts
    out = texts.to_pylist()
    for row in np.unique(np.searchsorted(ends, high, side="right") - 1).tolist():
        out[row] = decode_ids(vocabulary, ids[ends[row] : ends[row + 1]])
    return pa.array(out, pa.string())


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text that piece ids stand for."""
    first, high = vocabulary.byte[0], vocabulary.high
    if not ((ids >= high) & (ids < high + 128)).any():
        return "".join(vocabulary.shown_array[ids].tolist())[1:]
    out = bytearray()
    for i in ids.tolist():
        if first <= i < first + 256:
            out.append(i - first)
        else:
            out += vocabulary.shown[i].encode()
    return out.decode("utf-8")[1:]


_loaded: dict[str, Units] = {}


def units_of(path: str) -> Units:
    if path not in _loaded:
        _loaded[path] = Units(Vocabulary(path))
    return _loaded[path]


_SAMPLES = "id long, sample int, ids array<int>, log_prob double, gumbel double, inclusion double, decoded string"


def sample(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED,
    then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None,
) -> DataFrame:
    """id, sample (1..k), ids, log_prob, gumbel, inclusion, decoded for each row and sample.

    ``then``: a function of such a batch and the schema of what it returns, run
    in the same worker, for callers that want less than all ids and texts.
    """
    source = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    finish, schema = then or (lambda batch: batch, _SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(path)
        words = units.vocabulary

        def some(ids: list, texts: list[str]) -> pa.RecordBatch:
            batch = Batch(units, texts, np.array([i or 0 for i in ids], np.int64), seed)
            rows = [(i, at, *one) for i, found in zip(ids, batch.search(k), strict=True) for at, one in enumerate(found, 1)]
            name, at, log, key, inclusion, arcs = zip(*rows, strict=True)
            ends, pieces = batch.all_pieces(list(arcs), words)
            decoded = decode_all(words, ends, pieces)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pieces.astype(np.int32)))
            arrays = [pa.array(name, pa.int64()), pa.array(at, pa.int32()), lists, pa.array(log, pa.float64()), pa.array(key, pa.float64()), pa.array(inclusion, pa.float64()), decoded]
            return finish(pa.RecordBatch.from_arrays(arrays, names=["id", "sample", "ids", "log_prob", "gumbel", "inclusion", "decoded"]))

        try:
            for batch in batches:
                ids, texts, size = [], [], 0
                for row, value in zip(batch.column("id"), batch.column("text"), strict=True):  # one text at a time, not the batch
                    text = value.as_py()
                    ids.append(row.as_py())
                    texts.append(text)
                    size += len(text)
                    if size >= BATCH_CHARS:
                        yield some(ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    yield some(ids, texts)
        finally:
            units.release()

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids``: the library's best segmentation."""
    ids = F.pandas_udf(lambda s: s.fillna("").map(lambda t: model(path).encode(t)), "array<int>")
    return df.withColumn("ids", ids(df[text_col]))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of the ids."""
    text = F.pandas_udf(lambda s: s.map(lambda x: model(path).decode([int(i) for i in x]) if x is not None else None), "string")
    return df.withColumn("decoded", text(df[ids_col]))


_DIGESTS = "doc_id long, sample int, n_pieces long, ids_sha256 string, text_sha256 string, log_prob double, gumbel double, inclusion double"


def digests(samples: pa.RecordBatch) -> pa.RecordBatch:
    """Samples with digests in place of ids (as 32-bit little-endian numbers) and decoded text (as UTF-8)."""
    ids, text = samples.column("ids"), samples.column("decoded")
    ends, numbers = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<i4"))
    ids_sha = [hashlib.sha256(numbers[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
    text_sha = [hashlib.sha256(t.as_buffer()).hexdigest() for t in text]
    columns = [samples.column("id"), samples.column("sample"), pa.array(np.diff(ends).astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *map(samples.column, ("log_prob", "gumbel", "inclusion"))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _DIGESTS.split(", ")])


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample(docs, public_tokenizers.path("piece_bpe_32k.model"), then=(digests, _DIGESTS))


QUERIES = {"op1_lattice": op1_lattice}
ORACLES: dict[str, str] = {}
