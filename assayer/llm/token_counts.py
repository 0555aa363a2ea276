"""Token counts by finite-state transducers, exact for byte-level BPE.

Two deterministic transducers are compiled from the tokenizer's file:

* ``SPLIT`` cuts a text into the pre-tokenizer's pieces. It reads character
  classes and has a dozen states; a transition says whether a piece begins here
  or one character back. Texts are cut into chunks of equal length; every chunk
  is run from all states at once (its state map), the maps are composed by a
  parallel prefix scan, and each chunk is run again from the state in which the
  scan says it begins. All steps are numpy operations over all chunks.
* ``CountTransducer`` reads the bytes of the whole text, with the cuts marked;
  a transition carries the change in the number of tokens, and a cut leads back
  to the start from any state. It rests on the local test for BPE (a token
  sequence is the canonical one if each adjacent pair is): the last token of
  every prefix is unique, so the state is the set of tokens under way, each with
  the token before it and its count. The text's chunks are run all at once, each
  from the start state: behind its first cut a chunk's map is constant, so its
  end state and the tokens behind the cut are final. The part before the cut
  (all of a chunk inside a long piece) is then run from the end state of the
  chunk before it, and again wherever a scan along the chunks shows that this
  state wasn't the right one; as the automaton forgets its past within a few
  tokens, one round nearly always does, and the number of rounds never changes
  the result. Transitions are compiled into a dense table when first taken; when
  it is full, only the states that chunks are in are carried over to a new one,
  also in the midst of a piece, which changes no result.

A text's count is the sum of the changes over its bytes; special tokens' strings
split a text before that and count one each, as in the library's default.

Defined results: a null or empty text has 0 bytes and 0 tokens; very long texts
are chunked like any other (about 60 bytes of memory a character of one text); a
null id is kept; repeated rows stay repeated; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import table

LIMIT = 512
CHUNK = 256
#: Characters that are worked on together.
BATCH_CHARS = 1 << 21
MAX_STATES = 1 << 17
MAX_FUTURES = 1 << 18
#: Below a trie node with at most so many tokens a state keeps those that can still be taken.
FEW_TOKENS = 32

_CLASSES = ("letter", "stmd", "r", "e", "v", "l", "number", "space", "blank", "quote", "symbol", "end")
_C = {name: k for k, name in enumerate(_CLASSES)}
_STATES = ("start", "space", "spaces", "blank", "blanks", "letters", "numbers", "symbols", "quote", "quote_r", "quote_v", "quote_l")
_S = {name: k for k, name in enumerate(_STATES)}
_HERE, _BACK = 1, 2
_END = 0x110000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, and of the end mark behind the last one."""
    out = np.full(_END + 1, _C["symbol"], np.uint8)
    for point in range(_END):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = _C["letter"]
        elif kind == "N":
            out[point] = _C["number"]
    for point in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[point] = _C["blank"]
    for text, name in (("stmd", "stmd"), ("r", "r"), ("e", "e"), ("v", "v"), ("l", "l"), (" ", "space"), ("'", "quote")):
        for c in text:
            out[ord(c)] = _C[name]
    out[_END] = _C["end"]
    return out


@lru_cache(maxsize=1)
def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """next state and emitted marks by (state, class), flattened."""
    letters = {"letter", "stmd", "r", "e", "v", "l"}
    kind_state = {**dict.fromkeys(letters, "letters"), "number": "numbers", "symbol": "symbols"}
    fresh = {**kind_state, "space": "space", "blank": "blank", "quote": "quote", "end": "start"}
    step = np.zeros((len(_STATES), len(_CLASSES)), np.uint8)
    mark = np.zeros_like(step)

    def put(state: str, cls: str, to: str, marks: int) -> None:
        step[_S[state], _C[cls]], mark[_S[state], _C[cls]] = _S[to], marks

    for state in _STATES:
        for cls in _CLASSES:
            put(state, cls, fresh[cls], _HERE)  # unless said otherwise, a piece begins here
    for state in ("space", "spaces", "blank", "blanks"):
        back = _BACK if state in ("spaces", "blanks") else 0  # the last blank of several stands apart
        for cls in (*kind_state, "quote"):
            if state in ("space", "spaces"):  # one space joins the piece behind it
                put(state, cls, kind_state.get(cls, "symbols"), back)
            else:
                put(state, cls, fresh[cls], back | _HERE)
        put(state, "space", "spaces", 0)
        put(state, "blank", "blanks", 0)
    for cls in letters:
        put("letters", cls, "letters", 0)
    put("numbers", "number", "numbers", 0)
    for state in ("symbols", "quote"):
        for cls in ("symbol", "quote"):
            put(state, cls, "symbols", 0)
    put("quote", "stmd", "start", 0)
    for cls in ("r", "v", "l"):
        put("quote", cls, f"quote_{cls}", 0)
    for state, closing in (("quote_r", "e"), ("quote_v", "e"), ("quote_l", "l")):
        for cls in _CLASSES:
            to, marks = step[_S["letters"], _C[cls]], mark[_S["letters"], _C[cls]]
            step[_S[state], _C[cls]], mark[_S[state], _C[cls]] = to, marks | _BACK
        put(state, closing, "start", 0)
    return step.ravel(), mark.ravel()


def piece_marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a piece (or an end mark) begins."""
    step, mark = split_transducer()
    width = len(_CLASSES)
    n = len(classes)
    chunks = max(1, -(-n // chunk))
    grid = np.full(chunks * chunk, _C["end"], np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, chunk).T)
    wide = (step.astype(np.uint8) * width).astype(np.uint8)  # states as row offsets; 12 * 12 fits a byte
    maps = np.repeat((np.arange(len(_STATES), dtype=np.uint8) * width)[:, None], chunks, axis=1)
    for row in grid:
        maps = wide[maps + row]
    scan, span = maps, 1  # inclusive scan: scan[s, k] is the state after chunks 0..k from state s
    while span < chunks:
        after = scan.copy()
        after[:, span:] = np.take_along_axis(scan[:, span:], (scan[:, :-span] // width).astype(np.intp), axis=0)
        scan, span = after, span * 2
    state = np.r_[np.zeros(1, np.uint8), scan[0, :-1]]
    emitted = np.empty_like(grid)
    for k, row in enumerate(grid):
        at = state + row
        emitted[k] = mark[at]
        state = wide[at]
    flat = emitted.T.ravel()[:n]
    out = (flat & _HERE).astype(bool)
    out[:-1] |= (flat[1:] & _BACK).astype(bool)
    return out


class CountTransducer:
    """Bytes of one piece -> number of BPE tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.specials = [t["content"] for t in data["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        of_char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.merges: dict[tuple[bytes, bytes], int] = {}
        read = lambda t: bytes(of_char[c] for c in t)
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[read(a), read(b)] = rank
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}  # rank, left and right part of the merge that completes a token
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: dict[int, bytes] = {}
        for text in data["model"]["vocab"]:
            token = read(text) if all(c in of_char for c in text) else b""
            parts, last = self.canonical(token)
            if token and parts == [token]:
                self.made[token] = (self.merges[last], *last) if last else (-1, token, token)
                node = 0
                for b in token:
                    if b not in self.trie[node]:
                        self.trie[node][b] = len(self.trie)
                        self.trie.append({})
                    node = self.trie[node][b]
                self.token_at[node] = token
        self.futures: dict[tuple[int, bytes], tuple[int, ...]] = {}
        self.first, self.last, self.below = self._spans()
        self.reset([])

    def _spans(self) -> tuple[list[int], list[int], list[int]]:
        """For each trie node its place in depth-first order, the last place below it, and the number of tokens below it."""
        first, last, below = [0] * len(self.trie), [0] * len(self.trie), [0] * len(self.trie)
        at, stack = 0, [(0, False)]
        while stack:
            node, left = stack.pop()
            if left:
                last[node] = at - 1
                below[node] = sum(below[c] + (c in self.token_at) for c in self.trie[node].values())
            else:
                first[node] = at
                at += 1
                stack.append((node, True))
                stack += [(c, False) for c in self.trie[node].values()]
        return first, last, below

    def reset(self, live: list[np.ndarray]) -> None:
        """Forget all transitions; the arrays of state numbers in ``live`` are renumbered in place."""
        used = sorted({0, *(int(x) for states in live for x in np.unique(states))})
        keys = [self.states[x] for x in used] if live else [((0, b"", 0),)]
        for states in live:
            states[:] = np.searchsorted(used, states)
        self.states = keys
        self.ids = {key: k for k, key in enumerate(keys)}
        self.table = np.full((max(1 << 12, 2 * len(keys)), 256), -1, np.int32)  # 7 bits of change + 64, below them the state

    def canonical(self, text: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Plain BPE, for reading the vocabulary only: the tokens and the last merge."""
        parts, last = [text[i : i + 1] for i in range(len(text))], None
        while len(parts) > 1:
            ranked = [(self.merges.get(p, 1 << 30), i) for i, p in enumerate(pairwise(parts))]
            rank, at = min(ranked)
            if rank == 1 << 30:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether plain BPE leaves the two side by side.

        Their merges are undone from the last one back, along the edge where
        they meet; the parts that face each other then must not have a merge
        that comes before the one just undone (of equal merges the left one is
        made first).
        """
        if not before:
            return True
        a, b, limit = before, token, 1 << 30
        while self.merges.get((a, b), limit) >= limit:
            (rank_a, _, inner_a), (rank_b, inner_b, _) = self.made[a], self.made[b]
            if rank_a > rank_b:
                a, limit = inner_a, rank_a
            elif rank_b >= 0:
                b, limit = inner_b, rank_b + 1
            else:
                return True
        return False

    def ahead(self, node: int, before: bytes) -> bytes | tuple[int, ...] | None:
        """What must be known of the token before one that is under way at ``node``.

        With few tokens below the node, those that may follow ``before`` (none:
        nothing comes of it): states then differ only if their futures do.
        """
        if self.below[node] > FEW_TOKENS:
            return before
        found = self.futures.get((node, before))
        if found is None:
            if len(self.futures) > MAX_FUTURES:
                self.futures.clear()
            stack, fit = list(self.trie[node].values()), []
            while stack:
                at = stack.pop()
                token = self.token_at.get(at)
                if token is not None and self.fits(before, token):
                    fit.append(at)
                stack += self.trie[at].values()
            found = self.futures[node, before] = tuple(sorted(fit))
        return found or None

    def compile(self, state: int, byte: int) -> None:
        moved, accepted = [], None
        for node, past, count in self.states[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token_at.get(child)
            if accepted is None and token is not None and (child in past if isinstance(past, tuple) else self.fits(past, token)):
                accepted = (token, count + 1)
            if self.trie[child]:
                if isinstance(past, tuple):
                    past = tuple(x for x in past if x != child and self.first[child] <= self.first[x] <= self.last[child]) or None  # noqa: PLW2901
                else:
                    past = self.ahead(child, past)  # noqa: PLW2901
                if past is not None:
                    moved.append((child, past, count))
        token, change = accepted
        if not -64 <= change < 64:
            raise ValueError(f"a byte changes the number of tokens by {change}")
        key = (*((n, b, c - change) for n, b, c in moved), (0, token, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            if to == len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        self.table[state, byte] = (change + 64) << 24 | to

    def step(self, state: np.ndarray, symbols: np.ndarray, live: list[np.ndarray]) -> np.ndarray:
        """Packed transitions of many states at once; ``state`` must be one of ``live``."""
        found = self.table[state, symbols]
        if found.size and found.min() < 0:
            missing = np.unique(state[found < 0] << 8 | symbols[found < 0])
            if len(self.states) + len(missing) > MAX_STATES:
                self.reset(live)
                missing = np.unique(state << 8 | symbols)
            for at in missing.tolist():
                if self.table[at >> 8, at & 255] < 0:
                    self.compile(at >> 8, at & 255)
            found = self.table[state, symbols]
        return found

    def changes(self, symbols: np.ndarray, begins: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Change in the number of tokens at each byte; ``begins``: where a piece begins."""
        n = len(symbols)
        chunks = max(1, -(-n // chunk))
        grid, cut = np.zeros(chunks * chunk, np.int64), np.ones(chunks * chunk, bool)
        grid[:n], cut[:n] = symbols, begins
        grid, cut = np.ascontiguousarray(grid.reshape(chunks, chunk).T), np.ascontiguousarray(cut.reshape(chunks, chunk).T)
        out = np.empty((chunk, chunks), np.int8)
        exits = np.zeros(chunks, np.int64)
        live = [exits]
        for k in range(chunk):  # every chunk from the start state
            exits[cut[k]] = 0
            found = self.step(exits, grid[k], live)
            out[k] = (found >> 24) - 64
            exits[:] = found & 0xFFFFFF
        head = np.where(cut.any(axis=0), cut.argmax(axis=0), chunk)
        used = np.zeros(chunks, np.int64)  # the states that heads were run from: so far the start state
        live = [exits, used]
        while True:
            wrong = np.flatnonzero((head[1:] > 0) & (exits[:-1] != used[1:])) + 1
            if not len(wrong):
                break
            wrong = wrong[np.argsort(-head[wrong], kind="stable")]  # those still before their cut are the first ones
            state = exits[wrong - 1].copy()
            used[wrong] = state
            many = np.searchsorted(-head[wrong], -np.arange(head[wrong[0]]), side="left")
            for k, m in enumerate(many.tolist()):
                now = state[:m]
                found = self.step(now, grid[k, wrong[:m]], [now, state[m:], exits, used])
                out[k, wrong[:m]] = (found >> 24) - 64
                now[:] = found & 0xFFFFFF
            inside = head[wrong] == chunk  # no cut in the chunk: its end state is that of the head
            exits[wrong[inside]] = state[inside]
        return out.T.ravel()[:n]

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, owner, totals = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            split = [text]
            for special in self.specials:
                split = [x for part in split for x in part.split(special)]
            totals[k] = len(split) - 1
            parts += split
            owner += [k] * len(split)
        whole = chr(0).join(["", *parts])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes + 1) - sizes  # each part lies behind an end mark
        points[starts - 1] = _END
        marks = piece_marks(class_table()[np.append(points, np.uint32(_END))])[:-1]
        symbols = np.frombuffer(whole.encode(), np.uint8)
        places = np.flatnonzero(symbols & 0xC0 != 0x80)  # the first byte of each character
        begins = np.zeros(len(symbols), bool)
        begins[places[marks]] = True
        begins[places[starts - 1]] = True
        through = np.append(0, np.cumsum(self.changes(symbols, begins), dtype=np.int64))
        places = np.append(places, len(symbols))
        behind = np.append(starts - 1, len(points))[1:]  # the end mark behind each part
        for k, n in zip(owner, (through[places[behind]] - through[places[starts]]).tolist(), strict=True):
            totals[k] += n
        return totals


_loaded: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    if path not in _loaded:
        _loaded[path] = CountTransducer(path)
    return _loaded[path]


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row."""
    source = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(tokenizer_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            held: list[str] = []
            size = 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    counts += counter.count_texts(held)
                    held, size = [], 0
            if held:
                counts += counter.count_texts(held)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
