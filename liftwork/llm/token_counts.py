"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other:

* The pre-tokenizer, over character classes, with an output on each transition that says whether a
  pretoken starts there. Texts are cut into chunks of equal length; for each chunk the transducer
  runs from every state at once, which gives the chunk's state map, and a parallel prefix scan
  composes the maps, so that each chunk knows the state it starts in.
* The byte-pair encoder, over the bytes of a pretoken, with the change of the token count on each
  transition. After a prefix its state holds, for every start of a longer vocabulary string that
  the prefix may still complete, the trie node reached, the token that ends there and the count
  since. That is enough, as an encoding is right exactly when all neighbouring tokens are, and each
  prefix of an encoding is the encoding of that prefix. States are compiled when first met and
  stay for the worker's life; past a bounded number the table starts anew. Runs of more than LONG bytes without
  a cut (base64, scripts without spaces) hardly meet a state twice, so the same transitions are taken without
  being kept: for each prefix the one token that may end it, found by a trie of reversed tokens.

Special strings inside texts count as one token each, and text around them is cut there, as the
library does.

Defined cases: null text is empty; empty text has no tokens; repeated rows are counted each; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, ship, slices
from .tokens import BYTES, tokenizer_path

CHUNK = 2048
STATES, LONG, PAIRS = 250_000, 96, 2_000_000
SLICE = 2 << 20
#: Character classes of the pre-tokenizer.
SPACE, WHITE, QUOTE, S, T, R, E, V, M, L, D, LETTER, NUMBER, OTHER = range(14)


def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    for a, b in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = WHITE
    table[0x20], table[0x27] = SPACE, QUOTE
    for k, c in enumerate("strevmld"):
        table[ord(c)] = S + k
    return table


class PreTokenizer:
    """Transitions and outputs of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.

    White space before a non-space splits off its last character, so outputs may concern the character before: bit 1
    says that a pretoken starts here, bit 2 that one starts one character earlier.
    """

    START, IN_L, IN_N, IN_O, ONE_SPACE, ONE_WHITE, MANY_SPACE, MANY_WHITE, QUOTED, Q_R, Q_V, Q_L, SHORT = range(13)
    N = 13

    def __init__(self):
        self.to = np.zeros((self.N, 14), np.uint8)
        self.out = np.zeros((self.N, 14), np.uint8)
        letters = set(range(S, LETTER + 1))
        for s in range(self.N):
            for c in range(14):
                self.to[s, c], self.out[s, c] = self.step(s, c, letters)

    def step(self, s: int, c: int, letters: set[int]) -> tuple[int, int]:
        kind = self.IN_L if c in letters else self.IN_N if c == NUMBER else self.IN_O
        if c in (SPACE, WHITE):
            many = s in (self.ONE_SPACE, self.ONE_WHITE, self.MANY_SPACE, self.MANY_WHITE)
            to = {(0, SPACE): self.ONE_SPACE, (0, WHITE): self.ONE_WHITE, (1, SPACE): self.MANY_SPACE, (1, WHITE): self.MANY_WHITE}[many, c]
            return to, 0 if many else 1
        if s == self.ONE_SPACE:  # the space belongs to what follows
            return kind, 0
        if s == self.MANY_SPACE:
            return kind, 2
        if s in (self.ONE_WHITE, self.MANY_WHITE):
            return (self.QUOTED if c == QUOTE else kind), 1 | 2 * (s == self.MANY_WHITE)
        if s == self.QUOTED:
            if c in (S, T, M, D):
                return self.SHORT, 0
            if c in (R, V, L):
                return {R: self.Q_R, V: self.Q_V, L: self.Q_L}[c], 1
            return (kind, 0) if kind == self.IN_O else (kind, 1)
        if (s in (self.Q_R, self.Q_V) and c == E) or (s == self.Q_L and c == L):
            return self.SHORT, 4  # takes back the start of the letter before
        if s in (self.Q_R, self.Q_V, self.Q_L):
            s = self.IN_L
        if s == kind:
            return kind, 0
        return (self.QUOTED if c == QUOTE else kind), 1

    def starts(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pretoken starts at each character; `first` marks where a text starts."""
        n = len(classes)
        rows = -(-n // CHUNK)
        grid = np.zeros(rows * CHUNK, np.uint8)
        grid[:n] = classes
        fresh = np.zeros(rows * CHUNK, bool)
        fresh[:n] = first
        grid, fresh = grid.reshape(rows, CHUNK).T.copy(), fresh.reshape(rows, CHUNK).T.copy()
        state = np.repeat(np.arange(self.N, dtype=np.uint8)[:, None], rows, 1)  # from every state at once
        flat = self.to.ravel()
        for c, f in zip(grid, fresh, strict=True):
            if f.any():
                state[:, f] = self.START
            state = flat[state.astype(np.intp) * 14 + c]
        entry = self.scan(state)
        out = np.zeros((CHUNK, rows), np.uint8)
        said = self.out.ravel()
        for k in range(CHUNK):
            if fresh[k].any():
                entry = np.where(fresh[k], self.START, entry)
            at = entry.astype(np.intp) * 14 + grid[k]
            out[k], entry = said[at], flat[at]
        out = out.T.ravel()[:n]
        found = (out & 1).astype(bool) | first
        found[:-1] |= (out[1:] & 2).astype(bool) & ~first[1:]
        found[:-1] &= ~((out[1:] & 4).astype(bool) & ~first[1:])
        return found

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """The state before each chunk: exclusive prefix composition of the chunks' state maps, by doubling."""
        maps, reach = maps.astype(np.intp), 1
        columns = np.arange(maps.shape[1])
        while reach < maps.shape[1]:
            later = maps[:, reach:]
            maps = np.concatenate([maps[:, :reach], later[maps[:, :-reach], columns[: later.shape[1]]]], 1)
            reach *= 2
        return np.concatenate([[self.START], maps[self.START, :-1]]).astype(np.uint8)


class Encoder:
    """The byte-pair transducer: state 0 is the start; to[state, class] and change[state, class]."""

    def __init__(self, path: str):
        data = json.load(open(path))
        letters = {c: b for b, c in byte_letters().items()}
        vocab = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in {a["content"] for a in data["added_tokens"]}}
        self.special = [a["content"].encode() for a in data["added_tokens"]]
        self.ranks = {}
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = k
        self.tokens = list(vocab)
        self.child: dict[int, int] = {}  # 256 * node + byte -> node
        self.token = array("i", [-1])
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                after = self.child.get(256 * node + b)
                if after is None:
                    after = self.child[256 * node + b] = len(self.token)
                    self.token.append(-1)
                node = after
            self.token[node] = i
        self.inner = bytearray(len(self.token))  # nodes with children
        for k in self.child:
            self.inner[k >> 8] = 1
        self.fits: dict[int, bool] = {}
        self.ending: dict[int, int] = {}  # 256 * node + byte -> node of the reversed tokens
        self.ended: list[int] = []
        self.column = np.full(256, -1, np.int16)
        self.reset()

    def reset(self) -> None:
        self.states: dict[bytes, int] = {}
        self.what: list[bytes] = []
        self.fits.clear()
        self.to = self.change = None  # frees the old table first
        self.to = np.zeros((STATES + STATES // 8, 32 * (self.column.max() // 32 + 4)), np.int32)  # 0: not compiled; memory is taken when it is written
        self.change = np.zeros(self.to.shape, np.int8)
        self.number([(0, -1, 0)])

    def number(self, entries: list[tuple[int, int, int]]) -> int:
        key = array("i", chain.from_iterable(entries)).tobytes()
        k = self.states.get(key)
        if k is None:
            k = self.states[key] = len(self.what)
            self.what.append(key)
            if k == len(self.to):
                more = len(self.to) // 2
                self.to = np.concatenate([self.to, np.zeros_like(self.to[:more])])
                self.change = np.concatenate([self.change, np.zeros_like(self.change[:more])])
        return k

    def merged(self, symbols: list[bytes]) -> list[bytes]:
        """Byte-pair merges by the definition, for two tokens at a time."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair, out, i = (symbols[at], symbols[at + 1]), [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def right(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side (a = -1: the start)."""
        key = (a + 1 << 20) + b
        if key not in self.fits:
            x, y = self.tokens[a] if a >= 0 else b"", self.tokens[b]
            self.fits[key] = self.merged([bytes([c]) for c in x + y]) == ([x, y] if x else [y])
        return self.fits[key]

    def compile(self, state: int, byte: int) -> None:
        """Adds the transition. A key is (trie node, token before it, count since) for each open start."""
        entries = array("i", self.what[state])
        moved = [(after, last, since) for n, last, since in zip(entries[::3], entries[1::3], entries[2::3], strict=True) if (after := self.child.get(256 * n + byte)) is not None]
        node, last, since = next(x for x in moved if self.token[x[0]] >= 0 and self.right(x[1], self.token[x[0]]))
        change = 1 - since
        to = self.number([*((n, t, s + change) for n, t, s in moved if self.inner[n]), (0, self.token[node], 0)])
        if self.column[byte] < 0:
            self.column[byte] = self.column.max() + 1
            if self.column[byte] == self.to.shape[1]:
                more = np.zeros((len(self.to), 32), np.int8)
                self.to, self.change = np.hstack([self.to, more.astype(np.int32)]), np.hstack([self.change, more])
        self.to[state, self.column[byte]] = to + 1
        self.change[state, self.column[byte]] = change

    def reverse(self) -> None:
        """The trie of reversed tokens, made when a long run is first met."""
        self.ended.append(-1)
        for i, t in enumerate(self.tokens):
            node = 0
            for b in reversed(t):
                after = self.ending.get(256 * node + b)
                if after is None:
                    after = self.ending[256 * node + b] = len(self.ended)
                    self.ended.append(-1)
                node = after
            self.ended[node] = i

    def long_count(self, data: bytes) -> int:
        """Tokens of one run: for each prefix its last token and count, from those of the prefixes before."""
        if not self.ended:
            self.reverse()
        if len(self.fits) > PAIRS:
            self.fits.clear()
        ending, ended, fits = self.ending.get, self.ended, self.fits.get
        last, count = array("i", [-1]), array("i", [0])
        for i in range(1, len(data) + 1):
            node, at = 0, i
            while True:  # exactly one token may end here
                at -= 1
                node = ending(256 * node + data[at])
                token = ended[node]
                if token >= 0:
                    before = last[at]
                    good = fits((before + 1 << 20) + token)
                    if good or (good is None and self.right(before, token)):
                        break
            last.append(token)
            count.append(count[at] + 1)
        return count[-1]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken data[start:end]: all pretokens step together, the longest last; long runs go one by one."""
        out = np.empty(len(starts), np.int32)
        short = ends - starts <= LONG
        for i in np.flatnonzero(~short).tolist():
            out[i] = self.long_count(data[starts[i] : ends[i]].tobytes())
        out[short] = self.short_counts(data, starts[short], ends[short])
        return out

    def short_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.what) > STATES:
            self.reset()
        order = np.argsort(starts - ends, kind="stable")  # longest first
        at, lengths = starts[order], (ends - starts)[order]
        live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right") if len(lengths) else []
        state = np.zeros(len(at), np.int32)
        total = np.zeros(len(at), np.int32)
        for k, n in enumerate(live):
            byte = data[at[:n] + k]
            s = state[:n]
            column = self.column[byte]
            missing = (column < 0) | (self.to[s, column] == 0)
            if missing.any():
                for x in np.unique(s[missing].astype(np.int64) * 256 + byte[missing]):
                    self.compile(int(x >> 8), int(x & 255))
                column = self.column[byte]
            total[:n] += self.change[s, column]
            state[:n] = self.to[s, column] - 1
        out = np.empty(len(at), np.int32)
        out[order] = total
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: bytes that print stand for themselves, the rest count up from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


def compiled(path: str) -> tuple[np.ndarray, PreTokenizer, Encoder]:
    return held(f"transducers {path}", lambda: (class_table(), PreTokenizer(), Encoder(path)))


def count_tokens(texts: list[bytes], path: str) -> np.ndarray:
    """Tokens of each text."""
    classes, cutter, encoder = compiled(path)
    extra = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for special in encoder.special:
            extra[i] += t.count(special)
        parts = [t]
        for special in encoder.special if extra[i] else ():
            parts = [y for x in parts for y in x.split(special)]
        pieces += [x for x in parts if x]
        owner += [i for x in parts if x]
    if not pieces:
        return extra
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which characters start
    points = np.frombuffer(b"".join(pieces).decode().encode("utf-32-le"), "<u4")
    text_starts = np.cumsum([0, *map(len, pieces)])
    first = np.zeros(len(points), bool)
    first[np.searchsorted(lead, text_starts[:-1])] = True
    starts = lead[cutter.starts(classes[points], first)]
    ends = np.append(starts[1:], len(data))
    of_piece = np.searchsorted(text_starts, starts, side="right") - 1
    found = np.bincount(np.array(owner)[of_piece], encoder.counts(data, starts, ends), len(texts))
    return extra + found.astype(np.int64)


def token_counts(df: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of `df` (doc_id, text)."""
    ship(df.sparkSession)
    where = path or tokenizer_path(BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, most=SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(count_tokens(texts, where))], ["doc_id", "n_bytes", "n_tokens"])

    found = df.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
