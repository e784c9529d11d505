"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is normalised as the model asks (white space to its mark, one mark in front) and cut into
words where no piece can cross. The distinct words that are new to the worker are laid out in flat
arrays of symbols; each round finds the best-ranked pair of every word by a segmented minimum,
merges its leftmost occurrence in all words at once and compacts the arrays, until no pair is
left. One merge for each word and round keeps the library's order exactly, also where a merge makes
a pair that ranks before another occurrence. Words of more than LONG symbols would need as many
rounds, so a heap merges those in the same order.

Symbols that are no piece fall back to their bytes. Decoding joins the pieces' bytes, restores
spaces and drops the one in front. Null text counts as empty and encodes to the end id alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, held, ship, slices
from .tokens import tokenizer_path

MODEL, MARK, LONG, CACHE = "piece_bpe_32k.model", "▁", 200, 700_000


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        inner = [not (byte[i] or lib.is_control(i) or lib.is_unknown(i)) for i in range(n)]
        self.ids = {names[i]: i for i in range(n) if inner[i]}
        self.byte_ids = [next(i for i in range(n) if byte[i] and int(names[i][1:-1], 16) == b) for b in range(256)]
        self.bytes = [names[i].replace(MARK, " ").encode() if inner[i] else bytes([int(names[i][1:-1], 16)]) if byte[i] else b"" for i in range(n)]
        assert not any(MARK in p.lstrip(MARK) for p in self.ids), "a piece crosses words"
        self.end = lib.eos_id()
        # pairs of symbols that merge; a symbol is a piece's id, or n + code point where it is none
        # best score first; pieces of equal score rank alike, so that their leftmost pair merges first
        self.rank_of = np.unique([-lib.get_score(i) for i in range(n)], return_inverse=True)[1].astype(np.int64)
        self.pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k], len(piece[:k]) == 1 and n + ord(piece[0])), self.ids.get(piece[k:], len(piece[k:]) == 1 and n + ord(piece[-1]))
                if a and b:
                    self.pairs[a, b] = i
        self.base = 1 << 22
        keys = np.array([a * self.base + b for a, b in self.pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], np.array(list(self.pairs.values()), np.int64)[by]
        self.n = n
        alone = "".join(sorted(c for c in "\n\t\r" if not any(c in p for p in self.ids)))
        self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + f"|[{alone}]" * bool(alone)).findall
        self.known: dict[str, tuple[bytes, int, bytes]] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The symbols that are left of each word, by merge rounds over all words."""
        out: list = [None] * len(words)
        for i in [i for i, w in enumerate(words) if len(w) > LONG]:
            out[i] = self.merge_long(words[i])
        todo = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
        sizes = np.array([len(words[i]) for i in todo], np.int64)
        points = np.frombuffer("".join(words[i] for i in todo).encode("utf-32-le"), "<u4").astype(np.int64)
        table, inverse = np.unique(points, return_inverse=True)
        symbols = np.array([self.ids.get(chr(c), self.n + c) for c in table.tolist()], np.int64)[inverse]
        word = np.repeat(np.arange(len(todo)), sizes)
        none = 1 << 40
        while len(symbols):
            made = np.full(len(symbols), -1)
            made[:-1] = np.where(word[:-1] == word[1:], self.lookup(symbols[:-1], symbols[1:]), -1)
            rank = np.where(made >= 0, self.rank_of[made], none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            done = best == none
            lengths = np.diff(np.append(starts, len(symbols)))
            for k in np.flatnonzero(done):  # finished words leave the arrays
                out[todo[word[starts[k]]]] = symbols[starts[k] : starts[k] + lengths[k]]
            hit = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank != none))
            hit = hit[np.unique(word[hit], return_index=True)[1]]  # the leftmost of each word
            symbols[hit] = made[hit]
            stay = np.repeat(~done, lengths)
            stay[hit + 1] = False
            symbols, word = symbols[stay], word[stay]
        return out

    def merge_long(self, word: str) -> np.ndarray:
        symbols: list = [self.ids.get(c, self.n + ord(c)) for c in word]
        left, right = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (m := self.pairs.get((symbols[i], symbols[right[i]]))) is not None:
                heapq.heappush(heap, (int(self.rank_of[m]), i, symbols[i], symbols[right[i]], m))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if symbols[i] != a or right[i] < 0 or symbols[right[i]] != b:
                continue
            gone, symbols[i] = right[i], m
            symbols[gone], right[i] = -1, right[gone]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return np.array([x for x in symbols if x >= 0], np.int64)

    def spelled(self, symbols: np.ndarray) -> list[int]:
        """Ids, with the bytes of symbols that are no piece."""
        return [x for s in symbols.tolist() for x in ([s] if s < self.n else [self.byte_ids[b] for b in chr(s - self.n).encode()])]

    def words(self, text: bytes) -> list[str]:
        return self.cut(MARK + text.decode().replace(" ", MARK)) if text else []

    def encode(self, texts: list[bytes]) -> list[list[tuple[bytes, int, bytes]]]:
        """For each text, its words' (decimal ids, number of ids, decoded bytes)."""
        cut = [self.words(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set(chain.from_iterable(cut))
        todo = list(new)
        for k in range(0, len(todo), 50_000):
            part = todo[k : k + 50_000]
            for w, s in zip(part, self.merge(part), strict=True):
                ids = self.spelled(s)
                self.known[w] = " ".join(map(str, ids)).encode(), len(ids), self.joined(ids)
        get = self.known.__getitem__
        return [list(map(get, c)) for c in cut]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """As the library decodes; bytes that are no UTF-8 are left to it."""
        text = self.joined(ids)
        try:
            return text.removeprefix(b" ").decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)


def pieces(path: str) -> Pieces:
    return held(f"pieces {path}", lambda: Pieces(path))


def encode_ids(texts: list[bytes], path: str) -> list[list[int]]:
    """The ids of each text with the end id."""
    p = pieces(path)
    return [[int(x) for w in words for x in w[0].split()] + [p.end] for words in p.encode(texts)]


def piece_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of `df` (doc_id, text)."""
    ship(df.sparkSession)
    where = path or tokenizer_path(MODEL)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(where)
        end = str(p.end).encode()
        for batch in batches:
            for part, texts in slices(batch):
                found = p.encode(texts)
                ids = [hashlib.sha256(b" ".join([*(w[0] for w in words), end])).hexdigest() for words in found]
                back = [hashlib.sha256(b"".join([w[2] for w in words]).removeprefix(b" ")).hexdigest() for words in found]
                n = [sum([w[1] for w in words]) + 1 for words in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))
