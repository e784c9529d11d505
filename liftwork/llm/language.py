"""Language identification by unigram models with all segmentations summed.

The pieces come from a fixed public vocabulary; for each language their probabilities are trained
by expectation maximisation over all segmentations of the training words. A text's likelihood is
the product of its words' likelihoods, and a word's is the sum over all ways to write it in pieces,
by a forward algorithm that runs over the distinct words of a batch at once. Words are maximal
runs of letters in lower case with the vocabulary's word mark in front; letters that no piece
spells count as the unknown piece.

The classifier is fitted on about `most_docs` training documents of each language, those whose hash of doc_id lies
under a threshold that the language's count gives (a documented bound). Class priors count all training documents.

Defined cases: null text, and text without a letter, is `und` with score 0; with no labelled training
document all texts are; documents with null lang or null doc_id never train; repeated rows are scored
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bundled, documents, held, scratch, ship, slices, unbundled, widened
from .pieces import MARK, MODEL
from .tokens import tokenizer_path

MOST_DOCS, ROUNDS, CACHE, POINTS = 2000, 3, 300_000, 200_000
LETTERS = re.compile(r"[^\W\d_]+").findall
#: ASCII letters in lower case and bytes of other characters; the rest of ASCII parts words.
PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
UNKNOWN_SHARE = 1e-5


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of letters; the unknown piece has the number after them."""
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=path)
    names = (lib.id_to_piece(i) for i in range(lib.vocab_size()))
    good = dict.fromkeys(p for p in names if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha()))
    return {p: i for i, p in enumerate(good)}


class Trie:
    """The vocabulary as a dense table: next[row, class of character], rows of inner nodes alone; node 0 is dead, node 1 the root."""

    def __init__(self, vocab: dict[str, int]):
        self.unknown, self.longest = len(vocab), max(map(len, vocab))
        self.single = np.full(0x110000, self.unknown, np.int32)
        letters = sorted({c for p in vocab if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        prefixes = sorted({p[:k] for p in vocab for k in range(1, len(p))})  # inner nodes come first
        node = {x: i + 1 for i, x in enumerate(["", *prefixes])}
        for p in vocab:
            node.setdefault(p, len(node) + 1)
        self.inner = len(prefixes) + 2
        self.piece = np.full(len(node) + 1, -1, np.int32)
        self.next = np.zeros((self.inner, len(letters) + 1), np.int32)
        for p, i in vocab.items():
            self.piece[node[p]] = i
            if len(p) == 1:
                self.single[ord(p)] = i
        for p, n in node.items():
            if p and self.kind[ord(p[-1])]:
                self.next[node[p[:-1]], self.kind[ord(p[-1])]] = n


def trie(path: str) -> Trie:
    return Trie(vocabulary(path))


class Lattice:
    """The pieces of some words, longest word first: piece[l - 1][start + i] is the number of word[i:i+l], or -1."""

    def __init__(self, words: list[str], tree: Trie):
        self.order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        words = [words[i] for i in self.order]
        self.lengths = np.array(list(map(len, words)), np.int64)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        left = np.repeat(ends, self.lengths) - np.arange(len(points))  # characters up to the word's end
        kinds, node = tree.kind[points], np.ones(len(points), np.int32)
        rows = [tree.single[points]]
        for k in range(tree.longest):
            row = np.where(node < tree.inner, node, 0)
            node = tree.next[row, np.append(kinds[k:], np.zeros(k, np.uint16))[: len(points)]] * (left > k)
            if not node.any():
                break
            if k:
                rows.append(tree.piece[node])
        self.piece = np.array(rows, np.int32).reshape(len(rows), -1)
        self.longest = len(rows)
        self.sizes = np.arange(1, self.longest + 1)[:, None]
        top = int(self.lengths[0]) if len(words) else 0
        self.live = np.searchsorted(-self.lengths, -np.arange(top + 1), side="right")

    def step(self, ring: np.ndarray, p: np.ndarray, j: int, n: int, back: bool) -> np.ndarray:
        """The sums over the pieces that end at j (begin there, if `back`) of the first n words; ring holds the sums around j."""
        most, total, around = min(self.longest, j if not back else len(self.live) - 1 - j), np.zeros((n, p.shape[1])), len(ring)
        if n <= 16:  # long words are few: all sizes at once
            size = self.sizes[:most]
            at = j - size if not back else j + size
            first = np.where(back, j, at) + self.starts[:n]
            ids = self.piece[size - 1, np.minimum(first, self.piece.shape[1] - 1)]
            fits = at <= self.lengths[:n]
            return np.einsum("snk,snk->nk", ring[at % around, np.arange(n)], p[np.where(fits, ids, -1)])
        for size in range(1, most + 1):
            at = j - size if not back else j + size
            m = n if not back else self.live[at]
            ids = self.piece[size - 1, self.starts[:m] + min(j, at)]
            hit = np.flatnonzero(ids >= 0)
            total[hit] += ring[at % around, hit] * p[ids[hit]]
        return total

    def forward(self, p: np.ndarray, every: np.ndarray | None = None) -> np.ndarray:
        """Log likelihood of each word (in the order given) under each column of p; p's last row is 0, for no piece. every: takes the logs at all positions, for one column."""
        ring = np.zeros((self.longest + 1, len(self.lengths), p.shape[1]))
        ring[0] = 1
        scale, out = np.zeros(ring.shape[1:]), np.zeros(ring.shape[1:])
        for j in range(1, len(self.live)):
            n = self.live[j]
            total = self.step(ring, p, j, n, False)
            ring[j % len(ring), :n] = total
            ends = slice(self.live[j + 1] if j + 1 < len(self.live) else 0, n)
            out[ends] = np.log(total[ends]) + scale[ends]
            if every is not None:
                every[j, :n] = np.log(total[:, 0]) + scale[:n, 0]
            if j % 8 == 0:
                ring[:, :n] /= total
                scale[:n] += np.log(total)
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def backward(self, p: np.ndarray, every: np.ndarray) -> None:
        """Fills every[j, word] with the log of the sum over all segmentations of word[j:]."""
        ring, scale = np.zeros((self.longest + 1, len(self.lengths), 1)), np.zeros((len(self.lengths), 1))
        for j in range(len(self.live) - 1, -1, -1):
            n = self.live[j]
            ending = slice(self.live[j + 1] if j + 1 < len(self.live) else 0, n)
            total = self.step(ring, p, j, n, True)
            total[ending] = 1
            ring[j % len(ring), :n] = total
            every[j, :n] = np.log(total[:, 0]) + scale[:n, 0]
            if j % 8 == 0:
                ring[:, :n] /= total
                scale[:n] += np.log(total)

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations, words counted `times`."""
        times, top, w = times[self.order], len(self.live) - 1, len(self.lengths)
        a, b, out = np.zeros((top + 1, w)), np.zeros((top + 1, w)), np.zeros(len(p))
        self.forward(p[:, None], a)
        self.backward(p[:, None], b)
        with np.errstate(divide="ignore"):
            log = np.log(p)
        word = np.repeat(np.arange(w), self.lengths)
        place = np.arange(len(word)) - self.starts[word]
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(self.piece[size - 1] >= 0)
            ids, x, j = self.piece[size - 1, at], word[at], place[at]
            out += np.bincount(ids, times[x] * np.exp(a[j, x] + log[ids] + b[j + size, x] - b[0, x]), len(p))
        return out


def in_batches(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of words, longest first, in batches of at most `most` for longest x words (or one word)."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, most // int(lengths[order[i]]))
        yield order[i : i + n]
        i += n


def runs(word: bytes) -> list[str]:
    """The maximal runs of letters; whatever is no letter, also a subscript or a fraction, parts them."""
    found = LETTERS(word.decode().lower())
    return [MARK + part for x in found for part in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


class Scorer:
    """Log likelihoods of raw words, kept for the worker's later batches. p: pieces x languages, priors: log."""

    def __init__(self, p: np.ndarray, priors: np.ndarray, path: str):
        self.p, self.priors, self.tree = p, priors, trie(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.priors) + 1))

    def learn(self, words: list[bytes]) -> None:
        for some in in_batches(np.array([len(w) + 1 for w in words], np.int64), POINTS):
            part = [words[i] for i in some]
            cut = [runs(w) for w in part]
            flat = [x for c in cut for x in c]
            owner = np.repeat(np.arange(len(part)), [len(c) for c in cut])
            found = np.zeros((len(part), self.rows.shape[1]))
            if flat:
                np.add.at(found[:, :-1], owner, Lattice(flat, self.tree).forward(self.p))
                found[owner, -1] = 1
            at = len(self.known)
            while at + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(part)] = found
            self.known.update(zip(part, range(at, at + len(part)), strict=True))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language or -1, its posterior, has a letter)."""
        cut = [t.translate(PLAIN).split() for t in texts]
        new = {w for c in cut for w in c}
        if len(self.known) + len(new) > CACHE:
            self.clear()
        self.learn([w for w in new if w not in self.known])
        get = self.known.__getitem__
        total = np.array([self.rows[np.fromiter(map(get, c), np.int64, len(c))].sum(0) for c in cut]).reshape(len(texts), -1)
        has = total[:, -1] > 0
        if not len(self.priors):
            return np.full(len(texts), -1), np.zeros(len(texts)), has
        log = total[:, :-1] + self.priors
        best = log.argmax(1)
        score = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
        return np.where(has, best, -1), np.where(has, score, 0.0), has


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(docs: DataFrame, most_docs: int) -> tuple[DataFrame | None, list]:
    """(the documents to fit on, (lang, training documents) of each language). A hash threshold for each language needs no ranking."""
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy("lang").collect()]  # the classes of the model
    if not labels:
        return None, labels
    share = F.create_map(*(F.lit(x) for lang, n in labels for x in (lang, most_docs / n)))
    uniform = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(uniform < share[F.col("lang")]), labels


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over whole texts, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found: dict = defaultdict(Counter)
                for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                    found[lang].update(text.translate(PLAIN).split())
                for lang, words in found.items():
                    letters: Counter = Counter()
                    for w, n in words.items():
                        for x in runs(w):
                            letters[x] += n
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(letters), pa.string()), pa.array(list(letters), pa.string()), pa.array(list(letters.values()), pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most_docs: int = MOST_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, pieces x languages probabilities, log priors). The model's size is fixed by the vocabulary and the labels."""
    spark = docs.sparkSession
    ship(spark)
    where = path or tokenizer_path(MODEL)
    size = len(vocabulary(where)) + 1
    sample, labels = training(docs, most_docs)
    langs = [k for k, _ in labels]
    p = np.zeros((size + 1, len(langs)))
    p[:size] = 1 / size
    priors = np.log(np.array([n for _, n in labels], float) / max(1, sum(n for _, n in labels)))
    if not langs:
        return langs, p, priors
    words = scratch(word_counts(sample), "words")
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(p)

        def expect(parts: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            tree, sums = held(f"trie {where}", lambda: trie(where)), {}
            for part in parts:
                for lang, rows in part.groupby("lang"):
                    known, n = rows["word"].to_numpy(), rows["n"].to_numpy(float)
                    for some in in_batches(rows["word"].str.len().to_numpy(), POINTS):
                        got = Lattice(known[some].tolist(), tree).expected(model.value[:, langs.index(lang)], n[some])
                        sums[lang] = sums.get(lang, 0) + got
            for lang, got in sums.items():
                at = np.flatnonzero(got)
                yield pd.DataFrame({"lang": lang, "piece": at, "n": got[at]})

        found = words.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # pieces x languages
        counts = np.zeros((size, len(langs)))
        counts[found["piece"], found["lang"].map({k: i for i, k in enumerate(langs)})] = found["n"]
        counts += 0.05
        counts[-1] = np.maximum(counts[-1], UNKNOWN_SHARE * counts.sum(0))
        p = np.vstack([counts / counts.sum(0), np.zeros((1, len(langs)))])
    return langs, p, priors


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], path: str | None = None) -> DataFrame:
    """`docs` with __lang_pred and __score; it needs a column text."""
    ship(docs.sparkSession)
    langs, p, priors = model
    where, name = path or tokenizer_path(MODEL), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((p, priors))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(f"language {name}", lambda: Scorer(*shared.value, where))
        for batch in batches:
            for part, texts in slices(batch):
                best, score, _ = scorer.score(texts)
                said = pa.array([langs[i] if i >= 0 else "und" for i in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, said, pa.array(score, pa.float64())], [*part.schema.names, "__lang_pred", "__score"])

    return docs.mapInArrow(predict, widened(docs, {"__lang_pred": "string", "__score": "double"}))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.5) -> DataFrame:
    """Documents with a language that is likelier than all others together."""
    found = with_language(bundled(docs), fit(docs.select("doc_id", "lang", "text")))
    return unbundled(found.filter((F.col("__lang_pred") != "und") & (F.col("__score") >= least_score)), docs.columns)
