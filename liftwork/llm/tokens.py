"""Token ids of whole texts by a public tokenizer file, and flat token files.

Texts are cut, in numpy, where the tokenizer's own pre-tokenizer always cuts; each distinct chunk is
encoded once by the tokenizers library, and a text's ids are gathered from those of its chunks. A hash
finds the distinct chunks of a batch, then every chunk is compared with the one that stands for it, byte
for byte; texts with a chunk that differs go to the library whole. The cache over batches goes by the bytes
themselves; it is bounded and starts anew when it is full. Texts that hold the tokenizer's special
strings, or white space that the cut does not know, go to the library whole too.

Defined cases: null and empty texts have the end id alone; equal and null doc_ids are all written, nulls
first; extra columns are not read; an empty table gives no file and an empty result.

Token files: documents are range-partitioned by doc_id, and each task writes `.ids` (flat unsigned
integers), `.offsets` (unsigned 64-bit document starts inside the file) and `.docs` (the doc_ids)
to the shared folder under a name of its own attempt, then moves them into place, so a task that
is repeated leaves one copy. Prefix sums over the files' sizes give each file's base, the number
of ids before it. Readers map the files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_folder
from .common import documents, filesystem, held, partitions, scratch, ship, slices

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Distinct chunks, and bytes of them, that a Python worker keeps.
CACHE, CACHE_BYTES = 600_000, 24 << 20


BLOCK = 1 << 18
_random = np.random.default_rng(7)
LETTER = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
POWERS, INVERSES = (np.cumprod(np.full(BLOCK, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: differences of prefix polynomials, a block of chunks at a time. Different chunks may share one."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = starts[i], ends[j - 1]
        if high - low > BLOCK:  # one very long chunk
            out[i] = xxhash.xxh3_64_intdigest(data[low:high].tobytes())
        else:
            upto = np.zeros(high - low + 1, np.uint64)
            np.cumsum(LETTER[data[low:high]] * POWERS[: high - low], out=upto[1:])
            out[i:j] = (upto[ends[i:j] - low] - upto[starts[i:j] - low]) * INVERSES[starts[i:j] - low]
        i = j
    x = out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The chunks that are not, byte for byte, the one that stands for them (chunk first[inverse])."""
    length, model = ends - starts, first[inverse]
    long = length != length[model]
    same = np.flatnonzero(~long & (model != np.arange(len(model))))
    bad, i = [np.flatnonzero(long)], 0
    upto = np.cumsum(length[same])
    while i < len(same):
        base = upto[i] - length[same[i]]
        j = max(i + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
        some = same[i:j]
        n = length[some]
        step = np.arange(upto[j - 1] - base, dtype=np.int32)
        begin = upto[i:j] - n - base
        differ = data[np.repeat(starts[some] - begin, n) + step] != data[np.repeat(starts[model[some]] - begin, n) + step]
        if differ.any():
            bad.append(some[np.unique(np.searchsorted(upto[i:j] - base, np.flatnonzero(differ), "right"))])
        i = j
    return np.concatenate(bad)


class Encoder:
    """ids(texts) for one tokenizer file. separator: a string whose one id no chunk's ids contain."""

    def __init__(self, path: str, separator: str, special: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only keep memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.separator, self.special = separator, special
        self.mark = self.library.encode(separator, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError(f"{path} has no id of its own for {separator!r}")
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}  # chunk -> place in begin and size
        self.bytes = 0
        self.begin, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk, by the library; many chunks go through one call with the separator between."""
        texts = [c.decode() for c in chunks]
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.separator not in t]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        joined = [self.separator.join([texts[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            assert len(cuts) == len(g) - 1
            for i, a, b in zip(g, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True):
                out[i] = ids[a:b]
        for i in set(range(len(texts))).difference(plain):
            out[i] = np.frombuffer(self.whole(chunks[i]), "<u4")
        return out

    def learn(self, chunks: list[bytes]) -> None:
        found = self.encode_chunks(chunks)
        sizes = np.array(list(map(len, found)), np.int64)
        n, at = len(self.known), self.used
        self.used += int(sizes.sum())
        while n + len(chunks) > len(self.size):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : self.used] = np.concatenate(found)
        self.begin[n : n + len(sizes)], self.size[n : n + len(sizes)] = at + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.bytes += sum(map(len, chunks))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        odd = [self.special in t or self.uncut(t) for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        data = np.frombuffer(raw := b"".join(plain), np.uint8)
        text_starts = np.cumsum([0, *map(len, plain)])
        starts, ends = self.cut(data, text_starts)
        _, first, inverse = np.unique(chunk_hashes(data, starts, ends), return_index=True, return_inverse=True)
        bad = unlike(data, starts, ends, first, inverse)
        if len(bad):  # these texts do not go by their chunks
            of = set((np.searchsorted(text_starts, starts[bad], "right") - 1).tolist())
            lone = iter([i in of for i in range(len(plain))])
            return self.mixed(texts, [o or next(lone) for o in odd])
        chunks = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        place = list(map(self.known.get, chunks))  # one look-up for each distinct chunk
        if missing := [i for i, k in enumerate(place) if k is None]:
            if len(self.known) + len(missing) > CACHE or self.bytes > CACHE_BYTES:
                self.clear()
                missing = range(len(chunks))
            self.learn([chunks[i] for i in missing])
            place = [self.known[x] for x in chunks]
        place = np.array(place, np.int64)[inverse]
        n = self.size[place]
        upto = np.cumsum(n)
        flat = self.flat[np.repeat(self.begin[place] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        edges = np.concatenate([[0], upto])[np.searchsorted(starts, text_starts)].tolist()
        done = iter([flat[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)])
        return [self.whole(t) if o else next(done) for t, o in zip(texts, odd, strict=True)]

    def mixed(self, texts: list[bytes], alone: list[bool]) -> list[bytes]:
        """Texts that go to the library whole, and the others by their chunks."""
        rest = iter(Encoder.ids(self, [t for t, o in zip(texts, alone, strict=True) if not o]))
        return [self.whole(t) if o else next(rest) for t, o in zip(texts, alone, strict=True)]


WHITE, LETTERS, MARKS = np.zeros((3, 256), bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTERS[[*range(65, 91), *range(97, 123)]] = True
MARKS[33:127] = ~LETTERS[33:127]


def after_letter(data: np.ndarray) -> np.ndarray:
    """Where an ASCII mark or digit follows an ASCII letter: both tokenizers always cut there."""
    out = MARKS[data]
    out[1:] &= LETTERS[data[:-1]]
    out[:1] = False
    return out


class WordEncoder(Encoder):
    """Chunks are runs between ASCII white space, cut after letters; case does not matter."""

    def __init__(self, path: str):
        super().__init__(path, "<|startoftext|>", b"<|")
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def uncut(self, text: bytes) -> bool:
        return False

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return super().ids([t if self.special in t else t.lower() for t in texts])  # ASCII alone; the library does the rest

    def encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Words of ASCII letters are one pretoken each, so that one space between them is enough to tell them apart."""
        words = [i for i, c in enumerate(chunks) if c.isalpha()]
        rest = [i for i, c in enumerate(chunks) if not c.isalpha()]
        out: list = [None] * len(chunks)
        for i, x in zip(rest, super().encode_chunks([chunks[i] for i in rest]), strict=True):
            out[i] = x
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for g, e in zip(groups, self.library.encode_batch_fast([b" ".join([chunks[i] for i in g]).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            for i, a, b in zip(g, [0, *ends], ends, strict=False):
                out[i] = ids[a:b]
            assert len(ends) == len(g)
        return out

    def cut(self, data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(data) + 1, bool)
        edge[text_starts] = True
        word, inside = ~WHITE[data], after_letter(data)
        starts = word & (edge[:-1] | ~np.append(False, word[:-1])[: len(data)] | inside)
        ends = word & (edge[1:] | ~np.append(word[1:], False)[: len(data)] | np.append(inside[1:], False)[: len(data)])
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class ByteEncoder(Encoder):
    """A chunk is a run of non-space with the one space before it, cut after letters, or other white space: the last character of a run before a word stands alone."""

    def __init__(self, path: str):
        super().__init__(path, "\n", b"<|endoftext|>")

    def uncut(self, text: bytes) -> bool:
        """Whether white space outside ASCII (U+0085, U+00A0 and so on) may be in the text."""
        if text.isascii():
            return False
        return any(x in text for x in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")) or (b"\xe2\x80" in text and WIDE(text) is not None)

    def cut(self, data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        white = WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[text_starts] = True
        before = np.append(False, white[:-1])[: len(data)] & ~edge[:-1]
        word_next = np.append(~white[1:], False)[: len(data)] & ~edge[1:]
        after_other = before & np.append(False, data[:-1] != 32)[: len(data)]
        starts = np.flatnonzero(edge[:-1] | (white & (~before | word_next)) | (~white & after_other) | after_letter(data))
        return starts, np.append(starts[1:], len(data)) if len(starts) else starts


#: Fixed value: the pattern of words that `WordEncoder` cuts by.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space in the general punctuation block.
WIDE = re.compile(b"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]").search


def encoder_for(path: str) -> Encoder:
    """The encoder whose cuts agree with the file's own normaliser, pre-tokenizer and suffix, whatever the file is called; other kinds raise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, cut, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("model", {})
    steps = [n["type"] for n in (before or {}).get("normalizers", [])]
    parts = [p["type"] for p in cut.get("pretokenizers", [])]
    if model.get("type") == "BPE" and not model.get("dropout"):
        if before is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not model.get("end_of_word_suffix"):
            return ByteEncoder(path)
        if steps == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and model.get("end_of_word_suffix") == "</w>":
            split = cut["pretokenizers"][0]
            if split["pattern"].get("Regex") == WORD_PATTERN and split["behavior"] == "Removed" and split["invert"] and not cut["pretokenizers"][1]["use_regex"]:
                return WordEncoder(path)
    raise ValueError(f"{path}: its normaliser and pre-tokenizer are of no kind that texts can be cut for")


def encoder(path: str) -> Encoder:
    """The worker's encoder for `path`: it stays for later tasks."""
    return held(f"tokens {path}", lambda: encoder_for(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


NULL_ID = np.iinfo(np.int64).min


def token_files(df: DataFrame, path: str | None = None, end_id: int = 1, dtype: str = "<u2") -> DataFrame:
    """Writes the ids of `df` (doc_id, text) in ascending doc_id order to the shared folder; returns the index of the files.

    dtype: an unsigned type that holds the vocabulary. The index has part, stem, n_docs, n_ids and base, the number
    of ids in all files before it. Equal doc_ids are ordered by text hash and text; null doc_ids come first, null text is empty.
    """
    spark = df.sparkSession
    ship(spark)
    tokenizer, folder = path or tokenizer_path(WORDS), f"{new_folder(spark)}/tokens"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}"
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        mine = {kind: f"{top}/.{stem}-{kind}-{task.taskAttemptId()}" for kind in ("ids", "offsets", "docs")}
        out = {kind: fs.open_output_stream(f) for kind, f in mine.items()}
        end, n_docs, n_ids = np.array([end_id], "<u4").tobytes(), 0, 0
        for batch in batches:
            for part, texts in slices(batch, most=2 << 20):
                ids = [x + end for x in encoder(tokenizer).ids(texts)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                out["ids"].write(np.frombuffer(b"".join(ids), "<u4").astype(dtype).tobytes())
                out["offsets"].write((n_ids + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                out["docs"].write(part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_ids = n_docs + len(ids), n_ids + int(sizes.sum())
        for kind, f in mine.items():
            out[kind].close()
            fs.move(f, f"{top}/{stem}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), f"{folder}/{stem}", n_docs, n_ids)], ["part", "stem", "n_docs", "n_ids"])

    ranges = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # a small sample, however long the texts are
    placed = df.select("doc_id", "text").repartitionByRange(partitions(spark), *ranges).sortWithinPartitions(*ranges, "text")
    index = scratch(placed.mapInArrow(write, "part long, stem string, n_docs long, n_ids long"), "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return scratch(index.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "bases")


def mapped(uri: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """The values low:high of the file: of a memory map where the file system is local, else by ranged reads."""
    fs, path = filesystem(uri)
    if isinstance(fs, LocalFileSystem):
        whole = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        return lambda low, high: whole[low:high]
    file, width = fs.open_input_file(path), np.dtype(dtype).itemsize
    return lambda low, high: np.frombuffer(file.read_at((high - low) * width, low * width), dtype)


def read_token_files(index: DataFrame, dtype: str = "<u2", docs_at_once: int = 2000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            ids, docs, starts = mapped(row["stem"] + ".ids", dtype), mapped(row["stem"] + ".docs", "<i8"), mapped(row["stem"] + ".offsets", "<u8")
            for k in range(0, row["n_docs"], docs_at_once):
                last = k + docs_at_once >= row["n_docs"]
                a = starts(k, min(k + docs_at_once + 1, row["n_docs"])).astype(np.int64)
                a = np.append(a, row["n_ids"]) if last else a
                crc = [zlib.crc32(ids(x, y).astype("<u4").tobytes()) for x, y in zip(a[:-1].tolist(), a[1:].tolist(), strict=True)]
                d = np.array(docs(k, min(k + docs_at_once, row["n_docs"])))
                yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == NULL_ID), pa.array(a[:-1] + row["base"]), pa.array(np.diff(a)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = index.select("stem", "base", "n_docs", "n_ids").repartition(partitions(index.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(token_files(documents(spark, sf_dir)))
