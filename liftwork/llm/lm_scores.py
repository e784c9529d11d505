"""Stupid-backoff scores as relational joins of n-gram count tables with exploded n-grams.

A document's score is the sum of log S(w | v) over its words, v being the word before (a start mark for the
first): count(v w) / count(v) where the pair occurs in the counted documents, else 0.4 count(w) / N, with at
least one for count(w). `train` says which documents are counted (none given: all). With `apart` every document is scored
by the counts of all other documents: its own n-grams are taken off all four counts, so what one document alone says
backs off, and a document that occurs twice is known from its copy. The order is two.

Exploded bigrams are shuffled in columns: a task takes the documents of one batch, keeps each distinct pair
once with its documents, how often it is in them and how often they have the two words, and sends one row of flat
arrays to each hash bucket. Buckets go by the pair's first word, so that a bucket holds all pairs of a context; hot
contexts go by the whole pair instead. In a bucket the counts are sums over equal pairs, joined at once to the pairs that
they came from. Pairs without a count take the count of their second word: from a broadcast table of common words, or
in the bucket of that word, where the table of the others is. Partial sums of a batch's documents meet by batch.

Words are common from a share of 2^-20 of all occurrences on, at most 2^20 of them. Words and pairs are hot beyond 2^20
occurrences, or beyond a share of 2^-20 where that is more: at most 2^20 of each, in tables that are broadcast with
exact counts. Hot pairs are scored from their table, where they stand, and never shuffled, so a bucket does not grow
with the corpus.

Words are runs of anything but ASCII white space, as they stand, known by 48 bits of a hash. Defined cases: null and empty
texts score 0; repeated rows are scored each, and each is the other's other document; with no counted document every
count is one of N = 1; empty tables give empty results; very long texts are a batch of their own; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, scratch, ship, slices
from .near_dedup import mix, word_hashes

ALPHA, HOT, COMMON, GROUP_BYTES, SLICE = 0.4, 1 << 20, 1 << 20, 32 << 20, 3 << 20
START, MASK = np.uint64(0x5354415254), np.uint64((1 << 48) - 1)


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def pack(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, and four more for those that need it."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u4").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=n)
    return out


def squeezed(data: bytes) -> bytes:
    """Small numbers are half as large with their entropy coded, which shuffles do not do."""
    return zstandard.compress(data, 1)


def _plain(column: pa.ChunkedArray) -> list:
    return [None if x is None else zstandard.decompress(x) for x in column.to_pylist()]


def places(here: np.ndarray) -> bytes:
    """Ascending numbers of documents, by their differences."""
    return squeezed(np.diff(here, prepend=0).astype("<u2").tobytes())


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, hashes of all words, number of the text of each)."""
    hashes = [word_hashes(t.split()) & MASK for t in texts]
    sizes = np.array(list(map(len, hashes)), np.int64)
    return sizes, np.concatenate(hashes), np.repeat(np.arange(len(texts)), sizes)


def words_before(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    first = np.append(START, words[:-1])[: len(words)]
    first[np.append(True, doc[1:] != doc[:-1])[: len(doc)]] = START
    return first


def own_counts(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word how often its document has it, and how often the document has the word before as a context."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((words, doc))
    run, starts = _runs(doc[order], words[order])
    own = np.empty(len(words), np.int64)
    own[order] = np.diff(np.append(starts, len(words)))[run]
    opens = np.append(True, doc[1:] != doc[:-1])
    last = words[np.append(np.flatnonzero(opens)[1:], len(words)) - 1][np.cumsum(opens) - 1]
    context = np.ones(len(words), np.int64)
    context[1:] = np.where(opens[1:], 1, own[:-1] - (words[:-1] == last[:-1]))
    return own, context


def valued(n: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log S, but for the division by N where it backs off; whether it does)."""
    seen = n > 0
    return np.where(seen, np.log(np.maximum(n, 1)) - np.log(np.maximum(c, 1)), np.log(ALPHA * np.maximum(w, 1))), ~seen


def unigrams(docs: DataFrame) -> DataFrame:
    """h, n (occurrences), c (occurrences as a context) in the counted documents, and a (occurrences in all), with a row for the start mark."""

    def rows(h: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in columns)], ["h", "n", "c", "a"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                sizes, words, doc = words_of(texts)
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                every, own = train.all(), train[doc]
                if not every:
                    h, a = np.unique(words, return_counts=True)
                    none = np.zeros(len(h) + 1)
                    yield rows(np.append(h, START), none, none, np.append(a, (sizes > 0).sum()))
                h, n = np.unique(words[own], return_counts=True)
                last = words[np.cumsum(sizes)[(sizes > 0) & train] - 1]
                c = n - np.bincount(np.searchsorted(h, last), minlength=len(h)) if len(h) else n
                n, c = np.append(n, 0), np.append(c, len(last))
                yield rows(np.append(h, START), n, c, np.maximum(n, c) if every else 0 * n)

    return docs.mapInArrow(count, "h long, n long, c long, a long").groupBy("h").agg(*(F.sum(x).alias(x) for x in "nca"))


class Words:
    """Some words with their counts: sorted hashes h, occurrences n and, as a context, c."""

    def __init__(self, words: pa.Table):
        h, n, c = (words[x].to_numpy() for x in "hnc")
        order = np.argsort(h.view(np.uint64))
        self.h, self.n, self.c = h.view(np.uint64)[order], n[order], c[order]

    def place(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        if not len(self.h):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.h, words), len(self.h) - 1)
        return np.where(self.h[at] == words, at, -1)


class Hot(Words):
    """Hot words, and hot pairs of them (sorted codes, occurrences)."""

    def __init__(self, words: pa.Table):
        super().__init__(words)
        self.codes, self.pair_n = np.empty(0, np.int64), np.empty(0, np.int64)

    def code(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The code of each pair of hot words, or -1."""
        a, b = self.place(first), self.place(second)
        return np.where((a >= 0) & (b >= 0), a * len(self.h) + b, -1)

    def learn(self, pairs: pa.Table) -> None:
        code, n = pairs["code"].to_numpy(), pairs["n"].to_numpy()
        order = np.argsort(code)
        self.codes, self.pair_n = code[order], n[order]

    def buckets(self, first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
        """Of hot contexts by the pair, of others by the context."""
        key = np.where(self.place(first) >= 0, mix(first * np.uint64(3) + second), mix(first))
        return (key % np.uint64(n)).astype(np.int64)


def pairs_of_hot_words(docs: DataFrame, hot: Hot) -> DataFrame:
    """code, n, a (occurrences in the counted documents and in all) of the pairs whose words are both hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                _, words, doc = words_of(texts)
                code = hot.code(words_before(words, doc), words)
                both = code >= 0
                codes, of, a = np.unique(code[both], return_inverse=True, return_counts=True)
                n = np.bincount(of, part.column("train").to_numpy(zero_copy_only=False)[doc[both]], len(codes))
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64)), pa.array(a)], ["code", "n", "a"])

    return docs.mapInArrow(count, "code long, n long, a long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


BLOCK = "bucket long, slice long, first binary, runs binary, second binary, trained binary, posts binary, doc binary, times binary, own_c binary, own_w binary, total binary, backed binary, doc_ids array<long>, words binary"
SUMS = "slice long, total binary, backed binary, bucket long, second binary, doc binary, times binary, own_w binary, batches binary, runs binary, doc_ids array<long>, words binary"


def exploded(docs: DataFrame, hot: Hot, buckets: int, apart: bool) -> DataFrame:
    """The bigrams of each batch of documents, a row for each bucket, and a row with the batch's documents and their sums over hot pairs."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                sizes, second, doc = words_of(texts)
                first = words_before(second, doc)
                own_w, own_c = own_counts(second, doc) if apart else np.zeros((2, len(second)), np.int64)
                total, backed = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if len(hot.codes):
                    code = hot.code(first, second)
                    at = np.minimum(np.searchsorted(hot.codes, code), len(hot.codes) - 1)
                    known = hot.codes[at] == code
                    at, who = at[known], doc[known]
                    _, same, often = np.unique(who * len(hot.codes) + at, return_inverse=True, return_counts=True)
                    value, off = valued(hot.pair_n[at] - apart * often[same], hot.c[hot.codes[at] // len(hot.h)] - own_c[known], hot.n[hot.codes[at] % len(hot.h)] - own_w[known])
                    total, backed = np.bincount(who, value, len(texts)), np.bincount(who, off, len(texts))
                    first, second, doc, own_w, own_c = (x[~known] for x in (first, second, doc, own_w, own_c))
                bucket = hot.buckets(first, second, buckets)
                order = np.lexsort((doc, second, first, bucket))
                first, second, doc, bucket, own_w, own_c = (x[order] for x in (first, second, doc, bucket, own_w, own_c))
                changes = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                post = np.flatnonzero(np.append(True, changes | (doc[1:] != doc[:-1]))[: len(doc)])  # a pair in a document
                times, doc, own_w, own_c = np.diff(np.append(post, len(doc))), doc[post], own_w[post], own_c[post]
                new = np.flatnonzero(np.append(True, (first[post][1:] != first[post][:-1]) | (second[post][1:] != second[post][:-1]))[: len(post)])
                posts, trained, train = np.diff(np.append(new, len(post))), None, part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                first, second, bucket = first[post][new], second[post][new], bucket[post][new]
                if not train.all() and len(new):
                    trained = np.add.reduceat(train[doc] * times, new)
                rows = [[-1, nth, *[None] * 9, total.tobytes(), squeezed(pack(backed.astype(np.int64))), part.column("doc_id").to_pylist(), sizes.tobytes()]]
                names, starts = np.unique(bucket, return_index=True)
                for b, low, high in zip(names.tolist(), starts, np.append(starts[1:], len(new))[: len(names)], strict=True):
                    at, some = slice(low, high), slice(new[low], new[high] if high < len(new) else len(doc))
                    contexts, runs = np.unique(first[at], return_counts=True)  # sorted already: each context once, with its pairs
                    counted = trained[at].astype("<u4").tobytes() if trained is not None else None
                    own = [squeezed(pack(own_c[some])), squeezed(pack(own_w[some]))] if apart else [None, None]
                    rows.append([b, nth, contexts.tobytes(), runs.astype("<u4").tobytes(), pack48(second[at]), counted, squeezed(posts[at].astype("<u4").tobytes()), squeezed(doc[some].astype("<u2").tobytes()), squeezed(pack(times[some])), *own, None, None, None, None])
                nth += 1
                types = [pa.int64(), pa.int64(), *[pa.binary()] * 11, pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in BLOCK.split(", ")])

    return docs.mapInArrow(explode, BLOCK)


def _many(column: list, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    parts = [np.frombuffer(x, dtype) for x in column]
    return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run of equal keys for each sorted row, run starts)."""
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _counts(column: list, sizes: np.ndarray) -> np.ndarray:
    """All counts of a packed column whose rows have so many; zeros where it is not there."""
    return np.concatenate([np.zeros(n, np.int64) if x is None else unpack(x, n) for x, n in zip(column, sizes.tolist(), strict=True)])


def _table(rows: list, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def pair_scores(blocks: DataFrame, hot: Hot, common: Words, buckets: int, apart: bool) -> DataFrame:
    """Joins the counts of pairs and contexts to the pairs of each bucket; pairs without a count, and of words that are not common, go on."""

    def join(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            columns = (table[c].to_pylist() for c in ("slice", "total", "backed", "doc_ids", "words"))
            return _table([[s, t, k, -1, *[None] * 6, d, w] for s, t, k, d, w in zip(*columns, strict=True)], SUMS)
        first = np.repeat(_many(table["first"].to_pylist(), "<u8")[0], _many(table["runs"].to_pylist(), "<u4")[0])
        second = np.concatenate([unpack48(x) for x in table["second"].to_pylist()])
        (posts, _), (doc, docs_of_row) = _many(_plain(table["posts"]), "<u4"), _many(_plain(table["doc"]), "<u2")
        times, own_c, own_w = (_counts(_plain(table[c]), docs_of_row) for c in ("times", "own_c", "own_w"))
        pair = np.repeat(np.arange(len(posts)), posts)
        occurs = np.bincount(pair, times, len(posts)).astype(np.int64)
        if table["trained"].null_count < table.num_rows:
            ends = np.cumsum([len(x) // 6 for x in table["second"].to_pylist()])
            for t, end in zip(table["trained"].to_pylist(), ends, strict=True):
                if t is not None:
                    occurs[end - len(t) // 4 : end] = np.frombuffer(t, "<u4")
        order = np.lexsort((second, first))
        run, starts = _runs(first[order], second[order])
        pair_count, context_count = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        pair_count[order] = np.add.reduceat(occurs[order], starts)[run]
        context, context_starts = _runs(first[order])
        context_count[order] = np.add.reduceat(occurs[order], context_starts)[context]
        at = hot.place(first)
        context_count[at >= 0] = hot.c[at[at >= 0]]
        n = pair_count[pair] - (times if apart else 0)
        unseen = n <= 0
        place, bare = np.full(len(first), -2), np.unique(pair[unseen])
        place[bare] = common.place(second[bare])
        at = place[pair]
        known = unseen & (at >= 0)
        value, _ = valued(n, context_count[pair] - own_c, np.where(known, common.n[np.maximum(at, 0)] if len(common.n) else 0, 0) - own_w)
        left = unseen & ~known
        value = np.where(left, 0.0, value) * times
        rows, low = [], 0
        batch = np.repeat(np.array(table["slice"].to_pylist()), docs_of_row)
        for s, m in zip(table["slice"].to_pylist(), docs_of_row.tolist(), strict=True):
            mine = slice(low, low + m)
            here, which = np.unique(doc[mine], return_inverse=True)
            off = unseen[mine] * times[mine]
            backed = squeezed(pack(np.bincount(which, off, len(here)).astype(np.int64))) if off.any() else None
            rows.append([s, np.bincount(which, value[mine], len(here)).tobytes(), backed, -1, None, places(here), *[None] * 6])
            low += m
        if left.any():  # one row for each bucket of second words, over all batches
            word = second[pair[left]]
            target = (mix(word) % np.uint64(buckets)).astype(np.int64)
            turn = np.lexsort((batch[left], target))
            target, word, batch, doc, times, own_w = target[turn], word[turn], batch[left][turn], doc[left][turn], times[left][turn], own_w[left][turn]
            names, starts = np.unique(target, return_index=True)
            for b, x, y in zip(names.tolist(), starts, np.append(starts[1:], len(turn)), strict=True):
                which, runs = np.unique(batch[x:y], return_counts=True)
                rows.append([None, None, None, b, pack48(word[x:y]), squeezed(doc[x:y].astype("<u2").tobytes()), squeezed(pack(times[x:y])), squeezed(pack(own_w[x:y])) if apart else None, which.tobytes(), runs.astype("<u4").tobytes(), None, None])
        return _table(rows, SUMS)

    # as many partitions as buckets: both grow with the corpus
    dealt = blocks.withColumn("of", F.when(F.col("bucket") < 0, F.col("slice"))).repartition(buckets, "bucket", "of")
    return dealt.groupBy("bucket", "of").applyInArrow(lambda t: join(t.drop(["of"])), SUMS)


def backed_off(unseen: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """Joins the counts of words that are not common to the pairs that no counted document has."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((mix(h) % np.uint64(buckets)).astype(np.int64)), *batch.columns], ["bucket", "h", "n"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        h, n = right["h"].to_numpy().view(np.uint64), right["n"].to_numpy()
        order = np.argsort(h)
        h, n = np.append(h[order], np.uint64(0)), np.append(n[order], 0)
        rows = []
        if left.num_rows:
            words = np.concatenate([unpack48(x) for x in left["second"].to_pylist()])
            (doc, sizes), (batches, _), (runs, _) = _many(_plain(left["doc"]), "<u2"), _many(left["batches"].to_pylist(), "<i8"), _many(left["runs"].to_pylist(), "<u4")
            times, own = _counts(_plain(left["times"]), sizes), _counts(_plain(left["own_w"]), sizes)
            at = np.minimum(np.searchsorted(h[:-1], words), len(h) - 1)
            value = np.log(ALPHA * np.maximum(np.where(h[at] == words, n[at], 0) - own, 1)) * times
            batch = np.repeat(batches, runs)
            order = np.argsort(batch, kind="stable")
            names, starts = np.unique(batch[order], return_index=True)
            for s, x, y in zip(names.tolist(), starts, np.append(starts[1:], len(order)), strict=True):
                here, which = np.unique(doc[order[x:y]], return_inverse=True)
                rows.append([s, np.bincount(which, value[order[x:y]], len(here)).tobytes(), None, -1, None, places(here), *[None] * 6])
        return _table(rows, SUMS)

    table = counts.select("h", "n").mapInArrow(hashed, "bucket long, h long, n long")
    return unseen.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(lambda left, right: join(left, right), SUMS)


def gathered(sums: DataFrame, total: int, apart: bool) -> DataFrame:
    """Adds the partial sums of each batch's documents, and the division by N for what backed off."""

    def add(table: pa.Table) -> pa.Table:
        ids = next(x for x in table["doc_ids"].to_pylist() if x is not None)
        words = next(np.frombuffer(w, "<i8") for d, w in zip(table["doc_ids"].to_pylist(), table["words"].to_pylist(), strict=True) if d is not None)
        sums, backed = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        parts = [x for x in zip(*(table[c].to_pylist() for c in ("total", "doc", "backed")), strict=True) if x[0] is not None]
        for t, d, b in sorted(parts, key=lambda x: (x[0], x[1] or b"")):  # in one order, whatever came first
            at = np.cumsum(np.frombuffer(zstandard.decompress(d), "<u2"), dtype=np.int64) if d is not None else slice(None)
            sums[at] += np.frombuffer(t, "<f8")
            if b is not None:
                backed[at] += unpack(zstandard.decompress(b), len(t) // 8)
        sums -= backed * np.log(np.maximum(total - words if apart else np.full(len(words), total), 1))
        return pa.table([pa.array(ids, pa.int64()), pa.array(words), pa.array(backed), pa.array(sums)], ["doc_id", "n_words", "n_backed_off", "log_score"])

    return sums.groupBy("slice").applyInArrow(lambda t: add(t), "doc_id long, n_words long, n_backed_off long, log_score double")


def backoff_scores(docs: DataFrame, train: Column | None = None, hot_count: int = HOT, group_bytes: int = GROUP_BYTES, apart: bool = False, common_share: int = COMMON) -> DataFrame:
    """doc_id, n_words, n_backed_off, log_score of each row of `docs` (doc_id, text).

    train: which rows are counted (none given: all). apart: all are counted, and each is scored by the others.
    """
    if apart and train is not None:
        raise ValueError("documents are scored apart from themselves where all are counted")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.lit(True).alias("train") if train is None else F.coalesce(train, F.lit(False)).alias("train"))
    counts = scratch(unigrams(docs), "unigrams")
    size = counts.agg(F.sum("n").alias("n"), F.sum("a").alias("a")).first()
    total, every = size["n"] or 1, size["a"] or 0
    limit, usual = max(hot_count, every >> 20), every // common_share  # at most 2^20 words, and pairs, are beyond
    hot = Hot(counts.filter(F.col("a") > limit).select("h", "n", "c").toArrow())
    if len(hot.h):
        hot.learn(pairs_of_hot_words(docs, hot).filter(F.col("a") > limit).select("code", "n").toArrow())
    common = Words(counts.filter(F.col("a") > usual).select("h", "n", "c").toArrow())
    buckets = max(partitions(spark), int(16 * every / group_bytes))
    scored = scratch(pair_scores(exploded(docs, hot, buckets, apart), hot, common, buckets, apart), "pair_scores")
    rest = backed_off(scored.filter("bucket >= 0"), counts.filter(F.col("a") <= usual), buckets)
    return gathered(scored.filter("bucket < 0").unionByName(rest), total, apart)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are counted, and each is scored by the counts of all others."""
    return backoff_scores(documents(spark, sf_dir), apart=True).select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


OP9_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), tokens AS (
  SELECT r, unnest(words) AS w, unnest(list_prepend(' ', words[:-2])) AS v FROM docs WHERE len(words) > 0
), own AS (SELECT r, v, w, count(*) AS n FROM tokens GROUP BY r, v, w),
own_contexts AS (SELECT r, v, sum(n) AS n FROM own GROUP BY r, v),
own_words AS (SELECT r, w, sum(n) AS n FROM own GROUP BY r, w),
pairs AS (SELECT v, w, sum(n) AS n FROM own GROUP BY v, w),
contexts AS (SELECT v, sum(n) AS n FROM own GROUP BY v),
words AS (SELECT w, sum(n) AS n FROM own GROUP BY w),
total AS (SELECT sum(n) AS n FROM words),
valued AS (
  SELECT own.r, own.n, pairs.n = own.n AS backed,
         CASE WHEN pairs.n > own.n THEN ln(pairs.n - own.n) - ln(contexts.n - own_contexts.n)
              ELSE ln(0.4 * greatest(words.n - own_words.n, 1)) - ln(greatest(total.n - len(docs.words), 1)) END AS s
  FROM own JOIN pairs USING (v, w) JOIN contexts USING (v) JOIN words USING (w) JOIN own_contexts ON own_contexts.r = own.r AND own_contexts.v = own.v
  JOIN own_words ON own_words.r = own.r AND own_words.w = own.w JOIN docs ON docs.r = own.r, total
), scored AS (SELECT r, coalesce(sum(n) FILTER (WHERE backed), 0) AS b, sum(n * s) AS s FROM valued GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b, 0) AS BIGINT) AS n_backed_off, round(coalesce(s, 0.0), 4) AS log_score
FROM docs LEFT JOIN scored USING (r)
"""
