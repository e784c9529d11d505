"""Line deduplication that can be undone: cuckoo filters in shards over exact reference counts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case, as the MD5 of its bytes; lines whose
key has fewer than `least` code points have none. A `LineStore` holds three tables in the shared folder:

* refs: one row for each document and key in it;
* counts: for each key its shard, how many documents hold it and the smallest of them;
* filters: for each shard a cuckoo filter of the keys that two documents or more hold.

Documents can be inserted and deleted in any order; the store is always that of the documents left. A cuckoo filter
forgets single keys, as Bloom filters cannot, so a deletion costs the keys of the deleted documents alone. Keys that a
filter does not know are not repeated, so their lines never reach the join with the exact counts; what a filter
claims is decided by the join. A filter that overflows is made anew, larger, from the counts; so are all of them, in
more shards, when a store has outgrown its number.

Keys that hold a large share of all lines (at most `HOT_SHARE` times as many as there are partitions) are counted by
partial aggregation and decided by a broadcast; all other lines go to their shard, where the filter comes first.

Defined cases: null and empty text is one empty line; documents without an id keep all lines and count for none; rows
that repeat an id are one document (each row is returned); a key's lines repeated inside its first document all stay; an
empty table gives an empty store and no rows; very long texts are split once and never joined line by line; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bundled, documents, partitions, scratch, ship, slices, widened

LEAST, SPACES, SHARD_KEYS, HOT_SHARE, KICKS = 10, b" \t\n\x0b\x0c\r", 1 << 18, 4, 400
FILTERS = "shard int, filter binary"


class Cuckoo:
    """A cuckoo filter of 16-byte keys: buckets of four 16-bit fingerprints, each key in one of two buckets."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """Room for n keys at three quarters full."""
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(n, 1) / 3)))), 4), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, 4).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def spots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first bucket) of keys as rows of two 64-bit words."""
        return (keys[:, 0] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (keys[:, 1] & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mark.astype(np.int64) * 0x5BD1E995 & (len(self.slots) - 1))

    def _nth(self, at: np.ndarray, mark: np.ndarray, value: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether there is one) for the n-th of the sorted rows with equal `mark`: its n-th slot of `value` in the bucket."""
        same = self.slots[at] == np.reshape(value, (-1, 1))
        nth = np.arange(len(mark)) - np.searchsorted(mark, mark)
        return (same.cumsum(1) == nth[:, None] + 1).argmax(1), nth < same.sum(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all keys found room; if not, the filter is of no use any more."""
        mark, at = self.spots(keys)
        for step in range(KICKS):
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            slot, fits = self._nth(at, at, 0)
            self.slots[at[fits], slot[fits]] = mark[fits]
            mark, at = mark[~fits], at[~fits]
            if not len(mark):
                return True
            if step % 2:  # both buckets are full: one key of each bucket changes places with one that is there
                _, first = np.unique(at, return_index=True)
                there, slot = at[first], (mark[first].astype(int) + step // 2) % 4
                out = self.slots[there, slot].copy()
                self.slots[there, slot] = mark[first]
                mark[first] = out
            at = self.other(at, mark)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Forgets keys that were inserted."""
        mark, at = self.spots(keys)
        for _ in range(2):
            order = np.lexsort((mark, at))
            mark, at = mark[order], at[order]
            slot, has = self._nth(at, at << 16 | mark, mark)
            self.slots[at[has], slot[has]] = 0
            mark, at = mark[~has], self.other(at[~has], mark[~has])

    def __contains__(self, key: bytes) -> bool:
        return bool(self.has(words([key]))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self.spots(keys)
        return ((self.slots[at] == mark[:, None]) | (self.slots[self.other(at, mark)] == mark[:, None])).any(1)

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of all keys, as large as it must be."""
        for grown in range(8):
            made = cls.sized(len(keys) << grown)
            if made.insert(keys):
                return made
        raise ValueError("keys repeat: a filter takes each key once")


def words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def keyed(line: bytes, least: int) -> bytes | None:
    """The key of a line in lower case."""
    line = line.strip(SPACES)
    if len(line) < least or (len(line) < 4 * least and len(line.decode()) < least):
        return None
    return md5(line, usedforsecurity=False).digest()


def pairs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key: once for each document and key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                keys = [{k for line in t.lower().split(b"\n") if (k := keyed(line, least))} for t in texts]
                at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array([k for some in keys for k in some], pa.binary())], ["doc_id", "key"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(split, rows.select("doc_id").schema.add("key", "binary")).distinct()


@dataclass(frozen=True)
class LineStore:
    """The tables over the documents inserted and not deleted. Every change writes new tables and leaves the old ones."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int = LEAST

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _counted(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).select(self._shard().alias("shard"), "key", "n_docs", "first_doc")

    def _filtered(self, changes: DataFrame, counts: DataFrame) -> DataFrame:
        """The filters after `changes` (shard, key, come: whether the key comes or goes)."""

        def change(key: tuple, had: pa.Table, rows: pa.Table) -> pa.Table:
            keys, come = words(rows.column("key").to_pylist()), np.array(rows.column("come").to_pylist(), bool)
            data = had.column("filter")[0].as_py() if len(had) else None
            if data is None:
                data = Cuckoo.of(keys[come]).dump()
            elif len(rows):
                found = Cuckoo.load(data)
                found.delete(keys[~come])
                data = found.dump() if found.insert(keys[come]) else None
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([data], pa.binary())})

        out = scratch(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, FILTERS), "filters")
        full = out.filter("filter IS NULL").select("shard")  # at most as many as there are shards
        if full.isEmpty():
            return out
        keys = counts.filter("n_docs > 1").join(F.broadcast(full), "shard").select("shard", "key", F.lit(True).alias("come"))
        anew = full.withColumn("filter", F.lit(None).cast("binary")).limit(0).groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(change, FILTERS)
        return scratch(out.filter("filter IS NOT NULL").unionByName(anew), "filters")

    def inserted(self, docs: DataFrame) -> LineStore:
        """The store with the documents (doc_id, text); what it holds already is not counted twice."""
        new = scratch(pairs(docs, self.least).join(self.refs, ["doc_id", "key"], "left_anti"), "refs")
        both = self.counts.withColumn("had", F.col("n_docs")).unionByName(self._counted(new).withColumn("had", F.lit(0).cast("long")))
        merged = scratch(both.groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.sum("had").alias("had")), "counts")
        changes = merged.filter("n_docs > 1 AND had < 2").select("shard", "key", F.lit(True).alias("come"))
        counts = merged.drop("had")
        refs, n = self.refs.unionByName(new), counts.count()
        if n > 2 * SHARD_KEYS * self.shards:
            return replace(self, refs=refs, counts=counts).resharded(1 + n // SHARD_KEYS)
        return LineStore(refs, counts, self._filtered(changes, counts), self.shards, self.least)

    def resharded(self, shards: int) -> LineStore:
        """The same store in another number of shards, its filters made anew from the counts."""
        anew = replace(self, shards=shards, filters=self.filters.limit(0))
        counts = scratch(self.counts.withColumn("shard", anew._shard()), "counts")
        return replace(anew, counts=counts, filters=anew._filtered(counts.filter("n_docs > 1").select("shard", "key", F.lit(True).alias("come")), counts))

    def deleted(self, ids: DataFrame) -> LineStore:
        """The store without the documents of `ids` (doc_id)."""
        ids = scratch(ids.select("doc_id").distinct(), "gone")
        refs = scratch(self.refs.join(ids, "doc_id", "left_anti"), "refs")
        keys = scratch(self.refs.join(ids, "doc_id", "left_semi").select("key").distinct(), "keys")
        left = scratch(self._counted(refs.join(keys, "key", "left_semi")), "left")
        was = self.counts.join(keys, "key", "left_semi")
        counts = scratch(self.counts.join(keys, "key", "left_anti").unionByName(left), "counts")
        gone = was.filter("n_docs > 1").join(left.filter("n_docs > 1"), "key", "left_anti").select("shard", "key", F.lit(False).alias("come"))
        return LineStore(refs, counts, self._filtered(gone, counts), self.shards, self.least)

    def repeated(self, held: DataFrame) -> DataFrame:
        """Of `held` (doc_id, key), the rows whose key a smaller document holds: those lines are dropped."""
        total = self.counts.agg(F.sum("n_docs")).first()[0] or 0
        hot = scratch(self.counts.filter((F.col("n_docs") > 1) & (F.col("n_docs") > total / (HOT_SHARE * partitions(held.sparkSession)))).select("key", "first_doc"), "hot")
        common = held.join(F.broadcast(hot), "key")  # at most HOT_SHARE x partitions keys
        rest = held.join(F.broadcast(hot), "key", "left_anti").select(self._shard().alias("shard"), "doc_id", "key", F.lit(None).cast("binary").alias("filter"))
        first = self.filters.select("shard", F.lit(None).cast(held.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("binary").alias("key"), "filter")
        schema = held.select("doc_id", "key").schema

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, seen = None, None
            for batch in batches:
                shards, filters = batch.column("shard").to_numpy(), batch.column("filter")
                keys, edges = batch.column("key"), np.flatnonzero(np.diff(shards, prepend=-1))
                hits = np.zeros(len(shards), bool)
                for start, end in zip(edges, [*edges[1:], len(shards)], strict=True):
                    if shards[start] != at:
                        at, seen = shards[start], None
                    if filters[int(start)].is_valid:
                        seen, start = Cuckoo.load(filters[int(start)].as_py()), start + 1
                    if seen is not None and start < end:
                        hits[start:end] = seen.has(words(keys.slice(start, end - start).to_pylist()))
                found = pa.array(np.flatnonzero(hits))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(found), keys.take(found)], ["doc_id", "key"])

        claimed = first.unionByName(rest).repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull()).mapInArrow(probe, schema)
        exact = claimed.join(self.counts.filter("n_docs > 1").select("key", "first_doc"), "key")
        return common.unionByName(exact).filter(F.col("doc_id") > F.col("first_doc")).select("doc_id", "key")

    def cleaned(self, docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """`docs` (doc_id, text and more) with the text's lines that stay, __n_lines before and __n_dropped. held: their pairs, if known."""
        least, names = self.least, docs.columns
        gone = self.repeated(pairs(docs, least) if held is None else held).groupBy(F.col("doc_id").alias("__of")).agg(F.collect_list("key").alias("__gone"))
        rows = bundled(docs).withColumn("__id", F.col("doc").getField("doc_id")).join(gone, F.col("__id") == F.col("__of"), "left").select("doc", "text", "__gone")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch):
                    kept, lines, dropped = [], [], []
                    for text, keys in zip(texts, part.column("__gone").to_pylist(), strict=True):
                        n = text.count(b"\n") + 1
                        lines.append(n)
                        if keys:
                            keys = set(keys)
                            stay = [x for x in text.split(b"\n") if keyed(x.lower(), least) not in keys]
                            text, n = b"\n".join(stay), len(stay)
                        kept.append(text)
                        dropped.append(lines[-1] - n)
                    yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc", "text", "__n_lines", "__n_dropped"])

        out = rows.mapInArrow(drop, widened(rows.select("doc", "text"), {"__n_lines": "long", "__n_dropped": "long"}))
        return out.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in names), "__n_lines", "__n_dropped")


def line_store(docs: DataFrame, least: int = LEAST, shards: int | None = None) -> LineStore:
    """A store of the documents. shards: by default one for each SHARD_KEYS rows of refs."""
    spark = docs.sparkSession
    ship(spark)
    refs = scratch(pairs(docs, least), "refs")
    shards = shards or 1 + refs.count() // SHARD_KEYS
    store = LineStore(refs, spark.createDataFrame([], "key binary"), spark.createDataFrame([], FILTERS), shards, least)
    counts = scratch(store._counted(refs), "counts")
    changes = counts.filter("n_docs > 1").select("shard", "key", F.lit(True).alias("come"))
    return LineStore(refs, counts, store._filtered(changes, counts), shards, least)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    store = line_store(docs)
    return store.cleaned(docs, store.refs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = """
WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
first AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, first_doc IS NOT NULL AND doc_id > first_doc AS dropped FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
