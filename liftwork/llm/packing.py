"""Best-fit packing with Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the whole instance is its histogram: at most as many
numbers as a sequence has tokens, whatever the corpus holds. The plan is made on the histogram:
sets of one, two or three pieces that provably dominate every other way to place their longest
piece are fixed for good and leave the instance, then best-fit decreasing packs the rest, both with
multiplicities. Each length adds at most three patterns to the plan, and a pattern has at most 45 different
lengths (1 + ... + 45 > 1024), so the plan's runs are bounded by the length of a sequence too and are broadcast.
Pieces find their place by their number among the pieces of their length, which
is a number within the task plus a prefix sum over tasks, so no task sees more than its share.

Defined cases: null text is empty and packs as its end id; empty tables give empty results; repeated
rows are packed as often as they occur; documents longer than a sequence are cut into full pieces,
the first of which may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, ship, slices
from .tokens import BYTES, encoder, tokenizer_path

SEQUENCE = 1024
Pattern = tuple[tuple[int, int], ...]  # (length, copies) of each length in a sequence


class Histogram:
    """Pieces left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.n = defaultdict(int, {k: v for k, v in counts.items() if v})
        self.lengths = sorted(self.n)

    def largest(self, most: int) -> int:
        """The largest length up to `most` that is left, or 0."""
        i = bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int, many: int) -> None:
        self.n[length] -= many
        if not self.n[length]:
            self.lengths.remove(length)
            del self.n[length]

    def smallest(self, k: int) -> int:
        """The sum of the k smallest pieces that are left."""
        total = 0
        for x in self.lengths:
            some = min(k, self.n[x])
            total, k = total + some * x, k - some
            if not k:
                return total
        return 1 << 60


def dominant(left: Histogram, length: int, capacity: int) -> list[int] | None:
    """A set with the piece `length` that dominates all feasible sets with it, or None. One piece of that length is out of `left`."""
    room = capacity - length
    first = left.largest(room)
    if not first:
        return [length]
    if first == room or left.smallest(2) > room:  # a perfect pair, or no two more pieces fit
        return [length, first]
    if left.smallest(3) <= room:
        return None
    left.take(first, 1)
    second = left.largest(room - first)
    left.n[first] += 1
    if left.n[first] == 1:
        insort(left.lengths, first)
    for y in reversed(left.lengths[: bisect_right(left.lengths, room // 2)]):  # the largest that is the lesser of a feasible pair
        if left.n[y] > 1 or left.largest(room - y) > y:
            return [length, first, second] if y <= second else None
    return None


def reduce_dominated(left: Histogram, capacity: int) -> dict[Pattern, int]:
    """Fixes dominating sets until there is none; they leave `left`."""
    fixed: dict[Pattern, int] = defaultdict(int)
    changed = True
    while changed:
        changed = False
        for length in sorted(left.lengths, reverse=True):
            while left.n.get(length):
                left.take(length, 1)
                found = dominant(left, length, capacity)
                left.n[length] += 1
                if left.n[length] == 1:
                    insort(left.lengths, length)
                if not found:
                    break
                need = {x: found.count(x) for x in found}
                # the same set stays dominating while there are enough pieces left for it
                many = min(left.n[x] // k for x, k in need.items())
                for x, k in need.items():
                    left.take(x, many * k)
                fixed[tuple(sorted(need.items(), reverse=True))] += many
                changed = True
    return fixed


def best_fit(left: Histogram, capacity: int) -> dict[Pattern, int]:
    """Best-fit decreasing with multiplicities: each length goes to the fullest sequences that it fits, as often as it fits."""
    open_: dict[int, dict[Pattern, int]] = defaultdict(dict)  # room -> pattern -> how many
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, many: int) -> None:
        if many:
            if room not in open_ or not open_[room]:
                insort(rooms, room)
            open_[room][pattern] = open_[room].get(pattern, 0) + many

    for length in sorted(left.lengths, reverse=True):
        n = left.n[length]
        i = bisect_right(rooms, length - 1)
        for room in rooms[i:]:
            if not n:
                break
            each = room // length
            for pattern, many in list(open_[room].items()):
                full = min(many, n // each)
                rest = min(n - full * each, each - 1) if full < many else 0
                open_[room].pop(pattern)
                put_back = many - full - (rest > 0)
                if put_back:
                    open_[room][pattern] = put_back
                n -= full * each + rest
                if not open_[room]:
                    rooms.remove(room)
                put((*pattern, (length, each)), room - each * length, full)
                if rest:
                    put((*pattern, (length, rest)), room - rest * length, 1)
                if not n:
                    break
        each = capacity // length
        put(((length, each),), capacity - each * length, n // each)
        if n % each:
            put(((length, n % each),), capacity - n % each * length, 1)
    out: dict[Pattern, int] = defaultdict(int)
    for patterns in open_.values():
        for pattern, many in patterns.items():
            out[pattern] += many
    return out


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[Pattern, int]]:
    """(pattern, sequences of it) for pieces given by their histogram."""
    left = Histogram(counts)
    fixed = reduce_dominated(left, capacity)
    for pattern, many in best_fit(left, capacity).items():
        fixed[pattern] += many
    return list(fixed.items())


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, number after the last, first sequence, copies in each, offset) of each run of pieces."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, many in patterns:
        offset = 0
        for length, copies in pattern:
            out.append((length, used[length], used[length] + many * copies, sequence, copies, offset))
            used[length] += many * copies
            offset += length * copies
        sequence += many
    return out


def token_pieces(df: DataFrame, path: str, end_id: int, most: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the task (part) and its number there among those of its length."""
    ship(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some, texts in slices(batch, most=2 << 20):
                ids = [x + end for x in encoder(path).ids(texts)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                n = -(-sizes // most)
                doc = np.repeat(np.arange(len(ids)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                lead = (sizes - 1) % most + 1
                start = np.where(piece == 0, 0, lead[doc] + (piece - 1) * most)
                length = np.where(piece == 0, lead[doc], most)
                crc = [zlib.crc32(ids[d][4 * a : 4 * (a + k)]) for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                of = length[order]
                nth = np.empty(len(doc), np.int64)
                nth[order] = seen[of] + np.arange(len(of)) - np.searchsorted(of, of)
                seen += np.bincount(length, minlength=most + 1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return df.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def pack(df: DataFrame, path: str | None = None, end_id: int = 2, most: int = SEQUENCE) -> DataFrame:
    """The pieces of `df` (doc_id, text) with their sequence_id and offset."""
    spark = df.sparkSession
    pieces = scratch(token_pieces(df, path or tokenizer_path(BYTES), end_id, most), "pieces")
    counts = scratch(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `most` rows at most
    runs = spark.createDataFrame(places(plan(histogram, most)), "length long, low long, high long, first long, copies long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    k = F.col("number") - F.col("low")
    return (
        pieces.join(scratch(bases, "bases"), ["part", "length"]).withColumn("number", F.col("base") + F.col("nth"))
        .join(F.broadcast(runs.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("length") * (k % F.col("copies"))).alias("offset"))
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
