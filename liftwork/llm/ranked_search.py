"""Ranked lexical search over an index in strata of equal document length.

Terms are the matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z in lower case. A document's normaliser m is
100 - 75 + (75 * n * N) div L; the score of a document for an item is the sum of w * ((1000000000 * tf) div
(1000 * tf + 8 * m)) over the item's terms, repeats included (see `weights` for w).

The index is a table. Its rows are the posting lists of a term in a block of documents: documents of a block are
numbered by m, so that all with one m, a stratum, are neighbours, and a list has its strata in order with postings by
falling tf. The impact (1000000000 * tf) div (1000 * tf + 8 * m) is computed once for each tf of a stratum, not for each posting; the
impact of a stratum's largest tf bounds the term there. A search adds these bounds over the item's terms, visits the
strata of a block by falling bound and ends where no bound reaches the tenth best score so far. Every document lies in
one stratum, so a visited document has its whole score. Results of blocks are merged in the task, then over all tasks.

Only posting lists of the items' terms leave the index, and each block is searched by one task, so neither a frequent
term nor many items meet in one place. Items are sent to the tasks in parts of at most `PART` item terms.

Defined cases: null text has no terms; documents without terms count for nothing and are never found; every row is a
document, also where ids repeat, and null ids come first among equal scores; rows that repeat an item_id are one item;
items without terms have no results; an empty table gives an empty result; a very long text is a block of its own;
other columns are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, ship, slices

BLOCK, PART, TOP, FIRST_STRATA = 1 << 21, 1 << 18, 10, 4
#: Bytes of terms, A-Z in lower case; all others part terms.
TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: One row for each block and term; the row without a term has the block's documents: strata are their m, postings their ids.
INDEX = "block string, term binary, n_docs int, strata binary, tfs binary, sizes binary, postings binary"
NONE = np.iinfo(np.int64).min  # stands for a null doc_id


@dataclass(frozen=True)
class Index:
    lists: DataFrame
    n_docs: int
    n_terms: int


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms with repeats)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                n = [len(t.translate(TERM).split()) for t in texts]
                yield pa.RecordBatch.from_pydict({"docs": [sum(map(bool, n))], "terms": [sum(n)]})

    r = docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


class Block:
    """Documents on their way into the index."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.term, self.tf, self.size, self.m, self.ids = array("i"), array("q"), array("q"), array("q"), array("q")

    def add(self, ident: int | None, terms: list[bytes], m: int) -> None:
        n, number = Counter(terms), self.number
        self.term.extend([number.setdefault(t, len(number)) for t in n])
        self.tf.extend(n.values())
        self.size.append(len(n))
        self.m.append(m)
        self.ids.append(NONE if ident is None else ident)

    def rows(self, name: str) -> pa.RecordBatch:
        m, ids = np.array(self.m), np.array(self.ids)
        order = np.lexsort((ids, m))
        m, ids, place = m[order], ids[order], np.argsort(order)
        doc, term, tf = np.repeat(place, np.array(self.size)), np.array(self.term), np.array(self.tf)
        order = np.lexsort((doc, -tf, m[doc], term))
        doc, term, tf = doc[order].astype(np.uint32), term[order], tf[order]
        stratum = m[doc]
        group = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(stratum, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
        first = np.flatnonzero(np.diff(term[group], prepend=-1))  # the first group of each term
        edges = [*first.tolist(), len(group)]
        sizes = np.diff(np.append(group, len(doc))).astype(np.uint32)
        at = np.append(group, len(doc))
        strata, tfs = stratum[group], tf[group]
        names = list(self.number)
        spans = list(zip(edges, edges[1:]))

        def cut(x: np.ndarray) -> list[bytes]:
            return [x[a:b].tobytes() for a, b in spans]

        lists = [doc[at[a] : at[b]].tobytes() for a, b in spans]
        columns = [
            pa.array([name] * (len(spans) + 1), pa.string()), pa.array([None, *(names[t] for t in term[group][first].tolist())], pa.binary()),
            pa.array([len(ids), *(at[edges[1:]] - at[edges[:-1]]).tolist()], pa.int32()),
            pa.array([m.tobytes(), *cut(strata)], pa.binary()), pa.array([None, *cut(tfs)], pa.binary()), pa.array([None, *cut(sizes)], pa.binary()), pa.array([ids.tobytes(), *lists], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "n_docs", "strata", "tfs", "sizes", "postings"])


def build(docs: DataFrame, block: int = BLOCK) -> Index:
    """The index of all documents (doc_id, text), in blocks of about `block` postings."""
    ship(docs.sparkSession)
    total, terms = corpus_size(docs)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, now = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            for part, texts in slices(batch):
                for ident, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    found = text.translate(TERM).split()
                    if found:
                        now.add(ident, found, 25 + 75 * len(found) * total // terms)
                    if len(now.term) >= block:
                        yield now.rows(f"{task}-{made}")
                        made, now = made + 1, Block()
        if now.ids:
            yield now.rows(f"{task}-{made}")

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lists, INDEX)
    return Index(scratch(found, "index"), total, terms)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found = [Counter(t.translate(TERM).split()) for t in texts]
                at = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(at), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())], ["item_id", "term", "times"])

    rows = items.select("item_id", "text")
    return rows.mapInArrow(count, rows.select("item_id").schema.add("term", "binary").add("times", "long")).groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def weights(index: Index, items: DataFrame) -> DataFrame:
    """item_id, term, weight: times * floor(1000 * ln((2 N + 2) / (2 df + 1))) for the terms that a document has."""
    asked = item_terms(items)
    lists = index.lists.filter("term IS NOT NULL").select("term", "n_docs")
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    return asked.join(df, "term").select("item_id", "term", (F.col("times") * w).cast("long").alias("weight")).filter("weight > 0")


class Searcher:
    """The best documents of each item over the blocks of a task."""

    def __init__(self, wanted: dict, top: int):
        self.wanted, self.top = wanted, top  # item number -> {term: weight}
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.visited = self.strata = 0

    def block(self, m: np.ndarray, ids: np.ndarray, lists: dict[bytes, tuple]) -> None:
        """lists: term -> (stratum, tf, size) of each group and the postings."""
        strata, start = np.unique(m, return_index=True)
        start, ready = np.append(start, len(m)), {}
        for term, (stratum, tf, size, docs) in lists.items():
            impact = 10**9 * tf // (1000 * tf + 8 * stratum)  # once for each tf of a stratum
            run = np.flatnonzero(np.diff(stratum, prepend=-1))
            at = np.append(0, np.cumsum(size, dtype=np.int64))
            ready[term] = np.searchsorted(strata, stratum[run]), impact[run], at[np.append(run, len(size))], docs, np.repeat(impact, size)
        for item, terms in self.wanted.items():
            have = [(w, ready[t]) for t, w in terms.items() if t in ready]
            if have:
                self._search(item, have, ids, start)

    def _search(self, item: int, have: list, ids: np.ndarray, start: np.ndarray) -> None:
        bound = np.zeros(len(start) - 1, np.int64)
        for w, (run, most, *_) in have:
            bound[run] += w * most
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        self.strata += len(order)
        score = np.zeros(len(ids), np.int64)
        found, names = self.best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        at, many = 0, FIRST_STRATA
        while at < len(order) and (len(found) < self.top or bound[order[at]] >= found[-1]):
            some = np.zeros(len(bound), bool)
            some[order[at : at + many]] = True
            for w, (run, _, edges, docs, impact) in have:
                hit = np.flatnonzero(some[run])
                if len(hit):
                    length = edges[hit + 1] - edges[hit]
                    where = np.repeat(edges[hit] - np.cumsum(length) + length, length) + np.arange(length.sum())
                    score[docs[where]] += w * impact[where]  # a term has a document once
            for s in order[at : at + many].tolist():
                part = score[start[s] : start[s + 1]]
                good = np.flatnonzero(part > 0 if len(found) < self.top else part >= found[-1])
                if len(good):
                    found, names = np.append(found, part[good]), np.append(names, ids[start[s] : start[s + 1]][good])
                    first = np.lexsort((names, -found))[: self.top]
                    found, names = found[first], names[first]
            self.visited += len(order[at : at + many])
            at, many = at + many, 2 * many
        if len(found):
            self.best[item] = found, names


def _split(index: Index, part: DataFrame, top: int) -> DataFrame:
    """nth, doc_id, score: the best of each task for some items."""
    spark = part.sparkSession
    wanted: dict = defaultdict(dict)
    for r in part.select("nth", "term", "weight").collect():  # at most PART terms, or one item
        wanted[r["nth"]][bytes(r["term"])] = r["weight"]
    shared = spark.sparkContext.broadcast(dict(wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, block, m, ids, lists = Searcher(shared.value, top), None, None, None, {}
        for batch in batches:
            names, terms, *columns = (batch.column(c).to_pylist() for c in ("block", "term", "strata", "tfs", "sizes", "postings"))
            for name, term, stratum, tf, size, postings in zip(names, terms, *columns, strict=True):
                if term is None:
                    if block is not None:
                        finder.block(m, ids, lists)
                    block, m, ids, lists = name, np.frombuffer(stratum, np.int64), np.frombuffer(postings, np.int64), {}
                else:
                    lists[term] = np.frombuffer(stratum, np.int64), np.frombuffer(tf, np.int64), np.frombuffer(size, np.uint32), np.frombuffer(postings, np.uint32)
        if block is not None:
            finder.block(m, ids, lists)
        for item, (score, names) in finder.best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(score), pa.int64()), pa.array(names, pa.int64(), mask=names == NONE), pa.array(score, pa.int64())], ["nth", "doc_id", "score"])

    terms = part.select("term").distinct()
    lists = index.lists.join(F.broadcast(terms), "term", "left_semi").unionByName(index.lists.filter("term IS NULL"))
    return lists.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first()).mapInArrow(search, "nth long, doc_id long, score long")


def ranked(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item (item_id, text)."""
    w = scratch(weights(index, items), "weights")
    number = w.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    # items are numbered and cut into parts by running sums over buckets of items, then inside a bucket
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(1024))
    counted = number.withColumn("first", bucket)
    bases = counted.groupBy("first").agg(F.sum("terms").alias("t"), F.count(F.lit(1)).alias("n")).select("first", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("t", "n")))
    inside = Window.partitionBy("first").orderBy("item_id")
    placed = counted.withColumns({"t": F.sum("terms").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(inside)}).join(F.broadcast(bases), "first")
    placed = scratch(placed.select("item_id", (F.col("n0") + F.col("n")).cast("long").alias("nth"), F.floor((F.col("t0") + F.col("t")) / PART).cast("int").alias("part")), "items")
    asked = scratch(w.withColumnRenamed("item_id", "__item").join(placed, F.col("__item").eqNullSafe(F.col("item_id"))).select("nth", "part", "term", "weight"), "asked")
    out = None
    for r in placed.select("part").distinct().orderBy("part").collect():  # one row for PART terms
        found = _split(index, asked.filter(F.col("part") == r["part"]), top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return placed.select("item_id", F.lit(0).alias("rank"), "nth", F.col("nth").alias("score")).select("item_id", "rank", F.col("nth").alias("doc_id"), "score")
    order = Window.partitionBy("nth").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(placed, "nth").select("item_id", "rank", "doc_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(documents(spark, sf_dir))
    return ranked(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
sized AS (SELECT row, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized),
tf AS (SELECT row, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nn),
asked AS (SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
scored AS (SELECT item_id, s.row, s.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN sized s ON s.row = tf.row, total GROUP BY item_id, s.row, s.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
