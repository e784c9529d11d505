"""How the sources of a language differ: term shares of every two sources compared on hash-consed segment trees.

Terms are the matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z in lower case; a language keeps those in at least
`least_docs` of its documents. The counts of a (language, source) group are the leaves of a segment tree over term ids.
Ids fall in shards by the term's hash, `WIDTH` of them to a shard on average, and run in a shard by falling frequency, so
that rare terms, whose counts are alike in most sources, are neighbours. A shard is a subtree; its nodes are hash-consed
over all groups: equal counts are one node, whatever the group. Two groups are compared by walking both trees at once
from the top; pairs of nodes that come up more than once at a height are merged with their number, so that each is
followed and priced once. The sums of the shards add up.

A group's rows are bounded by vocabulary and shard, not by its documents; the pairs of sources are as many as the result has.

Defined cases: null text, lang and source are ''; groups without terms have counts of 0; a language without kept terms has
distances of 0; every row is a document, also where ids repeat; an empty table gives an empty result; long texts are
counted in pieces of bounded size; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, ship, slices

LEAST_DOCS, ADDED, SCALE, WIDTH, MOST_TERMS, MOST_PAIRS = 30, 5, 10**9, 4096, 50, 1 << 12
#: Bytes of terms, A-Z in lower case; all others part terms.
TERM = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, docs with it; summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found: dict = defaultdict(lambda: (Counter(), Counter()))
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts, strict=True):
                    n, seen = found[lang, source]
                    terms = text.translate(TERM).split()
                    n.update(terms)
                    seen.update(set(terms))
                for (lang, source), (n, seen) in found.items():
                    terms = list(n)
                    columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns), pa.array(list(n.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])

    rows = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * size)), exactly."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + ADDED).cast("decimal(19,0)")
    return F.call_function("div", whole, (total + ADDED * size).cast("decimal(19,0)")) + 1


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same on whole numbers under 9e13, by long division; total includes the added counts."""
    first = (n + ADDED) * 10**5
    return 1 + first // total * 10**4 + first % total * 10**4 // total


class Forest:
    """The hash-consed segment trees of some groups. up[h] has the two children of each node of height h; node 0 is empty at all heights."""

    def __init__(self, group: np.ndarray, place: np.ndarray, count: np.ndarray, size: int):
        self.height = max(0, int(size - 1).bit_length())
        self.size = size
        self.counts, node = np.unique(np.append(0, count), return_inverse=True)
        node = node[1:]
        order = np.lexsort((place, group))
        group, place, node = group[order], place[order], node[order]
        self.up: list[np.ndarray] = []
        for _ in range(self.height):
            at = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(place // 2, prepend=-1) != 0))
            mine = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(group))))
            pair = np.zeros((len(at) + 1, 2), np.int64)  # the last row is the empty node
            pair[mine, place % 2] = node
            known, inverse = np.unique(pair[:, 0] << 32 | pair[:, 1], return_inverse=True)
            self.up.append(np.stack([known >> 32, known & 0xFFFFFFFF], 1))
            group, place, node = group[at], place[at] // 2, inverse[:-1]
        self.roots = dict(zip(group.tolist(), node.tolist(), strict=True))

    def nodes(self) -> int:
        return len(self.counts) + sum(map(len, self.up))

    def distances(self, left: np.ndarray, right: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, int]:
        """(sum of absolute differences of shares for each pair of groups, node pairs looked at); totals: of each group, the added counts included."""
        pair, times = np.arange(len(left)), np.ones(len(left), np.int64)
        u, v = (np.array([self.roots.get(g, 0) for g in side.tolist()], np.int64) for side in (left, right))
        seen = 0
        for children in reversed(self.up):
            seen += len(pair)
            u, v, pair, times = children[u].T.ravel(), children[v].T.ravel(), np.tile(pair, 2), np.tile(times, 2)
            order = np.lexsort((v, u, pair))  # equal pairs of nodes become one
            u, v, pair, times = u[order], v[order], pair[order], times[order]
            first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0))
            u, v, pair, times = u[first], v[first], pair[first], np.add.reduceat(times, first)
        gap = np.abs(shares(self.counts[u], totals[left[pair]]) - shares(self.counts[v], totals[right[pair]]))
        out = np.zeros(len(left), np.int64)
        np.add.at(out, pair, gap * times)
        empty = np.zeros(len(left), np.int64)
        beyond = (1 << self.height) - self.size  # places of the tree that are no terms
        return out - beyond * np.abs(shares(empty, totals[left]) - shares(empty, totals[right])), seen + len(pair)


def priced(key: tuple, leaves: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, a, b, f: the distances of every two groups in one shard of a language, in blocks of pairs."""
    number, totals = groups.column("number").to_numpy(), groups.column("total").to_numpy()
    order = np.argsort(number)
    number, totals = number[order], totals[order]
    forest = Forest(np.searchsorted(number, leaves.column("number").to_numpy()), leaves.column("place").to_numpy(), leaves.column("n").to_numpy(), int(groups.column("size")[0].as_py()))
    out, a = [], 0
    while a < len(number) - 1:
        upto = a + 1
        while upto < len(number) - 1 and (upto + 1 - a) * (len(number) - a) <= MOST_PAIRS:
            upto += 1
        left = np.repeat(np.arange(a, upto), len(number) - 1 - np.arange(a, upto))
        right = np.concatenate([np.arange(i + 1, len(number)) for i in range(a, upto)])
        out.append((number[left], number[right], forest.distances(left, right, totals)[0]))
        a = upto
    a, b, f = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a.astype(np.int64), "b": b.astype(np.int64), "f": f.astype(np.int64)})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of the language by distance, `term` the terms that the source has more of."""
    ship(docs.sparkSession)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    counts = scratch(term_counts(rows), "term_counts")
    vocab = scratch(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "all"), "kept_terms")
    langs = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_total"))
    shard = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / width)).cast("int")
    by = Window.partitionBy("lang", "shard")
    ids = vocab.join(langs, "lang").withColumn("shard", shard).repartition("lang", "shard")  # or the join's dealing by language alone would stay
    ids = scratch(ids.withColumn("place", F.row_number().over(by.orderBy(F.desc("all"), "term")) - 1), "term_ids")
    leaves = scratch(counts.drop("docs").join(ids, ["lang", "term"]), "leaves")
    totals = leaves.groupBy("lang", "source").agg(F.sum("n").alias("had"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("had", F.lit(0)).alias("had"), F.coalesce("v", F.lit(0)).alias("v"), F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("number"))
    groups = scratch(groups, "groups")

    sizes = ids.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("size"))
    there = scratch(groups.join(sizes, "lang").select("lang", "shard", "number", (F.col("had") + ADDED * F.col("v")).alias("total"), "size"), "shards")
    numbered = leaves.join(groups.select("lang", "source", "number"), ["lang", "source"]).select("lang", "shard", "number", F.col("place").cast("long").alias("place"), "n")
    found = numbered.groupBy("lang", "shard").cogroup(there.groupBy("lang", "shard")).applyInArrow(priced, "lang string, a long, b long, f long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, two = (groups.select(F.col("lang"), F.col("number").alias(n), F.col("source").alias(s)) for n, s in (("a", "source"), ("b", "item")))
    every = one.join(two, "lang").filter("a <> b")  # the pairs that the result lists
    pair = every.join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    p = leaves.join(groups.select("lang", "source", "had"), ["lang", "source"]).withColumn("value", share(F.col("n"), F.col("had"), F.col("v")) - share(F.col("all"), F.col("lang_total"), F.col("v")))
    best = Window.partitionBy("lang", "source", "shard").orderBy(F.desc("value"), "term")
    term = p.filter("n > 0 AND value > 0").withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most_terms).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pair.unionByName(term).withColumn("rank", F.row_number().over(ranked)).filter((F.col("part") == "pair") | (F.col("rank") <= most_terms))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir)).select("lang", "source", "part", "item", "value", "rank")


OP12_SQL = """
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + ((1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v)) AS p,
    1 + ((1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v)) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""
