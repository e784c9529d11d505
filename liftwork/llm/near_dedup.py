"""Near-duplicate groups by a signature-coordinate inverted join.

1. Each text's set of 5-word shingles (64-bit hashes) gives K MinHash coordinates. Rows with equal
   sets are one class from here on, with a number of its own, so copies are never paired.
2. Classes are posted under their coordinate-value pairs. Two sets are candidates when at least `least` of
   the K coordinates collide. Ordered by how many classes hold a value, rarest first, such a pair shares a
   value among the first K - least + 1 of each (prefix filter), so only those are posted, and values that
   one class holds are no posting at all. Posting lists with the same members are merged once.
3. Short lists give all their pairs, long lists only the pairs with their least member. Pairs whose
   full signatures collide often enough are confirmed on the full shingle sets. Links give components.
4. Long lists whose members are now in one component are skipped. In the others, members outside the
   largest component are compared with all others in blocks: products of 0/1 matrices give the sizes of
   the full sets' intersections, and a block returns only the links that join components. So no link
   between different components is lost and no group emits all its pairs.

A pair at similarity 0.85 has 28 or more collisions of 48, and one at 0.80 has 24, but for two in a million.

Defined cases: text without words and null text have an empty set and link with nothing; text of fewer
than five words is one shingle; rows with a null doc_id link with nothing and are kept; rows that repeat a
doc_id are judged each by its own text; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bundled, documents, held, partitions, scratch, ship, slices, unbundled

K, WORDS = 48, 5
#: Similarity in hundredths, and the collisions that a pair needs for it.
PERCENT, LEAST = 85, 28
STAGE_PERCENT, STAGE_LEAST = 80, 24
SHORT, BLOCK, CACHE, SLICE = 8, 256, 300_000, 2 << 20
#: Shingles of a block, on average, where long texts would fill it with fewer rows than BLOCK.
BLOCK_ITEMS = 1 << 19
#: Classes up to which texts are picked by broadcast (five numbers each, 10 MB); beyond, the texts are shuffled.
MOST_IDS = 250_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_random = np.random.default_rng(20240229)
MULTIPLY = _random.integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _random.integers(0, 1 << 63, K, np.uint64)
PLACE = _random.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = held("words", dict)
    if len(known) > CACHE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < WORDS:
        return mix((h * PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    total = h[: len(h) - WORDS + 1] * PLACE[0]
    for k in range(1, WORDS):
        total += h[k : len(h) - WORDS + 1 + k] * PLACE[k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """K coordinates, each marked with its place."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 8192):
        least = np.minimum(least, ((found[k : k + 8192, None] ^ FLIP) * MULTIPLY).min(0))
    return mix(least ^ (np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def set_names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two 64-bit sums of hashes of each set: equal for equal sets alone."""
    first = pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
    second = pa.array([int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
    return [pa.array(list(map(len, sets)), pa.int64()), first, second]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, most=SLICE):
            sets = [shingles(t) for t in texts]
            signed = pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), *set_names(sets), signed], ["doc_id", "n", "h1", "h2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, most=SLICE):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), *set_names(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "items"])


NAME = ["doc_id", "n", "h1", "h2"]


def full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """id, items of the classes in `ids`, from the whole texts of the rows that stand for them."""
    wanted = scratch(classes.join(ids.distinct(), "id").select("id", *NAME), f"{name}_ids")
    few = wanted.count() <= MOST_IDS
    rows = wanted.select("doc_id").distinct()
    found = docs.join(F.broadcast(rows) if few else rows, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, n long, h1 long, h2 long, items array<long>")
    return scratch(found.join(F.broadcast(wanted) if few else wanted, NAME).select("id", "items").dropDuplicates(["id"]), name)


def postings(nodes: DataFrame, least: int) -> DataFrame:
    """key, id of each class's prefix: its rarest coordinate values that other classes hold too."""
    posted = nodes.select("id", F.explode("sig").alias("key"))
    shared = posted.groupBy("key").count().filter(F.col("count") > 1)
    own = Window.partitionBy("id")
    ranked = posted.join(shared, "key").select("id", "key", F.count(F.lit(1)).over(own).alias("m"), F.row_number().over(own.orderBy("count", "key")).alias("nth"))
    return ranked.filter(F.col("nth") <= F.col("m") - (least - 1)).select("key", "id")


def posting_lists(posted: DataFrame) -> DataFrame:
    """key, n, centre of the posting lists, one for each set of members."""
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("x"), F.min("id").alias("centre"))
    return lists.filter("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key"), F.min("centre").alias("centre")).drop("s", "x")


def first_pairs(posted: DataFrame, lists: DataFrame) -> DataFrame:
    """a < b: all pairs of short lists, and the least member with each other one of long lists."""
    members = posted.join(lists, "key")
    short = members.filter(F.col("n") <= SHORT).select("key", "id")
    each = short.withColumnRenamed("id", "a").join(short.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b")
    star = members.filter((F.col("n") > SHORT) & (F.col("id") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("id").alias("b"))
    return each.unionByName(star).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar by their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * inter >= percent * (F.size("x") + F.size("y") - inter)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, label (the least id reachable) of each linked id, by large-star and small-star rounds.

    The least neighbours are counted before the shuffle and written, so that the join with them deals a hot
    centre's edges over several tasks (by broadcast while they are few, by AQE's skewed join beyond).
    """
    edges = scratch(links.select("a", "b"), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was, turn = None, 0
    while (now := state(edges)) != was:
        was, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"near{turn}")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        down = scratch(large, f"large{turn}").select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        least = scratch(down.groupBy("u").agg(F.min("v").alias("m")), f"low{turn}")
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a != b").distinct()
        edges = scratch(small, f"small{turn}")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())


BLOCKS = "grp long, i long, j long, id long, label long, main boolean, items array<long>"


def overlaps(items: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of 0/1 matrices over the items that two sets share."""
    owner = np.repeat(np.arange(len(items)), list(map(len, items)))
    _, item, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = times[item] > 1
    owner, item = owner[shared], np.unique(item[shared], return_inverse=True)[1]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    out = np.zeros((len(items), len(items)), np.float32)
    for low in range(0, int(item[-1]) + 1 if len(item) else 0, columns):
        some = slice(*np.searchsorted(item, [low, low + columns]))
        has = np.zeros((len(items), columns), np.float32)
        has[owner[some], item[some] - low] = 1
        out += has @ has.T
    return out


def block_links(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join different labels between the rows of one block pair."""
    part = part.drop_duplicates("id").sort_values("id")
    ids, root, main = part["id"].to_numpy(), part["label"].to_numpy().copy(), part["main"].to_numpy()
    items = [np.asarray(x, np.int64) for x in part["items"]]
    size, inter = np.array(list(map(len, items)), np.float32), overlaps(items)
    alike = 100 * inter >= percent * (size[:, None] + size - inter)
    alike &= ~(main[:, None] & main)
    out = []
    for k in range(len(ids)):
        for m in np.flatnonzero(alike[k] & (root != root[k])):
            if root[m] != root[k]:
                out.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
                root[root == root[m]] = root[k]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def rest_links(posted: DataFrame, lists: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, block_items: int = BLOCK_ITEMS) -> DataFrame | None:
    """Links between members of long lists that are still in different components.

    Lists that share members are worked off as one group, so that a pair in several of them meets once, unless
    they chain to a group of more than four times their longest list.
    """
    long = lists.filter(F.col("n") > SHORT)
    members = posted.join(long.select("key", "n", "centre"), "key").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = scratch(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"), "mixed")
    if mixed.isEmpty():
        return None
    rows = scratch(members.join(mixed, "key"), "mixed_members")
    chained = components(rows.filter("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()).withColumnRenamed("label", "cluster")
    rows = rows.join(chained, "id")
    extent = rows.groupBy("cluster").agg(F.count_distinct("id").alias("all"), F.max("n").alias("longest"))
    together = F.when(F.col("all") <= 4 * F.col("longest"), F.col("cluster")).otherwise(F.col("key"))
    rows = rows.join(extent, "cluster").select(together.alias("grp"), "id", "label").distinct()
    rows = scratch(rows.join(classes.select("id", F.col("n").alias("shingles")), "id"), "grouped")

    sizes = rows.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("shingles").alias("items"))
    sizes = sizes.groupBy("grp").agg(F.max_by(F.struct("label", "size", "items"), F.struct("size", "label")).alias("top"), F.sum("size").alias("n"), F.sum("items").alias("items"))
    rows = rows.join(sizes, "grp").withColumn("main", F.col("label") == F.col("top.label"))
    # blocks of the largest component, then blocks of the others; each of the latter meets all blocks
    n_main = F.ceil(F.greatest(F.col("top.size") / BLOCK, F.col("top.items") / block_items))
    n_rest = F.ceil(F.greatest((F.col("n") - F.col("top.size")) / BLOCK, (F.col("items") - F.col("top.items")) / block_items))
    own = F.when(F.col("main"), F.pmod(F.xxhash64("id"), n_main)).otherwise(n_main + F.pmod(F.xxhash64("id"), n_rest))
    meets = F.when(F.col("main"), F.sequence(n_main, n_main + n_rest - 1)).otherwise(F.sequence(F.lit(0), n_main + n_rest - 1))
    placed = rows.withColumn("own", own).withColumn("other", F.explode(meets)).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "main")
    sets = full_sets(docs, classes, rows.select("id"), "mixed_sets")
    full = placed.join(sets, "id").select(*(f.split()[0] for f in BLOCKS.split(", ")))
    return full.groupBy("grp", "i", "j").applyInPandas(lambda part: block_links(part, percent), "a long, b long").distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    signed = scratch(docs.mapInArrow(_signed, "doc_id long, n long, h1 long, h2 long, sig array<long>"), "signed")
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), F.any_value("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
    classes = scratch(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("id", "n", "sig")
    posted = scratch(postings(nodes, least), "postings")
    lists = scratch(posting_lists(posted), "lists")
    sig = nodes.select("id", "sig")
    pairs = first_pairs(posted, lists).join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    pairs = scratch(pairs.filter(F.size(F.array_intersect("x", "y")) >= least).select("a", "b"), "pairs")
    sets = full_sets(docs, classes, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), "sets")
    links = scratch(confirmed(pairs, sets, percent), "confirmed")
    labels = components(links)
    more = rest_links(posted, lists, labels, docs, classes, percent)
    if more is not None:
        labels = components(links.unionByName(more))
    least_doc = scratch(labels.join(classes.select("id", "doc_id"), "id").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    linked = labels.join(least_doc, "label").select("id", "component_id")
    of_class = classes.join(linked, "id", "left").select("h1", "h2", "n", "rows", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = scratch(of_class, "of_class")
    # classes with many copies: at most four for each partition
    hot = F.col("rows") > max(64, int(0.25 * (of_class.agg(F.sum("rows")).first()[0] or 0) / partitions(spark)))
    key, many = ["h1", "h2", "n"], F.broadcast(of_class.filter(hot).drop("rows"))
    rows = full.select("doc_id", *key)
    found = rows.join(many, key).unionByName(rows.join(many.drop("component_id"), key, "left_anti").join(of_class.filter(~hot).drop("rows"), key))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the least doc_id of their group, linked from a similarity of 0.8 on."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = scratch(near_groups(docs, STAGE_PERCENT, STAGE_LEAST).filter("kept").select(name.alias("name")).distinct(), "kept")
    rows = bundled(docs).withColumn("name", F.coalesce(F.col("doc").getField("doc_id").cast("string"), F.lit("")))
    return unbundled(rows.join(kept, "name", "left_semi"), docs.columns)
