"""Filters, and stores that take documents in and out, against brute force on the documents left."""

import random
from hashlib import md5

import numpy as np
import pytest
from test_contracts import awkward_rows

from liftwork.llm import line_dedup
from liftwork.llm.line_dedup import Cuckoo

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, least=10):
    """(doc_id, text that stays, lines, dropped) of each row."""

    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
        return k if len(k) >= least else None

    holders = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or key(x) is None or min(holders[key(x)]) == d]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def cleaned(store, spark, rows):
    got = store.cleaned(frame(spark, rows)).collect()
    return sorted(((r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in got), key=repr)


def corpus(n, seed=0):
    draw = random.Random(seed)
    lines = [f"a line that returns, number {i}" for i in range(40)] + ["short", "", "  A LINE that returns, number 3\t", "é" * 10, "é" * 9]
    return [(i, "\n".join([*(draw.choice(lines) for _ in range(draw.randint(0, 12))), f"only in {i} and nowhere else", "the line of all documents"])) for i in range(n)]


def keys(n, salt=""):
    return line_dedup.words([md5(f"{salt}{i}".encode()).digest() for i in range(n)])


@pytest.mark.parametrize("n", [0, 1, 50, 5000, 40000])
def test_filter_knows_its_keys_and_forgets_them(n):
    made = Cuckoo.of(keys(n))
    assert made.has(keys(n)).all() and Cuckoo.load(made.dump()).has(keys(n)).all()
    assert made.has(keys(20000, "x")).mean() < 0.001
    half = keys(n)[: n // 2]
    made.delete(half)
    assert made.has(keys(n)[n // 2 :]).all() and (n < 50 or made.has(half).mean() < 0.001)
    made.delete(keys(n)[n // 2 :])
    assert not made.slots.any()
    assert made.insert(keys(n)) and made.has(keys(n)).all()


def test_full_filter_says_so():
    made = Cuckoo.sized(12)
    assert not made.insert(keys(100))


def test_equal_marks_share_buckets():
    same = np.array([[7, 1], [7, 1], [7, 1]], np.uint64)  # as keys whose marks and buckets collide
    made = Cuckoo.sized(20)
    assert made.insert(same)
    made.delete(same[:2])
    assert made.has(same[:1]).all()
    made.delete(same[:1])
    assert not made.has(same[:1]).any()


@pytest.mark.parametrize("shards", [None, 5])
def test_batches_in_and_documents_out(spark, shards):
    rows = corpus(60)
    store = line_dedup.line_store(frame(spark, rows[:5]), shards=shards)
    assert cleaned(store, spark, rows[:5]) == brute(rows[:5])
    store = store.inserted(frame(spark, rows[5:30])).inserted(frame(spark, rows[20:]))  # ten of them again
    assert cleaned(store, spark, rows) == brute(rows)
    gone = {0, 1, 2, 7, 33, 59}
    store = store.deleted(spark.createDataFrame([(d,) for d in gone] * 2, "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert cleaned(store, spark, left) == brute(left)
    fresh = line_dedup.line_store(frame(spark, left), shards=store.shards)
    for name, columns in (("refs", ["key", "doc_id"]), ("counts", ["shard", "key", "n_docs", "first_doc"])):
        a, b = (sorted(map(repr, getattr(s, name).select(columns).collect())) for s in (store, fresh))
        assert a == b
    repeated = store.counts.filter("n_docs > 1").collect()
    filters = {r["shard"]: Cuckoo.load(r["filter"]) for r in store.filters.collect()}
    assert all(bytes(r["key"]) in filters[r["shard"]] for r in repeated)
    assert sum(int((f.slots > 0).sum()) for f in filters.values()) == len(repeated)
    everyone = store.deleted(frame(spark, left).select("doc_id"))
    assert everyone.counts.count() == 0 and not any((Cuckoo.load(r["filter"]).slots > 0).any() for r in everyone.filters.collect())
    assert cleaned(everyone.inserted(frame(spark, rows)), spark, rows) == brute(rows)


def test_filters_grow(spark):
    """Many keys come to a filter that was made for few."""
    first = [(1, "a line of both documents"), (2, "a line of both documents")]
    many = "\n".join(f"line number {i} of two" for i in range(300))
    store = line_dedup.line_store(frame(spark, first), shards=1).inserted(frame(spark, [(3, many), (4, many)]))
    assert cleaned(store, spark, [*first, (3, many), (4, many)]) == brute([*first, (3, many), (4, many)])


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(50, "one long line \n" * 3 + "x" * 300000), (49, "ONE long LINE\n\n\n"), (49, "another row of the document\nx")]
    df = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, key int, __gone string, shard int").repartition(3)
    out = line_dedup.line_store(df).cleaned(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in out.collect()), key=repr)
    assert got == brute(rows)


def test_store_that_outgrows_its_shards(spark, monkeypatch):
    rows = corpus(40, seed=2)
    store = line_dedup.line_store(frame(spark, rows[:4]))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    grown = store.inserted(frame(spark, rows[4:]))
    assert store.shards == 1 and grown.shards > 4 and cleaned(grown, spark, rows) == brute(rows)
    left = rows[10:]
    assert cleaned(grown.deleted(frame(spark, rows[:10]).select("doc_id")), spark, left) == brute(left)
