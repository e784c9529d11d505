"""Rankings against scoring every document, whatever the blocks and parts; strata that cannot win are not visited."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_contracts import awkward_rows

from liftwork.llm import ranked_search

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n, length = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    for i, q in asked.items():
        scored = []
        for d, c in tf:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in q.items() if c[t])
            if score > 0:
                scored.append((-score, -1 if d is None else d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, block=ranked_search.BLOCK, **how):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, m int").repartition(3)
    index = ranked_search.build(df, block)
    got = ranked_search.ranked(index, spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    return sorted(((r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got), key=repr)


def corpus(n):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    return [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(80)], k=draw.choice([0, 3, 3, 8, 40, 200])))) for i in range(n)]


def questions():
    draw = random.Random(3)
    return [*((i, " ".join(draw.choices([f"W{k}" for k in range(90)], k=draw.randint(1, 25)))) for i in range(30)), (5, "w1 w1 w2"), (40, None), (41, "nowhere"), (None, "w7 w7 w9")]


@pytest.mark.parametrize(("block", "top"), [(ranked_search.BLOCK, 10), (300, 3), (1, 10)])
def test_rankings(spark, block, top):
    docs = corpus(300)
    assert ranked(spark, docs, questions(), block, top=top) == brute(docs, questions(), top)


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "PART", 60)
    docs = corpus(120)
    assert ranked(spark, docs, questions(), 500) == brute(docs, questions())


def test_awkward_rows(spark):
    docs = [*((r[0], r[1]) for r in awkward_rows()), (70, "the of and " * 30000), (71, "the of"), (72, "of the"), (73, "the of")]
    items = [(1, "the OF and it"), (2, "of of of"), (3, "é日本 ab"), (4, "")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, docs[:0], items) == [] and ranked(spark, docs, items[:0]) == []


def test_only_strata_that_may_win_are_visited():
    """Of many strata only the short documents', whose bounds are highest."""
    block, draw = ranked_search.Block(), random.Random(0)
    for i in range(3000):
        n = draw.randint(1, 400)
        block.add(i, [b"x", *(b"f%d" % draw.randint(0, 50) for _ in range(n - 1))], 25 + n)
    rows = block.rows("b").to_pylist()
    lists = {r["term"]: tuple(np.frombuffer(r[c], t) for c, t in (("strata", np.int64), ("tfs", np.int64), ("sizes", np.uint32), ("postings", np.uint32))) for r in rows[1:]}
    finder = ranked_search.Searcher({0: {b"x": 100}}, 10)
    finder.block(np.frombuffer(rows[0]["strata"], np.int64), np.frombuffer(rows[0]["postings"], np.int64), {b"x": lists[b"x"]})
    assert finder.visited < finder.strata / 10
    score, names = finder.best[0]
    want = sorted((-100 * (10**9 // (1000 + 8 * m)), i) for i, m in zip(block.ids, block.m, strict=True))[:10]
    assert list(zip((-score).tolist(), names.tolist(), strict=True)) == want
