"""Distances and leading terms against counting in plain Python; trees share what is equal."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_contracts import awkward_rows

from liftwork.llm import source_audit

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least, most=50):
    """All result rows of (text, lang, source) rows."""
    count, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERMS.findall(lower(text or ""))
        groups.add((lang, source))
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (k, t), n in docs.items() if k == lang and n >= least)
        sources, v = sorted(s for k, s in groups if k == lang), len(kept)

        def shares(counts):
            total = sum(counts)
            return [1 + 10**9 * (c + 5) // (total + 5 * v) for c in counts]

        own = {s: [count[lang, s, t] for t in kept] for s in sources}
        p, q = {s: shares(c) for s, c in own.items()}, shares([sum(own[s][i] for s in sources) for i in range(v)])
        for s in sources:
            far = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -f, i + 1) for i, (f, _, o) in enumerate(far)]
            more = sorted((b - a, t.encode(), t) for a, b, t, c in zip(p[s], q, kept, own[s], strict=True) if c and a > b)
            out += [(lang, s, "term", t, -f, i + 1) for i, (f, _, t) in enumerate(more[:most])]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_audit.audit(df, **how).collect())


@pytest.mark.parametrize("width", [4096, 7, 1])
def test_audit(spark, width):
    draw = random.Random(1)
    words = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(90)] + ["Été", "日本", "ÀB"]
    rows = [(" ".join(draw.choices(words, [1 / (i + 1 + 3 * (k % 4)) for i in range(93)], k=draw.randint(0, 30))), ["en", "de", None][k % 3], [None, "a", "b", "c", "É"][k % 5]) for k in range(200)]
    rows += [("seldom", "xx", "a"), (None, "xx", "b"), ("", "yy", "only")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert audited(df, least_docs=8, width=width) == brute(rows, 8)


def test_awkward_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in awkward_rows()]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, shard int, number int")
    assert audited(df, least_docs=2) == brute(rows, 2)
    assert audited(df.limit(0)) == []


def test_trees_share_equal_parts():
    """Groups with the same counts are one tree, and a pair of nodes is looked at once however often it comes up."""
    draw = np.random.default_rng(0)
    one = draw.integers(1, 4, 256)
    group, place = np.repeat(np.arange(6), 256), np.tile(np.arange(256), 6)
    alike = source_audit.Forest(group, place, np.tile(one, 6), 256)
    assert len(set(alike.roots.values())) == 1 and alike.nodes() <= source_audit.Forest(np.zeros(256, int), np.arange(256), one, 256).nodes()
    totals = np.full(6, one.sum() + 5 * 256)
    far, looked = alike.distances(np.array([0, 1]), np.array([5, 4]), totals)
    assert (far == 0).all()
    flat = source_audit.Forest(np.array([0]), np.array([3]), np.array([9]), 1 << 12)
    far, looked = flat.distances(np.array([0]), np.array([1]), np.array([9 + 5 * 4096, 5 * 4096]))
    p, q = (1 + 10**9 * (np.where(np.arange(4096) == 3, c, 0) + 5) // (c + 5 * 4096) for c in (9, 0))
    assert far[0] == np.abs(p - q).sum() and looked < 30  # not 4096 leaves


def test_long_division():
    draw = random.Random(0)
    n = [draw.randint(0, 10**12) for _ in range(200)] + [0, 1]
    total = [x + 5 + draw.randint(0, 10**13) for x in n]
    got = source_audit.shares(np.array(n), np.array(total))
    assert got.tolist() == [1 + 10**9 * (a + 5) // b for a, b in zip(n, total, strict=True)]
