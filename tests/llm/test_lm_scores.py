"""Scores against counting in plain Python: hot words and pairs, partly counted documents, awkward rows, large batches."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_contracts import awkward_rows

from liftwork.llm import lm_scores

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, train):
    """(doc_id, words, backed off, score) of each row."""
    words = [SPACE.findall(t or "") for _, t in rows]
    pairs, contexts, single = Counter(), Counter(), Counter()
    for (d, _), w in zip(rows, words, strict=True):
        if train(d):
            pairs.update(zip([None, *w], w, strict=False))
            contexts.update([None, *w[:-1]] if w else [])
            single.update(w)
    total, out = max(1, sum(single.values())), []
    for (d, _), w in zip(rows, words, strict=True):
        score, backed = 0.0, 0
        for v, x in zip([None, *w], w, strict=False):
            if pairs[v, x]:
                score += np.log(pairs[v, x] / contexts[v])
            else:
                score, backed = score + np.log(0.4 * max(1, single[x]) / total), backed + 1
        out.append((-1 if d is None else d, len(w), backed, pytest.approx(score, abs=1e-6)))
    return sorted(out, key=lambda r: (r[0], r[1]))


def scored(spark, rows, **how):
    got = lm_scores.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()
    return sorted([(-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_backed_off"], r["log_score"]) for r in got], key=lambda r: (r[0], r[1]))


def skewed(n):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(i, " ".join([*draw.choices(words, weights, k=draw.randint(0, 60)), *(["of", "the"] * draw.randint(0, 9))])) for i in range(n)]


@pytest.mark.parametrize("hot_count", [1 << 20, 50, 5])
@pytest.mark.parametrize("part", [1, 3])
def test_hot_words_and_pairs(spark, hot_count, part):
    from pyspark.sql import functions as F

    rows = skewed(400)
    train = None if part == 1 else F.col("doc_id") % part == 0
    assert scored(spark, rows, train=train, hot_count=hot_count, group_bytes=4096) == brute(rows, lambda d: part == 1 or d % part == 0)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert scored(spark, rows) == brute(rows, lambda d: True)


def test_more_rows_than_16_bits_in_a_batch(spark):
    rows = [(i, f"a{i % 7} b") for i in range(70_000)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = lm_scores.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == 70_000 and {r["n_words"] for r in got} == {2}
    assert all(r["log_score"] == pytest.approx(np.log(1 / 7), abs=2e-4) for r in got)


def brute_apart(rows):
    """Each row by the counts of all other rows, counted anew for each."""
    words = [SPACE.findall(t or "") for _, t in rows]
    pairs = [Counter(zip([None, *w], w, strict=False)) for w in words]
    contexts, single = [Counter([None, *w[:-1]] if w else []) for w in words], [Counter(w) for w in words]
    every = [sum(x, Counter()) for x in (pairs, contexts, single)]
    out = []
    for (d, _), w, p, c, s in zip(rows, words, pairs, contexts, single, strict=True):
        p, c, s = every[0] - p, every[1] - c, every[2] - s
        total, score, backed = max(1, sum(s.values())), 0.0, 0
        for v, x in zip([None, *w], w, strict=False):
            if p[v, x]:
                score += np.log(p[v, x] / c[v])
            else:
                score, backed = score + np.log(0.4 * max(1, s[x]) / total), backed + 1
        out.append((-1 if d is None else d, len(w), backed, pytest.approx(score, abs=1e-6)))
    return sorted(out, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("hot_count", [1 << 20, 50, 5])
@pytest.mark.parametrize("common_share", [1 << 20, 100, 3])
def test_documents_by_all_others(spark, hot_count, common_share):
    rows = skewed(200) + [(500, "w1 w2 alone alone w3"), (501, "x y z"), (502, "x y z"), (503, "of the " * 400)]
    got = scored(spark, rows, apart=True, hot_count=hot_count, common_share=common_share, group_bytes=4096)
    assert got == brute_apart(rows)
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def test_awkward_rows_apart(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert scored(spark, rows, apart=True) == brute_apart(rows)
    with pytest.raises(ValueError):
        from pyspark.sql import functions as F

        scored(spark, rows, apart=True, train=F.lit(True))


def test_packed_counts():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 300, 1000)
    x[5] = 1 << 20
    assert np.array_equal(lm_scores.unpack(lm_scores.pack(x), 1000), x)
    h = draw.integers(0, 1 << 48, 1000).astype(np.uint64)
    assert np.array_equal(lm_scores.unpack48(lm_scores.pack48(h)), h)
