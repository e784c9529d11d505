"""Each stage of the pipeline on nulls, empty tables, repeats, long texts and columns with clashing names."""

import random
from collections import Counter

import pytest
from test_contracts import WORDS, brute_statistics

pytest.importorskip("public_tokenizers")
CLASHING = ["s", "l", "n", "id", "name", "doc", "key", "sig", "h1", "__text", "__none", "__head", "__hash", "__kept", "__keep_id", "__score", "__lang", "__source", "__key", "__x0", "__v0", "__c0", "__n_words", "__failed", "__lang_pred", "__of_lang"]


def rows():
    draw = random.Random(5)
    prose = [" ".join(draw.choice(WORDS) for _ in range(n)) for n in (60, 70, 90, 120, 150, 300)]
    texts = [*prose, prose[0], prose[0], prose[1] + " end", None, "", "123 456 !", "a b c", "ab " * 30000, " ".join(draw.choice(WORDS) for _ in range(40000)), None]
    ids = [*range(len(texts) - 2), 3, None]
    return [(d, t, "en" if i % 2 else None, None if i % 3 else "s0") for i, (d, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING)).repartition(3)


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["quality rules", "language identification", "exact dedup", "near dedup"])
def test_stage(spark, docs, name):
    out = stages()[name](spark, docs, "")
    assert out.columns == docs.columns
    got, all_rows = [tuple(r) for r in out.collect()], [tuple(r) for r in docs.collect()]
    assert not Counter(map(repr, got)) - Counter(map(repr, all_rows))  # rows as they were
    kept = Counter((r[0], r[1]) for r in got)
    given = Counter((r[0], r[1]) for r in all_rows)
    if name == "quality rules":
        bad = {k for k in given if (s := brute_statistics(k[1]))[0] < 50 or 100 * s[4] > 50 * s[0]}
        assert not bad & kept.keys() and len(given.keys() - bad - kept.keys()) <= 1
    if name == "language identification":
        assert all((k in kept) == any(c.isalpha() for c in k[1] or "") for k in given)
    if name == "exact dedup":
        texts = {k[1] or "" for k in given}
        assert sum(kept.values()) == len(texts) and {k[1] or "" for k in kept} == texts
        best = {t: max((d for d, x in given if (x or "") == t and d is not None), default=None) for t in texts}
        assert {(t or "", d) for d, t in kept} == {(t, d) for t, d in best.items()}
    if name == "near dedup":
        rest = [k for k in given if k[0] in (6, 7, 8)]  # copies of 0, and nearly 1
        assert not any(k in kept for k in rest) and all(kept[k] for k in given if k[0] in (0, 1, 2, 4, 5, None))


def test_packing_stage(spark, docs):
    out = stages()["best-fit packing"](spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("name", ["quality rules", "language identification", "exact dedup", "near dedup", "best-fit packing"])
def test_stage_of_nothing(spark, docs, name):
    out = stages()[name](spark, docs.limit(0), "")
    assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns)
