"""Stage by stage against plain Python, each on what its predecessor kept."""

import pytest
from test_contracts import brute_groups, brute_statistics  # noqa: F401

pytest.importorskip("public_tokenizers")


def test_stages(spark, sf):
    import corpus_pipeline
    from liftwork.llm import quality
    from liftwork.llm.common import documents, scratch

    docs = documents(spark, sf)
    columns = docs.columns
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, sf), name.replace(" ", "_"))
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start, good, known, distinct, single, packed = kept
    verdict = {r["doc_id"]: r["kept"] for r in quality.op1(spark, sf).collect()}
    assert {r["doc_id"] for r in good} == {d for d, k in verdict.items() if k}
    plain = [r["doc_id"] for r in start if brute_statistics(r["text"])[2] == 0 and not _failed(r["text"])]
    assert len(set(plain) - {r["doc_id"] for r in good}) <= 0.01 * len(plain)
    assert {r["doc_id"] for r in known} == {r["doc_id"] for r in good}
    last = {}
    for r in known:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert {r["doc_id"] for r in distinct} == set(last.values())
    groups = brute_groups([(r["doc_id"], r["text"]) for r in distinct], 80)  # no contract binds the stage to op6's 85
    assert {r["doc_id"] for r in single} == {d for d, (_, c) in groups.items() if d == c}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in single}


def _failed(text):
    s = brute_statistics(text)
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def test_run(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 0
