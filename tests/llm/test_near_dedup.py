"""Groups against row-by-row brute force: repeated ids, hot centres, other similarities."""

import random

import pytest
from test_contracts import SPACE

from liftwork.llm import near_dedup


def brute_rows(rows, percent):
    """(doc_id, shingles, least doc_id reachable) of each row; rows are nodes of their own."""
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            inter = len(sets[i] & sets[k])
            if inter and rows[i][0] is not None and rows[k][0] is not None and 100 * inter >= percent * (len(sets[i]) + len(sets[k]) - inter):
                root[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=repr)


def grouped(spark, rows, *how):
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), *how).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def changed(words, spots, mark):
    out = list(words)
    for k in spots:
        out[k] = f"z{mark}x{k}"
    return " ".join(out)


@pytest.mark.parametrize("how", [(85, 28), (80, 24)])
def test_repeated_ids_are_judged_by_their_own_texts(spark, how):
    draw = random.Random(1)
    texts = [[f"w{draw.randint(0, 10**6)}" for _ in range(150)] for _ in range(4)]
    a, b, c, d = texts
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, changed(b, [40], 1)), (3, " ".join(c)), (3, changed(a, [20, 90], 2)), (9, " ".join(c)), (9, " ".join(c)), (8, changed(d, [10, 50, 90, 130], 3)), (8, " ".join(d)), (None, " ".join(d)), (2, "a b"), (2, "A  b"), (1, "b a"), (1, None), (4, "")]
    assert grouped(spark, rows, *how) == brute_rows(rows, how[0])


def test_hot_centre(spark):
    """Leaves that are near the centre but not near each other, most of them copies of some others."""
    draw = random.Random(2)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        rows.append((i, changed(base, [draw.randint(4, 60), draw.randint(70, 120), draw.randint(130, 195)], i % 90)))
    rows += [(2000 + i, changed(base, list(range(0, 60, 6)), 500 + i % 3)) for i in range(40)]
    assert grouped(spark, rows) == brute_rows(rows, 85)


def test_links_from_the_least_similarity_on(spark):
    """Chains of pairs around the threshold."""
    draw, rows = random.Random(3), []
    for i in range(60):
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(104)]  # 100 shingles
        n = draw.randint(2, 30)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[n:], *(f"v{i}y{k}" for k in range(n))]))]
    for how in ((85, 28), (80, 24)):
        assert grouped(spark, rows, *how) == brute_rows(rows, how[0])


def test_blocks_by_shingles(spark, monkeypatch):
    """Blocks of a few texts each give the links of large ones."""
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(200)]
    rows = [(i, changed(base, [draw.randint(4, 60), draw.randint(70, 120), draw.randint(130, 195)], i % 90)) for i in range(100)]
    rows += [(2000 + i, changed(base, list(range(0, 60, 6)), 500 + i % 3)) for i in range(40)]
    monkeypatch.setattr(near_dedup.rest_links, "__defaults__", (900,))
    assert grouped(spark, rows) == brute_rows(rows, 85)
