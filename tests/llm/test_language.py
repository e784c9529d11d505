"""Expected piece counts by enumeration, long words, and planted languages."""

import numpy as np
import pytest

from liftwork.llm import language

path = pytest.importorskip("public_tokenizers").path


@pytest.fixture(scope="module")
def model():
    where = path("piece_bpe_32k.model")
    vocab = language.vocabulary(where)
    p = np.random.default_rng(3).random(len(vocab) + 2)
    p[-1] = 0
    return vocab, language.trie(where), p / p.sum()


def segmentations(word, vocab):
    """All ways to write `word` in pieces; single letters that are no piece are the unknown one."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        piece = vocab.get(word[:k], len(vocab) if k == 1 else None)
        if piece is not None:
            for rest in segmentations(word[k:], vocab):
                yield [piece, *rest]


def test_no_piece_is_left_out(model):
    vocab, tree, _ = model
    assert max(map(len, vocab)) == tree.longest > 8
    words = sorted(vocab, key=len)[-20:]
    lattice = language.Lattice(words, tree)
    assert all(lattice.piece[len(w) - 1, lattice.starts[lattice.order.index(i)]] == vocab[w] for i, w in enumerate(words))


def test_expected_counts_by_enumeration(model):
    vocab, tree, p = model
    words, times = ["▁the", "▁information", "▁ßü日", "▁a", "▁development"], np.array([2.0, 1, 3, 5, 1])
    want, total = np.zeros(len(p)), []
    for w, n in zip(words, times, strict=True):
        ways = [(np.prod(p[s]), s) for s in segmentations(w, vocab)]
        total.append(sum(x for x, _ in ways))
        for x, s in ways:
            np.add.at(want, s, n * x / total[-1])
    lattice = language.Lattice(words, tree)
    assert np.allclose(lattice.expected(p, times), want)
    assert np.allclose(lattice.forward(p[:, None])[:, 0], np.log(total))
    many = language.Lattice(words * 10, tree)  # the other way through the sizes
    assert np.allclose(many.expected(p, np.tile(times, 10)), 10 * want) and np.allclose(many.forward(p[:, None])[:, 0], np.tile(np.log(total), 10))


def test_very_long_words(model):
    """No underflow, and each position is covered once."""
    vocab, tree, p = model
    word = "▁" + "information" * 3000
    lattice = language.Lattice([word, "▁the"], tree)
    assert np.isfinite(lattice.forward(p[:, None])).all()
    size = {i: len(w) for w, i in vocab.items()}
    assert sum(n * size.get(i, 1) for i, n in enumerate(lattice.expected(p, np.ones(2))) if n) == pytest.approx(len(word) + 4)


def test_planted_languages(spark):
    """Three invented languages of their own letters and one text of each kind that has none."""
    draw, rows = np.random.default_rng(0), []
    letters = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    for i in range(300):
        lang = list(letters)[i % 3]
        rows.append((i, " ".join("".join(draw.choice(list(letters[lang]), 5)) for _ in range(30)), None if i % 50 == 0 else lang))
    docs = spark.createDataFrame([*rows, (900, "123 !", "aa"), (901, None, "bb"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["__lang_pred"], r["__score"]) for r in language.with_language(docs, language.fit(docs, most_docs=40)).collect()}
    assert all(got[i] == (list(letters)[i % 3], pytest.approx(1)) for i, _, _ in rows)
    assert {got[i] for i in (900, 901, 902)} == {("und", 0.0)}


def test_labels_and_scores_by_enumeration(spark, model):
    """lang_pred and score from all segmentations of all runs of letters, one by one; `und` exactly where no character is a letter."""
    vocab = model[0]
    docs = [("the water of the sea", "en"), ("das wasser der see", "de"), ("la mer et le vent", "fr"), ("it was the house", "en"), ("es war das haus", "de"), ("le vent de la nuit", "fr")] * 3
    asked = ["H₂O", "x²", "½cup", "CO₂ der See", "日本 the", "²³ ½", "१२ 1_2", None, "", "a_b-c ", "ǅ", "der7die7das", "le vent", "ﬁn the"]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([*docs, *((a, None) for a in asked)])], "doc_id long, text string, lang string").repartition(3)
    langs, p, priors = found = language.fit(rows)
    for r in language.with_language(rows, found).collect():
        words = "".join(c if c.isalpha() else " " for c in r["text"] or "").lower().split()
        words = ["▁" + x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
        if not words:
            assert (r["__lang_pred"], r["__score"]) == ("und", 0.0), r["text"]
            continue
        log = priors + sum(np.log(sum(np.prod(p[s], axis=0) for s in segmentations(w, vocab))) for w in words)
        assert r["__lang_pred"] == langs[int(np.argmax(log))], r["text"]
        assert r["__score"] == pytest.approx(1 / np.exp(log - log.max()).sum())
