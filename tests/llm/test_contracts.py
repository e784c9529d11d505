"""Each query against the library, SQL or brute force, on given tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import same_rows

from liftwork.llm import chat, exact_dedup, language, lm_scores, near_dedup, packing, pieces, quality, queries, token_counts, tokens

path = pytest.importorskip("public_tokenizers").path
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would".split()


def awkward_rows():
    draw = random.Random(1)
    prose = [" ".join(draw.choice(WORDS) for _ in range(n)) for n in (3, 60, 80, 120, 400)]
    near = prose[3].split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", *prose, prose[3], " ".join(near), prose[1].upper(), "<|endoftext|> a <|endoftext|>  b<|startoftext|>", "x" * 4000, "ab " * 60000, "é日本  ß q '’lĺ 1.5\r\n", "line\n" * 80, "▁ ▁▁ <s>", "%%% ### " * 60]
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], ["s0", None][i % 2], 1, True, 0.5, "x") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, prose[2], "en", "s0", 1, False, 0.1, "y"), (None, None, None, None, None, None, None, None)]


COLUMNS = "doc_id long, text string, lang string, source string, n_words long, kept boolean, score double, sig string"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder with documents full of nulls, ties, repeats and clashing column names, and one without rows."""
    top = tmp_path_factory.mktemp("awkward")
    df = spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3)
    df.write.parquet(f"{top}/full/documents.parquet")
    df.limit(0).write.parquet(f"{top}/none/documents.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a<b>[c]\\0 \\1"), (1, 1, "assistant", "tie"), (None, 0, None, "x"), (2, 5, "assistant", ""), (2, 5, "assistant", "")]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    talk.write.parquet(f"{top}/full/conversations.parquet")
    talk.limit(0).write.parquet(f"{top}/none/conversations.parquet")
    items = spark.createDataFrame([(1, "the of and"), (2, None), (None, "it was")], "item_id long, text string")
    items.write.parquet(f"{top}/full/benchmark.parquet")
    items.limit(0).write.parquet(f"{top}/none/benchmark.parquet")
    return top


def texts_of(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, awkward, name):
    assert queries.QUERIES[name](spark, f"{awkward}/none").count() == (1 if name.startswith("op4") else 0)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


def brute_statistics(text):
    words = SPACE.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(hit)


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_quality_statistics(spark, sf, awkward, which):
    folder = sf if which == "sf" else f"{awkward}/full"
    got = sorted([(r["doc_id"], *(r[c] for c in quality.STATS[:5]), r["base_failed"]) for r in quality.op1(spark, folder).collect()], key=repr)
    want = []
    for d, t in texts_of(spark, folder):
        s = brute_statistics(t)
        want.append((d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want, key=repr)


def test_quality_rejects_planted_outliers(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(0)
    x = draw.normal([1.6, 0, 0, 0.02], [0.05, 0.01, 0.02, 0.02], (900, 4))
    x[:60] += [0, 1.2, 0, 0]
    rows = spark.createDataFrame([("en", "s", False, *map(float, r), i) for i, r in enumerate(x)], "__lang string, __source string, __failed boolean, __x0 double, __x1 double, __x2 double, __x3 double, i int")
    judged = quality.judged(*quality.fit(rows), 1e-4)
    assert judged.filter("i < 60 AND __kept").isEmpty() and judged.filter("i >= 60").agg(F.avg(F.col("__kept").cast("int"))).first()[0] > 0.995


def test_chi_square():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and quality.consistency(1.0) == 1


def test_centre_is_that_of_the_rows_without_planted_outliers(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(0, 1, (120, 4)) * [0.2, 0.3, 0.3, 0.3]
    x[:20] += 3
    rows = spark.createDataFrame([("a", "b", False, *map(float, r)) for r in x], "__lang string, __source string, __failed boolean, __x0 double, __x1 double, __x2 double, __x3 double")
    model = quality.fit(rows)[1].first()
    assert np.allclose([model[f"__c{i}"] for i in range(4)], x[20:].mean(0), atol=0.15)


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_token_files(spark, sf, awkward, which):
    from tokenizers import Tokenizer

    folder = sf if which == "sf" else f"{awkward}/full"
    library, at = Tokenizer.from_file(path("word_bpe_49k.json")), 0
    got = sorted(tokens.op2(spark, folder).collect(), key=lambda r: r["start"])
    want = Counter()
    for d, t in texts_of(spark, folder):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_pieces(spark, sf, awkward, which):
    from sentencepiece import SentencePieceProcessor

    library, folder = SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), sf if which == "sf" else f"{awkward}/full"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for d, t in texts_of(spark, folder):
        ids = [*library.encode(t or ""), 2]
        want[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, pieces.op3(spark, folder).collect())) == want


def test_pieces_of_random_strings():
    from sentencepiece import SentencePieceProcessor

    library, draw = SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "▁", "'", "er", "the", " the", "é", "日本", "<s>", "<0x0A>", "\t", "in", "th", "\x00", "abab"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(1500)] + ["ab" * 600, "x" * 700]
    got = pieces.encode_ids([t.encode() for t in texts], path("piece_bpe_32k.model"))
    assert got == [[*library.encode(t), 2] for t in texts]
    own = pieces.pieces(path("piece_bpe_32k.model"))
    assert [own.decode(g) for g in got] == [library.decode(g) for g in got]
    assert own.decode([3 + 0xC3, 3 + 0x28]) == library.decode([3 + 0xC3, 3 + 0x28])


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_token_counts(spark, sf, awkward, which):
    from tokenizers import Tokenizer

    library, folder = Tokenizer.from_file(path("byte_bpe_50k.json")), sf if which == "sf" else f"{awkward}/full"
    want = Counter()
    for d, t in texts_of(spark, folder):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, token_counts.op5(spark, folder).collect())) == want


def test_token_counts_of_random_strings():
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(path("byte_bpe_50k.json")), random.Random(4)
    parts = ["a", " ", "  ", "\n", "'s", "'", "ll", "re", "'re", "1", "é", "!", "...", "\t", " ", "日本", "😀", "<|endoftext|>", "the", " the", "\r\n", "v", "e", "'l"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(1500)] + ["ab'll " * 3000]
    assert token_counts.count_tokens([t.encode() for t in texts], path("byte_bpe_50k.json")).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def brute_groups(rows, percent=85):
    """doc_id -> (shingles, least id of its component)."""
    sets = {}
    for d, t in rows:
        w = SPACE.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d] and d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def check_groups(rows, got):
    want = brute_groups(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len(got) == len(rows)


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_near_groups(spark, sf, awkward, which):
    folder = sf if which == "sf" else f"{awkward}/full"
    check_groups(texts_of(spark, folder), near_dedup.op6(spark, folder).collect())


def test_near_groups_of_many_borderline_copies(spark):
    """A long posting list whose members link to some of the others only."""
    draw = random.Random(7)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(220)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in draw.sample(range(220), draw.choice([1, 2, 3, 6, 8])):
            words[k] = f"z{i}x{k}"
        rows.append((i, " ".join(words)))
    check_groups(rows, near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["label"] for r in near_dedup.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("which", ["sf", "awkward"])
def test_packing(spark, sf, awkward, which):
    from tokenizers import Tokenizer

    library, folder = Tokenizer.from_file(path("byte_bpe_50k.json")), sf if which == "sf" else f"{awkward}/full"
    got = packing.op7(spark, folder).collect()
    want = Counter()
    for d, t in texts_of(spark, folder):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    least = -(-sum(r["length"] for r in got) // 1024)
    assert len(by) <= 1.02 * least + 1


def least_bins(items, capacity):
    """By search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            left = list(rooms)
            left.remove(room)
            place(i + 1, [*left, room - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    draw = random.Random(3)
    for _ in range(150):
        items = [draw.randint(3, 20) for _ in range(draw.randint(1, 8))]
        left = packing.Histogram(dict(Counter(items)))
        fixed = packing.reduce_dominated(left, 20)
        rest = [x for x, n in left.n.items() for _ in range(n)]
        assert sum(fixed.values()) + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)


def test_language(spark, sf, awkward):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.op8(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    rows = language.op8(spark, f"{awkward}/full").collect()
    text = dict(texts_of(spark, f"{awkward}/full"))
    for r in rows:
        none = not any(c.isalpha() for c in text[r["doc_id"]] or "") if r["doc_id"] is not None else None
        assert none is None or (r["lang_pred"] == "und") == none
    assert len(rows) == len(awkward_rows())


def test_forward_sums_all_segmentations():
    where = path("piece_bpe_32k.model")
    vocab, draw = language.vocabulary(where), np.random.default_rng(0)
    p = draw.random((len(vocab) + 2, 2))
    p[-1] = 0
    words = ["▁the", "▁ßü", "▁日本語", "▁thereouer"]
    got = language.Lattice(words, language.trie(where)).forward(p)

    def total(w, c):
        if not w:
            return 1.0
        return sum(p[vocab.get(w[:k], len(vocab) if k == 1 else -1), c] * total(w[k:], c) for k in range(1, len(w) + 1) if w[:k] in vocab or k == 1)

    assert np.allclose(got, [[np.log(total(w, c)) for c in (0, 1)] for w in words])
    n = language.Lattice(words, language.trie(where)).expected(p[:, 0] / p[:, 0].sum(), np.array([1.0, 2, 1, 1]))
    assert 4 <= n.sum() <= 2 * 3 + sum(map(len, words))


def test_exact_dedup_with_hot_texts(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(900)] + [(5, "hot"), (899, "hot"), (899, "hot"), (None, "hot"), (None, "lone")]
    got = exact_dedup.content_sort(spark.createDataFrame(rows, "doc_id long, text string"), hot_share=0.25).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["text"]].append(r)
    for t, own in by.items():
        ids = [d for d, x in rows if x == t]
        assert {(r["__keep_id"], r["__group_size"]) for r in own} == {(max([d for d in ids if d is not None], default=None), len(ids))}
        assert sum(r["__kept"] for r in own) == 1


def test_exact_dedup_awkward(spark, awkward):
    got = exact_dedup.op10(spark, f"{awkward}/full").collect()
    sizes = Counter(t or "" for _, t in texts_of(spark, f"{awkward}/full"))
    assert sum(r["kept"] for r in got) == len(sizes) and sum(r["group_size"] for r in got) == sum(n * n for n in sizes.values())


def test_chat_awkward(spark, awkward):
    got = {r["conv_id"]: r for r in chat.op4(spark, f"{awkward}/full").collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {-1: 2, 1: 3, 2: 2, None: 1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "a<b>[c]\\0 \\1tie"
    assert got[1]["loss_sha256"] == sha(said) and got[1]["loss_chars"] == len(said)
    assert got[-1]["turns_sha256"] == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")


def test_reply_trees(spark):
    """A branching tree, an orphan, a cycle."""
    rows = [("a", 1, None, "user", "root", 0.0), ("a", 2, 1, "assistant", "low", 1.0), ("a", 3, 1, "assistant", "high", 5.0), ("a", 4, 3, "user", "deep", -1.0), ("a", 5, 2, "user", "long", 0.5), ("b", 1, 9, "user", "orphan", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r["formatted"] for r in chat.format_trees(messages, 2).collect()}
    assert got == {("a", 1): "<s>[user]root</s>[assistant]high</s>[user]deep</s>", ("a", 2): "<s>[user]root</s>[assistant]low</s>[user]long</s>", ("b", 1): "<s>[user]orphan</s>"}


def test_backoff_scores_by_hand(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, "q b"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scores.backoff_scores(docs, F.col("doc_id") <= 2).collect()}
    ln = np.log
    assert got[1]["log_score"] == pytest.approx(ln(1) + ln(2 / 3) + ln(1) + ln(2 / 3)) and got[1]["n_backed_off"] == 0
    assert got[2]["log_score"] == pytest.approx(ln(1) + ln(1 / 3))
    assert got[3]["log_score"] == pytest.approx(ln(0.4 * 1 / 6) + ln(0.4 * 2 / 6)) and got[3]["n_backed_off"] == 2
    assert got[4]["log_score"] == 0
