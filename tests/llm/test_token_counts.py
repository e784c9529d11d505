"""Long runs without a cut against the library, with time and states bounded."""

import random
import time

import pytest

from liftwork.llm import token_counts

path = pytest.importorskip("public_tokenizers").path


def test_long_runs():
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(path("byte_bpe_50k.json")), random.Random(8)
    letters = "".join(draw.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(30_000))
    texts = [letters, "x" * 5000, "abab" * 3000, "".join(map(chr, (draw.randint(0x4E00, 0x9FFF) for _ in range(3000)))), " " * 4000 + "a", "=" * 3001, "".join(draw.choice("0123456789") for _ in range(5000)), "é" * 999]
    texts += ["".join(draw.choice(["th", "er", "ing", "q", "ß", "日"]) for _ in range(n)) for n in (30, 47, 48, 60, 96, 97, 200)]
    got = token_counts.count_tokens([t.encode() for t in texts], path("byte_bpe_50k.json")).tolist()
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_megabyte_without_a_cut():
    from tokenizers import Tokenizer

    draw = random.Random(9)
    text = "".join(draw.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(1 << 20))
    token_counts.count_tokens([b"warm"], path("byte_bpe_50k.json"))
    began = time.process_time()
    got = token_counts.count_tokens([text.encode()], path("byte_bpe_50k.json"))
    assert time.process_time() - began < 20
    assert got[0] == len(Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)
