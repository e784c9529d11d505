"""Chunks that share a hash, and long runs of letters."""

import numpy as np
import pytest

from liftwork.llm import tokens

path = pytest.importorskip("public_tokenizers").path


def thue_morse(n, first, second):
    return bytes(first if i.bit_count() % 2 else second for i in range(n))


@pytest.mark.parametrize("make, name", [(tokens.WordEncoder, tokens.WORDS), (tokens.ByteEncoder, tokens.BYTES)])
def test_chunks_with_one_hash(make, name):
    """Thue-Morse strings and their complements have one polynomial hash modulo a power of two."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path(name)), make(path(name))
    texts = [x for n in (1024, 2048, 4096, 8192) for x in (thue_morse(n, 97, 98), thue_morse(n, 98, 97), b"so " + thue_morse(n, 97, 98) + b" it is")]
    data = np.frombuffer(b"".join(texts[:2]), np.uint8)
    assert len(set(tokens.chunk_hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    texts += [b"", b"plain words", thue_morse(2048, 97, 98)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    assert own.ids(texts) == want and [own.ids([t])[0] for t in texts] == want


def test_kind_is_read_from_the_file(tmp_path):
    """A renamed copy is cut as the original; other kinds raise, whatever they are called."""
    import json
    import shutil

    import pytest

    from liftwork.llm import tokens

    public = pytest.importorskip("public_tokenizers").path
    for name, kind in (("word_bpe_49k.json", tokens.WordEncoder), ("byte_bpe_50k.json", tokens.ByteEncoder)):
        shutil.copy(public(name), tmp_path / "copy.json")
        assert type(tokens.encoder_for(str(tmp_path / "copy.json"))) is kind
    spec = json.loads((tmp_path / "copy.json").read_text())
    for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"type": "WordPiece"}}):
        (tmp_path / "word_bpe_other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="no kind"):
            tokens.encoder_for(str(tmp_path / "word_bpe_other.json"))
