import hashlib
import random

import pytest
from tokenizers import Tokenizer

from orrery.llm import forced_bpe as B

from .conftest import prose

BITS = ["a", "b", "The", " ", "  ", "\n", "\t", "'s", "'", "é", "É", "é", "日本", "1", "23", ".", ",", "!", "<|endoftext|>", "\xa0", "\x1c", "😀", "_", "İ", "Σ", "ß", "ﬁ", "Ⅷ", "²", "　", "​"]


@pytest.fixture(scope="module")
def both(tokenizer_json):
    spec = tokenizer_json("word_bpe_49k.json")
    return B.ForcedBoundaryBPE(spec, cache_fragments=200), Tokenizer.from_str(spec)


def test_equals_the_library(both):
    own, library = both
    draw = random.Random(5)
    texts = ["".join(draw.choices(BITS, k=draw.randint(0, 30))) for _ in range(4000)] + [prose(k, 60) for k in range(20)] + ["x" * 20_000, "qz" * 3000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced(both):
    """No token holds a byte pair that the table lacks."""
    own, _ = both
    alphabet = B.byte_alphabet()
    assert 0 < own.inside.sum() < 256 * 256
    for token in own.vocab:
        b = [alphabet[c] for c in token.removesuffix("</w>")]
        assert all(own.inside[x, y] for x, y in zip(b, b[1:], strict=False))
    word = "zqxjkvbpygfwmucldrhsnioate"
    assert any(word[k - 1 : k + 1] not in own.joins for k in range(1, len(word)))


def test_both_merge_loops_agree(both):
    own, draw = both[0], random.Random(1)
    for _ in range(500):
        symbols = draw.choices("abcdeinorst", k=draw.randint(1, 60))
        symbols[-1] += "</w>"
        assert own._merge(list(symbols)) == own._merge_long(list(symbols))


def test_queries_digests(both, edge_docs, empty_docs, tokenizer_json):
    _, library = both
    spec = tokenizer_json("word_bpe_49k.json")
    for r in B.round_trip_digests(edge_docs, spec).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert B.round_trip_digests(empty_docs, spec).collect() == []
    for r in B.encode_documents(edge_docs, spec).collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
