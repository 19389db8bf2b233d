import re

from orrery.llm import words as W

from .conftest import prose

EDGES = b".,!"


def test_words_and_lines(monkeypatch):
    """Against regular expressions, also where words and texts cross chunks."""
    texts = [prose(1, 300), "", " \n\n ", "One, two!\n.three... ... é\xa0É\tÀ", "x" * 500 + " " + "y" * 30, "İstanbul İİ Σας", "a\nb\n"]
    for size in (2**20, 64, 7):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        found = W.Words([W.folded(t) for t in texts], EDGES)
        n = 0
        for d, text in enumerate(texts):
            data = W.folded(text)
            spans = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", data)]
            own = slice(found.first_word[d], found.first_word[d + 1])
            assert list(zip(found.start[own].tolist(), found.stop[own].tolist(), strict=True)) == spans
            line = [data[:a].count(b"\n") for a, _ in spans]
            own_line = found.line[own].tolist()
            assert [x - own_line[0] for x in own_line] == [x - line[0] for x in line] if spans else own_line == []
            n += len(spans)
        assert len(found.hash) == n == found.first_word[-1]


def test_hashes_tell_words_apart(monkeypatch):
    seen = {}
    for size in (2**20, 50):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        words = [f"{a}{k}" for k in range(3000) for a in ("ab", "ba", "a", "")]
        found = W.Words([" ".join(words).encode()]).hash.tolist()
        for w, h in zip(words, found, strict=True):
            assert seen.setdefault(h, w) == w
    low = W.Words([W.folded("The End, end. (end)")], b".,()").hash
    assert low[1] == low[2] == low[3] != low[0]
    assert W.Words([b"... . a"], b".").hash.tolist() != W.Words([b"a a a"], b".").hash.tolist()
    assert len(W.folded("İ Ä ẞ")) == len("İ Ä ẞ".encode())
