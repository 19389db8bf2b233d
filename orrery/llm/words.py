"""Words of a batch of texts as numpy arrays: 64-bit hashes and places, without a Python object a word.

A word is a run of bytes other than ASCII white space; a line ends at a line feed. Hashes are polynomial sums over a word's bytes, taken from running
sums over the whole buffer, so that the cost is a few array operations a byte. They are the same in every process.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time (more where a word is longer): bounds the working arrays.
CHUNK_BYTES = 2**20

_WORD, _EDGE, _SPACE = 0, 1, 2
_BYTE = np.random.default_rng(12).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  kept over calls, of one chunk's length
    if base not in known or len(known[base]) < n:
        x = np.full(max(n, CHUNK_BYTES + 2**12), base, np.uint64)
        x[0] = 1
        known[base] = np.multiply.accumulate(x)
    return known[base][:n]


def folded(text: str) -> bytes:
    """Lower case in UTF-8, but for code points whose lower case has another number of bytes: so places in it are places in the text."""
    plain, low = text.encode("utf-8"), text.lower().encode("utf-8")
    if len(low) != len(plain):
        low = "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in text).encode("utf-8")
    return low


class Words:
    """hash, start and stop (bytes in its text) of every word, in order; doc, its text's number; line, which tells lines apart; first_word, the
    first word of each text (and their total)."""

    def __init__(self, texts: list[bytes], edges: bytes = b""):
        """Marks in edges are no part of a word's hash at its ends, unless it is made of them."""
        kinds = np.zeros(256, np.uint8)
        kinds[list(edges)] = _EDGE
        kinds[list(b" \t\n\v\f\r")] = _SPACE
        buffer = b"\n".join(texts) + b"\n"
        data = np.frombuffer(buffer, np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found: list[tuple[np.ndarray, ...]] = []
        at, lines = 0, 0
        while at < len(data):
            end = min(at + CHUNK_BYTES, len(data))
            while end < len(data) and kinds[data[end - 1]] != _SPACE:
                end += 1
            found.append(self._chunk(data[at:end], kinds, at, lines))
            lines += int(np.count_nonzero(data[at:end] == 10))
            at = end
        self.hash, starts, stops, self.line = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = np.searchsorted(bounds, starts, "right") - 1
        self.start, self.stop = starts - bounds[self.doc], stops - bounds[self.doc]
        self.first_word = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    @staticmethod
    def _chunk(data: np.ndarray, kinds: np.ndarray, at: int, lines: int) -> tuple[np.ndarray, ...]:
        kind = kinds[data]
        space = np.concatenate([[True], kind == _SPACE, [True]])
        turns = np.flatnonzero(space[1:] != space[:-1])
        starts, stops = turns[::2], turns[1::2]
        core = np.flatnonzero(kind == _WORD)
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == _WORD, out=before[1:])
        some = before[stops] > before[starts]
        own, end = starts.copy(), stops.copy()
        own[some], end[some] = core[before[starts[some]]], core[before[stops[some]] - 1] + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=sums[1:])
        hashes = mix((sums[end] - sums[own]) * _powers(_BACK, len(data) + 1)[own] + (end - own).astype(np.uint64))
        line = np.cumsum(data == 10)[starts] + lines
        return hashes, starts + at, stops + at, line
