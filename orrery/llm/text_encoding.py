"""Exact fast byte-level BPE encoding with the tokenizers library: texts are cut where the library's own splitter always cuts, and each distinct piece is encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np
from tokenizers import Tokenizer

from orrery.llm.common import worker_state

#: A piece starts with its leading blanks. The byte-level splitter never joins a non-blank with a following blank, and looks ahead over one blank run and one character only.
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Any other white space (by Python's wide definition, and one character on which definitions differ), and the marks of keys: the text is not cut.
_UNCUT = [chr(c) for c in (0, 1, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _keys(text: str) -> list[str]:
    """A text's pieces as cache keys: `word` for the piece ` word`, `\\nword` for itself, and any other piece after a mark."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        found = _PIECE.findall(text)
        return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p if p[0] == "\n" and p[1:2] not in (" ", "\n") else "\1" + p for p in found]
    found = text.replace("\n", " \n").split(" ")
    found[0] = "\0" + found[0]
    return found


def _piece(key: str) -> str:
    return key[1:] if key[:1] in ("\0", "\1") else key if key[:1] == "\n" else " " + key


class PieceEncoder:
    """Encodes whole texts to numpy arrays of ids, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, tokenizer_json: str, cache_pieces: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.cache_pieces = cache_pieces
        self.cache: dict[str, bytes] = {}
        self.id_bytes = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.id_bytes[i] = len(token)  # a character of the byte-level alphabet stands for one byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.id_bytes[i] = len(token.content.encode())

    def _direct(self, texts: Sequence[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in encoded]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that start with a blank and end without one: encoded as one text, and cut again where ids' bytes add up to a piece's."""
        (encoded,) = self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)
        ids = np.array(encoded.ids, self.dtype)
        places = np.concatenate([[0], np.cumsum(self.id_bytes[ids])])
        ends = np.cumsum([len(p.encode()) for p in pieces])
        at = np.searchsorted(places, ends)
        if len(ids) == 0 or at[-1] >= len(places) or (places[at] != ends).any():
            return self._direct(pieces)
        flat, cuts = ids.tobytes(), (at * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, keys: list[str]) -> None:
        pieces = list(map(_piece, keys))
        joinable = [bool(p) and p[0] in " \n" and p[-1] not in " \n" for p in pieces]
        own = [(k, p) for k, p, j in zip(keys, pieces, joinable, strict=True) if j]
        for at in range(0, len(own), 2000):
            part = own[at : at + 2000]
            self.cache.update(zip([k for k, _ in part], self._joined([p for _, p in part]), strict=True))
        other = [(k, p) for k, p, j in zip(keys, pieces, joinable, strict=True) if not j]
        self.cache.update(zip([k for k, _ in other], self._direct([p for _, p in other]), strict=True))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype."""
        whole = [i for i, t in enumerate(texts) if any(c in t for c in _UNCUT)]
        uncut = dict(zip(whole, self._direct([texts[i] for i in whole]), strict=True))
        keys = [[] if i in uncut else _keys(t) for i, t in enumerate(texts)]
        if len(self.cache) > self.cache_pieces:  # short pieces come again soonest
            self.cache = {k: v for k, v in self.cache.items() if len(k) <= 8}
            if len(self.cache) > self.cache_pieces // 2:
                self.cache.clear()
        self._learn(list(set().union(*keys).difference(self.cache)))
        get = self.cache.__getitem__
        return [uncut[i] if i in uncut else b"".join(map(get, x)) for i, x in enumerate(keys)]


def worker_encoder(tokenizer_json: str) -> PieceEncoder:
    """One encoder and cache a worker process, kept over its tasks."""
    return worker_state(f"piece encoder {hash(tokenizer_json)}", lambda: PieceEncoder(tokenizer_json))


def has_cut_safe_splitter(tokenizer_json: str) -> bool:
    """Whether the tokenizer's splitter is the byte-level one that PieceEncoder's cuts are proven for."""
    import json

    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
