"""BPE encoding by forced-boundary splitting, and decoding.

From the vocabulary a table says which pairs of bytes occur side by side inside some token. A pair that never does is a certain cut: no merge
can ever span it. White space, which this tokenizer family drops, is the plainest case and cuts a text into fragments first; the library's
own normalizer and splitter cut a fragment into words, and the byte-pair table cuts words further. Pieces are encoded independently by their
merges and concatenated; each distinct fragment is encoded once a worker while the cache holds it.

Defined cases: null text is empty (no ids, empty decoded text); special tokens' strings in a text become their ids, as in the library; a very
long text without cuts is encoded whole by the same merges; rows repeated whole encode alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from orrery.llm.common import rows, worker_state

#: White space by the Unicode property. Python's str.split() also splits at U+001C to U+001F; texts with those take the slower pattern.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The splitters in use never join a letter or digit with following punctuation, so a run of those before a mark is a fragment too. Its last
#: letter must be one that stays a single letter when normalized.
_MARKED = re.compile(r"[^\W_]*[A-Za-z0-9à-öø-ÿ](?=[.,!?])|\S+")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ForcedBoundaryBPE:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False) does, for byte-level BPE whose splitter drops or never crosses white space."""

    def __init__(self, tokenizer_json: str, cache_fragments: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or unsupported or any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError(f"unsupported tokenizer: {unsupported or model['type']}")
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.normalizer, self.splitter = self.library.normalizer, self.library.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        alphabet = byte_alphabet()
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            b = [alphabet[c] for c in token.removesuffix(self.suffix) if c in alphabet]
            self.inside[b[:-1], b[1:]] = True
        self.joins = {x + y for x, i in alphabet.items() for y, j in alphabet.items() if self.inside[i, j]}
        # Probed once: letters are lower-cased and marks split from them, as for the fragment patterns above.
        probe = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str("Ab.C d,3!") if self.normalizer else "Ab.C d,3!")]
        self.plain_letters = probe == ["ab", ".", "c", "d", ",", "3", "!"]
        self.cache_fragments = cache_fragments
        self.cache: dict[str, tuple[int, ...]] = {}
        self.decode_joiner, self.byte_level_decoder = (" ", None) if self.library.decoder is None else ("", alphabet)

    def _merge(self, symbols: list[str]) -> list[str]:
        """All merges by rank, leftmost first among equals."""
        n = len(symbols)
        if n > 48:
            return self._merge_long(symbols)
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            merged = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((merged, symbols[i + 1]), never)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], merged), never)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list, so that long fragments stay near-linear."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive: list[str | None] = list(symbols)
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, x, y = heappop(heap)
            j = after[i] if alive[i] is not None else -1
            if alive[i] != x or j < 0 or alive[j] != y:
                continue
            alive[i], alive[j] = x + y, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := self.ranks.get((alive[i], alive[after[i]]))) is not None:
                    heappush(heap, (r, i, alive[i], alive[after[i]]))
            if before[i] >= 0 and (r := self.ranks.get((alive[before[i]], alive[i]))) is not None:
                heappush(heap, (r, before[i], alive[before[i]], alive[i]))
        return [s for s in alive if s is not None]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in the byte-level alphabet: cut at forced boundaries, pieces encoded apart; only the last has the word's end."""
        whole = self.vocab.get(word + self.suffix)
        if whole is not None and len(word) == 1:
            return [whole]
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.joins), len(word)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            symbols = list(word[a:b])
            if b == len(word):
                symbols[-1] += self.suffix
            out += [self.vocab[s] for s in self._merge(symbols)]
        return out

    def _fragment(self, fragment: str) -> tuple[int, ...]:
        if self.plain_letters and fragment.isascii() and fragment.isalpha():
            return tuple(self.encode_word(fragment.lower()))  # what the normalizer and splitter make of A-Z alone
        if self.normalizer is not None:
            fragment = self.normalizer.normalize_str(fragment)
        return tuple(i for word, _ in self.splitter.pre_tokenize_str(fragment) if word for i in self.encode_word(word))

    def fragments(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return _SPACE.split(text)
        return _MARKED.findall(text) if self.plain_letters else text.split()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            for f in self.fragments(part):
                ids = self.cache.get(f)
                if ids is None:
                    if len(self.cache) >= self.cache_fragments:
                        self.cache.clear()
                    ids = self.cache[f] = self._fragment(f)
                out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False): without a decoder, tokens joined by blanks; with the byte-level one, their bytes."""
        tokens = [self.tokens[i] for i in ids if i in self.tokens]
        if self.byte_level_decoder is None:
            return " ".join(tokens)
        alphabet = self.byte_level_decoder
        return b"".join(bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens).decode("utf-8", errors="replace")


class _Renderer(dict):
    """Per fragment: how many ids, their decimal text, and their decoded text."""

    def __init__(self, bpe: ForcedBoundaryBPE, limit: int):
        super().__init__()
        self.bpe, self.limit = bpe, limit

    def __missing__(self, fragment: str) -> tuple[int, str, str]:
        ids = self.bpe._fragment(fragment)
        if len(self) < self.limit:
            self[fragment] = found = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))
            return found
        return len(ids), " ".join(map(str, ids)), self.bpe.decode(ids)


def encode_documents(docs: DataFrame, tokenizer_json: str, cache_fragments: int = 200_000) -> DataFrame:
    """docs with token_ids (array of int) appended; one pass, no shuffle."""
    return _mapped(docs, tokenizer_json, cache_fragments, "token_ids array<int>", lambda bpe, texts: [pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))])


def round_trip_digests(docs: DataFrame, tokenizer_json: str, cache_fragments: int = 400_000) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 appended: digests of the ids' decimal text and of the text decoded from them."""

    def digests(bpe: ForcedBoundaryBPE, texts: list[str]) -> list[pa.Array]:
        if bpe.decode_joiner != " ":  # decoded fragments do not concatenate by a plain joiner
            every = [bpe.encode(t) for t in texts]
            parts = [(len(i), " ".join(map(str, i)), bpe.decode(i)) for i in every]
        else:
            render = bpe.__dict__.setdefault("rendered", _Renderer(bpe, bpe.cache_fragments))
            if len(render) >= render.limit:
                render.clear()
            parts = []
            for text in texts:
                if bpe.special_pattern and bpe.special_pattern.search(text):
                    ids = bpe.encode(text)
                    parts.append((len(ids), " ".join(map(str, ids)), bpe.decode(ids)))
                    continue
                found = [x for x in map(render.__getitem__, bpe.fragments(text)) if x[0]]
                parts.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        n, ids, decoded = zip(*parts, strict=True)
        sha = lambda values: pa.array([hashlib.sha256(v.encode("utf-8")).hexdigest() for v in values])
        return [pa.array(n, pa.int64()), sha(ids), sha(decoded)]

    return _mapped(docs, tokenizer_json, cache_fragments, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, tokenizer_json: str, cache_fragments: int, added: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [x.split(" ")[0] for x in added.split(", ")]
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in rows(batches, 256):
            bpe = bpe or _worker_bpe(shared.value, cache_fragments)
            columns = make(bpe, [t or "" for t in batch["text"].to_pylist()])
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, *names])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), added])
    return kept.mapInArrow(run, fields)


def _worker_bpe(tokenizer_json: str, cache_fragments: int) -> ForcedBoundaryBPE:
    """One encoder and cache a worker process, kept over its tasks."""
    return worker_state(f"forced-boundary BPE {hash(tokenizer_json)} {cache_fragments}", lambda: ForcedBoundaryBPE(tokenizer_json, cache_fragments))
