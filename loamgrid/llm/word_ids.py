"""Token ids of whole texts as bytes, at the speed a packing job needs.

Same ids as the ``tokenizers`` library gives for a byte-level BPE file with an end-of-word suffix
(``add_special_tokens=False``). The merges run in ``tiktoken``: the suffix becomes byte 0xFF, which
UTF-8 never holds, and joining it to the last byte of a word gets the first ranks. Ranking joined
pieces instead of pairs gives the same result where every piece of the vocabulary encodes to itself,
which is checked on loading. Normalisation and splitting of other than plain ASCII words are the
library's own.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .bpe_codec import LATIN, byte_alphabet, split_white
from .common import Cache

CACHE_ENTRIES = 600_000
_END = b"\xff"


class WordIds:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        raw = lambda token: bytes(byte_of[c] for c in token.removesuffix(suffix)) + (_END if token.endswith(suffix) else b"")
        tokens = [bytes([b]) for b in range(256)] + [bytes([b]) + _END for b in range(256)]
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            tokens.append(raw(a + b))
        self.ranks = {t: r for r, t in enumerate(dict.fromkeys(tokens))}
        by_raw = {raw(t): i for t, i in vocab.items()}
        #: four bytes of the id of each rank; a lone 0xFF never stays
        self.id_of = [np.array([by_raw.get(t, 0)], "<u4").tobytes() for t in self.ranks]
        encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=self.ranks, special_tokens={})
        self.merge = encoding._core_bpe.encode_single_piece
        if any(self._bytewise(t) != [r] for t, r in self.ranks.items() if t != _END):
            raise ValueError("a piece of the vocabulary does not encode to itself")
        self.path, self.library, self.byte_of = path, None, byte_of
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.cache = Cache(cache_entries)

    def _bytewise(self, token: bytes) -> list[int]:
        """The merges of a piece from its bytes on (tiktoken itself looks whole pieces up)."""
        parts = [token[i : i + 1] for i in range(len(token))]
        rank = self.ranks.get
        while len(parts) > 1:
            found = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            i = found.index(min(found))
            if found[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _plain(self, chunk: str) -> bytes:
        if max(chunk) <= "ÿ":  # normalisation leaves Latin-1 as it is, but for the case
            words = [w.encode() for w in LATIN.findall(chunk.lower())]
        else:
            if self.library is None:  # only now: its own tables are large
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            byte_of, library = self.byte_of, self.library
            words = [bytes([byte_of[c] for c in w]) for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]
        id_of, merge = self.id_of, self.merge
        return b"".join([id_of[r] for w in words for r in merge(w + _END)])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space."""
        found = self.cache.recall(chunk)
        if found is not None:
            return found
        if "<|" in chunk:
            found = b"".join([self.special.get(p) or self._plain(p) for p in self.special_re.split(chunk) if p])
        else:
            found = self._plain(chunk)
        if len(chunk) <= 64:
            self.cache.put(chunk, found)
        return found

    def text(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        words = split_white(text)
        parts = list(map(self.cache.new.get, words))
        if None in parts:
            parts = [self.chunk(w) if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
