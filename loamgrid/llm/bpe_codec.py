"""BPE encoding and decoding with a contiguous rank array per word.

The vocabulary is a ``tokenizers`` JSON file of a byte-level BPE model with an end-of-word suffix.
Texts are cut at white space into chunks; a chunk's tokens depend on the chunk alone, so they are
kept in a bounded cache per Python worker. Below it lies a second cache for the pre-tokens of the
chunks ("word", "word," and "Word" share one). Only a pre-token that misses both is merged:

* ``merge_ranks`` holds the part boundaries, part ids and ranks of adjacent pairs of one short word
  in flat lists, scans for the minimum rank, deletes that boundary, and refreshes the two
  neighbouring ranks, until no pair has a rank.
* words over ``LONG_WORD`` parts go through the same merges with a heap over linked parts, since
  repeated scans would be quadratic there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache

LONG_WORD = 200
CACHE_ENTRIES = 400_000
_NONE = 1 << 60
#: Control characters at which str.split() cuts although they are no Unicode white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Pre-tokens of lower-case Latin-1 text: contractions, letters, single digits, other signs.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t-\r\x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes for code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def split_white(text: str) -> list[str]:
    """The chunks between Unicode white space; str.split() but for four control characters."""
    return text.split() if not _SEPARATORS.search(text) else [x for x in _WHITE.split(text) if x]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), n)
            self.merged.append(vocab[a + b])
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        self.words, self.chunks = Cache(cache_entries), Cache(cache_entries)

    # -- one word ---------------------------------------------------------------------------
    def merge_ranks(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Ids and start offsets (in parts) of the merged word, by the contiguous rank array."""
        rank, merged = self.rank.get, self.merged
        starts = list(range(len(ids)))
        ranks = [rank(pair, _NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], starts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NONE)
        return ids, starts

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, place) over linked parts."""
        rank = self.rank.get
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or rank((ids[i], ids[j])) != r:
                continue
            ids[i], alive[j], right[i] = self.merged[r], False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (s := rank((ids[a], ids[right[a]]))) is not None:
                    heapq.heappush(heap, (s, a))
        return [x for x, keep in zip(ids, alive) if keep]

    def word(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pre-token, given as its UTF-8 bytes."""
        found = self.words.get(raw)
        if found is None:
            ids = [self.inner[b] for b in raw[:-1]]
            ids.append(self.final[raw[-1]])
            found = tuple(self.merge_ranks(ids)[0] if len(ids) <= LONG_WORD else self.merge_long(ids))
            if len(raw) <= 64:
                self.words.put(raw, found)
        return found

    # -- texts ------------------------------------------------------------------------------
    def _plain(self, chunk: str) -> list[int]:
        ids: list[int] = []
        if max(chunk) <= "ÿ":  # normalisation leaves Latin-1 as it is, but for the case
            for w in LATIN.findall(chunk.lower()):
                ids += self.word(w.encode())
        else:
            byte_of = self.byte_of
            for w, _ in self.pre_tokenize(self.normalize(chunk)):
                ids += self.word(bytes(byte_of[c] for c in w))
        return ids

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of tokens, decimal ids and decoded text of a chunk without white space."""
        found = self.chunks.recall(chunk)
        if found is not None:
            return found
        if self.special_re is not None and "<" in chunk:
            ids = []
            for part in self.special_re.split(chunk):
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    ids += self._plain(part)
        else:
            ids = self._plain(chunk)
        found = len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))
        if len(chunk) <= 64:
            self.chunks.put(chunk, found)
        return found

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        get, chunk = self.chunks.new.get, self.chunk
        return [get(w) or chunk(w) for w in split_white(text)]

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, ids, _ in self.pieces(text) for x in ids.split(" ") if x]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, special ones too, joined by a space."""
        token = self.token
        return " ".join(token[i] for i in ids if i in token)


_LOADED: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """One codec per vocabulary file and Python process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; null texts count as empty.

    Returns one row per input row: ``doc_id`` (null stays null), ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by one space; of nothing for an empty text), ``decoded_sha256`` and, with
    ``ids``, the ids and the decoded text. Rows are independent of each other: repeated rows, an
    empty table and further columns of any name need no care; no shuffle takes place.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, whole, back = [], [], [], [], []
            for text in batch.column("text"):
                found = [x for x in own.pieces(text.as_py()) if x[0]]
                line, decoded = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
                n.append(sum([x[0] for x in found]))
                a.append(sha(line.encode()).hexdigest())
                b.append(sha(decoded.encode()).hexdigest())
                if ids:
                    whole.append([int(x) for x in line.split()])
                    back.append(decoded)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(whole, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema)
