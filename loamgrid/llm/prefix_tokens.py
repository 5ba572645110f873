"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For a BPE vocabulary whose merges depend on the joined piece alone, the encoding of a prefix ends in
one piece ``p``; what lies before it is the encoding of the shorter prefix; and two neighbours are
possible if and only if encoding their joined text gives the same two back. So ``count[i] =
count[i - len(p)] + 1`` for the one piece ending at ``i`` that fits its predecessor, found through a
memo of neighbouring pairs. Truncation and budget questions are then lookups in the counts.

Pieces hold the space sign only in front, so a text falls into units (spaces, then a word) that
never merge with each other; characters without a piece are bytes of their own and cut units too.
What a unit's characters add to the count is kept in a bounded cache per Python worker, and of every
document a table keeps it, a byte per character.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, settle

SPACE = "▁"
#: Entries of a worker's memo of states (half as many totals more) and of pairs; full, they take about 300 MB.
CACHE_ENTRIES = 500_000
PAIR_ENTRIES = 500_000
#: Different steps that are kept once for all units that have them.
STEP_ENTRIES = 50_000
#: Longer units keep no state per prefix.
LONG_UNIT = 64
_ONE = [1]
_TAIL = ".,;:!?#$%&*|"
_UNIT = re.compile("\n|▁*[^▁\n]+|▁+")


class PrefixCounter:
    """Prefix counts for one sentencepiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a\tb ÅÅ "
        #: what the model puts in front of every text that isn't empty
        self.front = library.normalize(probe).removesuffix(probe.replace(" ", SPACE))
        if self.front not in ("", SPACE):
            raise ValueError("the model must leave texts as they are but for the space sign")
        self.rank: dict[str, float] = {}
        for i in range(library.vocab_size()):
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.rank[library.id_to_piece(i)] = -library.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces must hold the space sign in front only")
        self.single = {p for p in self.rank if len(p) == 1}
        #: pieces that the merges reach, by length: only these can end a prefix
        self.whole = {p: p for p in self.rank if self._merge(p) == [p]}  # the memos hold these very strings
        self.longest = max(map(len, self.whole))
        #: lengths of the pieces by their last two characters, long first, down to the last alone
        self.ends: dict[str, list[int]] = {}
        for p in sorted(self.whole, key=len, reverse=True):
            own = self.ends.setdefault(p[-2:], [])
            if len(p) > 1 and len(p) not in own:
                own.append(len(p))
        for own in self.ends.values():
            own.append(1)
        #: neighbours inside some piece; no merge crosses any other pair of characters
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states, self.totals = Cache(cache_entries), Cache(3 * cache_entries // 2)
        self.step_bytes: dict[bytes, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short text by its merges: best rank first, leftmost among equals."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            ranks = [rank(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == np.inf:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return found

    def _state(self, text: str, counts: list[int] | None = None) -> tuple[int, str, int]:
        """Of a prefix of a unit: its tokens, its last piece, and where its last stretch of characters
        with pieces starts. Words share prefixes, so few characters are new in a new word. To ``counts``
        go the tokens of the prefixes of 1, 2, ... characters."""
        states = self.states
        count, last, start = now = 0, "", 0
        if counts is None:
            k = len(text)
            while k and not (now := states.new.get(text[:k]) or states.recall(text[:k])):
                k -= 1
        else:
            k = 0
            while k < len(text) and (found := states.new.get(text[: k + 1]) or states.recall(text[: k + 1])):
                now = found
                counts.append(now[0])
                k += 1
        if k:
            count, last, start = now
        single, whole, ends, fits = self.single, self.whole.get, self.ends.get, self._fits
        for i in range(k + 1, len(text) + 1):
            c = text[i - 1]
            if c not in single:
                count, last, start = count + len(c.encode()), "", i
            else:
                for n in ends(text[i - 2 : i], _ONE):
                    j = i - n
                    if j < start:
                        continue
                    last = whole(text[j:i])
                    if last:
                        before = states.new.get(text[:j]) or self._state(text[:j]) if j else (0, "", 0)
                        if j == start or fits(before[1], last):
                            count = before[0] + 1
                            break
                else:
                    raise ValueError(f"no piece ends {text[:i]!r}")
            states.put(text[:i], (count, last, start))
            if counts is not None:
                counts.append(count)
        return count, last, start

    def steps(self, unit: str) -> bytes:
        """What each character of a unit adds to the count, as signed bytes; they sum up to its tokens."""
        found = self.totals.recall(unit)
        if found is None:
            stem = unit.rstrip(_TAIL)
            if stem and len(stem) < len(unit) and unit[len(stem) - 1 : len(stem) + 1] not in self.inside:
                found = self.steps(stem) + self.steps(unit[len(stem) :])
            else:
                counts = self.unit(unit)
                found = array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()  # OverflowError beyond a byte
            if len(unit) <= LONG_UNIT:
                found = self.step_bytes.get(found, found)
                if len(self.step_bytes) < STEP_ENTRIES:
                    self.step_bytes[found] = found
                self.totals.put(unit, found)
        return found

    def unit(self, text: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters of a unit."""
        if len(text) <= LONG_UNIT:
            known: list[int] = []
            self._state(text, known)
            return known
        counts, last = [0], [""]
        single, whole, longest, fits = self.single, self.whole.get, self.longest, self._fits
        start = 0
        for i, c in enumerate(text, 1):
            if c not in single:
                counts.append(counts[-1] + len(c.encode()))
                last.append("")
                start = i
                continue
            for j in range(max(start, i - longest), i):
                p = whole(text[j:i])
                if p and (j == start or fits(last[j], p)):
                    break
            else:
                raise ValueError(f"no piece ends {text[:i]!r}")
            counts.append(counts[j] + 1)
            last.append(p)
        return counts[1:]

    def split(self, text: str) -> list[str]:
        """The text's units: spaces with the word after them; line feeds, which have no piece, alone."""
        return _UNIT.findall(self.front + text.replace(" ", SPACE)) if text else []

    def text_steps(self, text: str) -> bytes:
        """The steps of a whole text: a signed byte per character, that of the first with the model's front."""
        units = self.split(text)
        parts = list(map(self.totals.new.get, units))
        k = -1
        for _ in range(parts.count(None)):
            k = parts.index(None, k + 1)
            parts[k] = self.steps(units[k])
        steps = b"".join(parts)
        if not self.front or not steps:
            return steps
        first = (steps[0] + steps[1] + 128) % 256 - 128  # the front is one character, each step small
        return first.to_bytes(1, "little", signed=True) + steps[2:]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i = 1, 2, ...; the last entry is that of the whole text."""
        return counts_of(self.text_steps(text))

    def count(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text; characters of its longest prefix of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return int(counts[-1]) if len(counts) else 0, longest_prefix(counts, budget)


def counts_of(steps: bytes) -> np.ndarray:
    """The token count at every prefix, of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix within a budget; counts may fall where a longer piece forms."""
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` (null stays null), ``n_bytes`` (UTF-8), ``n_chars``, ``n_tokens``
    and ``steps``: what each character adds to the token count, a signed byte each, so that the count
    at every prefix is their running sum. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            steps = [own.text_steps(t) for t in texts]
            n = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            fields = {"n_bytes": [len(t.encode()) for t in texts], "n_chars": list(map(len, texts)), "n_tokens": n}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in fields.values()], pa.array(steps, pa.binary())], ["doc_id", *fields, "steps"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, steps binary")


def fit_budget(table: DataFrame, limit: int) -> DataFrame:
    """The rows of a prefix table with ``over_limit`` (more than ``limit`` tokens) and ``fit_chars``
    (characters of the longest prefix within it), from the stored counts alone."""
    over = F.col("n_tokens") > limit

    def run(steps: pd.Series) -> pd.Series:
        return pd.Series([0 if s is None else longest_prefix(counts_of(s), limit) for s in steps], dtype="int64")

    fits = F.pandas_udf(run, T.LongType())(F.when(over, F.col("steps")))  # others travel as nulls
    return table.select("*", over.alias("over_limit"), F.when(over, fits).otherwise(F.col("n_chars")).alias("fit_chars"))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False, stored: bool = False) -> DataFrame:
    """Token counts of every whole text; null texts count as empty.

    The counts come from the prefix table, ``stored`` in the shared folder if asked. Returns per row:
    ``doc_id`` (null stays null), ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than
    ``limit`` tokens), ``fit_chars`` (characters of the longest prefix within ``limit``) and, with
    ``prefixes``, ``prefix_tokens``: the count at every prefix, one per character. Rows are
    independent: repeats, empty tables and columns with clashing names need no care; no shuffle.
    """
    table = prefix_table(docs, path, id_col, text_col)
    out = fit_budget(settle(table, "prefix-tokens") if stored else table, limit)
    if prefixes:
        listed = F.pandas_udf(lambda steps: pd.Series([counts_of(s).tolist() for s in steps], dtype=object), T.ArrayType(T.IntegerType()))
        out = out.withColumn("prefix_tokens", listed("steps"))
    return out.drop("steps", "n_chars")
