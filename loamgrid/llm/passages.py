"""Substring near-duplicates by compact windows.

Tokens are hashes of five-word shingles. For each of ``HASHES`` hash functions, the Cartesian tree of
a document's token hashes, cut off below ``min_words`` words, yields compact windows: node ``c``
covers ``[l, r]``, and all long enough subsequences of that range that hold ``c`` share its hash as
their min-hash. Windows of equal function and token meet in one sorted run and are linked, without
pairing them all, to the run's first document; intersecting the two ranges around the shared token
gives the interval that may be a common passage. Per pair of documents, intervals of enough hash
functions are joined into regions, whose token slices are then compared run by run.

A first document may hold a token without holding the passage around it. Runs of equal tokens are
therefore sampled as well (the least of every ``STEP`` hashes of ``GRAM`` tokens), and a sampled gram is
linked to the first document that holds it. Of two documents that share a longer passage, one word
changed or not, one such gram reaches beyond what an earlier document holds of it.

Several earlier documents may hold all grams of a passage in parts that are too short to repeat it.
Where a gram's documents are not covered by spans with its first one, every window of ``min_words``
words around it is therefore linked to the first of those documents that holds the whole window.

Near copies share no whole window. Of two passages of ``min_words`` words with one word changed, put in
or left out, two runs are equal, and the longer one has at least half of the tokens that make the
passages similar (``least_same``), so that it holds a sampled gram. Where such a run ends or starts, as
documents that share it go on differently there and have a token in common again beyond a short hole,
it is linked by that many tokens in two runs around the hole, to the first document that holds them:
whoever holds them is similar enough.

Windows and runs are taken of which all grams are asked for. A gram that isn't is held by one document
behind its first at most, or spans with its first cover all around it: no link is missing there.
"""

from __future__ import annotations

import bisect
import contextlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import BROADCAST_ROWS, drop_settled, shared_path, trim

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
HASHES, ENOUGH = 6, 2
#: Tokens of a sampled gram, and of how many neighbours one is taken: any GRAM + STEP - 1 = 21 equal
#: tokens in a row hold a sampled gram, which is the longer run of near copies at the least, and so do
#: those of any passage that is longer by STEP tokens than what an earlier document holds of its start or end.
GRAM, STEP = 14, 8
#: Intervals join one region if their shifts between the documents differ by at most this.
SHIFT = 256
#: Runs that a hot key's documents are dealt to, and documents looked at to find hot keys.
SALTS, HOT_SAMPLE = 64, 5_000
#: Ids (8 bytes each) that may be broadcast to pick the texts to compare; more are joined.
ID_ROWS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULT = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(9).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = "doc_id bigint, start_word int, end_word int, of_doc_id bigint, of_start_word int, of_end_word int, similarity double"


#: Whether Spark deletes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go as it ends, not only when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settle(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """As in ``common``; its shuffle files go, and the settled tables in ``done``, which nothing reads any more."""
    with _shuffles_dropped(df.sparkSession):
        settled = common.settle(df, name)
    for table in done:
        drop_settled(table)
    return settled


def tokens(text: bytes) -> np.ndarray:
    """A hash of every five-word shingle: XXH64 of its words in a multilinear sum; empty for fewer words."""
    words = text.split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    word = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8")
    total = word[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += word[k : n + k] * _PLACE[k]
    return hashed(total, 0)


def hashed(token: np.ndarray, f: int) -> np.ndarray:
    """Hash function ``f``: a bijection of 64-bit tokens, so equal values mean equal tokens."""
    x = token * _MULT[f]
    x ^= x >> np.uint64(29)
    return x * _MULT[f]


def hashes(token: np.ndarray) -> np.ndarray:
    """A row of hashed tokens for each hash function."""
    x = token * _MULT[:, None]
    x ^= x >> np.uint64(29)
    x *= _MULT[:, None]
    return x


def compact_windows(values: np.ndarray, width: int) -> tuple[list[int], list[int], list[int]]:
    """Nodes ``(c, l, r)`` of the Cartesian tree whose range holds at least ``width`` entries."""
    c, left, right = [], [], []
    todo = [(0, len(values))]
    while todo:
        a, b = todo.pop()
        while b - a >= width:
            m = a + int(values[a:b].argmin())
            c.append(m)
            left.append(a)
            right.append(b - 1)
            if b - m - 1 >= width:
                todo.append((m + 1, b))
            b = m
    return c, left, right


def _slide(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``n`` consecutive entries, by doubling."""
    size = 1
    while 2 * size <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - n + size], x[n - size :]) if size < n else x


def sampled_grams(token: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some ``STEP`` in a row, ties included, of a
    text of at least ``width`` tokens."""
    size = min(GRAM, width)
    h = hashed(_rolled(token, size), 1)
    step = min(STEP, width - size + 1)
    edge = np.zeros(step - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, _slide(h, step, np.minimum), edge]), step, np.maximum) == h).astype(np.int32)
    return at, h[at]


def _all_asked(token: np.ndarray, starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """For every ``n`` tokens (``GRAM + STEP - 1`` at least) whether all grams that are sampled of them alone are in ``starts``.

    Of two documents that share them, neither is then a gram's first one, and some gram's spans leave them open."""
    size = min(GRAM, width)
    step = min(STEP, width - size + 1)
    h = hashed(_rolled(token, size), 1)
    asked = np.full(len(h), ~np.uint64(0))
    starts = starts[starts < len(h)]  # another row of this id
    asked[starts] = h[starts]
    return _slide(_slide(asked, step, np.minimum) == _slide(h, step, np.minimum), n - size - step + 2, np.logical_and)


def windows(docs: DataFrame, width: int, hot: np.ndarray | None = None) -> DataFrame:
    """``key`` (token under its hash function), ``salt``, ``doc_id``, ``c``, ``before`` and ``after`` it.

    Keys of windows are even. A sampled gram is a row of odd key that claims the ``width`` tokens from
    its start on, as its first document does, so that it always meets that one. The salt is 0, but for the keys in ``hot``: there it deals the documents to ``SALTS`` runs."""
    hot = np.zeros(0, np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, cs, before, after = [], [], [], [], []
            held = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                token = tokens(text.as_py())
                if len(token) < width:
                    continue
                values, nodes, sizes = hashes(token), ([], [], []), []
                for own in values:
                    found = compact_windows(own, width)
                    sizes.append(len(found[0]))
                    for all_of, x in zip(nodes, found):
                        all_of += x
                c, left, right = np.array(nodes, np.int32)
                keys.append(values[np.repeat(np.arange(HASHES), sizes), c] & ~np.uint64(1))
                cs.append(c)
                before.append(c - left)
                after.append(right - c)
                at, gram = sampled_grams(token, width)
                keys.append(gram | np.uint64(1))
                cs.append(at)
                before.append(np.zeros(len(at), np.int32))
                after.append(np.full(len(at), width - 1, np.int32))
                ids.append(np.full(len(c) + len(at), doc, np.int64))
                held += len(c) + len(at)
                if held > 200_000:
                    yield _windows(hot, keys, ids, cs, before, after)
                    keys, ids, cs, before, after, held = [], [], [], [], [], 0
            if keys:
                yield _windows(hot, keys, ids, cs, before, after)
        trim()

    return docs.mapInArrow(run, "key bigint, salt int, doc_id bigint, c int, before int, after int")


def _windows(hot: np.ndarray, keys: list, ids: list, *rest: list) -> pa.RecordBatch:
    key, doc = np.concatenate(keys).view(np.int64), np.concatenate(ids)
    salt = np.where(np.isin(key, hot), 1 + (doc.view(np.uint64) * _MULT[0] >> np.uint64(40)).astype(np.int64) % SALTS, 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(doc), *[pa.array(np.concatenate(x)) for x in rest]], ["key", "salt", "doc_id", "c", "before", "after"])


def hot_keys(docs: DataFrame, width: int) -> np.ndarray:
    """Keys with a window in about every hundredth document, as a sample of some ``HOT_SAMPLE`` shows.

    This only decides how rows are dealt: a key missed here costs balance, no result. Their number is
    bounded by the windows of a document times 100."""
    step = max(1, docs.count() // HOT_SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counts = windows(sample, width).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(50, HOT_SAMPLE // 100))
    return np.array(sorted(r.key for r in counts.select("key").collect()), np.int64)


_LINKS_SQL = "hot boolean, doc_id bigint, of bigint, lo int, hi int, shift int, key bigint"


def _links(width: int):
    """Rows sorted by key, salt, doc_id, c: the interval that each shares with the first of its run.

    Only the first row of the open run is held, however long it is. Rows of hot keys (salted) pass
    as they are, with their own range and, as ``shift``, their token's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, doc, c, before, after = (batch.column(i).to_numpy() for i in range(6))
            new = np.concatenate([[lead is None or lead[0] != key[0]], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            of, of_c, of_before, of_after = (np.where(at >= 0, x[at], lead[k] if lead is not None else 0) for k, x in enumerate((doc, c, before, after), 1))
            low, high = np.minimum(before, of_before), np.minimum(after, of_after)
            if at[-1] >= 0:
                lead = [x[at[-1]] for x in (key, doc, c, before, after)]
            hot = salt > 0
            rows = hot | (doc != of) & (low + high + 1 >= width)
            if rows.any():
                fields = {"hot": hot, "doc_id": doc, "of": of, "lo": c - np.where(hot, before, low), "hi": c + np.where(hot, after, high), "shift": np.where(hot, c, of_c - c), "key": key}
                yield pa.RecordBatch.from_pydict({k: pa.array(v[rows]) for k, v in fields.items()})

    return run


def window_links(source: DataFrame, width: int) -> DataFrame:
    """``doc_id, of, lo, hi, shift, key``: what every window shares with the first document of its key.

    Keys meet in sorted runs. The few hot keys are dealt by document as well; their first rows are
    minima summed up per task, a table of a row per hot key, which is then joined to their rows."""
    hot = hot_keys(source, width)
    rows = windows(source, width, hot).repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "c")
    links = rows.mapInArrow(_links(width), _LINKS_SQL)
    columns = ["doc_id", "of", "lo", "hi", "shift", "key"]
    if not len(hot):
        return settle(links.select(columns), "window-links")
    path = shared_path(source.sparkSession, "window-links")
    with _shuffles_dropped(source.sparkSession):
        links.write.partitionBy("hot").parquet(path)  # either part is read alone
    links = source.sparkSession.read.schema(links.schema).parquet(path)
    own = links.where("hot").select("key", "doc_id", F.col("shift").alias("c"), (F.col("shift") - F.col("lo")).alias("before"), (F.col("hi") - F.col("shift")).alias("after"))
    firsts = own.groupBy("key").agg(F.min(F.struct("doc_id", "c", "before", "after")).alias("m"))
    met = own.join(F.broadcast(firsts) if len(hot) <= BROADCAST_ROWS else firsts, "key").where("doc_id <> m.doc_id")
    met = met.select("*", F.least("before", "m.before").alias("low"), F.least("after", "m.after").alias("high")).where(F.col("low") + F.col("high") + 1 >= width)
    met = met.select("doc_id", F.col("m.doc_id").alias("of"), (F.col("c") - F.col("low")).alias("lo"), (F.col("c") + F.col("high")).alias("hi"), (F.col("m.c") - F.col("c")).alias("shift"), "key")
    return links.where("not hot").select(columns).unionAll(met)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id, of, lo: intervals that overlap, under like shifts, of enough tokens."""
    names = ("doc_id", "of", "lo", "hi", "shift", "key")
    held: list[np.ndarray] | None = None  # rows of the open pair
    for batch in batches:
        rows = [batch.column(n).to_numpy().astype(np.int64) for n in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].sum() + 1) if (rows[0][0], rows[1][0]) != (rows[0][-1], rows[1][-1]) else 0
        held = [x[last:] for x in rows]
        if last:
            yield _joined(*[x[:last] for x in rows])
    if held is not None:
        yield _joined(*held)


def _joined(doc: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """The regions of whole pairs. Where all shifts of a pair are alike, intervals join that overlap."""
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])])
    firsts, pair = np.flatnonzero(new), np.cumsum(new)
    alike = np.maximum.reduceat(shift, firsts) - np.minimum.reduceat(shift, firsts) <= SHIFT
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(pair * far + hi)
    cut = new.copy()
    cut[1:] |= lo[1:] + pair[1:] * far > reach[:-1]
    cuts = np.flatnonzero(cut)
    least = np.minimum.reduceat(shift, cuts), np.maximum.reduceat(shift, cuts)
    # one token is not enough (ENOUGH is 2), a gram is
    enough = (np.minimum.reduceat(key, cuts) != np.maximum.reduceat(key, cuts)) | np.bitwise_or.reduceat(key & 1, cuts).astype(bool)
    keep = enough & alike[pair[cuts] - 1]
    low, high = lo[cuts][keep], np.maximum.reduceat(hi, cuts)[keep]
    found = [doc[cuts][keep], of[cuts][keep], low, high, np.maximum(low + least[0][keep], 0), high + least[1][keep]]
    odd = [x for k in np.flatnonzero(~alike).tolist() for x in _by_shift(*(x[firsts[k] : (firsts[k + 1] if k + 1 < len(firsts) else len(doc))].tolist() for x in (doc, of, lo, hi, shift, key)))]
    if odd:
        found = [np.concatenate([x, np.array(y, np.int64)]) for x, y in zip(found, zip(*odd))]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc_id", "of", "lo", "hi", "of_lo", "of_hi"])


def _by_shift(doc: list, of: list, *rows: list) -> Iterator[tuple]:
    """The regions of one pair, apart where its shifts differ."""
    open_: list[list] = []  # each: lo, hi, least and greatest shift, keys
    done: list[list] = []
    for lo, hi, shift, key in zip(*rows):
        done += [x for x in open_ if x[1] < lo]
        open_ = [x for x in open_ if x[1] >= lo]
        for x in open_:
            if x[2] - SHIFT <= shift <= x[3] + SHIFT:
                x[1], x[2], x[3] = max(x[1], hi), min(x[2], shift), max(x[3], shift)
                x[4].update((key, ~key) if key & 1 else (key,))  # a gram is enough by itself
                break
        else:
            open_.append([lo, hi, shift, shift, {key, ~key} if key & 1 else {key}])
    for lo, hi, least, most, keys in done + open_:
        if len(keys) >= ENOUGH:
            yield doc[0], of[0], lo, hi, max(0, lo + least), hi + most


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token slices of the requested ranges; consecutive requests for a document share its tokens."""
    last, token = None, None
    for batch in batches:
        out = []
        for doc, text, lo, hi in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("slice_lo").to_pylist(), batch.column("slice_hi").to_pylist()):
            raw = text.as_py()
            if last is None or last[0] != doc or last[1] != raw:
                last, token = (doc, raw), tokens(raw)
            out.append(token[lo : hi + 1].astype("<u4").tobytes())
        names = [n for n in batch.schema.names if n not in ("id", "text", "slice_lo", "slice_hi")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.binary())], [*names, "slice"])


def matching_spans(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Maximal spans ``(a0, a1, b0, b1, similarity)`` of at least ``width`` tokens of ``a``.

    Spans as similar as asked hold a run of over a third of ``width`` equal tokens (one changed word
    costs five), so anchors are sought from seeds of that length, left to right: the nearest place
    ahead in ``b`` or, if its run is longer, any nearest. All shorter runs before, between and after
    the anchors then join them. Of all spans from a run to a run the longest counts whose shared
    tokens are at least ``similarity`` of all tokens of both sides; one that is shorter than
    ``width`` is first filled up with the tokens beside it.
    """
    seed = width // 3
    if min(len(a), len(b)) < seed:
        return []
    of_b = _rolled(b, seed)
    order = np.argsort(of_b, kind="stable")
    ordered, of_a = of_b[order], _rolled(a, seed)
    low, high = np.searchsorted(ordered, of_a, "left"), np.searchsorted(ordered, of_a, "right")
    known = np.flatnonzero(high > low)

    rows: list[list[tuple[int, int, int]]] = [[]]  # runs that rise in both texts; a jump back opens a new row
    i, shift, floor = 0, 0, 0
    while (k := int(np.searchsorted(known, i))) < len(known):
        i = int(known[k])
        places = order[low[i] : high[i]]
        p, q = bisect.bisect_left(places, floor), bisect.bisect_left(places, i + shift)
        tried = {int(x) for x in (*places[p : p + 1], *places[max(0, q - 1) : q + 1])}
        n, ahead, _, j = max((_equal(a, b, i, x), x >= floor, -abs(x - i - shift), x) for x in tried)
        if not ahead:
            rows.append([])
        rows[-1].append((i, j, n))
        shift, floor, i = j - i, j + n, i + max(n, 1)
    spans = [span for runs in rows if runs for span in _best_spans(np.array(_with_short_runs(a, b, runs, width, similarity)), width, similarity, len(a), len(b))]
    return spans + _equal_spans(a, b, width, spans, high > low, width - seed + 1)


def _equal(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Equal entries from ``a[i]`` and ``b[j]`` on, compared in growing blocks."""
    n, limit, step = 0, min(len(a) - i, len(b) - j), 64
    while n < limit:
        end = min(limit, n + step)
        differ = a[i + n : i + end] != b[j + n : j + end]
        if differ.any():
            return n + int(differ.argmax())
        n, step = end, 2 * step
    return n


def _equal_spans(a: np.ndarray, b: np.ndarray, width: int, spans: list, seeds: np.ndarray, row: int) -> list[tuple[int, int, int, int, float]]:
    """Runs of ``width`` equal tokens under any shift that hold tokens of ``a`` no span has yet.

    Where sentences repeat inside both texts, the run that a pass takes first may hide a longer one.
    ``seeds`` says which seeds of ``a`` are in ``b``; a gram of ``width`` tokens needs ``row`` of them.
    Every gram that ``b`` holds too is covered, left to right, each time by the
    longest run from its first, its last or its nearest place, however often ``b`` repeats it."""
    if min(len(a), len(b)) < width:
        return []
    bare = np.ones(len(a), bool)
    for first, end, *_ in spans:
        bare[first:end] = False
    bare, held = (np.concatenate([[0], np.cumsum(x)]) for x in (bare, seeds))
    known = np.flatnonzero((bare[width:] > bare[:-width]) & (held[row:] - held[:-row] == row))
    if not len(known):  # no gram of which b has all seeds
        return []
    of_b, of_a = _rolled(b, width), _rolled(a, width)
    order = np.argsort(of_b, kind="stable")
    ordered = of_b[order]
    low, high = np.searchsorted(ordered, of_a, "left"), np.searchsorted(ordered, of_a, "right")
    known = known[high[known] > low[known]]
    out, i, shift = [], 0, 0
    while (k := int(np.searchsorted(known, i))) < len(known):
        i = int(known[k])
        places = order[low[i] : high[i]]
        q = int(np.searchsorted(places, i + shift))
        tried = {int(x) for x in (places[0], places[-1], *places[max(0, q - 1) : q + 1])}
        n, j = max((_equal(a, b, i, x), -x) for x in tried)
        if n >= width:  # less would be two grams of one hash
            out.append((i, i + n, -j, n - j, 1.0))
            shift = -j - i
        i += max(n - width, 0) + 1
    return out


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sums, up`` of which ``(sums[i + n] - sums[i]) * up[i]`` is a hash of ``x[i : i + n]``, wherever it stands."""
    if len(_POWERS[0]) <= len(x):
        for k, base in enumerate((int(_MULT[0]), pow(int(_MULT[0]), -1, 1 << 64))):
            factors = np.full(2 * len(x) + 2, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _POWERS[1][: len(x)], dtype=np.uint64, out=sums[1:])
    return sums, _POWERS[0][: len(x) + 1]


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive tokens: differences of prefix sums, turned to one place."""
    sums, up = _sums(x)
    h = sums[n:] - sums[:-n]
    return h * up[: len(h)]


def _short_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal tokens, down to one, that rise in both: from either's start on the nearest next.

    The search for the next run ends at its distance, so all of them cost about the tokens between."""
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low, high = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    known = np.flatnonzero(high > low).tolist()
    out, i, j = [], 0, 0
    while True:
        best = None
        k = bisect.bisect_left(known, i)
        while k < len(known) and (best is None or known[k] - i < best[0]):
            x = known[k]
            places = order[low[x] : high[x]]
            q = int(np.searchsorted(places, j))
            if q < len(places) and (best is None or x - i + int(places[q]) - j < best[0]):
                best = (x - i + int(places[q]) - j, x, int(places[q]))
            k += 1
        if best is None:
            return out
        _, x, y = best
        n = _equal(a, b, x, y)
        out.append((x, y, n))
        i, j = x + n, y + n


def _with_short_runs(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]], width: int, similarity: float) -> list[tuple[int, int, int]]:
    """The anchors with all shorter runs beside them.

    Short runs alone are never as similar as asked, so a span leaves its anchors by about as many
    tokens as they share; nothing farther away is looked at."""
    reach = int(2 * sum(n for _, _, n in anchors) / similarity) + width
    out = []
    at_a, at_b = max(0, anchors[0][0] - reach), max(0, anchors[0][1] - reach)
    for k, (i, j, n) in enumerate(anchors):
        if k and max(i - at_a, j - at_b) <= 2 * reach:
            out += [(at_a + x, at_b + y, m) for x, y, m in _short_runs(a[at_a:i], b[at_b:j])]
        else:  # far apart: what is near either anchor, outwards
            if k:
                end_a, end_b = min(i, at_a + reach), min(j, at_b + reach)
                out += [(at_a + x, at_b + y, m) for x, y, m in _short_runs(a[at_a:end_a], b[at_b:end_b])]
                at_a, at_b = max(end_a, i - reach), max(end_b, j - reach)
            out += [(i - x - m, j - y - m, m) for x, y, m in reversed(_short_runs(a[at_a:i][::-1], b[at_b:j][::-1]))]
        out.append((i, j, n))
        at_a, at_b = i + n, j + n
    return out + [(at_a + x, at_b + y, m) for x, y, m in _short_runs(a[at_a : at_a + reach], b[at_b : at_b + reach])]


def _filled(first: int, end: int, width: int, limit: int) -> tuple[int, int]:
    """The range with tokens beside it, those before it first, until it holds ``width`` of ``limit``."""
    first = max(0, min(first, end - width))
    return first, min(limit, max(end, first + width))


def _best_spans(r: np.ndarray, width: int, similarity: float, len_a: int, len_b: int) -> list[tuple[int, int, int, int, float]]:
    spans = []
    shared = np.concatenate([[0], np.cumsum(r[:, 2])])
    s = 0
    while s < len(r):
        in_a, in_b = r[s:, 0] + r[s:, 2] - r[s, 0], r[s:, 1] + r[s:, 2] - r[s, 1]
        same = shared[s + 1 :] - shared[s]
        rate = same / (np.maximum(in_a, width) + np.maximum(in_b, width) - same)
        ok = np.flatnonzero(rate >= similarity) if min(len_a, len_b) >= width else []
        if len(ok):
            e = int(ok[-1])
            spans.append((*_filled(int(r[s, 0]), int(r[s, 0] + in_a[e]), width, len_a), *_filled(int(r[s, 1]), int(r[s, 1] + in_b[e]), width, len_b), float(rate[e])))
            s += e + 1
        else:
            s += 1
    return spans


def _verify(width: int, similarity: float):
    """Rows sorted by region and side: the spans that both slices share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, own = None, None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "of", "lo", "hi", "of_lo", "of_hi")))
            for key, side, piece in zip(keys, batch.column("side").to_pylist(), batch.column("slice")):
                if side == 0:
                    region, own = key, np.frombuffer(piece.as_buffer(), "<u4")
                elif region == key and own is not None:
                    for a0, a1, b0, b1, rate in matching_spans(own, np.frombuffer(piece.as_buffer(), "<u4"), width, similarity):
                        doc, of, lo, _, of_lo, _ = key
                        out.append((doc, lo + a0, lo + a1 + SHINGLE - 1, of, of_lo + b0, of_lo + b1 + SHINGLE - 1, rate))
                    own = None
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [f.split()[0] for f in _SPAN.split(", ")])

    return run


def _in_regions(links: DataFrame) -> DataFrame:
    return settle(links.repartition("doc_id", "of").sortWithinPartitions("doc_id", "of", "lo").mapInArrow(_regions, "doc_id bigint, of bigint, lo bigint, hi bigint, of_lo bigint, of_hi bigint"), "regions")


def _spans(source: DataFrame, regions: DataFrame, width: int, similarity: float) -> DataFrame:
    """The spans that the slices of each region share."""
    # a region may start or end inside a passage, by less than the least passage
    regions = regions.select("doc_id", "of", F.greatest(F.col("lo") - width, F.lit(0)).alias("lo"), (F.col("hi") + width).alias("hi"), F.greatest(F.col("of_lo") - width, F.lit(0)).alias("of_lo"), (F.col("of_hi") + width).alias("of_hi"))
    columns = [F.col(c) for c in regions.columns]
    asked = regions.select(F.col("doc_id").alias("id"), F.lit(0).alias("side"), F.col("lo").alias("slice_lo"), F.col("hi").alias("slice_hi"), *columns)
    asked = asked.unionAll(regions.select(F.col("of").alias("id"), F.lit(1).alias("side"), F.col("of_lo").alias("slice_lo"), F.col("of_hi").alias("slice_hi"), *columns))
    ids = settle(asked.select(F.col("id").alias("doc_id")).distinct(), "asked")
    texts = source.join(F.broadcast(ids) if ids.count() <= ID_ROWS else ids, "doc_id", "left_semi")
    # a passage's first document may be asked for by very many: the join may split such an id
    met = asked.join(texts.withColumnRenamed("doc_id", "id"), "id")
    slices = met.mapInArrow(_slices, "side int, doc_id bigint, of bigint, lo bigint, hi bigint, of_lo bigint, of_hi bigint, slice binary")
    keys = ["doc_id", "of", "lo", "hi", "of_lo", "of_hi"]
    return slices.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_verify(width, similarity), _SPAN).distinct()


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least ``min_words`` words that nearly repeat one of a document of smaller id.

    One row per passage and earlier document: ``doc_id, start_word, end_word`` (exclusive), the same
    of the earlier passage (``of_...``), and their ``similarity`` (shared five-word shingles, in
    order, of all of both). Null and short texts have no passages; rows without ``doc_id`` take no
    part; rows of equal ``doc_id`` are one document and no repeats of each other; repeats inside one
    document are left alone; an empty table gives no rows; other columns are ignored.
    """
    width = min_words - SHINGLE + 1
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    links = window_links(source, width)
    spans = settle(_spans(source, _in_regions(links), width, similarity), "passages")
    more = _in_regions(_open_window_links(source, links, spans, width, similarity))
    drop_settled(links)
    more = _spans(source, more, width, similarity)
    known = spans.select(F.col("doc_id").alias("d"), F.col("of_doc_id").alias("o"), F.col("start_word").alias("s"), F.col("end_word").alias("e"))
    return spans.unionAll(more.join(known, F.expr("doc_id = d and of_doc_id = o and start_word >= s and end_word <= e"), "left_anti"))


def _windows_around(width: int):
    """Rows ``doc_id, text, asked``: ``key, doc_id, c, open`` of every ``width`` tokens whose grams are all among
    the starts; open are those that no span with the first document of one of them holds."""
    around = np.arange(width - min(GRAM, width) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("asked").to_pylist()):
                token = tokens(text.as_py())
                if len(token) < width:  # another row of this id
                    continue
                h = _rolled(token, width)
                known, open_ = _all_asked(token, np.concatenate([np.array(group["starts"], np.int64) for group in asked]), width, width), np.zeros(len(h), bool)
                for group in asked:
                    at = np.unique(np.array(group["starts"], np.int64)[:, None] - around)
                    own = np.zeros(len(h), bool)
                    own[at[(at >= 0) & (at < len(h))]] = True
                    for span in group["held"] or ():
                        own[span["start_word"] : max(0, span["end_word"] - SHINGLE + 2 - width)] = False
                    open_ |= own
                at = np.flatnonzero(known)
                yield pa.RecordBatch.from_arrays([pa.array(hashed(h[at], 2).view(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32)), pa.array(open_[at])], ["key", "doc_id", "c", "open"])
        trim()

    return run


def _open_links(width: int):
    """Rows sorted by key, doc_id, c: each with the first of its run, if either of the two is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, c, open_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.concatenate([[lead is None or lead[0] != key[0]], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            of, of_c, of_open = (np.where(at >= 0, x[at], lead[k] if lead is not None else 0) for k, x in enumerate((doc, c, open_), 1))
            if at[-1] >= 0:
                lead = [x[at[-1]] for x in (key, doc, c, open_)]
            rows = (doc != of) & (open_ | of_open.astype(bool))
            if rows.any():
                fields = {"doc_id": doc, "of": of, "lo": c, "hi": c + np.int32(width - 1), "shift": (of_c - c).astype(np.int32), "key": key | 1}  # odd: enough by itself
                yield pa.RecordBatch.from_pydict({k: pa.array(v[rows]) for k, v in fields.items()})

    return run


def least_same(width: int, similarity: float) -> int:
    """Equal tokens that make two passages of ``width`` tokens as similar as asked."""
    return int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))


def _reach(held: pa.ListScalar, n: int) -> np.ndarray:
    """For each of ``n`` tokens the farthest end of a span that starts up to there."""
    reach = np.zeros(n, np.int64)
    if held.is_valid:
        start, end = (held.values.field(x).to_numpy() for x in ("start_word", "end_word"))
        np.maximum.at(reach, np.minimum(start, n - 1), end)
    return np.maximum.accumulate(reach)


def _runs_around(width: int, run: int, size: int):
    """Rows ``doc_id, text, starts, held``: ``key, doc_id, c`` of every ``run`` tokens whose grams are all among the
    starts (if they are too few to be sure of one, that hold any), with the tokens ``before`` and ``after``
    them; an end of the text is unlike any other. Those are open around which some window of ``width`` tokens lies in no span."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, starts, held in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("starts"), batch.column("held")):
                token = tokens(text.as_py())
                if len(token) < width:
                    continue
                starts = starts.values.to_numpy().astype(np.int64)
                if run >= size + min(STEP, width - size + 1) - 1:
                    at = np.flatnonzero(_all_asked(token, starts, width, run))
                else:
                    at = np.unique(starts[:, None] - np.arange(run - size + 1))
                    at = at[(at >= 0) & (at <= len(token) - run)]
                windows = np.arange(len(token) - width + 1)
                bare = np.concatenate([[0], np.cumsum(_reach(held, len(token))[windows] < windows + width + SHINGLE - 1)])
                open_ = bare[np.minimum(at, windows[-1]) + 1] > bare[np.clip(at + run - width, 0, windows[-1])]
                around = _with_edges(token, doc).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashed(_rolled(token, run)[at], 3).view(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32)), pa.array(around[at]), pa.array(around[at + run + 1]), pa.array(open_)], ["key", "doc_id", "c", "before", "after", "open"])
        trim()

    return go


def _streak(flags: np.ndarray) -> np.ndarray:
    """How many flags in a row are set up to each entry."""
    at = np.arange(len(flags))
    return at - np.maximum.accumulate(np.where(flags, -1, at))


def _first_covered(key: np.ndarray, doc: np.ndarray, c: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    """All open rows; of the covered ones of a key the first document's: others only hold what it holds."""
    covered = np.flatnonzero(~open_)
    covered = covered[np.lexsort((doc[covered], key[covered]))]
    own = key[covered]
    rows = np.concatenate([np.flatnonzero(open_), covered[np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]])]])
    return pa.RecordBatch.from_arrays([pa.array(v[rows]) for v in (key, doc, c, open_)], ["key", "doc_id", "c", "open"])


def _with_edges(token: np.ndarray, doc: int) -> np.ndarray:
    """The tokens between what stands for the ends of this document's text."""
    edge = hashed(np.array([doc], np.int64).view(np.uint64), 3)
    return np.concatenate([edge, token, edge])


class _Holes:
    """Every two runs of ``least_same`` tokens in all around a hole, the longer one shared, between places
    where its documents part. With a hole of at most what ``width`` leaves, whoever holds both runs is similar enough.

    A ``code`` names the hole beside a place: ``c`` of the ``run`` shared tokens next to it, and its tokens, negative
    before that place, 0 for one whole run."""

    def __init__(self, width: int, similarity: float, run: int):
        self.run, self.same = run, least_same(width, similarity)
        self.long = np.arange(run, self.same)
        self.holes = np.arange(1, width - self.same + 1)

    @staticmethod
    def code(c: np.ndarray, hole: np.ndarray | int) -> np.ndarray:
        return np.asarray(c, np.int64) << 16 | np.asarray(hole, np.int64) + (1 << 15)

    @staticmethod
    def place(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code >> 16, (code & 0xFFFF) - (1 << 15)

    def of(self, token: np.ndarray, runs: pa.ListScalar, held: pa.ListScalar, codes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """``code, first, then, n_first, n_then, open`` of a document's: starts and sizes of both runs. With
        ``codes`` those beside these holes and whole runs, without it those with a hole."""
        run, same = self.run, self.same
        places = len(token) - run + 1
        c, opens, ends = (runs.values.field(n).to_numpy(zero_copy_only=False) for n in ("c", "opens", "ends"))
        c, opens, ends = (x[c < places] for x in (c, opens, ends))  # another row of this id
        shared, opened, ended = np.zeros((3, places), bool)
        shared[c], opened[c], ended[c] = True, opens, ends
        left, right = _streak(shared), _streak(shared[::-1])[::-1]
        e, x = c[ends].astype(np.int64), c[opens].astype(np.int64)
        found = []
        if codes is not None:
            for at, first in ((e[left[e] > same - run], run - same), (x[right[x] > same - run], 0)):
                size = np.full(len(at), same)
                found.append((self.code(at, 0), at + first, at + first + same, size, size - same))
            at, hole = self.place(codes)
            e, x = np.intersect1d(e, at[hole > 0]), np.intersect1d(x, at[hole < 0])
        # a run of fewer tokens is whole: its other end parts documents as well
        i, k = np.nonzero((left[e][:, None] > self.long - run) & opened[np.maximum(e[:, None] + run - self.long, 0)])
        j, m = np.nonzero((right[x][:, None] > self.long - run) & ended[np.minimum(x[:, None] + self.long - run, places - 1)])
        for hole in self.holes:
            # the long run first, up to the hole; the long run last, from the hole on
            at, long = e[i], self.long[k]
            found.append((self.code(at, hole), at + run - long, at + run + hole, long, same - long))
            at, long = x[j], self.long[m]
            found.append((self.code(at, -hole), at - hole - (same - long), at, same - long, long))
        code, first, then, n_first, n_then = map(np.concatenate, zip(*found))
        ok = (first >= 0) & (then + n_then <= len(token))
        if codes is not None:
            ok &= (self.place(code)[1] == 0) | np.isin(code, codes)
        code, first, then, n_first, n_then = (v[ok] for v in (code, first, then, n_first, n_then))
        return code, first, then, n_first, n_then, _reach(held, len(token))[first] < then + n_then + SHINGLE - 1


def _hole_ends(holes: _Holes):
    """Rows ``doc_id, text, runs, held``: ``key`` of the shared run beside a hole with the token beyond it, ``doc_id``,
    ``code``, the token ``inside`` the hole next to the run, and whether any two runs around that hole are open."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs, held in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs"), batch.column("held")):
                token = tokens(text.as_py())
                if len(token) < holes.run:
                    continue
                code, *_, open_ = holes.of(token, runs, held)
                code, at = np.unique(code, return_inverse=True)
                some = np.bincount(at, open_, len(code)) > 0
                c, hole = holes.place(code)
                around, after = _with_edges(token, doc), hole > 0
                key = hashed(_rolled(token, holes.run)[c], 3) * _MULT[1] + token[np.where(after, c + holes.run + hole, c + hole - 1)] * _MULT[2] + after.astype(np.uint64)
                inside = around[np.where(after, c + holes.run + 1, c)]
                yield pa.RecordBatch.from_arrays([pa.array(hashed(key, 4).view(np.int64)), pa.array(np.full(len(c), doc, np.int64)), pa.array(code), pa.array(inside.view(np.int64)), pa.array(some)], ["key", "doc_id", "code", "inside", "open"])
        trim()

    return go


def _holed(holes: _Holes):
    """Rows ``doc_id, text, runs, held, beside``: ``key, doc_id, c, open`` of two runs around a hole, of the holes in
    ``beside`` and of whole runs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held_rows = [], 0
        for batch in batches:
            for doc, text, runs, held, beside in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs"), batch.column("held"), batch.column("beside")):
                token = tokens(text.as_py())
                if len(token) < holes.run:
                    continue
                codes = beside.values.to_numpy() if beside.is_valid else np.zeros(0, np.int64)
                _, first, then, n_first, n_then, open_ = holes.of(token, runs, held, codes)
                sums, up = _sums(token)
                key = (sums[first + n_first] - sums[first]) * up[first] * _MULT[1] + (sums[then + n_then] - sums[then]) * up[then] * _MULT[2] + n_first.astype(np.uint64)
                out.append((hashed(key, 4).view(np.int64), np.full(len(key), doc, np.int64), first.astype(np.int32), open_))
                held_rows += len(key)
                if held_rows > 1_000_000:
                    yield _first_covered(*map(np.concatenate, zip(*out)))
                    out, held_rows = [], 0
        if out:
            yield _first_covered(*map(np.concatenate, zip(*out)))
        trim()

    return go


def _holed_windows(source: DataFrame, asked: DataFrame, held: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows of ``_holed`` around the grams in ``asked`` (``doc_id, starts``): of their runs those that two
    documents share, open in one of them, and among these the ones after or before which the documents differ
    and, beyond a hole, have a token in common again."""
    size = min(GRAM, width)
    run = max((least_same(width, similarity) + 1) // 2, size)
    holes = _Holes(width, similarity, run)
    all_held = held.groupBy("doc_id").agg(F.flatten(F.collect_list("held")).alias("held"))
    wanted = settle(asked.join(all_held, "doc_id", "left"), "wanted")
    runs = settle(_texts_of(source, wanted).mapInArrow(_runs_around(width, run, size), "key bigint, doc_id bigint, c int, before bigint, after bigint, open boolean"), "runs", wanted)
    kinds = runs.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("open").alias("open"), (F.min("before") != F.max("before")).alias("opens"), (F.min("after") != F.max("after")).alias("ends"))
    own = runs.drop("open").join(kinds.where("a <> b and open").select("key", "opens", "ends"), "key").groupBy("doc_id").agg(F.collect_list(F.struct("c", "opens", "ends")).alias("runs"))  # bounded by a document
    parted = settle(own.where(F.exists("runs", lambda r: r.opens | r.ends)).join(all_held, "doc_id", "left"), "parted", runs)
    ends = settle(_texts_of(source, parted).mapInArrow(_hole_ends(holes), "key bigint, doc_id bigint, code bigint, inside bigint, open boolean"), "hole-ends")
    met = ends.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("open").alias("open"), (F.min("inside") != F.max("inside")).alias("parts")).where("a <> b and open and parts").select("key")
    beside = ends.join(met, "key", "left_semi").groupBy("doc_id").agg(F.collect_list("code").alias("beside"))  # bounded by a document
    around = settle(parted.join(beside, "doc_id", "left"), "beside", ends, parted)
    return _texts_of(source, around).mapInArrow(_holed(holes), "key bigint, doc_id bigint, c int, open boolean")


def _texts_of(source: DataFrame, asked: DataFrame) -> DataFrame:
    """The documents of a settled table of one row per id, with its columns; other texts stay where they lie."""
    ids = asked.select("doc_id")
    return source.join(F.broadcast(ids) if ids.count() <= ID_ROWS else ids, "doc_id", "left_semi").join(asked, "doc_id")


def _open_window_links(source: DataFrame, links: DataFrame, spans: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links as in ``window_links``, of every window of ``width`` equal tokens and of every one with a hole to
    the first document that holds all of it, where spans with the first document of a gram in it leave that open.

    Grams are looked at that two documents behind their first one hold, if windows around one of them
    are open. Their number goes with the ends of passages."""
    grams = links.where(F.col("key").bitwiseAND(F.lit(1)) == 1).select("key", "doc_id", "of", F.col("lo").alias("c"))
    held = spans.groupBy("doc_id", F.col("of_doc_id").alias("of")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("held"))  # bounded by a document
    around = width - min(GRAM, width)
    inside = F.exists("held", lambda s: (s.start_word <= F.greatest(F.col("c") - around, F.lit(0))) & (s.end_word >= F.col("c") + width + SHINGLE - 1))
    met = settle(grams.join(held, ["doc_id", "of"], "left").select("key", "doc_id", "of", "c", F.coalesce(inside, F.lit(False)).alias("inside")), "grams")
    keys = met.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("inside").alias("all_inside")).where("a <> b and not all_inside").select("key")
    starts = met.join(keys, "key", "left_semi").groupBy("doc_id", "of").agg(F.collect_set("c").alias("starts")).join(held, ["doc_id", "of"], "left")
    asked = settle(starts.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "held")).alias("asked")), "asked", met)  # bounded by a document
    whole = _texts_of(source, asked).mapInArrow(_windows_around(width), "key bigint, doc_id bigint, c int, open boolean")
    holed = _holed_windows(source, asked.select("doc_id", F.flatten("asked.starts").alias("starts")), held, width, similarity)
    rows = whole.unionAll(holed)
    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "c").mapInArrow(_open_links(width), "doc_id bigint, of bigint, lo int, hi int, shift int, key bigint")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after each."""
    if not spans:
        return text
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(min(a, len(starts) - 1), 0), min(b, len(starts) - 1)
        if starts[b] > at:
            out.append(text[at : max(at, starts[a])])
            at = starts[b]
    return "".join([*out, text[at:]])


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with every repeated passage cut but for its first document; columns stay as they are.

    ``n_chars`` is counted anew where the text changed. A document of which no word is left goes.
    """
    spans = settle(repeated_passages(docs, min_words, similarity).groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")), "spans")  # lists bounded by a document

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else cut_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(text, spans)], dtype=object)

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # no name can clash inside
    same, count = F.col("row.doc_id") == F.col("doc_id"), spans.count()
    if BROADCAST_ROWS < count <= ID_ROWS:
        # the ids are small where the spans may not be: texts that nothing is cut from stay where they lie
        ids = F.broadcast(spans.select(F.col("doc_id").alias("cut_id")))
        marked = rows.join(ids, F.col("row.doc_id") == F.col("cut_id"), "left")
        whole = marked.where("cut_id is null").select("row", F.lit(None).cast(T.LongType()).alias("doc_id"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
        met = marked.where("cut_id is not null").select("row").join(spans, same).select("row", "doc_id", "spans").unionAll(whole)
    else:
        met = rows.join(F.broadcast(spans) if count <= BROADCAST_ROWS else spans, same, "left")
    # only texts with spans travel to Python
    met = met.select("row", "spans", F.pandas_udf(cut, T.StringType())(F.when(F.col("spans").isNotNull(), F.col("row.text")), "spans").alias("rest"))
    changed = F.col("spans").isNotNull()
    new = {"text": F.when(changed, F.col("rest")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return met.where(~changed | F.col("rest").rlike(r"[^\x20\x09-\x0D]")).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
