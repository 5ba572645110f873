"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into ``SEGMENTS`` consecutive segments on a ring. If two fingerprints differ in
at most t bits, some start segment has all its chains within proportional budgets: the first l
segments from there differ in at most floor(l * t / m) bits together, for every l. With t = 4 and
m = 5 that is 0, 1, 2, 3, 4 bits. The first two links are the bucket key (first segment equal,
second equal but for one masked bit); the third and fourth prune inside a bucket before the full
Hamming check. Buckets link their members by a spanning forest, never by all pairs; a large bucket of
unlike members is cut further by pieces of the remaining bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, settle, trim
from .components import components

BITS = 64
SEED = 42
_CHUNK = 65_536
#: Rows from which a bucket may be cut, and comparisons per row after which it is.
LARGE, WORK = 4_096, 512
#: Rows of a part of such a bucket up to which its rows are compared shift by shift.
_PART = 512
#: Ids from here on stand for fingerprints of which no document has an id to give; documents' ids are smaller.
UNNAMED = 1 << 62


def fingerprint(text: bytes, shingle: int) -> int:
    """A-Z lower-cased; words between ASCII white space; XXH64 of every shingle; bits set in over half."""
    words = text.lower().split()  # of bytes: both are ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed bigint) and ``carry`` (a bigint, if given) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(fps, pa.int64())], [*kept, "fp"])
        trim()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *([] if carry is None else [carry.alias("carry")]))
    return source.mapInArrow(run, "doc_id bigint, fp bigint" if carry is None else "doc_id bigint, carry bigint, fp bigint")


class Ring:
    """Segments of a fingerprint and what pigeonring asks of chains of them."""

    def __init__(self, max_distance: int, segments: int | None = None):
        m = self.m = segments or max_distance + 1
        self.max_distance = max_distance
        if m <= max_distance or 2 * max_distance // m > 1:
            raise ValueError("the key needs an equal first segment and at most one bit in the second")
        self.widths = [BITS // m + (i < BITS % m) for i in range(m)]
        self.offsets = np.cumsum([0, *self.widths[:-1]]).tolist()
        self.budgets = [(k + 1) * max_distance // m for k in range(m)]
        #: (start segment, masked bit of the second segment) of each table of keys
        self.tables = [(i, j) for i in range(m) for j in range(self.widths[(i + 1) % m])]

    def chain_mask(self, start: int, length: int) -> int:
        mask = 0
        for k in range(length):
            s = (start + k) % self.m
            mask |= ((1 << self.widths[s]) - 1) << self.offsets[s]
        return mask

    def keys(self, fp: str):
        """Array column of one bigint key per table: the two segments turned to the low bits, the
        masked bit cleared, the table's number above them."""
        out = []
        for t, (i, j) in enumerate(self.tables):
            o, w, v = self.offsets[i], self.widths[i], self.widths[(i + 1) % self.m]
            turned = F.col(fp) if not o else F.shiftrightunsigned(fp, o).bitwiseOR(F.shiftleft(fp, BITS - o))
            out.append(turned.bitwiseAND(F.lit(((1 << (w + v)) - 1) & ~(1 << (w + j)))).bitwiseOR(F.lit(t << 40)))
        return F.array(*out)

    def passing(self, start: int, x: np.ndarray) -> np.ndarray:
        """Which differences keep every chain from ``start`` within its budget."""
        ok = np.ones(len(x), bool)
        for length in range(3, self.m + 1):
            ok &= np.bitwise_count(x & np.uint64(self.chain_mask(start, length))) <= self.budgets[length - 1]
        return ok if self.m > 2 else np.bitwise_count(x) <= self.max_distance

    def forest(self, start: int, fps: np.ndarray, large: int = LARGE) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links that span each connected part of a bucket: whoever is reached leaves the rest, so a
        dense bucket costs about its size. A large one that has taken ``WORK`` comparisons a row goes
        on by ``cut`` with the parts not yet begun, which have no link to the finished ones."""
        found = []
        rest, budget = fps, WORK * len(fps)
        while len(rest) > 1:
            if budget < 0 and len(rest) > large and self.m > 2:  # with two segments no bits lie beyond the key
                return found + self.cut(start, rest)
            seeds, rest = [rest[0]], rest[1:]
            while seeds and len(rest):
                p = seeds.pop()
                budget -= len(rest)
                ok = self.passing(start, rest ^ p)
                if ok.any():
                    hits, rest = rest[ok], rest[~ok]
                    found.append((np.full(len(hits), p), hits))
                    seeds.extend(hits)
        return found

    def pieces(self, start: int) -> list[int]:
        """Masks of ``max_distance + 2`` pieces of the bits beyond the key; pairs that link are equal in two
        of them at least."""
        beyond = [o + i for k in range(2, self.m) for s in [(start + k) % self.m] for o in [self.offsets[s]] for i in range(self.widths[s])]
        return [sum(1 << int(b) for b in own) for own in np.array_split(beyond, self.max_distance + 2) if len(own)]

    def cut(self, start: int, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links that connect what ``forest`` would, from rows that are equal in two pieces. Rows
        already known to be connected are not compared again."""
        found = []
        label = np.arange(len(fps))  # points to a row of the same connected part
        for one, two in itertools.combinations(self.pieces(start), 2):
            key = fps & np.uint64(one | two)
            order = np.argsort(key, kind="stable")
            key = key[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(cuts, len(key)))
            for at, n in zip(cuts[size > _PART].tolist(), size[size > _PART].tolist()):
                found += self.forest(start, fps[order[at : at + n]], len(fps))
            left = np.repeat(np.append(cuts[1:], len(key)), size) - np.arange(len(key))  # rows from here to the part's end
            at = np.flatnonzero(np.repeat(size <= _PART, size))
            for shift in range(1, _PART):
                at = at[left[at] > shift]
                if not len(at):
                    break
                a, b = order[at], order[at + shift]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                ok = np.bitwise_count(fps[a] ^ fps[b]) <= self.max_distance
                a, b = a[ok], b[ok]
                ok = self.passing(start, fps[a] ^ fps[b])
                a, b = a[ok], b[ok]
                if len(a):
                    found.append((fps[a], fps[b]))
                    np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
                    while (label[label] != label).any():
                        label = label[label]
        return found


def _bucket_links(ring: Ring):
    """mapInArrow function over rows sorted by key: links within each run of equal keys."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(cuts, len(keys)))
        starts = np.array([i for i, _ in ring.tables])[keys[cuts] >> 40]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = cuts[size == 2]
        if len(pairs):
            a, b = fps[pairs], fps[pairs + 1]
            ok = np.zeros(len(pairs), bool)
            for s in range(ring.m):
                own = starts[size == 2] == s
                ok[own] = ring.passing(s, (a ^ b)[own])
            found.append((a[ok], b[ok]))
        for at, n, s in zip(cuts[size > 2].tolist(), size[size > 2].tolist(), starts[size > 2].tolist()):
            found += ring.forest(s, fps[at : at + n])
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the open bucket, and whole ones before it
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or (held and held[-1][0][-1] != key[0]):
                held.append((key[:cut], fp[:cut]))
                yield links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
        trim()

    return run


def near_links(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that connect all those within
    ``max_distance`` bits of each other, each bucket by a spanning forest."""
    ring = Ring(max_distance)
    keyed = nodes.select(F.explode(ring.keys("fp")).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    return keyed.mapInArrow(_bucket_links(ring), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents whose fingerprints differ in at most ``max_distance`` bits are linked;
    ``component_id`` is the smallest ``doc_id`` reachable. Texts of fewer words than a shingle hash
    their whole word sequence; texts without words and null texts have fingerprint zero, linked like
    any other. A null ``doc_id`` stays null and counts for no minimum (a component of nulls alone has
    a null id); repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    near = near_groups(docs, shingle, max_distance, id_col, text_col)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """``doc_id, fp, component_id``, the component's own ``group`` and what each row is to ``carry``."""
    docs_fp = settle(fingerprints(docs, shingle, id_col, text_col, carry), "fingerprints")
    # A fingerprint goes by its smallest document, so that roots are document ids at once. If one id is
    # the smallest of several fingerprints, all but the first of them go by a number of their own.
    least = settle(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    shared = least.where(F.col("least").isNotNull()).groupBy("least").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1").select("least", "first")
    own = F.col("fp").bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    named = F.col("least").isNotNull() & F.coalesce(F.col("first") == F.col("fp"), F.lit(True))
    nodes = settle(join_small(least, settle(shared, "shared"), ["least"], "fp").select("fp", "least", F.when(named, F.col("least")).otherwise(own).alias("node")), "fingerprint-nodes")
    pairs = near_links(nodes.select("fp"), max_distance)
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end)
    roots = components(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    rooted = nodes.join(roots, "node", "left").select("fp", "least", "node", F.coalesce("root", "node").alias("group"))
    other = settle(rooted.where((F.col("node") >= UNNAMED) & F.col("least").isNotNull()).groupBy("group").agg(F.min("least").alias("id")), "shared")
    found = F.least(F.when(F.col("group") < UNNAMED, F.col("group")), F.col("id"))
    rooted = join_small(rooted, other, ["group"], "fp").select("fp", "group", found.alias("component_id"))
    return docs_fp.join(rooted, "fp")


def keep_one(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that with the smallest ``doc_id`` and, of
    these, the smallest text hash.

    Groups are of texts: unlike texts under one ``doc_id`` are groups of their own. Columns stay as
    they are. Rows without ``doc_id`` can't be named and stay; null and empty texts are one group; of
    rows equal in id and text one stays, whatever their other columns hold; an empty table stays empty.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    near = near_groups(texts.where(F.col("doc_id").isNotNull()), shingle, max_distance, carry=F.xxhash64("text"))
    # a group's root names its id; ties under that id go by text hash
    kept = near.where("doc_id = component_id").groupBy("component_id", "group").agg(F.min("carry").alias("h")).select(F.col("component_id").alias("doc_id"), "h").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    met = rows.join(kept, ["doc_id", "h"], "left_semi")
    # repeats of one row lie together; whole texts are not ordered, the first that comes stays
    one = met.groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    return one.select("row.*").unionAll(docs.where(F.col("doc_id").isNull()).select(docs.columns))
