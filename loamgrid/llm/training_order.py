"""Training-order materialisation: every token sequence gets a global slot, shards hold slots in order.

Texts are encoded, ended by an end id and cut into sequences. Sequences are numbered 0..N-1 by task
and place in the task; a keyed Feistel network over the next even power of two, walked on until it
falls below N, permutes the numbers, so any slot's sequence and any sequence's slot can be computed
from the key alone. Slots are dealt to shards by range; a task writes its shards front to back, each
record at ``HEADER + place * stride``, hence a reader resumes at any slot with one seek.

The count N must be known before the first slot, so texts are encoded twice (a count pass, then the
slots): cheaper at scale than holding all sequences on disk between the passes.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_path

LENGTH, SHARD_SLOTS, KEY = 512, 16_384, 0x5EED
ROUNDS = 6
#: Shards that a task writes at most, where there are more of them than shuffle partitions.
TASK_SHARDS = 8
MAGIC, HEADER = b"LGSEQ001", 64
#: Record: doc_id (minimum of int64 for null), piece, ids in use; then LENGTH ids of 16 bits.
_HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4")])
_NO_ID = -(1 << 63)
_ROWS_SQL = "slot bigint, shard bigint, doc_id bigint, piece int, ids binary"


class Permutation:
    """Keyed permutation of 0..n-1: balanced Feistel rounds with cycle-walking."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.array(x, np.uint64)
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> self.half, x[todo] & self.mask
            for k in self.keys[::-1] if back else self.keys:
                if back:
                    left, right = right ^ self._mix(left, k), left
                else:
                    left, right = right, left ^ self._mix(right, k)
            x[todo] = left << self.half | right
            todo = todo[x[todo] >= self.n]
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, back=False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, back=True)


#: White space in a row from which texts are cut before the library sees them.
LONG_RUN = 10_000
#: White space as the pattern knows it, which str.isspace() and ``re`` don't: no separators 1C to 1F.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What no pre-token crosses: a word with the space before it; white space but for the sign that
#: joins the next word or stands alone; that sign.
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_EDGE = re.compile(f"[{_WHITE}]")
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN}}}")
#: Fixed value: the pattern (that of the published rank files) whose pre-tokens are known to end before
#: a single space between words. With any other, texts go to the library whole.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoder(path: str, pattern: str):
    """Encoder of a tiktoken rank file and its first free id, which ends texts."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _LOADED[path]


class RankIds:
    """Ids of whole texts as 16-bit numbers."""

    def __init__(self, path: str, pattern: str):
        self.library, self.end = encoder(path, pattern)
        if self.end > 0xFFFF:
            raise ValueError(f"ids up to {self.end} do not fit 16 bits")
        self.spaced = pattern == SPACED_PATTERN

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of what ``_CHUNK`` finds; a run of white space is one pre-token, however long."""
        if _EDGE.match(chunk) and (chunk[0] != " " or len(chunk) == 1 or _EDGE.match(chunk, 1)):
            return self.library._core_bpe.encode_single_piece(chunk.encode())
        return self.library.encode_ordinary(chunk)

    def by_chunks(self, text: str) -> np.ndarray:
        return np.array([i for c in _CHUNK.findall(text) for i in self._chunk(c)], "<u2")

    def text(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and self.spaced and _RUN.search(text):  # beyond what the library's pattern bears
            return self.by_chunks(text)
        return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u2")  # it knows no special tokens


_IDS: dict[tuple[str, str], RankIds] = {}


def rank_ids(path: str, pattern: str) -> RankIds:
    if (path, pattern) not in _IDS:
        _IDS[path, pattern] = RankIds(path, pattern)
    return _IDS[path, pattern]


def sequences(texts: DataFrame, path: str, pattern: str, length: int, plan: tuple[list[int], int, int, int] | None) -> DataFrame:
    """Without ``plan`` the number of sequences per task; with it (offsets, n, key, slots of a shard) the sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_ids(path, pattern)
        part, count, last = TaskContext.get().partitionId(), 0, np.array([own.end], "<u2").tobytes()
        if plan is not None:
            offsets, n, key, shard_slots = plan
            order, limit = Permutation(n, key), offsets[part + 1] - offsets[part]

        def rows(docs: list, pieces: list, ids: list) -> pa.RecordBatch:
            if count > limit:
                raise RuntimeError("the input changed between the count and the write")
            slot = order.slot(offsets[part] + count - len(ids) + np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard_slots), pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(ids, pa.binary())], ["slot", "shard", "doc_id", "piece", "ids"])

        for batch in batches:
            docs, pieces, ids = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if plan is None:
                    count += -(-(len(own.text(text.as_py())) + 1) // length)
                    continue
                raw = own.text(text.as_py()).tobytes() + last
                for k, at in enumerate(range(0, len(raw), 2 * length)):
                    docs.append(doc)
                    pieces.append(k)
                    ids.append(raw[at : at + 2 * length])
                    count += 1
                if len(ids) >= 10_000:
                    yield rows(docs, pieces, ids)
                    docs, pieces, ids = [], [], []
            if ids:
                yield rows(docs, pieces, ids)
        if plan is None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int64())], ["part", "n"])
        elif count != limit:
            raise RuntimeError("the input changed between the count and the write")

    return texts.mapInArrow(run, "part int, n bigint" if plan is None else _ROWS_SQL)


def _writer(folder: str, length: int, shard_slots: int, n: int, key: int):
    stride = _HEAD.itemsize + 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        attempt, shard, sink, done, at = uuid.uuid4().hex, None, None, [], 0

        def close() -> None:
            if sink is not None:
                sink.close()
                if at != min(n, (shard + 1) * shard_slots):
                    raise RuntimeError(f"shard {shard} is not whole")
                files.move(f"{base}/.{attempt}", f"{base}/shard-{shard:08d}.bin")
                done.append((f"{folder}/shard-{shard:08d}.bin", shard * shard_slots, at - shard * shard_slots))

        record = np.dtype([*_HEAD.descr, ("ids", "<u2", (length,))])
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, shards = batch.column("slot").to_numpy(), batch.column("shard").to_numpy()
            rows = np.empty(len(slots), record)
            rows["doc_id"] = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            rows["piece"] = batch.column("piece").to_numpy()
            ids = batch.column("ids").to_pylist()
            rows["length"] = [len(x) // 2 for x in ids]
            rows["ids"] = np.frombuffer(b"".join([x.ljust(2 * length, b"\0") for x in ids]), "<u2").reshape(-1, length)
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for first, end in zip(cuts, cuts[1:]):
                if shards[first] != shard:
                    close()
                    shard = int(shards[first])
                    at = shard * shard_slots
                    sink = files.open_output_stream(f"{base}/.{attempt}", compression=None)
                    sink.write(MAGIC + struct.pack("<QQQQQ", stride, length, at, n, key) + b"\0" * (HEADER - 48))
                if (slots[first:end] != at + np.arange(end - first)).any():
                    raise RuntimeError(f"slots of shard {shard} are missing from {at} on")
                sink.write(rows[first:end].tobytes())
                at += end - first
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "first_slot", "records"])

    return run


def write_shards(docs: DataFrame, folder: str, path: str, pattern: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all sequences of ``docs`` as shards below ``folder``; returns the manifest.

    ``docs`` must give the same rows to the same tasks twice, as a table scan does; if it doesn't, the
    write fails and leaves no whole shard behind that the manifest would name."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = sequences(texts, path, pattern, length, None).collect()  # one number per task
    parts = max([r.part for r in counts], default=-1) + 1
    per_part = np.zeros(parts, np.int64)
    for r in counts:
        per_part[r.part] += r.n
    offsets = np.concatenate([[0], np.cumsum(per_part)]).tolist()
    n = offsets[-1]
    rows = sequences(texts, path, pattern, length, (offsets, n, key, shard_slots))
    # a task writes a range of shards; their number is known, so that no pass is spent on finding ranges
    shards = -(-n // shard_slots)
    tasks = max(1, min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK_SHARDS))))
    dealt = rows.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {max(1, shards)} as int)")).sortWithinPartitions("slot")
    return settle(dealt.mapInArrow(_writer(folder, length, shard_slots, n, key), "path string, first_slot bigint, records bigint"), "shards")


def read_shard(uri: str, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """``(first slot, records)`` blocks of a shard from place ``start`` on, read in sequence."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(uri)
    with files.open_input_file(base) as source:
        head = source.read(HEADER)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        stride, length, first, _, _ = struct.unpack("<QQQQQ", head[8:48])
        record = np.dtype([*_HEAD.descr, ("ids", "<u2", (length,))])
        source.seek(HEADER + start * stride)
        at = first + start
        while block := source.read(stride * max(1, (4 << 20) // stride)):
            rows = np.frombuffer(block, record)
            yield at, rows
            at += len(rows)


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per sequence in the shards: ``slot, doc_id, piece, length, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for at, rows in read_shard(path):
                    raw, size, start = rows.view(np.uint8).data, rows.dtype.itemsize, _HEAD.itemsize
                    crc = [zlib.crc32(raw[i : i + 2 * n]) for i, n in zip(range(start, len(raw), size), rows["length"].tolist())]
                    doc = rows["doc_id"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(rows))), pa.array(doc, mask=doc == _NO_ID), pa.array(rows["piece"].astype(np.int32)), pa.array(rows["length"].astype(np.int64)), pa.array(crc, pa.int64())], ["slot", "doc_id", "piece", "length", "ids_crc32"])

    count = manifest.count()
    return manifest.select("path").repartition(max(1, count)).mapInArrow(run, "slot bigint, doc_id bigint, piece int, length bigint, ids_crc32 bigint")


def training_order(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Materialise all documents in training order in the shared folder and read the shards back.

    Returns one row per sequence: ``slot`` (0..N-1, each once), ``doc_id``, ``piece`` (from 0),
    ``length`` (ids in use; the last piece ends with the end id), ``ids_crc32`` (unsigned, of the
    little-endian 16-bit ids). Null and empty texts are the end id alone; a null ``doc_id`` stays
    null; repeated rows are sequences of their own; an empty table gives no shard and no rows; other
    columns are ignored.
    """
    return read_shards(write_shards(docs, shared_path(docs.sparkSession, "training-order"), path, pattern))
