"""Best-fit packing of token sequences: hierarchical residual packing.

Round 0 packs every partition on its own (best-fit decreasing); bins that are full but for a small
slack are emitted. The underfull bins of many partitions then meet as items of one partition of the
next round, are packed best-fit again, and so on up the tree. A bin travels with
the list of its pieces, at most one per token, so every row and every task is bounded, and no join
is needed to resolve nested bins. All rounds are written tables in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, trim
from .word_ids import word_ids

#: Items and pieces that one packing call holds at most.
CHUNK_ITEMS, CHUNK_PARTS = 40_000, 400_000

_PART = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = pa.schema([("closed", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("parts", pa.list_(_PART))])
_BINS_SQL = "closed boolean, sequence_id bigint, fill int, parts array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
_PIECES_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, in the order they were placed.

    Open bins are stacked by residual; a bit set of the residuals in use finds the tightest fit."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        need = sizes[i]
        fit = used >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                used &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= need
        if room:
            stacks[room].append(b)
            used |= 1 << room
    return bins


def _merge(fills: np.ndarray, parts: pa.ListArray, capacity: int, slack: int, first_id: int) -> pa.RecordBatch:
    """Pack items (fill and pieces each) into bins; a bin's pieces are those of its items in turn."""
    bins = best_fit(fills.tolist(), capacity)
    order = np.fromiter((i for b in bins for i in b), np.int64)
    taken = parts.take(pa.array(order))
    ends = np.cumsum(np.asarray(taken.value_lengths()))[np.cumsum([len(b) for b in bins]) - 1]
    total = np.add.reduceat(fills[order], np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), taken.flatten())
    return pa.RecordBatch.from_arrays([pa.array(total >= capacity - slack), pa.array(first_id + np.arange(len(bins)), pa.int64()), pa.array(total.astype(np.int32)), lists], schema=_BINS)


def _packer(capacity: int, slack: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = (level << 56) + (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []
        items = pieces = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, items, pieces
            if items:
                table = pa.Table.from_batches(held).combine_chunks()
                out = _merge(table["fill"].to_numpy().astype(np.int64), table["parts"].chunk(0), capacity, slack, next_id)
                next_id += out.num_rows
                held.clear()
                items = pieces = 0
                yield out

        for batch in batches:
            done = np.asarray(batch.column("closed"), bool)
            if done.any():  # full pieces of round 0
                out = batch.filter(pa.array(done)).set_column(1, _BINS.field(1), pa.array(next_id + np.arange(done.sum()), pa.int64()))
                next_id += out.num_rows
                yield out
                batch = batch.filter(pa.array(~done))
            at = 0
            counts = np.cumsum(np.asarray(batch.column("parts").value_lengths()))
            while at < batch.num_rows:
                base = counts[at - 1] if at else 0
                n = max(1, min(CHUNK_ITEMS - items, int(np.searchsorted(counts, base + CHUNK_PARTS - pieces, "right")) - at))
                n = min(n, batch.num_rows - at)
                held.append(batch.slice(at, n))
                items, pieces, at = items + n, pieces + int(counts[at + n - 1] - base), at + n
                if items >= CHUNK_ITEMS or pieces >= CHUNK_PARTS:
                    yield from flush()
        yield from flush()

    return run


def _cutter(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``doc_id, text``: one item per piece, the document's ids and ``end_id`` cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        whole, step = capacity, 4 * capacity
        for batch in batches:
            docs_of, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                doc, ids = doc.as_py(), own.text(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    docs_of.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            fills = np.array(length, np.int32)
            columns = [pa.array(docs_of, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(fills) + 1, dtype=np.int32)), pa.StructArray.from_arrays(columns, fields=list(_PART)))
            yield pa.RecordBatch.from_arrays([pa.array(fills == whole), pa.nulls(len(fills), pa.int64()), pa.array(fills), parts], schema=_BINS)
        trim()

    return run


def pack(source: DataFrame, capacity: int, slack: int | None = None, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Pack items (``closed``, ``sequence_id``, ``fill``, ``parts``) up the tree; one row per piece.

    ``cut`` makes items of the rows of ``source``, in the worker that packs them: a second ``mapInArrow`` in
    the stage would hold a second worker a task, and in time each of them the tables of ``cut``.
    A round's tasks hold ``CHUNK_ITEMS`` underfull bins each, so there are fewer and fewer of them;
    the last round has one, or saved nothing: bins are dealt anew in every round."""
    slack = max(1, capacity // 256) if slack is None else slack
    first = _packer(capacity, slack, 0)
    tables = [settle(source.mapInArrow(first if cut is None else lambda batches: first(cut(batches)), _BINS_SQL), "pack0")]
    open_bins = tables[0].where(~F.col("closed"))
    left = open_bins.count()
    while left > 1:
        parts, level = -(-left // CHUNK_ITEMS), len(tables)
        tables.append(settle(open_bins.repartition(parts).mapInArrow(_packer(capacity, slack, level), _BINS_SQL), f"pack{level}"))
        open_bins = tables[-1].where(~F.col("closed"))
        was, left = left, open_bins.count()
        if parts == 1 or left == was:
            break
    whole = tables[-1]
    for t in tables[:-1]:
        whole = whole.unionAll(t.where(F.col("closed")))
    return whole.mapInArrow(_pieces, _PIECES_SQL)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("parts")
        counts = np.asarray(lists.value_lengths())
        flat = lists.flatten()
        if not len(flat):
            continue
        length = np.asarray(flat.field("length"))
        ends = np.cumsum(length)
        firsts = np.cumsum(counts) - counts
        offset = ends - length - np.repeat((ends - length)[firsts], counts)
        fields = {f: flat.field(f) for f in ("doc_id", "piece", "start", "length", "ids_crc32")}
        fields |= {"sequence_id": pa.array(np.repeat(np.asarray(batch.column("sequence_id")), counts)), "offset": pa.array(offset)}
        yield pa.RecordBatch.from_pydict(fields)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is its ids (no special tokens added) and ``end_id``; only documents longer than
    ``capacity`` are cut, every ``capacity`` ids. Returns one row per piece: ``doc_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (gapless from 0 in a sequence).
    Null and empty texts give one piece of the end id alone; a null ``doc_id`` stays null; repeated
    rows are packed each on its own; ties of length keep the order of rows; an empty table gives no
    rows; other columns of any name are ignored.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return pack(source, capacity, cut=_cutter(path, capacity, end_id))
